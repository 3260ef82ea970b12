"""Tables that a query writes once and reads several times, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ForesailError


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session may do without: a folder of one machine is made for it then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ForesailError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foresail-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its plan is cut, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foresail/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple[str, ...], tuple[str, T.StructType]] = {}


def kept_once(spark: SparkSession, key: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written on first use and read from there as long as the application lasts and its files are there."""
    at = (spark.sparkContext.applicationId, *key)
    if at in _KEPT:
        path, schema = _KEPT[at]
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return spark.read.schema(schema).parquet(path)
    df = make()
    path = f"{shared_folder(spark)}/foresail/{'-'.join(k.strip('/').replace('/', '_') for k in key)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT[at] = path, df.schema
    return spark.read.schema(df.schema).parquet(path)
