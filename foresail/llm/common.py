"""Shared plumbing: scratch tables in the cluster's shared folder, and table reading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of every word rule here: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    ``spark.checkpoint.dir`` of the session decides. Only where it is unset in a local session, as in
    tests, a folder of our own is made and put into it; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foresail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, under the application's own name, so that ``sweep`` finds what it left."""
    return f"{shared_dir(spark)}/foresail/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once its results are read: those that a result is still read from cannot go earlier."""
    remove(spark, f"{shared_dir(spark)}/foresail/{spark.sparkContext.applicationId}")


def local_options(spark: SparkSession, path: str) -> dict[str, str]:
    """Options of a write to a folder of the machine: without Hadoop's checksum files beside the parts.

    Without its native library Hadoop starts a ``chmod`` process for every file and folder that it makes, so a part
    with a checksum takes three, and one without takes two. Another file system that the session sets stays.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    local = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).getUri().getScheme() == "file"
    if not local or conf.get("fs.file.impl"):
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def parted(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with whole-number ``keys`` that the planner takes for new columns.

    A join by them then deals the rows anew by a plain exchange, also where they come from an aggregate or a join by
    the same keys, so adaptive execution can split a hot key on the other side. Costs a shuffle, but no file.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0)) for k in keys})


def written(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again.

    The files outlive any executor, so a lost one costs only its running tasks.
    The returned frame carries its folder in ``_scratch`` for ``discard``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.options(**local_options(spark, path)).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def ship(spark: SparkSession) -> None:
    """Make a session ready for Python operators.

    Workers can import this package when only the driver's path holds it, and get texts in batches of 1,000 rows, as
    10,000 long ones take hundreds of MB on both sides; another number that the session sets stays.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    A text of ASCII only takes the fast built-in; for others ``lower`` would
    change letters such as 'É' too, so they are translated letter by letter.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
