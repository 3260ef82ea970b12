"""Running scores over an append-only store: outcomes join forecasts as they arrive.

Forecasts and outcomes are streams with event times. A forecast waits for its outcome no longer than its
horizon and the allowed delay, so state is bounded; scores are windowed by the time of the outcome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def matched(forecasts: DataFrame, outcomes: DataFrame, delay: str = "7 days", horizon: str = "31 days") -> DataFrame:
    """Forecasts (unique_id, model, made_at, target_at, y_pred, lo, hi) with their outcome (unique_id, seen_at, y). Late rows of either side are dropped by the watermarks."""
    f = forecasts.withWatermark("made_at", delay).alias("f")
    o = outcomes.withWatermark("seen_at", delay).alias("o")
    when = (F.col("f.unique_id") == F.col("o.unique_id")) & (F.col("o.seen_at") == F.col("f.target_at"))
    within = (F.col("o.seen_at") >= F.col("f.made_at")) & (F.col("o.seen_at") <= F.col("f.made_at") + F.expr(f"interval {horizon}"))
    return f.join(o, when & within).select("f.unique_id", "f.model", "f.y_pred", "f.lo", "f.hi", "o.y", "o.seen_at")


def running_scores(rows: DataFrame, width: str = "7 days") -> DataFrame:
    """Mean absolute error and coverage by series, model and window of outcome time: sums only, so that each window is a handful of numbers."""
    error = F.abs(F.col("y") - F.col("y_pred"))
    inside = F.col("y").between(F.col("lo"), F.col("hi"))
    return rows.groupBy(F.window("seen_at", width), "unique_id", "model").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"), F.avg(inside.cast("double")).alias("coverage"))


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of (ts, event_type, value) in tumbling windows, closed by a watermark."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sink_states(path: str) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch`` in update mode: a batch's changed rows as files of its own, so that a batch that is run again replaces what it wrote."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_state(spark: SparkSession, path: str, schema: StructType, key: list[str]) -> DataFrame:
    """The last state of each key over all batches."""
    values = [f.name for f in schema if f.name not in key]
    rows = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*key, "v.*")
