"""The forecast store: an append-only Parquet table partitioned by buckets of series, window and role, with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..operators.backtest import store_schema

STATUS = ("ok", "failed", "skipped")
ORDER = ["unique_id", "window", "model", "origin_t", "h"]
PARTS = ["bucket", "window", "origin_role"]


def levels_of(columns: list[str]) -> tuple[float, ...]:
    return tuple(sorted(int(c[3:]) / 100 for c in columns if c.startswith("lo_") and c[3:].isdigit()))


class ForecastStore:
    """Rows can be added and read, never changed. Columns, their order and types, and the domain of status are checked before any write.

    Series share folders by a hash of their name, so that a panel of millions does not make millions of them; inside a file
    rows are sorted by series. ``buckets`` belongs to the stored table.
    """

    def __init__(self, spark: SparkSession, path: str, levels: tuple[float, ...] = (0.8, 0.95), buckets: int = 32):
        self.spark, self.path, self.levels, self.buckets = spark, path, levels, buckets
        self.schema = T.StructType.fromDDL(store_schema(levels))

    def conform(self, rows: DataFrame) -> DataFrame:
        """The store's columns in order; absent nullable ones are null. Unknown columns and bad status are errors."""
        if extra := set(rows.columns) - set(self.schema.names):
            raise SchemaError(f"unknown columns {', '.join(sorted(extra))}")
        if missing := {"unique_id", "window", "model", "origin_t", "h", "status"} - set(rows.columns):
            raise SchemaError(f"missing columns {', '.join(sorted(missing))}")
        have = set(rows.columns)
        out = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        if not out.where(~F.col("status").isin(*STATUS)).isEmpty():
            raise SchemaError("a status is none of " + ", ".join(STATUS))
        return out

    def _bucket(self, series: Column) -> Column:
        return F.pmod(F.xxhash64(series), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> None:
        out = self.conform(rows).withColumn("bucket", self._bucket(F.col("unique_id")))
        # A bucket's rows go to one task unless adaptive execution finds them too many.
        out.repartition(*PARTS).sortWithinPartitions(*PARTS, *ORDER).write.mode("append").partitionBy(*PARTS).parquet(self.path)

    def extend(self, other: ForecastStore) -> None:
        if other.levels != self.levels:
            raise SchemaError("stores of different levels")
        self.append(other.read())

    def read(self, *series: str) -> DataFrame:
        """All rows, or those of the named series, whose buckets alone are read. Window and role prune folders too, and status reaches the scan as a filter."""
        rows = self.spark.read.parquet(self.path)
        if set(rows.columns) != {*self.schema.names, "bucket"}:
            raise SchemaError(f"{self.path} holds other columns: {', '.join(sorted(set(rows.columns) ^ {*self.schema.names, 'bucket'}))}")
        if series:
            wanted = self.spark.range(1).select(F.explode(F.array(*[self._bucket(F.lit(x)) for x in series])).alias("b")).collect()
            rows = rows.where(F.col("bucket").isin(*{r["b"] for r in wanted}) & F.col("unique_id").isin(*series))
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def content_hash(self) -> str:
        """One number for all rows in any order; run times do not count, and doubles count to 9 digits."""
        parts = [F.round(c.name, 9) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in self.schema if c.name not in ("fit_seconds", "run_id")]
        found = self.read().select(F.xxhash64(*parts).alias("h")).agg(F.bit_xor("h").alias("x"), F.count(F.lit(1)).alias("n")).first()
        return f"{(found['x'] or 0) & (1 << 64) - 1:016x}-{found['n']}"
