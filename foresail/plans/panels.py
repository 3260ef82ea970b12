"""Panels of series made from business tables: monthly revenue by priority, daily prices by return flag, quarterly orders by customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SeriesConfig
from ..operators.series import reindexed

MONTHLY = SeriesConfig(id="revenue", H=6, m=12, initial_window=36, rolling_length=36, n_dev=20, n_test=30, models=("naive", "seasonal_naive", "drift", "sma"), sma_windows=(3, 6, 12))
DAILY = SeriesConfig(
    id="price", freq="trading_days", H=5, m=1, target="returns", initial_window=500, rolling_length=500, origin_step=5, n_dev=20, n_test=250,
    models=("zero_return", "last_return", "mean_return", "sma", "ewma"), sma_windows=(5, 20),
)
QUARTERLY = SeriesConfig(id="customers", freq="quarterly", H=2, m=4, initial_window=12, rolling_length=12, n_dev=3, n_test=4, models=("naive", "seasonal_naive", "drift"))
LEVELS = (0.8, 0.95)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def monthly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id, ds (first of the month), y in millions; the last month, which is not whole, is left out."""
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("unique_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ds"))
    rows = rows.agg(F.round(F.sum("o_totalprice") / 1e6, 8).alias("y"))
    last = rows.agg(F.max("ds").alias("last"))
    return rows.join(F.broadcast(last), F.col("ds") < F.col("last")).select("unique_id", "ds", "y")  # the right side is one row


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reindexed(monthly_rows(spark, sf_dir), "monthly")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where(F.weekday("l_shipdate") < 5)
    rows = rows.groupBy(F.col("l_returnflag").alias("unique_id"), F.col("l_shipdate").cast("date").cast("timestamp_ntz").alias("ds")).agg(F.round(F.sum("l_extendedprice") / 1e6, 8).alias("y"))
    return reindexed(rows, "trading_days")


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: orders of each customer by quarter, on each one's own span."""
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("unique_id"), F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("ds"))
    return reindexed(rows.agg(F.round(F.sum("o_totalprice") / 1e6, 8).alias("y")), "quarterly")
