"""Daily index closes from public services, as canonical rows: the first source that answers is taken.

A download is a few thousand rows and is done once, on the driver; what is kept is a CSV file in a shared folder that ``read_csv`` reads like any other.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AdapterError
from .canonical import last_close

Fetch = Callable[[str], bytes]
# The services' addresses.
STOOQ = "https://stooq.com/q/d/l/?s={symbol}&i=d"
YAHOO = "https://query1.finance.yahoo.com/v8/finance/chart/{symbol}?period1={first}&period2={last}&interval=1d"


def fetched(url: str) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=30) as r:
        return r.read()


def stooq_closes(payload: bytes) -> list[tuple[str, float]]:
    """(date, close) of a CSV with a header that names Date and Close."""
    lines = payload.decode().strip().splitlines()
    head = [c.strip() for c in lines[0].split(",")] if lines else []
    if not {"Date", "Close"} <= set(head):
        raise AdapterError(f"no table of closes but {payload[:80]!r}")
    date, close = head.index("Date"), head.index("Close")
    rows = [x.split(",") for x in lines[1:]]
    return [(r[date], float(r[close])) for r in rows if len(r) > close and r[close] not in ("", "N/D")]


def yahoo_closes(payload: bytes) -> list[tuple[str, float]]:
    """(date, close) of a chart; the days are those of the exchange."""
    import datetime

    try:
        result = json.loads(payload)["chart"]["result"][0]
        zone = datetime.timezone(datetime.timedelta(seconds=result["meta"].get("gmtoffset", 0)))
        pairs = zip(result["timestamp"], result["indicators"]["quote"][0]["close"])
        return [(datetime.datetime.fromtimestamp(t, zone).date().isoformat(), float(c)) for t, c in pairs if c is not None]
    except (ValueError, KeyError, IndexError, TypeError) as e:
        raise AdapterError(f"no chart but {payload[:80]!r}") from e


def first_that_answers(sources: Iterable[tuple[str, Callable[[bytes], list[tuple[str, float]]]]], fetch: Fetch = fetched) -> list[tuple[str, float]]:
    """The closes of the first address that gives any; if none does, an error that says why of each."""
    said = []
    for url, parse in sources:
        try:
            if rows := parse(fetch(url)):
                return rows
            said.append(f"{url}: nothing")
        except (AdapterError, OSError) as e:
            said.append(f"{url}: {e}")
    raise AdapterError("; ".join(said))


def index_sources(stooq: str, yahoo: str, first: int = 0, last: int = 4_102_444_800) -> list[tuple[str, Callable[[bytes], list[tuple[str, float]]]]]:
    return [(STOOQ.format(symbol=quote(stooq)), stooq_closes), (YAHOO.format(symbol=quote(yahoo), first=first, last=last), yahoo_closes)]


def closes(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    """ds, y of (date, close) in the order of download: weekends dropped, of a repeated date the last."""
    df = spark.createDataFrame([(k, d, v) for k, (d, v) in enumerate(rows)], "seq long, d string, y double")
    return last_close(df.select("seq", F.col("d").cast("date").cast("timestamp_ntz").alias("ds"), "y"))


def write_closes(df: DataFrame, path: str) -> None:
    """A CSV of Date (03 Jul 1990) and Close in a new folder, one file in order of date."""
    out = df.repartition(1).sortWithinPartitions("ds").select(F.date_format(F.col("ds").cast("timestamp"), "dd MMM yyyy").alias("Date"), F.col("y").alias("Close"))
    out.write.option("header", True).csv(path)
