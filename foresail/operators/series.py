"""From canonical rows to dense series: parsing, calendar, data-quality rules, transforms of the target.

Each step is a DataFrame program keyed by unique_id; a series' windows are ordered by its dense position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SeriesConfig
from ..errors import BY_RULE

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
_PERIOD = {"monthly": "month", "quarterly": "quarter", "weekly": "week"}
#: strftime marks in Spark's pattern letters.
_STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def spark_pattern(strftime: str) -> str:
    out = strftime
    for k, v in _STRFTIME.items():
        out = out.replace(k, v)
    return out


def ordinal(ds: Column, freq: str) -> Column:
    """The number of a date's period: months, quarters or weeks (from Monday) since the epoch; days for trading days."""
    if freq == "monthly":
        return F.year(ds) * 12 + F.month(ds) - 1
    if freq == "quarterly":
        return F.year(ds) * 4 + F.quarter(ds) - 1
    days = F.datediff(ds.cast("date"), F.lit("1970-01-05").cast("date"))
    return F.floor(days / 7).cast("int") if freq == "weekly" else days


def period_label(period: Column, freq: str) -> Column:
    """A period's number as text: 2020-05, 2020Q2, a week's Monday and Sunday, a trading day's date."""
    if freq == "monthly":
        return F.when(period.isNotNull(), F.format_string("%04d-%02d", F.floor(period / 12), F.pmod(period, F.lit(12)) + 1))
    if freq == "quarterly":
        return F.when(period.isNotNull(), F.format_string("%04dQ%d", F.floor(period / 4), F.pmod(period, F.lit(4)) + 1))
    monday = F.lit("1970-01-05").cast("date")
    if freq == "weekly":
        first = F.date_add(monday, (period * 7).cast("int"))
        return F.concat(first.cast("string"), F.lit("/"), F.date_add(first, 6).cast("string"))
    return F.date_add(monday, period.cast("int")).cast("string")


def parsed(rows: DataFrame, config: SeriesConfig) -> DataFrame:
    """unique_id, ds, y from text, with the flags ds_null, ds_zone, ds_bad, ds_clock, y_bad and y_infinite."""
    text = F.col("ds").cast("string")
    stamp = F.try_to_timestamp(text, F.lit(spark_pattern(config.date_format))) if config.date_format else F.try_to_timestamp(text)
    ds = F.when(~text.rlike(OFFSET), stamp).cast("timestamp_ntz")
    number = F.trim(F.col("y").cast("string"))
    y = F.when(number.rlike(NUMBER), F.expr("try_cast(trim(cast(y as string)) as double)"))
    return rows.select(
        "unique_id", ds.alias("ds"), y.alias("y"), F.col("ds").isNull().alias("ds_null"), F.coalesce(text.rlike(OFFSET), F.lit(False)).alias("ds_zone"),
        (F.col("ds").isNotNull() & ~text.rlike(OFFSET) & ds.isNull()).alias("ds_bad"),
        F.coalesce(ds != F.date_trunc("day", ds).cast("timestamp_ntz"), F.lit(False)).alias("ds_clock"),
        (F.col("y").isNotNull() & (number != "") & y.isNull() & ~F.lower(number).rlike(r"^[+-]?inf(inity)?$")).alias("y_bad"),
        F.coalesce(F.lower(number).rlike(r"^[+-]?inf(inity)?$") | (F.abs(y) == float("inf")), F.lit(False)).alias("y_infinite"),
    )


def merged(rows: DataFrame, how: str) -> DataFrame:
    """One row a timestamp: duplicates summed (all null stays null) or averaged; with ``error`` they are left for the rules."""
    if how == "error":
        return rows
    agg = F.sum("y") if how == "sum" else F.avg("y")
    return rows.groupBy("unique_id", "ds").agg(agg.alias("y"))


def islands(rows: DataFrame, flag: Column, order: str = "pos") -> DataFrame:
    """unique_id, first, length of each run of rows for which ``flag`` holds."""
    by_series = Window.partitionBy("unique_id").orderBy(order)
    marked = rows.withColumn("_f", flag).withColumn("_g", F.row_number().over(by_series) - F.row_number().over(Window.partitionBy("unique_id", "_f").orderBy(order)))
    return marked.where("_f").groupBy("unique_id", "_g").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("length")).drop("_g")


def reindexed(rows: DataFrame, freq: str) -> DataFrame:
    """unique_id, pos, period, y on the full calendar from first to last period: gaps are null, nothing is filled. Trading days stay as they are."""
    with_period = rows.withColumn("period", ordinal(F.col("ds"), freq).cast("long"))
    if freq == "trading_days":
        dense = with_period.select("unique_id", "period", "y")
    else:
        span = with_period.groupBy("unique_id").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
        calendar = span.select("unique_id", F.explode(F.sequence("lo", "hi")).alias("period"))
        dense = calendar.join(with_period.select("unique_id", "period", "y"), ["unique_id", "period"], "left")
    pos = F.row_number().over(Window.partitionBy("unique_id").orderBy("period")) - 1
    return dense.select("unique_id", pos.cast("long").alias("pos"), "period", "y")


def step_counts(rows: DataFrame, freq: str) -> DataFrame:
    """unique_id, step: the commonest distance between periods (the smaller of a tie)."""
    by_series = Window.partitionBy("unique_id").orderBy("period")
    steps = rows.select("unique_id", ordinal(F.col("ds"), freq).cast("long").alias("period")).distinct()
    steps = steps.withColumn("step", F.col("period") - F.lag("period").over(by_series)).where("step IS NOT NULL")
    counts = steps.groupBy("unique_id", "step").count()
    return counts.groupBy("unique_id").agg(F.min_by("step", F.struct(-F.col("count"), F.col("step"))).alias("step"))


def trading_gaps(rows: DataFrame) -> DataFrame:
    """unique_id, weekdays, absent, longest: weekdays of the span, those without a row, and the longest run without a value."""
    days = rows.select("unique_id", F.col("ds").cast("date").alias("d"), "y")
    span = days.groupBy("unique_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    calendar = span.select("unique_id", F.explode(F.sequence("lo", "hi")).alias("d")).where(F.weekday("d") < 5)
    have = days.groupBy("unique_id", "d").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("v"))
    full = calendar.join(have, ["unique_id", "d"], "left")
    runs = islands(full, F.coalesce(F.col("v"), F.lit(0)) == 0, "d").groupBy("unique_id").agg(F.max("length").alias("longest"))
    totals = full.groupBy("unique_id").agg(F.count(F.lit(1)).alias("weekdays"), F.count_if(F.col("n").isNull()).alias("absent"))
    return totals.join(runs, "unique_id", "left").select("unique_id", "weekdays", "absent", F.coalesce("longest", F.lit(0)).alias("longest"))


def _weekday_number(d: Column) -> Column:
    """The number of a weekday among weekdays since Monday, 1970-01-05; a weekend's is that of the Friday before."""
    days = F.datediff(d.cast("date"), F.lit("1970-01-05").cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.weekday(d), F.lit(4))


def facts(rows: DataFrame, config: SeriesConfig) -> DataFrame:
    """One row a series with all that the rules look at, of canonical rows (text or typed).

    Timestamps are brought together once and each series is gone through once in order of time: gaps are
    distances between neighbours, so no calendar is written out.
    """
    p = parsed(rows, config)
    trading = config.freq == "trading_days"
    early = F.col("ds") < F.lit(config.start).cast("timestamp_ntz") if config.start else F.lit(False)
    flags = ("ds_null", "ds_zone", "ds_bad", "ds_clock", "y_bad", "y_infinite")
    y = {"sum": F.sum("y"), "mean": F.avg("y")}.get(config.duplicates, F.max("y"))
    one = p.groupBy("unique_id", "ds").agg(F.count(F.lit(1)).alias("n"), y.alias("y"), *[F.count_if(f).alias(f) for f in flags])
    one = one.withColumn("early", F.coalesce(early, F.lit(False))).withColumn("in", F.col("ds").isNotNull() & ~F.col("early"))
    at = _weekday_number(F.col("ds")) if trading else ordinal(F.col("ds"), config.freq)
    one = one.withColumn("at", F.when(F.col("in"), at.cast("long"))).withColumn("at_seen", F.when(F.col("y").isNotNull(), F.col("at")))
    before = Window.partitionBy("unique_id", "in").orderBy("ds").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("step", F.col("at") - F.max("at").over(before)).withColumn("blank", F.col("at_seen") - F.max("at_seen").over(before) - 1)
    inside = F.col("in")
    out = one.groupBy("unique_id").agg(
        *[F.sum(f).alias(f) for f in flags], F.sum(F.when(F.col("early"), F.col("n"))).alias("dropped"),
        F.count_if(inside & (F.col("n") > 1)).alias("repeated"), F.min(F.when(inside & (F.col("n") > 1), F.col("ds"))).alias("first_repeated"),
        F.count_if(inside).alias("stamps"), F.count("at_seen").alias("seen"), F.count_if(F.col("step") == 0).alias("finer"),
        F.mode(F.when(F.col("step") > 0, F.col("step")), True).alias("step"), F.min("at").alias("lo"), F.max("at").alias("hi"),
        F.min("at_seen").alias("lo_seen"), F.max("at_seen").alias("hi_seen"), F.max("blank").alias("blank"), F.count_if(inside & (F.weekday("ds") >= 5)).alias("weekend"),
        F.count_if(inside & (F.col("y") == 0)).alias("zeros"), F.count_if(inside & (F.col("y") < 0)).alias("negatives"), F.count_if(inside & (F.col("y") <= 0)).alias("low"),
    )
    span = F.col("hi") - F.col("lo") + 1
    # Runs without a value at either end count too; without any value the whole span is one.
    longest = F.coalesce(F.greatest(F.coalesce("blank", F.lit(0)), F.col("lo_seen") - F.col("lo"), F.col("hi") - F.col("hi_seen")), span, F.lit(0))
    rows_ = F.col("stamps") if trading else F.coalesce(span, F.lit(0))
    return out.select(
        "unique_id", *flags, F.coalesce("dropped", F.lit(0)).alias("dropped"), "repeated", "first_repeated", "stamps", "finer", "step", F.coalesce(span, F.lit(0)).alias("span"), "weekend",
        rows_.alias("rows"), "seen", longest.alias("longest"), "zeros", "negatives", "low",
    )


def violations(rows: DataFrame, config: SeriesConfig) -> DataFrame:
    """unique_id, rule_no, rule, detail: the first broken rule of each series, in the rules' order; sound series have no row."""
    trading = config.freq == "trading_days"
    found: list[Column] = []

    def rule(no: int, name: str, condition: Column, words: str, *numbers: Column) -> None:
        detail = F.concat_ws(" ", F.lit(words), *[n.cast("string") for n in numbers])
        found.append(F.when(condition, F.struct(F.lit(no).alias("rule_no"), F.lit(name).alias("rule"), detail.alias("detail"))))

    c = F.col
    clock = c("ds_clock") if trading else F.lit(0)
    rule(2, "timestamp", c("ds_null") + c("ds_zone") + c("ds_bad") + clock > 0, "rows that are empty, zoned, unreadable or timed:", c("ds_null"), c("ds_zone"), c("ds_bad"), clock)
    rule(3, "non_numeric_y", c("y_bad") + c("y_infinite") > 0, "rows:", c("y_bad") + c("y_infinite"))
    if config.duplicates == "error":
        rule(4, "duplicates", c("repeated") > 0, "timestamps that repeat, and the first:", c("repeated"), c("first_repeated"))
    if trading:
        absent = c("span") - c("stamps")
        rule(5, "trading_calendar", c("weekend") > 0, "weekend rows:", c("weekend"))
        rule(6, "irregular_frequency", absent > 0.15 * c("span"), "weekdays without a row:", absent)
        rule(7, "long_gap", c("longest") > 5, "longest closure:", c("longest"))
    else:
        rule(5, "irregular_frequency", c("finer") > 0, "periods with several rows:", c("finer"))
        rule(6, "irregular_frequency", (c("step") != 1) & (c("stamps") >= 3), "commonest step:", c("step"))
        rule(7, "long_gap", c("longest") > 2, "longest run of missing values:", c("longest"))
    missing = c("rows") - c("seen")
    rule(8, "missing_share", missing > 0.05 * c("rows"), "missing:", missing)
    rule(9, "zeros", c("zeros") > 0.3 * c("seen"), "zeros:", c("zeros"))
    if config.positive:
        rule(10, "negatives", c("negatives") > 0, "negative:", c("negatives"))
    if config.returns:
        rule(11, "non_positive_for_returns", c("low") > 0, "not positive:", c("low"))
    rule(12, "too_short", c("rows") - config.offset < config.least_rows, f"rows, of {config.least_rows + config.offset} at least:", c("rows"))
    return facts(rows, config).select("unique_id", F.coalesce(*found).alias("v")).where("v IS NOT NULL").select("unique_id", "v.*")


def warnings(rows: DataFrame, config: SeriesConfig) -> DataFrame:
    """unique_id, warning: what is left out or brought together without being an error."""
    extra = [x for x in rows.columns if x not in ("unique_id", "ds", "y")]
    said = [
        F.when(F.col("dropped") > 0, F.concat_ws(" ", F.lit(f"rows before {config.start} dropped:"), F.col("dropped").cast("string"))),
        F.when(F.col("repeated") > 0, F.concat_ws(" ", F.lit(f"timestamps that repeat, brought together by {config.duplicates}:"), F.col("repeated").cast("string"))) if config.duplicates != "error" else F.lit(None).cast("string"),
        F.lit(f"columns that are not used: {', '.join(extra)}" if extra else None).cast("string"),
    ]
    return facts(rows, config).select("unique_id", F.explode(F.array_compact(F.array(*said))).alias("warning"))


def validate(rows: DataFrame, config: SeriesConfig) -> DataFrame:
    """The dense series (unique_id, pos, period, y); the first broken rule of any series is raised as its typed error."""
    broken = violations(rows, config).orderBy("rule_no", "unique_id").first()
    if broken:
        raise BY_RULE[broken["rule"]](broken["unique_id"], broken["detail"])
    p = parsed(rows, config).where("ds IS NOT NULL")
    if config.start:
        p = p.where(F.col("ds") >= F.lit(config.start).cast("timestamp_ntz"))
    return reindexed(merged(p.select("unique_id", "ds", "y"), config.duplicates), config.freq)


def profile(dense: DataFrame) -> DataFrame:
    """One row a series: counts, span, gaps and shape of its values."""
    w = Window.partitionBy("unique_id").orderBy("pos")
    seen = F.when(F.col("y").isNotNull(), F.col("pos"))
    rows = dense.withColumn("_at", seen).withColumn("_before", F.max(seen).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_d", F.col("y") - F.lag("y").over(w))
    n, k = F.count(F.lit(1)), F.count("y")
    blank = F.col("_at") - F.coalesce("_before", F.lit(-1)) - 1
    return rows.groupBy("unique_id").agg(
        n.alias("n_rows"), k.alias("n_seen"), (n - k).alias("n_missing"), F.min("period").alias("first_period"),
        F.max("period").alias("last_period"), F.count_if(F.col("y") == 0).alias("n_zero"), F.count_if(F.col("y") < 0).alias("n_negative"), F.min("y").alias("y_min"),
        F.max("y").alias("y_max"), F.avg("y").alias("y_mean"), F.stddev_samp("y").alias("y_sd"), F.median("y").alias("y_median"),
        ((n - k) / n).alias("missing_share"), F.coalesce(F.greatest(F.max(blank), n - 1 - F.max("_at")), n).alias("longest_gap"), F.try_divide(F.count_if(F.col("y") == 0), k).alias("zero_share"),
        F.count_if(F.col("y") > 0).alias("n_positive"), F.skewness("y").alias("y_skewness"), F.kurtosis("y").alias("y_kurtosis"), F.percentile("y", F.lit(0.25)).alias("y_q25"), F.percentile("y", F.lit(0.75)).alias("y_q75"),
        F.min_by("y", "_at").alias("y_first"), F.max_by("y", "_at").alias("y_last"), F.avg(F.abs("_d")).alias("mean_step"),
    )


def data_hash(dense: DataFrame) -> DataFrame:
    """unique_id, data_hash: sha256 over periods and values in order."""
    item = F.concat_ws(":", F.col("period").cast("string"), F.coalesce(F.col("y").cast("string"), F.lit("")))
    rows = dense.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("t")))).alias("a"))
    return rows.select("unique_id", F.sha2(F.array_join(F.transform("a", lambda x: x["t"]), "\n"), 256).alias("data_hash"))


def interpolated(dense: DataFrame, keep: bool = False) -> DataFrame:
    """Column ``filled``: y, or the straight line by position between the observed neighbours; null before the first and after the last. ``keep`` leaves the neighbours' positions, _p0 and _p1.

    Forecasts start at observed positions only, so every value that such a slice holds lies between neighbours in the slice.
    """
    w = Window.partitionBy("unique_id").orderBy("pos")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("y").isNotNull(), F.col("pos"))
    rows = dense.withColumn("_p0", F.last(seen, True).over(back)).withColumn("_p1", F.first(seen, True).over(ahead))
    rows = rows.withColumn("_y0", F.last("y", True).over(back)).withColumn("_y1", F.first("y", True).over(ahead))
    line = F.expr("_y0 + (_y1 - _y0) * (pos - _p0) / nullif(_p1 - _p0, 0)")
    return rows.withColumn("filled", F.coalesce("y", line)).drop("_y0", "_y1", *([] if keep else ["_p0", "_p1"]))


def log_returns(dense: DataFrame) -> DataFrame:
    """Column ``r``: the difference of logs of neighbouring positive values."""
    w = Window.partitionBy("unique_id").orderBy("pos")
    return dense.withColumn("r", F.expr("ln(case when y > 0 then y end)") - F.lag(F.expr("ln(case when y > 0 then y end)")).over(w))


def outliers(dense: DataFrame, m: int, value: str = "y") -> DataFrame:
    """Column ``outlier``: further than 4 robust deviations from the median of the max(2m, 20) values before; the first ones never are."""
    width = max(2 * m, 20)
    w = Window.partitionBy("unique_id").orderBy("pos")
    rows = dense.withColumn("_a", F.collect_list(value).over(w.rowsBetween(-width, -1))).withColumn("_n", F.row_number().over(w))

    def median(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    rows = rows.withColumn("_m", median(F.col("_a")))
    rows = rows.withColumn("_d", median(F.transform("_a", lambda x: F.abs(x - F.col("_m")))) * 1.4826)
    enough = F.col("_n") > width if value == "y" else F.size("_a") == width
    flag = enough & (F.col("_d") > 0) & (F.abs(F.col(value) - F.col("_m")) > 4 * F.col("_d"))
    return rows.withColumn("outlier", F.coalesce(flag, F.lit(False))).drop("_a", "_n", "_m", "_d")


def auto_transform(dense: DataFrame, m: int) -> DataFrame:
    """unique_id, slope, n_blocks, transform: log if the spread of blocks grows with their mean by a power over 0.5.

    Blocks hold max(8, a season of 8 or more) values and end at the last one; spread is the deviation of first
    differences inside a block. Values that are not positive, or under three usable blocks, give none.
    """
    width = m if m >= 8 else 8
    last = Window.partitionBy("unique_id")
    rows = dense.withColumn("b", F.floor((F.max("pos").over(last) - F.col("pos")) / width))
    inside = Window.partitionBy("unique_id", "b").orderBy("pos")
    rows = rows.withColumn("d", F.col("y") - F.lag("y").over(inside))
    blocks = rows.groupBy("unique_id", "b").agg(F.avg("y").alias("mean"), F.stddev_samp("d").alias("sd"), F.count("y").alias("n"), F.min("y").alias("low"))
    usable = (F.col("n") == width) & (F.col("sd") > 0) & (F.col("mean") > 0)
    x, y = F.when(usable, F.log("mean")), F.when(usable, F.log("sd"))
    out = blocks.groupBy("unique_id").agg(F.regr_slope(y, x).alias("slope"), F.count_if(usable).alias("n_blocks"), F.min("low").alias("low"))
    log = (F.col("low") > 0) & (F.col("n_blocks") >= 3) & (F.col("slope") > 0.5)
    return out.select("unique_id", "slope", "n_blocks", F.when(log, "log").otherwise("none").alias("transform"))
