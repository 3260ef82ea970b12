"""Quantile grids: calibration, conformal correction, threshold probabilities, tail risk and the registered decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import NORMAL, chi2_sf, norm_cdf
from .folds import tag


def grid(levels: tuple[float, ...]) -> tuple[Column, list[float]]:
    """The bounds of a store row as ascending quantiles, and their probabilities (12 digits)."""
    down, up = sorted(levels, reverse=True), sorted(levels)
    columns = [F.col(f"lo_{tag(x)}") for x in down] + [F.col(f"hi_{tag(x)}") for x in up]
    return F.array(*columns), [round((1 - x) / 2, 12) for x in down] + [round((1 + x) / 2, 12) for x in up]


def pinball_rows(rows: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """One row a quantile: tau and its loss."""
    quantiles, taus = grid(levels)
    each = rows.withColumn("q", F.explode(F.arrays_zip(F.array(*map(F.lit, taus)).alias("tau"), quantiles.alias("v"))))
    d = F.col("y_true") - F.col("q.v")
    return each.select("unique_id", "window", "model", "origin_t", "h", F.col("q.tau").alias("tau"), F.when(d >= 0, F.col("q.tau") * d).otherwise((F.col("q.tau") - 1) * d).alias("loss")).where("loss IS NOT NULL")


def pinball(rows: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    return pinball_rows(rows, levels).groupBy("unique_id", "window", "model", "h", "tau").agg(F.avg("loss").alias("pinball"))


def crps(rows: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Twice the integral of the mean quantile loss over the grid, by the trapezoid rule."""
    key = ["unique_id", "window", "model", "h"]
    by_tau = pinball(rows, levels)
    w = Window.partitionBy(*key).orderBy("tau")
    area = (F.col("tau") - F.lag("tau").over(w)) * (F.col("pinball") + F.lag("pinball").over(w)) / 2
    return by_tau.withColumn("a", area).groupBy(*key).agg((2 * F.sum("a")).alias("crps"))


def pit_bins(rows: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """unique_id, window, model, h, bin, n, expected: where the outcome falls between the quantiles. Bins that nothing falls into have n = 0."""
    quantiles, taus = grid(levels)
    key = ["unique_id", "window", "model", "h"]
    rows = rows.withColumn("_q", quantiles).where("forall(_q, x -> x IS NOT NULL)").withColumn("bin", F.size(F.filter("_q", lambda v: v <= F.col("y_true"))))
    counts = rows.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"))
    edges = [0.0, *taus, 1.0]
    shares = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(b - a).alias("expected")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    spine = counts.select(*key).distinct().withColumn("s", F.explode(shares)).select(*key, "s.bin", "s.expected")
    return spine.join(counts, [*key, "bin"], "left").select(*key, "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "expected")


def pit(rows: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Rows with ``pit``: the probability at the outcome, on straight lines between the quantiles, the outermost probability beyond them; null without a whole grid or with one that falls."""
    quantiles, taus = grid(levels)
    last = len(taus) - 1
    t = F.array(*map(F.lit, taus))
    out = rows.withColumn("_q", quantiles).withColumn("_i", F.size(F.filter("_q", lambda v: v <= F.col("y_true"))))
    sound = F.forall("_q", lambda v: v.isNotNull()) & F.forall(F.sequence(F.lit(1), F.lit(last)), lambda i: F.get("_q", i) >= F.get("_q", i - 1)) & F.col("y_true").isNotNull()
    i = F.col("_i")
    lo, hi = F.get("_q", i - 1), F.get("_q", i)
    inside = F.get(t, i - 1) + (F.get(t, i) - F.get(t, i - 1)) * F.try_divide(F.col("y_true") - lo, hi - lo)
    value = F.when(i == 0, taus[0]).when(i > last, taus[-1]).otherwise(inside)
    return out.withColumn("pit", F.when(sound, value)).drop("_q", "_i")


def calibration_table(rows: DataFrame, levels: tuple[float, ...], step: int) -> DataFrame:
    """One row a cell and level: coverage with its tests, the uniformity of the outcomes' probabilities, and the score of the grid. Ordered by series, window, model and horizon."""
    from .scoring import CELL, christoffersen, interval_metrics, interval_rows

    each = interval_rows(rows, levels)
    cover = interval_metrics(each, levels)
    apart = christoffersen(each, [*CELL, "level"], step).select(*CELL, "level", "ind_p", "cc_p", "clustered", "testable")
    even = pit_uniformity(pit_bins(rows, levels)).select(*CELL, F.col("p").alias("pit_p"))
    return cover.join(apart, [*CELL, "level"]).join(even, CELL, "left").join(crps(rows, levels), CELL, "left").orderBy(*CELL, "level")


def pit_uniformity(bins: DataFrame) -> DataFrame:
    """Pearson's statistic over the bins; null where the least expected count is under 5."""
    key = ["unique_id", "window", "model", "h"]
    total = F.sum("n").over(Window.partitionBy(*key))
    rows = bins.withColumn("_t", total).withColumn("_e", F.col("_t") * F.col("expected"))
    out = rows.groupBy(*key).agg(F.sum(F.pow(F.col("n") - F.col("_e"), 2) / F.col("_e")).alias("_x"), F.min("_e").alias("_m"), (F.count(F.lit(1)) - 1).cast("int").alias("df"))
    out = out.withColumn("chi2", F.when(F.col("_m") >= 5 - 1e-9, F.col("_x")))
    return out.select(*key, "chi2", "df", chi2_sf(F.col("chi2"), F.col("df")).alias("p"))


def conformal(
    rows: DataFrame, levels: tuple[float, ...], window: int = 60, least: int = 20, model_window: str | None = None, roles: tuple[str, ...] = ("dev", "test")
) -> DataFrame:
    """Rows with corrected bounds, ``conformal_n`` and ``conformal_q`` (of the largest level).

    Corrected are usable rows (status ok, with an outcome) of ``roles``, of one model window if it is named; all others keep their bounds, with
    conformal_n = 0. A row's history is the last ``window`` outcomes of usable rows of any role known at its origin: origins at most t - h. The correction is an
    order statistic of how far outcomes fell outside; with under ``least`` of them there is none.

    Each outcome becomes known at its origin plus its horizon; there it carries the last ``window`` scores up to it, and a
    row takes over what was carried last before it. All frames are bounded or carry one value, and all windows share one exchange.
    """
    key = ["unique_id", "window", "model", "h"]
    cell = Window.partitionBy(*key)
    usable = (F.col("status") == "ok") & ~F.col("y_true_missing")
    if model_window is not None:
        usable = usable & (F.col("window") == model_window)
    tags = [tag(x) for x in sorted(levels)]
    out = rows.withColumn("_u", F.coalesce(usable, F.lit(False)))
    for t in tags:
        out = out.withColumn(f"_s{t}", F.when(F.col("_u"), F.greatest(F.col(f"lo_{t}") - F.col("y_true"), F.col("y_true") - F.col(f"hi_{t}"))))
        latest = Window.partitionBy(*key, F.col(f"_s{t}").isNull()).orderBy("origin_t").rowsBetween(-(window - 1), 0)
        out = out.withColumn(f"_v{t}", F.when(F.col(f"_s{t}").isNotNull(), F.collect_list(f"_s{t}").over(latest)))
    known = F.struct((F.col("origin_t") + F.col("h")).alias("at"), F.lit(0).alias("kind"), *[F.col(f"_v{t}") for t in tags])
    asked = F.struct(F.col("origin_t").alias("at"), F.lit(1).alias("kind"), *[F.lit(None).cast("array<double>").alias(f"_v{t}") for t in tags])
    out = out.drop(*[f"_{c}{t}" for t in tags for c in ("s",)]).withColumn("_e", F.explode(F.array(known, asked))).drop(*[f"_v{t}" for t in tags])
    past = cell.orderBy("_e.at", "_e.kind").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_h{t}": F.last(F.col(f"_e._v{t}"), True).over(past) for t in tags}).where("_e.kind = 1").drop("_e")
    corrects = F.col("_u") & F.col("origin_role").isin(*roles)
    for level, t in zip(sorted(levels), tags):
        n = F.coalesce(F.size(f"_h{t}"), F.lit(0))
        rank = F.least(F.lit(1.0), F.try_divide(F.ceil((n + 1) * level), n))
        q = F.when(corrects & (n >= least), F.get(F.array_sort(f"_h{t}"), F.ceil(F.bround(rank * (n - 1), 9)).cast("int")))
        out = out.withColumn("conformal_q", q).withColumn("conformal_n", F.when(q.isNotNull(), n).otherwise(0).cast("long"))
        out = out.withColumn(f"lo_{t}", F.col(f"lo_{t}") - F.coalesce("conformal_q", F.lit(0.0))).withColumn(f"hi_{t}", F.col(f"hi_{t}") + F.coalesce("conformal_q", F.lit(0.0)))
    return monotone(out.drop("_u", *[f"_h{t}" for t in tags]).select(*rows.columns, "conformal_n", "conformal_q"), levels)


def monotone(rows: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Corrected bounds made to widen with the level: running least and largest from the innermost out."""
    done: list[str] = []
    out = rows
    for level in sorted(levels):
        done.append(tag(level))
        if len(done) > 1:
            fixed = F.col("conformal_n") > 0
            out = out.withColumn(f"lo_{done[-1]}", F.when(fixed, F.least(*[f"lo_{t}" for t in done])).otherwise(F.col(f"lo_{done[-1]}")))
            out = out.withColumn(f"hi_{done[-1]}", F.when(fixed, F.greatest(*[f"hi_{t}" for t in done])).otherwise(F.col(f"hi_{done[-1]}")))
    return out


def threshold_probabilities(rows: DataFrame, levels: tuple[float, ...], losses: list[float]) -> DataFrame:
    """One row a loss threshold: p_exceed of a simple loss of at least L, with its bracket and state.

    The distribution between quantiles is a straight line in normal scores. Outside the grid there is only a bound, and a grid that falls has no answer.
    """
    import math

    if any(x >= 1 for x in losses):
        raise ValueError("a simple loss is below 1")
    quantiles, taus = grid(levels)
    scores = [NORMAL.inv_cdf(t) for t in taus]
    k = len(taus)
    cuts = F.array(*[F.struct(F.lit(float(x)).alias("loss"), F.lit(math.log1p(-x)).alias("r")) for x in losses])
    out = rows.withColumn("_q", quantiles).withColumn("_c", F.explode(cuts)).withColumn("loss", F.col("_c.loss")).withColumn("_r", F.col("_c.r"))
    out = out.withColumn("_i", F.size(F.filter("_q", lambda v: v <= F.col("_r"))))
    falls = F.exists(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.get("_q", i) < F.get("_q", i - 1))
    state = F.when(F.exists("_q", lambda v: v.isNull()), "no_grid").when(falls, "crossed_grid").when((F.col("_r") < F.get("_q", F.lit(0))) | (F.col("_r") > F.get("_q", F.lit(k - 1))), "outside_grid").otherwise("ok")
    out = out.withColumn("state", state)
    seg = F.least(F.greatest(F.col("_i") - 1, F.lit(0)), F.lit(k - 2))
    z, t = F.array(*map(F.lit, scores)), F.array(*map(F.lit, taus))
    lo, hi = F.get("_q", seg), F.get("_q", seg + 1)
    share = F.when(hi > lo, (F.col("_r") - lo) / F.when(hi > lo, hi - lo)).otherwise(1.0)
    p = norm_cdf(F.get(z, seg) + share * (F.get(z, seg + 1) - F.get(z, seg)))
    ok, outside = F.col("state") == "ok", F.col("state") == "outside_grid"
    below = F.col("_r") < F.get("_q", F.lit(0))
    out = out.withColumn("p_exceed", F.when(ok, p))
    out = out.withColumn("p_lo", F.when(ok, F.get(t, seg)).when(outside, F.when(below, 0.0).otherwise(taus[-1]))).withColumn("p_hi", F.when(ok, F.get(t, seg + 1)).when(outside, F.when(below, taus[0]).otherwise(1.0)))
    return out.withColumn("realised", (F.col("y_true") <= F.col("_r"))).drop("_q", "_c", "_r", "_i")


def threshold_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("unique_id", "window", "model", "h", "loss").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "ok").alias("answered"), F.count_if(F.col("state") == "outside_grid").alias("outside"), F.count_if(F.col("state") == "crossed_grid").alias("crossed"),
        F.avg("p_exceed").alias("p_mean"), F.avg(F.when(F.col("state") == "ok", F.col("realised").cast("double"))).alias("realised"), F.count_if((F.col("state") == "outside_grid") & F.col("realised")).alias("outside_hits"),
    )


def simple_loss(r: Column) -> Column:
    return 1 - F.exp(r)


def risk_table(rows: DataFrame, levels: tuple[float, ...], step: int = 1) -> DataFrame:
    """Mean value at risk as a simple loss, worst outcome, breaches and the coverage test of the lower tail, by cell and level."""
    from .scoring import kupiec

    stacked = ", ".join(f"{level!r}D, lo_{tag(level)}" for level in levels)
    each = rows.selectExpr("unique_id", "window", "model", "h", "y_true", f"stack({len(levels)}, {stacked}) as (level, lo)").where("lo IS NOT NULL")
    breach = (F.col("y_true") <= F.col("lo")).cast("int")
    out = each.groupBy("unique_id", "window", "model", "h", "level").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(simple_loss(F.col("lo"))).alias("var_mean"), F.max(simple_loss(F.col("y_true"))).alias("worst"), F.sum(breach).cast("double").alias("breaches")
    )
    n_eff = F.col("n") / F.greatest(F.lit(1.0), F.col("h") / step)
    lr, p = kupiec(F.col("breaches") * n_eff / F.col("n"), n_eff, (1 - F.col("level")) / 2)
    return out.select("unique_id", "window", "model", "h", "level", F.col("n").cast("long").alias("n"), "var_mean", "worst", F.col("breaches").cast("long").alias("breaches"), lr.alias("kupiec_lr"), p.alias("kupiec_p"))


def gate_checks(calibration: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row a check of a calibration table (coverage, kupiec_p, ind_p, crps_ratio by cell): name, passed. A missing value fails, but for independence that is not testable."""
    names = {
        "coverage": F.col("coverage").between(limits["coverage_lo"], limits["coverage_hi"]),
        "kupiec": F.col("kupiec_p") >= limits["alpha"],
        "independence": F.when(F.col("ind_p").isNull(), F.lit(True)).otherwise(F.col("ind_p") >= limits["alpha"]),
        "crps": F.col("crps_ratio") < limits["crps_ratio"],
    }
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in names.items()])
    return calibration.withColumn("c", F.explode(rows)).select("unique_id", "window", "model", "h", "c.name", "c.passed")


def gate_decision(checks: DataFrame) -> DataFrame:
    """unique_id, window, model, n_checks, n_passed, go: every check has to pass, and there must be one."""
    return checks.groupBy("unique_id", "window", "model").agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("go"))
