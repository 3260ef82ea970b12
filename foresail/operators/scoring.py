"""Score tables of the forecast store: filters, selections, accuracy, paired tests, intervals, sub-periods. Nothing refits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LEVEL_BASELINES, RETURN_BASELINES
from ..functions.special import binomial_quantile, chi2_sf, norm_sf, t_cdf
from .folds import tag

CELL = ["unique_id", "window", "model", "h"]
BASELINES = tuple(sorted({*LEVEL_BASELINES, *RETURN_BASELINES}))


def usable(store: DataFrame, role: str) -> DataFrame:
    """Rows of a role that forecast and outcome both have."""
    return store.where((F.col("origin_role") == role) & (F.col("status") == "ok") & ~F.col("y_true_missing") & F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def scorable(store: DataFrame) -> DataFrame:
    return usable(store, "test")


def is_baseline(model: Column) -> Column:
    return model.isin(*BASELINES) | model.startswith("sma_")


def dev_mase(store: DataFrame) -> DataFrame:
    """unique_id, window, model, dev_mase: mean scaled error over all horizons of dev origins."""
    rows = usable(store, "dev").where("mase_scale > 0")
    return rows.groupBy("unique_id", "window", "model").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")) / F.col("mase_scale")).alias("dev_mase"))


def dev_selection(store: DataFrame) -> DataFrame:
    """unique_id, window, sma, reference, reference_mase, candidate: the moving average, baseline and candidate best on dev. Ties go to the shorter average and the first name."""
    scores = dev_mase(store)
    key = ["unique_id", "window"]
    span = F.regexp_extract("model", r"^sma_(\d+)$", 1)
    sma = scores.where(F.col("model").startswith("sma_")).groupBy(*key).agg(F.min_by("model", F.struct("dev_mase", span.cast("int"))).alias("sma"))
    marked = scores.join(sma, key, "left")
    base = marked.where(F.col("model").isin(*BASELINES) | (F.col("model") == F.col("sma")))
    base = base.groupBy(*key).agg(F.min_by("model", F.struct("dev_mase", "model")).alias("reference"), F.min("dev_mase").alias("reference_mase"))
    cand = scores.where(~is_baseline(F.col("model"))).groupBy(*key).agg(F.min_by("model", F.struct("dev_mase", "model")).alias("candidate"))
    return base.join(sma, key, "left").join(cand, key, "left").select(*key, "sma", "reference", "reference_mase", "candidate")


def candidate_ranking(store: DataFrame, interval: str = "lo_80") -> DataFrame:
    """unique_id, window, model, dev_mase, rank, has_intervals, chosen: candidates by their dev score, ties by name; the best and the best that has intervals are chosen."""
    key = ["unique_id", "window"]
    bounds = store.where("origin_role = 'dev' AND status = 'ok'").groupBy(*key, "model").agg(F.bool_or(F.col(interval).isNotNull()).alias("has_intervals"))
    rows = dev_mase(store).where(~is_baseline(F.col("model"))).join(bounds, [*key, "model"])
    order = Window.partitionBy(*key).orderBy("dev_mase", "model")
    rows = rows.withColumn("rank", F.row_number().over(order))
    first = F.min(F.when(F.col("has_intervals"), F.col("rank"))).over(Window.partitionBy(*key))
    return rows.withColumn("chosen", F.when(F.col("rank") == 1, "point").when(F.col("rank") == first, "intervals")).select(*key, "model", "dev_mase", "rank", "has_intervals", "chosen")


def latest_origin(rows: DataFrame) -> DataFrame:
    """The rows of each series, window and model at its last origin."""
    last = F.max("origin_t").over(Window.partitionBy("unique_id", "window", "model"))
    return rows.withColumn("_last", last).where("origin_t = _last").drop("_last")


def bucket_losses(rows: DataFrame, m: int, horizon: int) -> DataFrame:
    """unique_id, window, bucket, h_last, origin_t, model, loss: the mean absolute error over a bucket's horizons, at origins where every model of the bucket has all of them."""
    rows = rows.withColumn("bucket", bucket(F.col("h"), m, horizon))
    cell = ["unique_id", "window", "bucket"]
    each = rows.groupBy(*cell, "origin_t", "model").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("loss"), F.count(F.lit(1)).alias("_n"), F.max("h").alias("_h"))
    want = each.groupBy(*cell).agg(F.count_distinct("model").alias("_models"), F.max("_n").alias("_size"), F.max("_h").alias("h_last"))
    have = each.groupBy(*cell, "origin_t").agg(F.sum("_n").alias("_have"))
    full = have.join(want, cell).where(F.col("_have") == F.col("_models") * F.col("_size")).select(*cell, "origin_t", "h_last")
    return each.join(full, [*cell, "origin_t"]).select(*cell, F.col("h_last").cast("long").alias("h_last"), "origin_t", "model", "loss")


def sma_collapsed(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Moving averages but the chosen one dropped, and that one named ``sma``."""
    out = rows.join(selection.select("unique_id", "window", "sma"), ["unique_id", "window"], "left")
    out = out.where(~F.col("model").startswith("sma_") | (F.col("model") == F.col("sma")))
    return out.withColumn("model", F.when(F.col("model") == F.col("sma"), "sma").otherwise(F.col("model"))).drop("sma")


def point_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy by series, window, model and horizon. mase needs a positive scale in every row, mape positive outcomes in the whole series and window."""
    rows = rows.withColumn("low", F.min("y_true").over(Window.partitionBy("unique_id", "window")))
    e, y, p = F.col("y_true") - F.col("y_pred"), F.col("y_true"), F.col("y_pred")
    return rows.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.col("h")).alias("n_eff"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.when(F.min(F.coalesce("mase_scale", F.lit(0.0))) > 0, F.avg(F.abs(e) / F.when(F.col("mase_scale") > 0, F.col("mase_scale")))).alias("mase"),
        F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(y))).alias("wape"),
        (F.avg(F.coalesce(F.try_divide(2 * F.abs(e), F.abs(y) + F.abs(p)), F.lit(0.0))) * 100).alias("smape"),
        F.when(F.min("low") > 0, F.avg(F.try_divide(F.abs(e), F.abs(y))) * 100).alias("mape"),
    )


def return_metrics(rows: DataFrame) -> DataFrame:
    """Directional accuracy, the test of direction against chance, and errors against a forecast of zero and of the mean."""
    bench = rows.where("model = 'mean_return'").select("unique_id", "window", "origin_t", "h", F.col("y_pred").alias("_m"))
    rows = rows.join(bench, ["unique_id", "window", "origin_t", "h"], "left")
    y, p = F.col("y_true"), F.col("y_pred")
    up, guess = (y > 0).cast("double"), (p > 0).cast("double")
    out = rows.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.avg((up == guess).cast("double")).alias("dir_acc"), F.avg(up).alias("py"), F.avg(guess).alias("px"),
        F.try_divide(F.avg(F.abs(y - p)), F.avg(F.abs(y))).alias("mae_vs_zero"), F.sqrt(F.try_divide(F.avg((y - p) * (y - p)), F.avg(y * y))).alias("rmse_vs_zero"),
        (1 - F.try_divide(F.sum(F.when(F.col("_m").isNotNull(), (y - p) * (y - p))), F.sum((y - F.col("_m")) * (y - F.col("_m"))))).alias("r2_oos"),
    )
    n, py, px = F.col("n").cast("double"), F.col("py"), F.col("px")
    out = out.withColumn("ps", py * px + (1 - py) * (1 - px))
    var = F.col("ps") * (1 - F.col("ps")) / n - (
        F.pow(2 * py - 1, 2) * px * (1 - px) / n + F.pow(2 * px - 1, 2) * py * (1 - py) / n + 4 * py * px * (1 - py) * (1 - px) / (n * n)
    )
    out = out.withColumn("v", var)
    fine = (F.col("v") > 0) & ~px.isin(0.0, 1.0) & ~py.isin(0.0, 1.0)
    out = out.withColumn("pt_stat", F.when(fine, (F.col("dir_acc") - F.col("ps")) / F.sqrt(F.when(F.col("v") > 0, F.col("v")))))
    return out.withColumn("pt_p", norm_sf(F.col("pt_stat"))).drop("v", "ps", "py", "px")


def paired(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows with ``d_a`` and ``d_b``: absolute errors of each model and of the reference (unique_id, window, reference) on the origins that both have."""
    ref = rows.join(reference.select("unique_id", "window", "reference"), ["unique_id", "window"])
    own = ref.where(F.col("model") == F.col("reference")).select("unique_id", "window", "origin_t", "h", F.abs(F.col("y_true") - F.col("y_pred")).alias("d_b"))
    return ref.join(own, ["unique_id", "window", "origin_t", "h"]).withColumn("d_a", F.abs(F.col("y_true") - F.col("y_pred")))


def diebold_mariano(pairs: DataFrame, key: list[str], max_h: int, least: int = 5) -> DataFrame:
    """``key`` (with h), n, rel_mae, dm_stat, dm_p, dm_p_better of d = d_a - d_b.

    The long-run variance has lags 0 to h - 1; where it is not positive, lag 0 alone is used. Equal losses give 0 or an infinity. Under ``least`` h pairs the test is not made.
    """
    by_cell = Window.partitionBy(*key)
    rows = pairs.withColumn("d", F.col("d_a") - F.col("d_b")).withColumn("_c", F.col("d") - F.avg("d").over(by_cell))
    order = by_cell.orderBy("origin_t")
    lags = [F.sum(F.when(F.lit(k) < F.col("h"), F.col("_c") * F.col(f"_l{k}"))).alias(f"_g{k}") for k in range(1, max_h)]
    for k in range(1, max_h):
        rows = rows.withColumn(f"_l{k}", F.lag("_c", k).over(order))
    out = rows.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("d").alias("_m"), F.sum(F.col("_c") * F.col("_c")).alias("_g0"), *lags,
        F.try_divide(F.avg("d_a"), F.avg("d_b")).alias("rel_mae"), F.min("d").alias("_lo"), F.max("d").alias("_hi"),
    )
    n, h = F.col("n"), F.col("h").cast("double")
    zero = F.col("_g0") / n / n
    long = (F.col("_g0") + 2 * sum([F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) for k in range(1, max_h)], F.lit(0.0))) / n / n
    fallback = (long <= 0) & (h > 1)
    var, lag = F.when(fallback, zero).otherwise(long), F.when(fallback, 1.0).otherwise(h)
    scale = F.sqrt((n + 1 - 2 * lag + lag * (lag - 1) / n) / n)
    flat = F.when(F.col("_m") == 0, 0.0).otherwise(F.signum("_m") * float("inf"))
    stat = F.when((F.col("_lo") == F.col("_hi")) | (var <= 0), flat).otherwise(F.col("_m") / F.sqrt(F.when(var > 0, var)) * scale)
    out = out.withColumn("dm_stat", F.when((n >= least * h) & (n > h), stat)).withColumn("dm_p_better", t_cdf(F.col("dm_stat"), n - 1))
    out = out.withColumn("dm_p", F.least(F.lit(1.0), 2 * F.least("dm_p_better", 1 - F.col("dm_p_better"))))
    return out.select(*key, F.col("n").cast("long").alias("n"), "rel_mae", "dm_stat", "dm_p", "dm_p_better")


def holm(rows: DataFrame, p: str, family: list[str], out: str) -> DataFrame:
    """Column ``out``: step-down adjusted p-values in each family; null p-values are outside of it."""
    inside = Window.partitionBy(*family, F.col(p).isNull())
    order = inside.orderBy(p)
    k, i = F.count(F.lit(1)).over(inside), F.row_number().over(order)
    rows = rows.withColumn("_a", (k - i + 1) * F.col(p))
    running = F.max("_a").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("_a")


def interval_rows(store: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """One row a level, with lo, hi and the outcome flags, of rows that have both bounds."""
    stacked = ", ".join(f"{level!r}D, lo_{tag(level)}, hi_{tag(level)}" for level in levels)
    out = store.selectExpr("unique_id", "window", "model", "origin_t", "h", "y_true", f"stack({len(levels)}, {stacked}) as (level, lo, hi)")
    out = out.where("lo IS NOT NULL AND hi IS NOT NULL AND model <> 'combination'")
    return out.withColumn("miss", ((F.col("y_true") < F.col("lo")) | (F.col("y_true") > F.col("hi"))).cast("int"))


def kupiec(misses: Column, n: Column, p: Column) -> tuple[Column, Column]:
    """Likelihood ratio of unconditional coverage and its p-value; counts may be fractions."""
    def part(count: Column, of: Column) -> Column:
        return F.when(count == 0, 0.0).otherwise(count * F.log(F.when(of > 0, of)))

    share = misses / n
    lr = -2 * (part(n - misses, 1 - p) + part(misses, p) - part(n - misses, 1 - share) - part(misses, share))
    lr = F.greatest(F.lit(0.0), lr)
    return lr, chi2_sf(lr, 1)


def coverage_band(n_eff: Column, level: Column, levels: Sequence[float]) -> tuple[Column, Column]:
    """The central 95 % of coverages that as many independent trials as there are whole ones would have."""
    k = F.greatest(F.lit(1), F.floor(n_eff)).cast("int")
    lower = upper = F.lit(None).cast("double")
    for x in levels:
        lower = F.when(level == x, binomial_quantile(0.025, k, x) / k).otherwise(lower)
        upper = F.when(level == x, binomial_quantile(0.975, k, x) / k).otherwise(upper)
    return lower, upper


def interval_metrics(rows: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Coverage, its band, width, interval score and the coverage test by cell and level, with n / h for dependence."""
    y, lo, hi, a = F.col("y_true"), F.col("lo"), F.col("hi"), 1 - F.col("level")
    score = (hi - lo) + F.lit(2) / a * F.greatest(lo - y, F.lit(0.0)) + F.lit(2) / a * F.greatest(y - hi, F.lit(0.0))
    out = rows.groupBy(*CELL, "level").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(1 - F.col("miss")).alias("coverage"), F.sum("miss").cast("double").alias("misses"), F.avg(hi - lo).alias("width"), F.avg(score).alias("winkler")
    )
    out = out.withColumn("n_eff", F.col("n") / F.col("h"))
    lower, upper = coverage_band(F.col("n_eff"), F.col("level"), levels)
    lr, p = kupiec(F.col("misses") * F.col("n_eff") / F.col("n"), F.col("n_eff"), 1 - F.col("level"))
    return out.select(*CELL, "level", F.col("n").cast("long").alias("n"), "coverage", "width", "winkler", lower.alias("band_lo"), upper.alias("band_hi"), lr.alias("kupiec_lr"), p.alias("kupiec_p"))


def bucket(h: Column, m: int, horizon: int) -> Column:
    """The class of a horizon: 1, up to a quarter season, up to a season, and longer; without a season 1, up to 3, and longer."""
    if m == 1:
        return F.when(h == 1, "very_short").when(h <= 3, "short").otherwise("long")
    return F.when(h == 1, "very_short").when(h <= -(-m // 4), "short").when(h <= m, "medium").otherwise("long")


def interval_buckets(rows: DataFrame, m: int, horizon: int, levels: tuple[float, ...] = (0.8, 0.95)) -> DataFrame:
    """Coverage with its band and test, and width, by bucket of horizons; the effective count is the origins over the bucket's last horizon."""
    rows = rows.withColumn("bucket", bucket(F.col("h"), m, horizon))
    out = rows.groupBy("unique_id", "window", "model", "bucket", "level").agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct("origin_t") / F.max("h")).alias("n_eff"), F.avg(1 - F.col("miss")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"), F.avg("miss").alias("_share")
    )
    lower, upper = coverage_band(F.col("n_eff"), F.col("level"), levels)
    _, p = kupiec(F.col("_share") * F.col("n_eff"), F.col("n_eff"), 1 - F.col("level"))
    return out.withColumn("band_lo", lower).withColumn("band_hi", upper).withColumn("kupiec_p", p).drop("_share")


def christoffersen(rows: DataFrame, key: list[str], step: int | None = None) -> DataFrame:
    """Transitions of misses in order of origin, and the tests of independence and of conditional coverage (null under 30 rows or without variation).

    ``clustered``: misses follow misses more often than hits; false without both. With ``step``, the distance of origins, horizons beyond
    it are not ``testable``, as their windows overlap, and have no tests.
    """
    w = Window.partitionBy(*key).orderBy("origin_t")
    rows = rows.withColumn("_b", F.lag("miss").over(w))
    pairs = {f"n{a}{b}": F.count_if((F.col("_b") == a) & (F.col("miss") == b)).cast("double").alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)}
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("miss").cast("double").alias("misses"), F.max(1 - F.col("level")).alias("_p"), *pairs.values())
    n00, n01, n10, n11 = (F.col(k) for k in ("n00", "n01", "n10", "n11"))

    def part(count: Column, share: Column) -> Column:
        return F.when(count == 0, 0.0).otherwise(count * F.log(F.when(share > 0, share)))

    p0, p1 = F.try_divide(n01, n00 + n01), F.try_divide(n11, n10 + n11)
    p = F.try_divide(n01 + n11, n00 + n01 + n10 + n11)
    lr = -2 * (part(n00 + n10, 1 - p) + part(n01 + n11, p) - part(n00, 1 - p0) - part(n01, p0) - part(n10, 1 - p1) - part(n11, p1))
    testable = F.lit(True) if step is None else F.col("h") <= step
    lr = F.when(testable & (F.col("n") >= 30) & p0.isNotNull() & p1.isNotNull(), F.greatest(F.lit(0.0), lr))
    uc, _ = kupiec(F.col("misses"), F.col("n"), F.col("_p"))
    out = out.withColumn("lr_ind", lr).withColumn("lr_cc", F.col("lr_ind") + uc)
    return out.select(*key, "n00", "n01", "n10", "n11", "lr_ind", chi2_sf(F.col("lr_ind"), 1).alias("ind_p"), "lr_cc", chi2_sf(F.col("lr_cc"), 2).alias("cc_p"), F.coalesce(p1 > p0, F.lit(False)).alias("clustered"), testable.alias("testable"))


def window_gap(rows: DataFrame, max_h: int) -> DataFrame:
    """Rolling against expanding windows by series, model and horizon, on the origins both have, with Holm over each series both ways."""
    error = F.abs(F.col("y_true") - F.col("y_pred"))
    e = rows.where("window = 'expanding'").select("unique_id", "model", "h", "origin_t", error.alias("d_b"))
    r = rows.where("window = 'rolling'").select("unique_id", "model", "h", "origin_t", error.alias("d_a"))
    key = ["unique_id", "model", "h"]
    pairs = r.join(e, [*key, "origin_t"])
    means = pairs.groupBy(*key).agg(F.avg("d_b").alias("mae_expanding"), F.avg("d_a").alias("mae_rolling"))
    out = diebold_mariano(pairs, key, max_h).join(means, key).withColumn("p_expanding_better", 1 - F.col("dm_p_better"))
    out = holm(out, "dm_p_better", ["unique_id"], "p_rolling_better_holm")
    return holm(out, "p_expanding_better", ["unique_id"], "p_expanding_better_holm").withColumnsRenamed({"rel_mae": "ratio", "dm_p_better": "p_rolling_better"})


def subperiods(rows: DataFrame, reference: DataFrame, blocks: int = 4) -> DataFrame:
    """Relative error in consecutive, nearly equal blocks of the reference's origins."""
    pairs = paired(rows, reference)
    spine = pairs.where(F.col("model") == F.col("reference")).select("unique_id", "window", "h", "origin_t").distinct()
    spine = spine.withColumn("block", F.ntile(blocks).over(Window.partitionBy("unique_id", "window", "h").orderBy("origin_t")))
    joined = pairs.where(F.col("model") != F.col("reference")).join(spine, ["unique_id", "window", "h", "origin_t"])
    return joined.groupBy(*CELL, "block").agg(
        F.min("origin_t").alias("first_origin"), F.max("origin_t").alias("last_origin"), F.count(F.lit(1)).alias("n"), F.try_divide(F.avg("d_a"), F.avg("d_b")).alias("rel_mae")
    )


def h_star(skill: DataFrame, horizon: int) -> DataFrame:
    """unique_id, window, model, h_star: the last horizon before the first whose skill interval (column lo) is not above zero; null fails."""
    fails = F.when(~F.coalesce(F.col("lo") > 0, F.lit(False)), F.col("h"))
    return skill.groupBy("unique_id", "window", "model").agg(F.coalesce(F.min(fails) - 1, F.lit(horizon)).cast("long").alias("h_star"))


def failed_share(store: DataFrame, limit: float = 0.01) -> DataFrame:
    """window (null: all), n, failed, share (5 digits), passed."""
    out = store.groupingSets([[F.col("window")], []], F.col("window")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("failed"))
    return out.withColumn("share", F.bround(F.col("failed") / F.col("n"), 5)).withColumn("passed", F.col("failed") / F.col("n") <= limit)


def autocorrelation(rows: DataFrame, key: list[str], value: str, lags: int) -> DataFrame:
    """``key``, n, and Ljung-Box Q over ``lags`` with its p-value for the demeaned values in order of origin_t."""
    cell = Window.partitionBy(*key)
    rows = rows.withColumn("_c", F.col(value) - F.avg(value).over(cell))
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"_l{k}", F.lag("_c", k).over(cell.orderBy("origin_t")))
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_g0"), *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_g{k}") for k in range(1, lags + 1)])
    total = sum([F.pow(F.try_divide(F.col(f"_g{k}"), F.col("_g0")), 2) / F.when(F.col("n") > k, F.col("n") - k) for k in range(1, lags + 1)], F.lit(0.0))
    q = F.when((F.col("n") >= 2 * lags + 1) & (F.col("_g0") > 0), F.col("n") * (F.col("n") + 2) * total)
    return out.withColumn("lb_q", q).select(*key, F.col("n").cast("long").alias("n"), "lb_q", chi2_sf(F.col("lb_q"), lags).alias("lb_p"))


def arch_lm(rows: DataFrame, key: list[str], value: str, lags: int = 4) -> DataFrame:
    """Engle's test: (n - lags) times the fit of squares, not demeaned, on the ``lags`` squares before and a constant. Null under 2 lags + 1 values or where squares do not vary.

    The sums of the regression, over squares scaled by their mean, are aggregates, and its normal equations are solved by elimination in columns.
    """
    w = Window.partitionBy(*key).orderBy("origin_t")
    rows = rows.withColumn("_s", F.pow(F.col(value), 2))
    rows = rows.withColumn("_s", F.try_divide(F.col("_s"), F.avg("_s").over(Window.partitionBy(*key))))
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"_l{k}", F.lag("_s", k).over(w))
    columns = [*[f"_l{k}" for k in range(1, lags + 1)], "_s"]
    whole = F.col(f"_l{lags}").isNotNull()
    means = [F.avg(F.when(whole, F.col(c))).alias(f"m{c}") for c in columns]
    moments = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_all"), F.count_if(whole).cast("double").alias("_n"), (F.max("_s") - F.min("_s")).alias("_range"), *means)
    off = [F.col(c) - F.col(f"m{c}") for c in columns]
    upper = [(i, j) for i in range(lags + 1) for j in range(i, lags + 1)]
    keep = [*key, "_all", "_n", "_range"]
    out = rows.where(whole).join(moments, key).groupBy(*keep).agg(*[F.sum(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in upper]).withColumn("_total", F.col(f"c{lags}_{lags}"))
    # Elimination of one column after the other: the last entry becomes what the regression leaves unexplained.
    for k in range(lags):
        def share(i: int, k: int = k) -> Column:
            return F.when(F.col(f"c{k}_{k}") > 1e-10 * F.col("_n"), F.try_divide(f"c{k}_{i}", f"c{k}_{k}")).otherwise(0.0)

        out = out.select(*keep, "_total", *[(F.col(f"c{i}_{j}") - share(i) * F.col(f"c{k}_{j}")).alias(f"c{i}_{j}") for i, j in upper if i > k])
    runs = (F.col("_all") >= 2 * lags + 1) & (F.col("_range") > 0) & (F.col("_total") > 0)
    out = out.withColumn("arch_lm", F.when(runs, F.col("_n") * (1 - F.greatest(F.try_divide(f"c{lags}_{lags}", "_total"), F.lit(0.0)))))
    return out.select(*key, F.col("_n").cast("long").alias("n"), "arch_lm", chi2_sf(F.col("arch_lm"), lags).alias("arch_p"))


def residual_summary(tests: DataFrame) -> DataFrame:
    """unique_id, window, model and, of each residual test that ran, the number of folds, the share that rejects at 5 % and the median p-value."""
    each = []
    for test, name in (("lb_p", "lb"), ("lb_p_2m", "lb_2m"), ("arch_p", "arch")):
        p = F.col(test)
        each += [F.count(p).alias(f"n_{name}"), F.avg((p < 0.05).cast("double")).alias(f"{name}_reject_share"), F.median(p).alias(f"{name}_median_p")]
    return tests.groupBy("unique_id", "window", "model").agg(*each)


def transform_counts(folds: DataFrame) -> DataFrame:
    """Distinct folds by family of transform, their share, and the least and largest Box-Cox power."""
    folds = folds.dropDuplicates(["unique_id", "window", "model", "origin_t"])
    power = F.when(F.col("transform").startswith("boxcox("), F.expr("try_cast(regexp_extract(transform, '\\\\((-?[0-9.]+)\\\\)', 1) as double)"))
    family = F.when(F.col("transform").startswith("boxcox"), "boxcox").when(F.col("transform").startswith("none"), "none").otherwise(F.col("transform"))
    out = folds.groupBy("unique_id", family.alias("family")).agg(F.count(F.lit(1)).alias("n"), F.min(power).alias("power_min"), F.max(power).alias("power_max"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("unique_id")))
