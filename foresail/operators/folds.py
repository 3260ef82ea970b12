"""Origins, truth, and forecasts of the closed-form models, as window programs over dense series.

A fold is (series, window, origin). Its training slice is never materialised: what a
model needs of it is an aggregate over a frame that ends at the origin, so an expanding
window costs as much as a running sum. Only the truth column looks ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import SeriesConfig
from ..functions.special import z_value
from .series import period_label

KEYS = ["unique_id", "window", "model", "origin_t", "h"]


def tag(level: float) -> str:
    return f"{round(level * 100)}"


def origins(dense: DataFrame, config: SeriesConfig) -> DataFrame:
    """unique_id, origin_t, role, reduced. Origins step back from the last that leaves H values; the last n_test are test, n_dev before them dev.

    Where they do not fit, the first window is shortened as far as the floor, and after that dev and test shrink in proportion. Only lengths are looked at.
    """
    step, h, need = config.origin_step, config.H, config.n_dev + config.n_test

    def count(first_window: Column) -> Column:
        span = F.col("n") - 1 - h - (first_window - 1 + config.offset)
        return F.when(span < 0, 0).otherwise(F.floor(span / step) + 1)

    n = dense.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("c0", count(F.lit(config.initial_window))).withColumn("reduced", F.col("c0") < need)
    least = F.greatest(F.lit(config.floor_initial), F.col("n") - config.offset - h - step * (need - 1))
    n = n.withColumn("initial", F.when(F.col("reduced"), F.least(least, F.lit(config.initial_window))).otherwise(config.initial_window))
    n = n.withColumn("c", count(F.col("initial")).cast("long"))
    n = n.withColumn("test", F.when(F.col("c") < need, F.greatest(F.lit(1), F.bround(F.col("c") * config.n_test / need))).otherwise(config.n_test).cast("long"))
    n = n.withColumn("dev", F.when(F.col("c") < need, F.col("c") - F.col("test")).otherwise(config.n_dev).cast("long"))
    n = n.withColumn("test", F.when(F.col("dev") < 1, F.col("c") - 1).otherwise(F.col("test"))).withColumn("dev", F.greatest(F.col("dev"), F.lit(1)))
    n = n.where("c >= 2")
    each = n.select("unique_id", "reduced", "test", "dev", "n", F.explode(F.expr("sequence(0L, c - 1)")).alias("j"))
    role = F.when(F.col("j") < F.col("test"), "test").when(F.col("j") < F.col("test") + F.col("dev"), "dev").otherwise("warmup")
    return each.select("unique_id", (F.col("n") - 1 - h - step * F.col("j")).alias("origin_t"), role.alias("role"), "reduced")


def truth(dense: DataFrame, config: SeriesConfig) -> DataFrame:
    """unique_id, origin_t, h, y_true, level_true, origin_period, target_period of every position and horizon: the value ahead, or the return one step or h steps ahead."""
    w = Window.partitionBy("unique_id").orderBy("pos")
    ahead = dense.withColumn("a", F.collect_list(F.struct("y", "period")).over(w.rowsBetween(1, config.H)))
    rows = ahead.select("unique_id", F.col("pos").alias("origin_t"), F.col("y").alias("p"), F.col("period").alias("at"), "a", F.explode(F.sequence(F.lit(1), F.lit(config.H))).alias("h"))
    at, before = F.get("a", F.col("h") - 1)["y"], F.when(F.col("h") == 1, F.col("p")).otherwise(F.get("a", F.col("h") - 2)["y"])
    positive = lambda c: F.log(F.when(c > 0, c))
    if config.target == "level":
        y = at
    else:
        y = positive(at) - positive(before if config.target == "returns" else F.col("p"))
    return rows.select("unique_id", "origin_t", F.col("h").cast("long").alias("h"), y.alias("y_true"), at.alias("level_true"), period_label(F.col("at"), config.freq).alias("origin_period"), period_label(F.get("a", F.col("h") - 1)["period"], config.freq).alias("target_period"))


def fold_facts(dense: DataFrame, config: SeriesConfig) -> DataFrame:
    """One row a series, window and position t: what the closed-form models need of the slice that ends at t.

    ``z`` is the value, or the return of a return target, on straight lines between the values seen. A slice starts at the first
    value seen in it: what lies on a line that comes from before a rolling window is left out. Columns: n, z_t, z_1, means of z and of its square,
    its deviation, sums of squares of its first and seasonal differences, mase_scale, recent values (newest last), the moving
    averages, the outliers inside the slice and, if asked for, the ewma variance. At a position without a value n is the window's length.
    """
    from .series import interpolated, outliers

    m, length, off = config.m, config.rolling_length, config.offset
    w = Window.partitionBy("unique_id").orderBy("pos")
    rows = interpolated(dense, keep=True)
    if config.returns:
        log = F.expr("ln(case when filled > 0 then filled end)")
        rows = rows.withColumn("z", log - F.lag(log).over(w))
    else:
        rows = rows.withColumn("z", F.col("filled"))
    rows = rows.select("unique_id", "pos", "y", "z", "_p0", "_p1")
    rows = rows.withColumn("d", F.col("z") - F.lag("z").over(w)).withColumn("s", F.col("z") - F.lag("z", m).over(w))
    past = max(2 * m, 20)  # the first values of a slice are never outliers
    rows = outliers(rows, m, "z").withColumn("outlier", F.col("outlier").cast("long"))
    if "ewma" in config.models:
        rows = decayed(rows)
    if "rolling" in config.windows:
        rows = _gap_ends(rows, w, m, off, past)
    out = None
    for window in config.windows:
        expanding = window == "expanding"
        start = Window.unboundedPreceding if expanding else -(length - 1)
        whole = w.rowsBetween(start, 0)
        steps = w.rowsBetween(start if expanding else min(0, start + 1), 0)
        seasons = w.rowsBetween(start if expanding else min(0, start + m), 0)
        square = lambda c: F.col(c) * F.col(c)
        sums = {
            "n": F.count("z").over(whole), "z": F.sum("z").over(whole), "z2": F.sum(square("z")).over(whole), "d2": F.sum(square("d")).over(steps), "nd": F.count("d").over(steps),
            "s2": F.sum(square("s")).over(seasons), "sa": F.sum(F.abs("s")).over(seasons), "ns": F.count("s").over(seasons), "o": _outliers_inside(w, start, past),
            "sd": F.stddev_samp("z").over(whole), "raw": F.count(F.lit(1)).over(w.rowsBetween(start if expanding else start - off, 0)),
        }
        cut = {k: F.lit(0.0) if expanding else F.coalesce(F.lag(f"_x_{k}", length - 1 + off).over(w), F.lit(0.0)) for k in ("n", "z", "z2", "d2", "s2", "sa", "o", "e")}
        facts = rows.select(
            "unique_id", F.lit(window).alias("window"), F.col("pos").alias("origin_t"), "y", F.col("z").alias("z_t"), F.first(F.when(F.col("y").isNotNull(), F.col("z")), True).over(whole).alias("z_1"),
            *[v.alias(f"s_{k}") for k, v in sums.items()], *[v.alias(f"c_{k}") for k, v in cut.items()], F.collect_list("z").over(w.rowsBetween(-(m - 1), 0)).alias("recent"),
            *([x.alias(k) for k, x in _ewma_parts(w, window, length).items()] if "ewma" in config.models else []),
            *[F.when(F.count("z").over(w.rowsBetween(-(k - 1), 0)) == k, F.avg("z").over(w.rowsBetween(-(k - 1), 0))).alias(f"sma_{k}") for k in config.sma_windows],
        )
        out = facts if out is None else out.unionByName(facts)
    seen = F.col("y").isNotNull() & F.col("z_t").isNotNull()
    n = F.col("s_n") - F.col("c_n")
    out = out.withColumn("n", F.when(seen, n).otherwise(F.col("s_raw")).cast("long"))
    mean, ns = F.try_divide(F.col("s_z") - F.col("c_z"), n), F.when(n - m > 0, F.col("s_ns") - F.col("c_n")).otherwise(0.0)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("s_z2") - F.col("c_z2") - n * mean * mean, n - 1)))
    lost = F.col("c_n") > 0  # only then are sums corrected, so others stay as exact as the frames give them
    return out.select(
        "unique_id", "window", "origin_t", "y", "z_t", "n", "z_1", mean.alias("mean_z"), F.try_divide(F.col("s_z2") - F.col("c_z2"), n).alias("mean_z2"),
        F.when(lost, F.when(n > 1, spread)).otherwise(F.col("s_sd")).alias("sd_z"), F.greatest(F.col("s_d2") - F.col("c_d2"), F.lit(0.0)).alias("sum_d2"), (F.col("s_nd") - F.col("c_n")).alias("n_d"),
        F.when(ns > 0, F.greatest(F.col("s_s2") - F.col("c_s2"), F.lit(0.0))).alias("sum_s2"), ns.alias("n_s"), F.when(seen, F.try_divide(F.col("s_sa") - F.col("c_sa"), F.when(ns > 0, ns))).alias("mase_scale"),
        "recent", F.when(seen & (n > past), (F.col("s_o") - F.col("c_o")).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_outliers"),
        *([_ewma_variance(n, F.try_divide(F.col("s_z2") - F.col("c_z2"), n)).alias("ewma_variance")] if "ewma" in config.models else []), *[f"sma_{k}" for k in config.sma_windows],
    )


def _gap_ends(rows: DataFrame, w: WindowSpec, m: int, off: int, past: int) -> DataFrame:
    """Columns _x_*: at each filled position, sums over the rest of its gap.

    A rolling window that starts at a filled position holds, before its first value seen, just that rest; what it adds to the window's sums
    (of z, differences that reach back into it, and outliers counted from it) is known there and taken off again.
    """
    def ahead(c: str, k: int) -> Column:
        return F.lead(c, k).over(w) if k else F.col(c)

    z, d, s = ahead("z", off), ahead("d", 1 + off), ahead("s", m + off)
    terms = {
        "n": F.when(z.isNotNull(), 1.0), "z": z, "z2": z * z, "d2": d * d, "s2": s * s, "sa": F.abs(s), "o": ahead("outlier", past + off).cast("double"),
        "e": z * z * F.pow(F.lit(DECAY), F.col("_p1") - F.col("pos") - 1),
    }
    rows = rows.withColumns({f"_t_{k}": v for k, v in terms.items()})
    gap = F.col("y").isNull() & F.col("_p0").isNotNull() & F.col("_p1").isNotNull()
    rest = Window.partitionBy("unique_id", "_p0").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_x_{k}": F.when(gap, F.sum(F.when(gap, F.col(f"_t_{k}"))).over(rest)) for k in terms})
    return rows.drop(*[f"_t_{k}" for k in terms])


def _models(config: SeriesConfig) -> list[tuple[str, Column, Column, int]]:
    """(name, mean, deviation at h, least n) of the closed-form models asked for; a null deviation means no interval."""
    h, n, m = F.col("h"), F.col("n"), config.m
    root = lambda c: F.sqrt(F.when(c >= 0, c))
    k = F.floor((h - 1) / m)
    one = F.expr("sqrt(sum_d2 / nullif(n_d, 0))")
    slope = F.expr("(z_t - z_1) / nullif(n - 1, 0)")
    spread = F.sqrt(F.expr("greatest(sum_d2 - (n - 1) * pow((z_t - z_1) / nullif(n - 1, 0), 2), 0D) / nullif(n_d - 1, 0)"))
    known = {
        "naive": (F.col("z_t"), one * F.sqrt(h), 2),
        "last_return": (F.col("z_t"), one * F.sqrt(h), 2),
        "seasonal_naive": (F.get("recent", (F.size("recent") - (m * (k + 1) - h) - 1).cast("int")), F.expr("sqrt(sum_s2 / nullif(n_s, 0))") * F.sqrt(k + 1), m + 1),
        "drift": (F.col("z_t") + h * slope, spread * F.sqrt(h * (1 + h / (n - 1))), 3),
        "zero_return": (F.lit(0.0), root(F.col("mean_z2")), 1),
        "mean_return": (F.col("mean_z"), F.expr("sd_z * sqrt(1 + 1D / n)"), 3),
    }
    out = [(name, *known[name]) for name in config.models if name in known]
    if "sma" in config.models:
        out += [(f"sma_{w}", F.col(f"sma_{w}"), F.lit(None).cast("double"), w) for w in config.sma_windows]
    if "ewma" in config.models:
        out.append(("ewma", F.lit(0.0), F.sqrt("ewma_variance"), 2))
    return out


def _outliers_inside(w: WindowSpec, start: int, past: int) -> Column:
    """Outliers of the slice that ends at a row: those that have ``past`` values of the slice before them."""
    if start == Window.unboundedPreceding:
        return F.coalesce(F.sum("outlier").over(w.rowsBetween(start, 0)), F.lit(0).cast("long"))
    if start + past > 0:
        return F.lit(0).cast("long")
    return F.coalesce(F.sum("outlier").over(w.rowsBetween(start + past, 0)), F.lit(0).cast("long"))


DECAY, RUN = 0.94, 512


def decayed(rows: DataFrame) -> DataFrame:
    """Columns ``seen`` (values so far) and ``decayed``: the sum of the squares of z so far, each weighted by DECAY to the number of values after it.

    A running sum inside runs of RUN values, rescaled to each row, with the total of the run before; what is older
    weighs under DECAY ** RUN, 2e-14. So each row costs the same however long its series is.
    """
    w = Window.partitionBy("unique_id").orderBy("pos")
    rows = rows.withColumn("seen", F.count("z").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_run", F.floor(F.col("seen") / RUN)).withColumn("_at", F.pmod("seen", F.lit(RUN)).cast("double"))
    inside = Window.partitionBy("unique_id", "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.sum(F.coalesce(F.col("z") * F.col("z"), F.lit(0.0)) * F.pow(F.lit(1 / DECAY), F.col("_at"))).over(inside)
    rows = rows.withColumn("_own", grown * F.pow(F.lit(DECAY), F.col("_at")))
    before = F.max_by("_own", "pos").over(Window.partitionBy("unique_id").orderBy("_run").rangeBetween(-1, -1))
    total = F.col("_own") + F.coalesce(before, F.lit(0.0)) * F.pow(F.lit(DECAY), F.col("_at") + 1)
    return rows.withColumn("decayed", total).drop("_run", "_at", "_own")


def _ewma_parts(w: WindowSpec, window: str, length: int) -> dict[str, Column]:
    """What ``decayed`` gives at the row and, for a rolling window, at the row before it."""
    if window == "expanding":
        return {"e_n": F.col("seen"), "e_sum": F.col("decayed"), "e_before": F.lit(0.0)}
    return {"e_n": F.col("seen") - F.coalesce(F.lag("seen", length).over(w), F.lit(0)), "e_sum": F.col("decayed"), "e_before": F.coalesce(F.lag("decayed", length).over(w), F.lit(0.0))}


def _ewma_variance(n: Column, mean_square: Column) -> Column:
    """The next variance of s2 <- DECAY s2 + (1 - DECAY) z^2 over a slice of n values, started from the slice's mean square: written out as weighted sums."""
    weight = F.pow(F.lit(DECAY), n)
    total = F.col("e_sum") - F.col("e_before") * F.pow(F.lit(DECAY), F.col("e_n")) - weight * F.col("c_e")
    return F.when(n > 0, weight * mean_square + (1 - DECAY) * total)


def forecasts(dense: DataFrame, config: SeriesConfig, levels: tuple[float, ...] = (0.8, 0.95), run_id: str = "run") -> DataFrame:
    """Store rows of the closed-form models that ``config`` names.

    An origin without a value gives ``skipped`` rows and a model without enough values ``failed`` ones: every cell of series, window, origin, model and
    horizon has its row.
    """
    plan = origins(dense, config)
    facts = fold_facts(dense, config).join(plan, ["unique_id", "origin_t"])
    cells = facts.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(config.H))))
    cells = cells.withColumn("n", F.col("n").cast("double"))
    able = F.lit(config.target != "cumulative_returns")  # a sum of returns needs simulated paths
    models = F.array(*[
        F.struct(F.lit(name).alias("model"), F.when(able & (F.col("n") >= least), mean.cast("double")).alias("mean"), F.when(able & (F.col("n") >= least), sd.cast("double")).alias("sd"))
        for name, mean, sd, least in _models(config)
    ])
    rows = cells.select("unique_id", "window", "origin_t", "role", F.col("h").cast("long").alias("h"), "y", "z_t", F.col("n").cast("long").alias("n_train"), "mase_scale", "n_outliers", F.explode(models).alias("f"))
    rows = rows.join(truth(dense, config), ["unique_id", "origin_t", "h"])
    seen = F.col("z_t").isNotNull() & F.col("y").isNotNull()
    status = F.when(~seen, "skipped").when(F.col("f.mean").isNull(), "failed").otherwise("ok")
    ok = status == "ok"
    bounds = []
    for level in levels:
        z = z_value(level)
        bounds += [F.when(ok, F.col("f.mean") - z * F.col("f.sd")).alias(f"lo_{tag(level)}"), F.when(ok, F.col("f.mean") + z * F.col("f.sd")).alias(f"hi_{tag(level)}")]
    price = F.col("y") * F.exp(F.col("f.mean") * (F.col("h") if config.target == "returns" else 1)) if config.returns else F.lit(None).cast("double")
    return rows.select(
        F.lit(run_id).alias("run_id"), "unique_id", F.col("f.model").alias("model"), "window", "origin_t", "origin_period", F.col("role").alias("origin_role"), "h", "target_period",
        "y_true", F.col("y_true").isNull().alias("y_true_missing"), F.when(ok, F.col("f.mean")).alias("y_pred"), *bounds,
        (F.col("level_true") if config.returns else F.lit(None).cast("double")).alias("level_true"), price.alias("level_pred"), "mase_scale", "n_train", "n_outliers", status.alias("status"),
    )
