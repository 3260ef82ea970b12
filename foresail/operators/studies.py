"""Analyses beside a run: twins of a model compared, sampling noise of simulated bounds, interpolation error, and room to a coverage band."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import NORMAL, binomial_quantile, z_value
from . import kernels
from .folds import tag


def width_ratio(rows: DataFrame, model: str, twin: str, levels: tuple[float, ...]) -> DataFrame:
    """unique_id, window, h, level, n, ratio: mean width of ``twin`` over that of ``model`` on the origins both have, with the share of draws it refused and the ratio of fit times."""
    stacked = ", ".join(f"{x!r}D, hi_{tag(x)} - lo_{tag(x)}" for x in levels)
    each = rows.where("status = 'ok'").selectExpr("unique_id", "window", "model", "origin_t", "h", "variant", "fit_seconds", f"stack({len(levels)}, {stacked}) as (level, width)")
    key = ["unique_id", "window", "origin_t", "h", "level"]
    a = each.where(F.col("model") == model).select(*key, F.col("width").alias("wa"), F.col("fit_seconds").alias("ta"))
    b = each.where(F.col("model") == twin).select(*key, F.col("width").alias("wb"), F.col("fit_seconds").alias("tb"), F.expr("try_cast(regexp_extract(variant, 'refused=([0-9.]+)', 1) as double)").alias("refused"))
    return a.join(b, key).groupBy("unique_id", "window", "h", "level").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.avg("wb"), F.avg("wa")).alias("ratio"), F.avg("refused").alias("refused"), F.try_divide(F.sum("tb"), F.sum("ta")).alias("time_ratio")
    )


def paired_widening(rows: DataFrame, model: str, twin: str, levels: tuple[float, ...]) -> DataFrame:
    """unique_id, window, h, level, n and, of each origin's width of ``twin`` over that of ``model``, the mean, median, 5th and 95th percentile; with the share of the twin's width and variance that ``model`` lacks."""
    stacked = ", ".join(f"{x!r}D, hi_{tag(x)} - lo_{tag(x)}" for x in levels)
    each = rows.where("status = 'ok'").selectExpr("unique_id", "window", "model", "origin_t", "h", f"stack({len(levels)}, {stacked}) as (level, width)")
    key = ["unique_id", "window", "origin_t", "h", "level"]
    both = each.where(F.col("model").isin(model, twin)).groupBy(*key).agg(F.max(F.when(F.col("model") == model, F.col("width"))).alias("a"), F.max(F.when(F.col("model") == twin, F.col("width"))).alias("b"))
    both = both.withColumn("r", F.try_divide("b", "a")).where("r IS NOT NULL")
    return both.groupBy("unique_id", "window", "h", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.percentile("r", F.lit(0.05)).alias("p5"), F.percentile("r", F.lit(0.95)).alias("p95"),
        (1 - F.avg(F.try_divide(F.lit(1.0), F.col("r")))).alias("width_share"), F.avg(1 - F.pow("r", F.lit(-2.0))).alias("variance_share"),
    )


def path_shapes(returns: DataFrame, model: str, twin: str, horizon: int, n_paths: int = 10_000, seed: int = 0) -> DataFrame:
    """unique_id, origin_t, sd_ratio, q80_ratio, kurtosis, twin_kurtosis, linear_ratio: the sums of ``horizon`` simulated returns of two models with the same seed. Rows (unique_id, origin_t, r array<double>); a task an origin."""
    work = returns.select("unique_id", "origin_t", "r").repartition("unique_id", "origin_t")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                r = np.array(row.r)
                own = kernels.seed_of(seed, row.unique_id, row.origin_t)
                (a, za), (b, _) = (kernels.simulated_sums(name, r, horizon, n_paths, own) for name in (model, twin))
                qa, qb = np.quantile(a, [0.1, 0.9]), np.quantile(b, [0.1, 0.9])
                out.append((row.unique_id, row.origin_t, b.std() / a.std(), (qb[1] - qb[0]) / (qa[1] - qa[0]), excess_kurtosis(a), excess_kurtosis(b), linear_ratio(za, kernels.BLOCK, horizon)))
            yield pd.DataFrame(out, columns=["unique_id", "origin_t", "sd_ratio", "q80_ratio", "kurtosis", "twin_kurtosis", "linear_ratio"])

    return work.mapInPandas(run, "unique_id string, origin_t long, sd_ratio double, q80_ratio double, kurtosis double, twin_kurtosis double, linear_ratio double")


def shape_summary(shapes: DataFrame) -> DataFrame:
    """unique_id, n and the medians, means and range over origins of ``path_shapes``, with the share of origins where the twin is wider."""
    return shapes.groupBy("unique_id").agg(
        F.count(F.lit(1)).alias("n"), F.median("sd_ratio").alias("sd_ratio_median"), F.avg("sd_ratio").alias("sd_ratio_mean"), F.min("sd_ratio").alias("sd_ratio_min"), F.max("sd_ratio").alias("sd_ratio_max"),
        F.avg("q80_ratio").alias("q80_ratio_mean"), F.avg("linear_ratio").alias("linear_ratio_mean"), F.median("kurtosis").alias("kurtosis_median"), F.median("twin_kurtosis").alias("twin_kurtosis_median"),
        F.avg((F.col("sd_ratio") > 1).cast("double")).alias("share_wider"),
    )


def excess_kurtosis(x: np.ndarray) -> float:
    c = x - x.mean()
    return float(np.mean(c**4) / np.mean(c**2) ** 2 - 3)


def linear_ratio(z: np.ndarray, block: int, h: int) -> float:
    """Deviation of a sum of h values drawn in blocks over that of single draws, as the autocorrelations inside blocks foretell it."""
    whole, rest = divmod(h, block)
    pairs = np.array([whole * max(block - k, 0) + max(rest - k, 0) for k in range(1, block)])  # neighbours k apart inside one block
    rho = np.array([kernels.acf(z, k) for k in range(1, block)])
    return float(np.sqrt(1 + 2 * (pairs @ rho) / h))


def crps_ratio(scores: DataFrame, seed: int, reps: int = 5000) -> DataFrame:
    """unique_id, h, ratio, lo, hi of mean scores (columns origin_t, a, b) a over b, by a bootstrap over origins in pairs."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin_t")
        a, b, k = pdf.a.to_numpy(), pdf.b.to_numpy(), pdf.iloc[0]
        rng = np.random.Generator(np.random.PCG64(kernels.seed_of(seed, "crps", k.unique_id, k.h)))
        at = rng.integers(0, len(a), (reps, len(a)))
        lo, hi = np.quantile(a[at].mean(axis=1) / b[at].mean(axis=1), [0.025, 0.975])
        return pd.DataFrame([(k.unique_id, k.h, a.mean() / b.mean(), lo, hi)], columns=["unique_id", "h", "ratio", "lo", "hi"])

    return scores.select("unique_id", "h", "origin_t", "a", "b").groupBy("unique_id", "h").applyInPandas(run, "unique_id string, h long, ratio double, lo double, hi double")


def simulation_noise(returns: DataFrame, model: str, horizon: int, level: float, path_counts: list[int], seeds: int = 30) -> DataFrame:
    """unique_id, n_paths, sd, share: the deviation of a simulated lower bound over seeds, and its share of the interval. Rows (unique_id, r array<double>); a task a series, number of paths and seed."""
    work = returns.select("unique_id", "r", F.explode(F.array(*map(F.lit, path_counts))).alias("n_paths")).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    work = work.repartition("unique_id", "n_paths", "seed")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                f = kernels.KERNELS[model](np.array(r.r), 1, horizon, (level,), kernels.seed_of("noise", r.unique_id, r.n_paths, r.seed), cumulative=True, n_paths=int(r.n_paths))
                out.append((r.unique_id, r.n_paths, float(f.lower[level][-1]), float(f.upper[level][-1])))
            yield pd.DataFrame(out, columns=["unique_id", "n_paths", "lo", "hi"])

    each = work.mapInPandas(run, "unique_id string, n_paths int, lo double, hi double")
    return each.groupBy("unique_id", "n_paths").agg(F.stddev_samp("lo").alias("sd"), (F.stddev_samp("lo") / F.avg(F.col("hi") - F.col("lo"))).alias("share"))


def interpolation_error(sample: np.ndarray, levels: tuple[float, ...], thresholds: np.ndarray) -> float:
    """Mean distance between the distribution read off a grid of a sample's quantiles by straight lines in normal scores, and the sample's own counts."""
    taus = np.array(sorted([(1 - x) / 2 for x in levels] + [(1 + x) / 2 for x in levels]))
    q, z = np.quantile(sample, taus), np.array([NORMAL.inv_cdf(t) for t in taus])
    inside = thresholds[(thresholds >= q[0]) & (thresholds <= q[-1])]
    read = np.array([NORMAL.cdf(v) for v in np.interp(inside, q, z)])
    return float(np.abs(read - np.searchsorted(np.sort(sample), inside, "right") / len(sample)).mean())


def coverage_margin(intervals: DataFrame, level: float) -> DataFrame:
    """Rows of an interval table at ``level`` with ``margin``: how many origins may turn before the coverage leaves its band."""
    rows = intervals.where(F.col("level") == level)
    n = F.col("n").cast("int")
    hits = F.round(F.col("coverage") * F.col("n")).cast("long")
    lo, hi = binomial_quantile(0.025, n, level), binomial_quantile(0.975, n, level)
    return rows.withColumn("margin", F.least(hits - lo, hi - hits))


def scaled_deviation(phi: float, h: int) -> float:
    """Deviation of the sum of h values whose neighbours correlate by powers of phi, over that of independent ones."""
    return math.sqrt(1 + 2 * sum((1 - k / h) * phi**k for k in range(1, h)))


__all__ = ["coverage_margin", "crps_ratio", "excess_kurtosis", "interpolation_error", "linear_ratio", "paired_widening", "path_shapes", "scaled_deviation", "shape_summary", "simulation_noise", "width_ratio", "z_value"]
