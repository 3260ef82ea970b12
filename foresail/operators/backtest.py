"""Backtest of fitted models: one task a bundle of folds, each series' values shipped once a bundle.

Closed-form models are window programs in ``folds``; what needs an optimiser or simulation runs here in
grouped maps over (series, window, bundle of origins), so a long series is spread over many tasks.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMBINED, VARIANCE_MODELS, SeriesConfig
from ..errors import FitError, ModelError, TransformError
from . import kernels
from .folds import forecasts, origins, tag, truth
from .scoring import bucket_losses
from .series import interpolated

CLOSED = ("naive", "seasonal_naive", "drift", "sma", "zero_return", "last_return", "mean_return")
BUNDLE = 8  #: origins a task fits


def _columns(levels: tuple[float, ...]) -> list[str]:
    return [f"{side}_{tag(x)}" for x in levels for side in ("lo", "hi", "es")]


def store_schema(levels: tuple[float, ...]) -> str:
    """The forecast store: one row a series, window, origin, model and horizon."""
    head = "run_id string, unique_id string, model string, window string, origin_t long, origin_period string, origin_role string, h long, target_period string, y_true double, y_true_missing boolean, y_pred double"
    tail = "level_true double, level_pred double, mase_scale double, n_train long, n_outliers long, n_resid long, lb_p double, lb_p_2m double, arch_p double, transform string, variant string, fit_seconds double, status string, error string"
    return f"{head}, {', '.join(f'{c} double' for c in _columns(levels))}, {tail}"


Rule = Callable[[np.ndarray, int], tuple[str, Callable, Callable]]


def _same(x: np.ndarray) -> np.ndarray:
    return x


def _log(z: np.ndarray, m: int) -> tuple[str, Callable, Callable]:
    return "log", np.log, np.exp


def _box_cox(z: np.ndarray, m: int) -> tuple[str, Callable, Callable]:
    power = kernels.box_cox_power(z)
    return f"boxcox({power:.3f})", lambda x: kernels.box_cox(x, power), lambda x: kernels.inverse_box_cox(x, power)


def _auto(z: np.ndarray, m: int) -> tuple[str, Callable, Callable]:
    """log if the spread of blocks grows with their mean by a power over 0.5; as ``series.auto_transform`` on a whole panel."""
    width = m if m >= 8 else 8
    k = len(z) // width
    if np.any(z <= 0) or k < 3:
        return TRANSFORMS["none"](z, m)
    blocks = z[len(z) - k * width :].reshape(k, width)
    sd = np.diff(blocks, axis=1).std(axis=1, ddof=1)
    ok = sd > 0
    slope = np.polyfit(np.log(blocks[ok].mean(axis=1)), np.log(sd[ok]), 1)[0] if ok.sum() >= 3 else 0.0
    return TRANSFORMS["log" if slope > 0.5 else "none"](z, m)


#: Name, forward and inverse of a transform chosen on one slice, by the rule that a configuration names.
TRANSFORMS: dict[str, Rule] = {"none": lambda z, m: ("none", _same, _same), "log": _log, "boxcox": _box_cox, "auto": _auto}
POSITIVE = ("log", "boxcox")


def choose_transform(z: np.ndarray, rule: str, m: int) -> tuple[str, Callable, Callable]:
    if rule in POSITIVE and np.any(z <= 0):
        raise TransformError("values that are not positive")
    return TRANSFORMS[rule](z, m)


def _slice(y: np.ndarray, t: int, window: str, config: SeriesConfig) -> np.ndarray:
    """The training values of a fold: no position after t is read. Missing values inside are on a straight line."""
    start = 0 if window == "expanding" else max(0, t - config.rolling_length + 1 - config.offset)
    v = y[start : t + 1]
    seen = np.flatnonzero(np.isfinite(v))
    v = np.interp(np.arange(seen[0], len(v)), seen, v[seen])
    if config.returns:
        if np.any(v <= 0):
            raise TransformError("prices that are not positive")
        v = np.diff(np.log(v))
    return v


class Rows:
    """Store rows of folds, column by column."""

    def __init__(self, names: list[str], horizon: int):
        self.columns: dict[str, list] = {n: [] for n in names}
        self.h = list(range(1, horizon + 1))

    def add(self, same: dict[str, object], each: dict[str, object]) -> None:
        """A model's rows of one fold: values for all horizons, and lists by horizon."""
        for name, column in self.columns.items():
            column.extend(self.h if name == "h" else each[name] if name in each else [same.get(name)] * len(self.h))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.columns[f.name], f.type) for f in schema], schema=schema)


def _fold(out: Rows, y: np.ndarray, base: int, t: int, role: str, window: str, uid: str, config: SeriesConfig, levels, seed: int, n_paths: int, run_id: str, fitted: list[str], known: dict) -> None:
    """All models at one origin; ``y`` starts at position ``base`` of the series."""
    last = y[t - base]

    def emit(model: str, f: kernels.Forecast | None, status: str, error: str = "", **facts) -> None:
        same = {"run_id": run_id, "unique_id": uid, "model": model, "window": window, "origin_t": t, "origin_role": role, "status": status, "error": error, **facts}
        each: dict[str, object] = {}
        if f is not None:
            same["variant"] = f.variant
            each["y_pred"] = f.mean.tolist()
            for side, values in (("lo", f.lower), ("hi", f.upper), ("es", f.shortfall)):
                each |= {f"{side}_{tag(x)}": v.tolist() for x, v in values.items()}
            if config.returns:
                each["level_pred"] = (last * np.exp(f.mean if config.target == "cumulative_returns" else np.cumsum(f.mean))).tolist()
        out.add(same, each)

    names = [n for n in fitted if role != "warmup" or config.warmup_models == "all"]
    combined = "combination" in config.models and bool(names)
    if not np.isfinite(last):
        for n in [*names, *(["combination"] if combined else [])]:
            emit(n, None, "skipped", "no value at the origin", n_train=t + 1 - (0 if window == "expanding" else max(0, t - config.rolling_length + 1 - config.offset)), n_outliers=0)
        return
    facts: dict = {}
    try:
        z = _slice(y, t - base, window, config)
        lag = config.m
        facts = {"n_train": len(z), "n_outliers": kernels.count_outliers(z, config.m), "mase_scale": float(np.mean(np.abs(z[lag:] - z[:-lag]))) if len(z) > lag else None}
        try:
            label, forward, back = choose_transform(z, "none" if config.returns else config.transform, config.m)
        except (TransformError, FitError):
            label, forward, back = f"none (fallback: {config.transform})", _same, _same
        facts["transform"] = label
        w = forward(z)
    except ModelError as e:
        for n in [*names, *(["combination"] if combined else [])]:
            emit(n, None, "failed", str(e), **facts)
        return
    members = []
    for name in names:
        began = time.perf_counter()
        extra = {"cumulative": config.target == "cumulative_returns", "n_paths": n_paths} if name in VARIANCE_MODELS else ({"search": config.sarima_search} if name == "sarima" else {})
        try:
            f = known[name](w, config.m, config.H, levels, kernels.seed_of(seed, uid, window, t, name), **extra)
            if name in COMBINED:
                members.append((name, f.mean))
            f = replace(f, mean=back(f.mean), lower={k: back(v) for k, v in f.lower.items()}, upper={k: back(v) for k, v in f.upper.items()})
            if not np.all(np.isfinite(f.mean)):
                raise FitError("a forecast is not finite")
            tests = kernels.residual_tests(f.residuals, config.m) if role == "test" and f.residuals is not None else {}
            emit(name, f, "ok", fit_seconds=time.perf_counter() - began, **facts, **tests)
        except (ModelError, ValueError, np.linalg.LinAlgError, ZeroDivisionError, IndexError, OverflowError) as e:
            emit(name, None, "failed", f"{type(e).__name__}: {e}"[:200], fit_seconds=time.perf_counter() - began, **facts)
    if combined:
        if members:
            lost = [n for n in COMBINED if n in names and n not in [k for k, _ in members]]
            mean = back(np.mean([v for _, v in members], axis=0))
            emit("combination", kernels.Forecast(mean, variant="mean of " + ",".join(k for k, _ in members) + (f" without {','.join(lost)}" if lost else "")), "ok", **facts)
        else:
            emit("combination", None, "failed", "no member", **facts)


def fitted_forecasts(dense: DataFrame, config: SeriesConfig, levels: tuple[float, ...] = (0.8, 0.95), seed: int = 20260922, n_paths: int = 10_000, run_id: str = "run", registry: dict | None = None) -> DataFrame:
    """Store rows of the models that need fitting. ``registry`` adds kernels by name (taken only if the configuration names them)."""
    fitted = [m for m in config.models if m not in CLOSED and m != "combination"]
    schema = store_schema(levels)
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    names = arrow.names
    plan = origins(dense, config)
    values = dense.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("pos", "y"))).alias("v"))
    values = values.select("unique_id", F.transform("v", lambda x: x["y"]).alias("y"))
    each = plan.withColumn("window", F.explode(F.array(*map(F.lit, config.windows)))).withColumn("bundle", F.floor(F.col("origin_t") / (BUNDLE * config.origin_step)))
    bundles = each.groupBy("unique_id", "window", "bundle").agg(F.array_sort(F.collect_list(F.struct("origin_t", "role"))).alias("folds"), F.min("origin_t").alias("first"), F.max("origin_t").alias("last"))
    # Bundles are small and slow, so their number of tasks is fixed: adaptive execution would put them together by size.
    session = dense.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    # A bundle takes along only what its slices hold, and nothing after its last origin.
    start = F.when(F.col("window") == "expanding", 0).otherwise(F.greatest(F.lit(0), F.col("first") - (config.rolling_length - 1 + config.offset))).cast("int")
    work = bundles.join(values, "unique_id").withColumn("base", start).withColumn("y", F.slice("y", start + 1, (F.col("last") - start + 1).cast("int")))
    work = work.select("unique_id", "window", "bundle", "folds", "base", "y").repartition(tasks, "unique_id", "window", "bundle")
    known = kernels.KERNELS | (registry or {})

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                y = np.array([np.nan if v is None else v for v in r["y"]], dtype=float)
                out = Rows(names, config.H)
                for f in r["folds"]:
                    _fold(out, y, r["base"], f["origin_t"], f["role"], r["window"], r["unique_id"], config, levels, seed, n_paths, run_id, fitted, known)
                yield out.batch(arrow)

    made = work.drop("bundle").mapInArrow(run, schema)
    return with_truth(made, dense, config)


def with_truth(made: DataFrame, dense: DataFrame, config: SeriesConfig) -> DataFrame:
    real = truth(dense, config).select("unique_id", "origin_t", "h", F.col("y_true").alias("_y"), F.col("level_true").alias("_l"), F.col("origin_period").alias("_o"), F.col("target_period").alias("_t"))
    out = made.join(real, ["unique_id", "origin_t", "h"])
    out = out.withColumn("y_true", F.col("_y")).withColumn("y_true_missing", F.col("_y").isNull()).withColumn("origin_period", F.col("_o")).withColumn("target_period", F.col("_t"))
    if config.returns:
        out = out.withColumn("level_true", F.col("_l"))
    return out.select(*made.columns)


def backtest(dense: DataFrame, config: SeriesConfig, levels: tuple[float, ...] = (0.8, 0.95), seed: int = 20260922, n_paths: int = 10_000, run_id: str = "run") -> DataFrame:
    """All models of a configuration, as store rows. Closed-form models are window programs; a cumulative target, which needs paths, they cannot forecast, and say so in failed rows."""
    closed = tuple(m for m in config.models if m in CLOSED)
    out = None
    if closed:
        out = forecasts(dense, replace(config, models=closed), levels, run_id)
    if any(m not in CLOSED for m in config.models):
        rest = fitted_forecasts(dense, config, levels, seed, n_paths, run_id)
        out = rest if out is None else rest.unionByName(out, allowMissingColumns=True)
    return out


def bootstrap_skill(pairs: DataFrame, seed: int, reps: int = 2000) -> DataFrame:
    """unique_id, window, model, h, skill, lo, hi of each model against the reference, over blocks of h origins."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin_t")
        k = pdf.iloc[0]
        s = kernels.skill_bootstrap(pdf.d_a.to_numpy(), pdf.d_b.to_numpy(), int(k.h), kernels.seed_of(seed, "skill", k.unique_id, k.window, k.model, k.h), reps)
        return pd.DataFrame([(k.unique_id, k.window, k.model, k.h, *s)], columns=["unique_id", "window", "model", "h", "skill", "lo", "hi"])

    rows = pairs.where("model <> reference AND d_b IS NOT NULL").select("unique_id", "window", "model", "h", "origin_t", "d_a", "d_b")
    return rows.groupBy("unique_id", "window", "model", "h").applyInPandas(run, "unique_id string, window string, model string, h long, skill double, lo double, hi double")


def model_confidence_set(rows: DataFrame, seed: int, alpha: float = 0.10, reps: int = 1000) -> DataFrame:
    """unique_id, window, h, model, mcs_p, mcs_in, on origins that every model has."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf.iloc[0]
        wide = pdf.pivot(index="origin_t", columns="model", values="loss").dropna().sort_index()
        if len(wide) < 2:
            return pd.DataFrame({"unique_id": k.unique_id, "window": k.window, "h": k.h, "model": wide.columns, "mcs_p": None, "mcs_in": None})
        p, inside = kernels.confidence_set(wide.to_numpy(), int(k.h), kernels.seed_of(seed, "mcs", k.unique_id, k.window, k.h), alpha, reps)
        return pd.DataFrame({"unique_id": k.unique_id, "window": k.window, "h": k.h, "model": wide.columns, "mcs_p": p, "mcs_in": inside})

    losses = rows.select("unique_id", "window", "h", "model", "origin_t", F.abs(F.col("y_true") - F.col("y_pred")).alias("loss"))
    return losses.groupBy("unique_id", "window", "h").applyInPandas(run, "unique_id string, window string, h long, model string, mcs_p double, mcs_in boolean")


def bucket_confidence_set(rows: DataFrame, m: int, horizon: int, seed: int, alpha: float = 0.10, reps: int = 1000) -> DataFrame:
    """unique_id, window, bucket, h_last, model, mcs_n, mcs_p, mcs_in: the confidence set over mean losses of a bucket's horizons, in blocks of its last one; buckets of one model or origin have none."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf.iloc[0]
        wide = pdf.pivot(index="origin_t", columns="model", values="loss").sort_index()
        if wide.shape[0] < 2 or wide.shape[1] < 2:
            return pd.DataFrame(columns=["unique_id", "window", "bucket", "h_last", "model", "mcs_n", "mcs_p", "mcs_in"])
        p, inside = kernels.confidence_set(wide.to_numpy(), int(k.h_last), kernels.seed_of(seed, "mcs", k.unique_id, k.window, k.bucket), alpha, reps)
        return pd.DataFrame({"unique_id": k.unique_id, "window": k.window, "bucket": k.bucket, "h_last": k.h_last, "model": wide.columns, "mcs_n": len(wide), "mcs_p": p, "mcs_in": inside})

    schema = "unique_id string, window string, bucket string, h_last long, model string, mcs_n long, mcs_p double, mcs_in boolean"
    return bucket_losses(rows, m, horizon).groupBy("unique_id", "window", "bucket").applyInPandas(run, schema)


def shortfall_backtest(rows: DataFrame, levels: tuple[float, ...], seed: int) -> DataFrame:
    """unique_id, window, model, h, level, n_breaches, gap, lo, hi, es_ok: realised against predicted shortfall over breaches of the lower bound."""
    stacked = ", ".join(f"{x!r}D, lo_{tag(x)}, es_{tag(x)}" for x in levels)
    each = rows.selectExpr("unique_id", "window", "model", "h", "origin_t", "y_true", f"stack({len(levels)}, {stacked}) as (level, lo, es)").where("y_true <= lo AND es IS NOT NULL")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin_t")
        k = pdf.iloc[0]
        gap, lo, hi, ok = kernels.shortfall_test(pdf.y_true.to_numpy(), pdf.es.to_numpy(), kernels.seed_of(seed, "es", k.unique_id, k.window, k.model, k.h, k.level))
        out = pd.DataFrame([(k.unique_id, k.window, k.model, k.h, k.level, len(pdf), gap, lo, hi, ok)], columns=["unique_id", "window", "model", "h", "level", "n_breaches", "gap", "lo", "hi", "es_ok"])
        return out.astype({"es_ok": "boolean"}).replace({np.nan: None})

    return each.groupBy("unique_id", "window", "model", "h", "level").applyInPandas(run, "unique_id string, window string, model string, h long, level double, n_breaches long, gap double, lo double, hi double, es_ok boolean")


__all__ = ["backtest", "bootstrap_skill", "fitted_forecasts", "interpolated", "model_confidence_set", "shortfall_backtest", "store_schema"]
