"""A run from configuration to store, manifest and report; scoring never refits."""

from __future__ import annotations

import hashlib
import json
import platform
import shutil
import subprocess
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig, SeriesConfig
from ..errors import ForesailError
from ..operators import calibration, scoring
from ..operators.backtest import backtest, bootstrap_skill, bucket_confidence_set, model_confidence_set, shortfall_backtest
from ..operators.folds import origins
from ..operators.series import data_hash, profile, validate
from ..sources.canonical import load
from ..sources.scratch import kept
from ..sources.store import ForecastStore
from . import verdicts
from .charts import line_chart
from .gate import Gate, check_gate, registered


def code_version() -> str:
    def git(*args: str) -> str:
        done = subprocess.run(["git", "-C", str(Path(__file__).parent), *args], capture_output=True, text=True)
        return done.stdout if done.returncode == 0 else ""

    head = git("rev-parse", "HEAD").strip()
    if not head:
        return "nogit"
    changes = git("diff", "HEAD")
    return f"{head}-dirty-{hashlib.sha256(changes.encode()).hexdigest()[:8]}" if changes else head


def validated(spark: SparkSession, config: RunConfig, cache: str = "cache") -> dict[str, DataFrame]:
    """The dense series of each source; the first broken rule is raised."""
    return {s.id: validate(load(spark, s, cache), s) for s in config.series}


def run(spark: SparkSession, config: RunConfig, warnings: list[str] | None = None, gate: Gate | None = None, force: bool = False, cache: str = "cache") -> Path:
    """Backtest every source into one store; a run that is there already is taken as it is. Returns its folder.

    What there is of each series (hashes, plans, selections) goes to tables beside the store; the manifest holds totals.
    """
    if gate:
        check_gate(gate, config)
    dense = validated(spark, config, cache)
    hashes = union(*(data_hash(d).withColumn("source", F.lit(k)) for k, d in dense.items()))
    combined = hashes.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("source", "unique_id", "data_hash")).alias("x"), F.sum(F.xxhash64("data_hash", "unique_id", "source").cast("decimal(38,0)")).alias("s")).first()
    digest = hashlib.sha256(f"{combined['n']}:{combined['x']}:{combined['s']}".encode()).hexdigest()
    run_id = config.run_id(digest, code_version())
    folder = Path(config.output_dir) / run_id
    if (folder / "manifest.json").exists() and not force:
        return folder
    folder.mkdir(parents=True, exist_ok=True)
    store = ForecastStore(spark, str((folder / "store").resolve()), config.levels)
    if force:
        shutil.rmtree(store.path, ignore_errors=True)
    for s in config.series:
        store.append(backtest(dense[s.id], s, config.levels, config.seed, config.n_paths, run_id))
    rows = store.read()
    plans = union(*(origins(dense[s.id], s).groupBy("unique_id", "role").agg(F.count(F.lit(1)).alias("n"), F.bool_or("reduced").alias("reduced")).withColumn("source", F.lit(s.id)) for s in config.series))
    for name, table in (("data_hashes", hashes), ("plans", plans), ("selections", scoring.dev_selection(rows)), ("candidates", scoring.candidate_ranking(rows))):
        table.write.mode("overwrite").parquet(str((folder / name).resolve()))
    counted = spark.read.parquet(str((folder / "plans").resolve())).groupBy("source", "role").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("series")).collect()
    manifest = {
        "run_id": run_id, "created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "code": code_version(),
        "versions": {"python": platform.python_version(), "spark": spark.version}, "config": json.loads(json.dumps(config, default=lambda o: o.__dict__)),
        "data_hashes": {"series": combined["n"], "sha256": digest, "table": "data_hashes"}, "plans": [r.asDict() for r in counted], "selections": {"table": "selections"},
        "rows": {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}, "a4": [r.asDict() for r in scoring.failed_share(rows).collect()], "content_hash": store.content_hash(),
        "gate": {"sha256": gate.sha256, "registered": registered(gate)} if gate else None, "warnings": sorted(set(warnings or [])),
    }
    (folder / "manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True))
    return folder


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def scores(spark: SparkSession, folder: Path, config: RunConfig) -> dict[str, DataFrame]:
    """The score tables of a run, from its store alone."""
    store = ForecastStore(spark, str((folder / "store").resolve()), config.levels).read()
    selection = scoring.dev_selection(store)
    test = scoring.sma_collapsed(scoring.scorable(store), selection)
    reference = selection.withColumn("reference", F.when(F.col("reference") == F.col("sma"), "sma").otherwise(F.col("reference")))
    most, season = max(s.H for s in config.series), max(s.m for s in config.series)
    pairs = scoring.paired(test, reference)
    against = scoring.holm(scoring.diebold_mariano(pairs, scoring.CELL, most).withColumn("candidate", ~scoring.is_baseline(F.col("model"))), "dm_p_better", ["unique_id", "window", "candidate"], "dm_p_better_holm")
    skill = kept(bootstrap_skill(pairs, config.seed), "skill")
    rows = scoring.interval_rows(test, config.levels)
    folds = store.where("origin_role = 'test' AND status = 'ok' AND h = 1")
    return {
        "point": scoring.point_metrics(test).join(against.drop("n"), scoring.CELL, "left").join(reference.select("unique_id", "window", "reference"), ["unique_id", "window"], "left"),
        "skill": skill, "h_star": scoring.h_star(skill, most), "mcs": model_confidence_set(test, config.seed), "mcs_buckets": bucket_confidence_set(test, season, most, config.seed),
        "intervals": scoring.interval_metrics(rows, config.levels), "buckets": scoring.interval_buckets(rows, season, most, config.levels),
        "independence": scoring.christoffersen(rows, [*scoring.CELL, "level"], min(s.origin_step for s in config.series)), "crps": calibration.crps(test, config.levels),
        "residuals": scoring.residual_summary(folds), "transforms": scoring.transform_counts(folds.where("transform IS NOT NULL")),
        "window_gap": scoring.window_gap(test, most), "subperiods": scoring.subperiods(test, reference), "selection": selection, "choice": verdicts.chosen(store),
    }


def checks(tables: dict[str, DataFrame], gate: Gate, base: str) -> DataFrame:
    """The registered checks on the primary models, at the least level, against the scores of ``base``."""
    wanted = {(s.id, s.primary_model) for s in gate.series}
    level = tables["intervals"].agg(F.min("level")).first()[0]
    primary = F.array(*[F.lit(f"{a}|{b}") for a, b in sorted(wanted)])
    cover = tables["intervals"].where((F.col("level") == level) & F.array_contains(primary, F.concat_ws("|", "unique_id", "model")))
    crps = tables["crps"]
    other = crps.where(F.col("model") == base).select("unique_id", "window", "h", F.col("crps").alias("base"))
    ratio = crps.join(other, ["unique_id", "window", "h"], "left").select(*scoring.CELL, F.try_divide("crps", "base").alias("crps_ratio"))
    independent = tables["independence"].where(F.col("level") == level).select(*scoring.CELL, "ind_p")
    table = cover.join(independent, scoring.CELL, "left").join(ratio, scoring.CELL, "left")
    horizons = sorted({h for s in gate.series for h in s.horizons})
    return calibration.gate_checks(table.where(F.col("h").isin(horizons)), gate.limits)


def answers(tables: dict[str, DataFrame], config: RunConfig) -> DataFrame:
    """unique_id, window, question, answer, detail in the primary window: the six questions and the exit row. Written once, as the criteria read it again."""
    window = verdicts.primary_window(config.series[0].windows)
    t = {k: v.where(F.col("window") == window) if "window" in v.columns else v for k, v in tables.items()}
    choice = t["choice"]
    first = verdicts.beats_reference(t["point"], choice)
    return kept(union(
        first, verdicts.reach(t["h_star"], t["skill"], choice), verdicts.covers(t["buckets"], choice), verdicts.residuals(t["residuals"], choice),
        verdicts.windows_and_time(tables["window_gap"].withColumn("window", F.lit(window)), t["subperiods"], choice), verdicts.transforms(t["transforms"], choice, config.series[0].transform),
        verdicts.exit_decision(t["point"], first, any(s.returns for s in config.series)),
    ), "answers")


def criteria(tables: dict[str, DataFrame], said: DataFrame, config: RunConfig, coverage: dict[float, tuple[float, float]]) -> DataFrame:
    window = verdicts.primary_window(config.series[0].windows)
    t = {k: v.where(F.col("window") == window) if "window" in v.columns else v for k, v in tables.items()}
    return verdicts.criteria(t["point"], t["buckets"], t["subperiods"], t["h_star"], said, t["choice"], coverage)


SHOWN = 500  #: rows of a table that a Markdown report shows; the whole table is always written beside it


def _shown(folder: Path, name: str, df: DataFrame) -> str:
    """``df`` written whole as Parquet in the run's folder, and its first rows as Markdown with the number of the others."""
    place = (folder / "tables" / name).resolve()
    df.write.mode("overwrite").parquet(str(place))
    whole = df.sparkSession.read.schema(df.schema).parquet(str(place))
    order = [c for c, t in whole.dtypes if t in ("string", "bigint", "int")][:5]
    n, rows = whole.count(), (whole.orderBy(*order) if order else whole).limit(SHOWN).collect()
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "/")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    note = [] if n <= SHOWN else ["", f"{n - SHOWN} of {n} rows are not shown here: they are in `tables/{name}`."]
    return "\n".join([head, *[f"| {' | '.join(show(v) for v in r)} |" for r in rows], *note])


def _charts(folder: Path, tables: dict[str, DataFrame], config: RunConfig) -> list[str]:
    """Relative errors and coverage by horizon of the first few series, as SVG files."""
    window = verdicts.primary_window(config.series[0].windows)
    out = []
    some = [r["unique_id"] for r in tables["choice"].select("unique_id").distinct().orderBy("unique_id").limit(4).collect()]
    for name, df, value, level in (("relative_error", tables["point"], "rel_mae", 1.0), ("coverage", tables["intervals"].where("level = 0.8"), "coverage", 0.8)):
        rows = df.where((F.col("window") == window) & F.col("unique_id").isin(*some)).select("unique_id", "model", "h", value).collect() if some else []
        for uid in some:
            lines: dict[str, list[tuple[float, float]]] = {}
            for r in rows:
                if r["unique_id"] == uid and r[value] is not None:
                    lines.setdefault(r["model"], []).append((r["h"], r[value]))
            file = f"{name}-{len(out)}.svg"
            (folder / file).write_text(line_chart(f"{uid}: {name.replace('_', ' ')}", lines, "horizon", value, level))
            out.append(f"![{name} of {uid}]({file})")
    return out


def report(spark: SparkSession, folder: Path, config: RunConfig, gate: Gate | None = None) -> Path:
    """A Markdown report of a run's tables. A decision is stated only for a gate that is committed and unchanged."""
    tables = scores(spark, folder, config)
    said = answers(tables, config)
    bounds = {0.8: (gate.limits["coverage_lo"], gate.limits["coverage_hi"])} if gate else {0.8: (0.7, 0.9), 0.95: (0.9, 0.99)}
    lines = [f"# Run {folder.name}", "", "## Does a candidate beat the reference, and what else is known?", "", _shown(folder, "answers", said), "", "## Criteria", "", _shown(folder, "criteria", criteria(tables, said, config, bounds)), ""]
    if gate:
        decided = calibration.gate_decision(checks(tables, gate, "zero_return"))
        lines += ["## Decision", "", _shown(folder, "decision", decided) if registered(gate) else "The gate is not registered, so nothing is decided.", ""]
    lines += ["## Charts", "", *_charts(folder, tables, config), ""]
    for name in ("selection", "point", "skill", "h_star", "mcs", "mcs_buckets", "intervals", "buckets", "independence", "crps", "residuals", "transforms", "window_gap", "subperiods"):
        lines += [f"## {name}", "", _shown(folder, name, tables[name]), ""]
    out = folder / "report.md"
    out.write_text("\n".join(lines))
    return out


def risk(spark: SparkSession, folder: Path, config: RunConfig, losses: list[float], window: int = 60) -> Path:
    """Conformal correction, tail risk and threshold probabilities of a run, as Markdown."""
    store = ForecastStore(spark, str((folder / "store").resolve()), config.levels).read()
    fixed = calibration.conformal(store.where(F.col("lo_" + str(round(config.levels[0] * 100))).isNotNull()), config.levels, window, model_window=verdicts.primary_window(config.series[0].windows))
    test = scoring.scorable(fixed).where("conformal_n > 0")
    each = calibration.threshold_probabilities(test, config.levels, losses)
    latest = scoring.latest_origin(each).select("unique_id", "window", "model", "origin_period", "h", "loss", "state", "p_exceed", "p_lo", "p_hi")
    lines = [f"# Risk of run {folder.name}", "", "## Value at risk", "", _shown(folder, "risk", calibration.risk_table(test, config.levels)), "", "## Shortfall", "", _shown(folder, "shortfall", shortfall_backtest(test, config.levels, config.seed)), ""]
    lines += ["## Threshold probabilities", "", _shown(folder, "thresholds", calibration.threshold_summary(each)), "", "## At the last origin", "", _shown(folder, "latest", latest)]
    out = folder / "risk.md"
    out.write_text("\n".join(lines))
    return out


def profiles(spark: SparkSession, config: RunConfig, cache: str = "cache") -> dict[str, DataFrame | ForesailError]:
    """A profile of each source, or the error that it has."""
    out: dict[str, DataFrame | ForesailError] = {}
    for s in config.series:
        try:
            out[s.id] = profile(validate(load(spark, s, cache), s))
        except ForesailError as e:
            out[s.id] = e
    return out


__all__ = ["SeriesConfig", "answers", "checks", "criteria", "profiles", "report", "risk", "run", "scores", "validated"]
