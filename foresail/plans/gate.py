"""Pre-registration: thresholds fixed in a file before a run, tied to its series, horizons and models."""

from __future__ import annotations

import hashlib
import subprocess
from dataclasses import dataclass, replace
from pathlib import Path

from ..config import RunConfig
from ..errors import GateError

LIMITS = {"coverage_lo", "coverage_hi", "alpha", "crps_ratio"}
_KEYS = {"series", "limits"}
_SERIES = {"id", "horizons", "models", "primary_model"}


@dataclass(frozen=True)
class SeriesGate:
    id: str
    horizons: tuple[int, ...]
    models: tuple[str, ...]
    primary_model: str


@dataclass(frozen=True)
class Gate:
    path: str
    sha256: str
    limits: dict[str, float]
    series: tuple[SeriesGate, ...]


def load_gate(path: str) -> Gate:
    import yaml

    try:
        data = Path(path).read_bytes()
        raw = yaml.safe_load(data)
    except (OSError, yaml.YAMLError) as e:
        raise GateError(f"{path}: {e}") from e
    if not isinstance(raw, dict) or set(raw) != _KEYS:
        raise GateError(f"{path}: the keys {', '.join(sorted(_KEYS))} are needed, and no others")
    if set(raw["limits"]) != LIMITS or not 0 < raw["limits"]["alpha"] < 1 or not 0 <= raw["limits"]["coverage_lo"] < raw["limits"]["coverage_hi"] <= 1:
        raise GateError(f"{path}: limits must be {', '.join(sorted(LIMITS))}, in range")
    series = []
    for s in raw["series"]:
        if set(s) != _SERIES or s["primary_model"] not in s["models"] or not s["horizons"]:
            raise GateError(f"{path}: a series needs {', '.join(sorted(_SERIES))}, its primary model among its models")
        series.append(SeriesGate(str(s["id"]), tuple(sorted(s["horizons"])), tuple(s["models"]), s["primary_model"]))
    return Gate(path, hashlib.sha256(data).hexdigest(), {k: float(v) for k, v in raw["limits"].items()}, tuple(series))


def check_gate(gate: Gate, config: RunConfig) -> None:
    """The registered series, horizons and models must be the configuration's own."""
    by_id = {s.id: s for s in config.series}
    if set(by_id) != {s.id for s in gate.series}:
        raise GateError("registered and configured series differ")
    for s in gate.series:
        c = by_id[s.id]
        if s.horizons != c.decision_horizons or set(s.models) != set(c.models):
            raise GateError(f"{s.id}: registered horizons or models differ from the configured ones")


def registered(gate: Gate) -> bool:
    """Whether the file is committed and unchanged since; only then does a decision count."""
    folder, name = Path(gate.path).resolve().parent, Path(gate.path).name

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    return bool(git("log", "-1", "--format=%H", "--", name)) and git("status", "--porcelain", "--", name) == ""


def with_primary(gate: Gate, model: str) -> Gate:
    """The same rules for another model, to see what they would say of it: never a registered decision."""
    return replace(gate, sha256="", series=tuple(replace(s, primary_model=model) for s in gate.series if model in s.models))
