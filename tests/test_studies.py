"""Analyses beside a run."""

import numpy as np
import pytest

from foresail.functions.special import z_value
from foresail.operators import studies


def test_width_ratio(spark):
    rows = [("u", "w", m, t, 1, f"{m} refused=0.100", 1.0 + k, "ok", -w, w) for t in range(4) for k, (m, w) in enumerate((("garch", 1.0), ("garch_pu", 1.5)))]
    df = spark.createDataFrame(rows, "unique_id string, window string, model string, origin_t long, h long, variant string, fit_seconds double, status string, lo_80 double, hi_80 double")
    r = studies.width_ratio(df, "garch", "garch_pu", (0.8,)).collect()[0]
    assert (r.n, r.ratio, r.refused, r.time_ratio) == (4, 1.5, 0.1, 2.0)


def test_interpolation_of_a_normal_sample_is_close():
    x = np.random.default_rng(0).normal(size=40_000)
    assert studies.interpolation_error(x, (0.5, 0.8, 0.9, 0.95), np.linspace(-1.5, 1.5, 50)) < 0.004


def test_noise_falls_with_paths(spark):
    r = np.random.default_rng(1).normal(0, 0.01, 300).tolist()
    got = {x.n_paths: x.sd for x in studies.simulation_noise(spark.createDataFrame([("u", r)], "unique_id string, r array<double>"), "ewma", 3, 0.95, [1000, 16_000], 8).collect()}
    assert got[16_000] < got[1000]


def test_scores_in_pairs(spark):
    df = spark.createDataFrame([("u", 1, t, 1.0 + t % 3, 2.0 * (1 + t % 3)) for t in range(30)], "unique_id string, h long, origin_t long, a double, b double")
    r = studies.crps_ratio(df, 3, 200).collect()[0]
    assert r.ratio == pytest.approx(0.5) and r.lo == pytest.approx(0.5) and r.hi == pytest.approx(0.5)


def test_margin(spark):
    df = spark.createDataFrame([("u", 0.8, 100, 0.8)], "unique_id string, level double, n long, coverage double")
    assert studies.coverage_margin(df, 0.8).collect()[0].margin in (7, 8)
    assert studies.scaled_deviation(0.0, 5) == 1 and z_value(0.95) == pytest.approx(1.959964)
