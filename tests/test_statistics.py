"""Statistics, simulation, studies and verdicts against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresail.config import SeriesConfig
from foresail.errors import AdapterError, FitError
from foresail.functions.special import chi2_tail
from foresail.operators import calibration, folds, kernels, scoring, series, studies
from foresail.operators.backtest import _slice, bucket_confidence_set
from foresail.plans import verdicts
from foresail.plans.charts import line_chart
from foresail.sources.canonical import Synthetic, affine_scan, prices, read_fred, to_frame


def test_affine_scan_and_processes():
    rng = np.random.default_rng(0)
    f, a = rng.uniform(0.5, 1.1, 1000), rng.normal(size=1000)
    want, x = [], 0.7
    for k in range(1000):
        x = f[k] * x + a[k]
        want.append(x)
    assert np.allclose(affine_scan(f, a, 0.7), want, rtol=1e-9)
    trend = Synthetic("trend_reversal_variance_jump", 1, n=400, sigma=1e-9)
    y = trend.values()
    assert trend.break_at == 280 and np.allclose(np.diff(y[:281]), 0.5, atol=1e-6) and np.allclose(np.diff(y[281:]), -0.5, atol=1e-6)
    walk = Synthetic("random_walk", 3, n=5000).values()
    assert np.std(np.diff(walk)) == pytest.approx(1, abs=0.05) and np.array_equal(walk, Synthetic("random_walk", 3, n=5000).values())
    r = Synthetic("garch11_returns", 2, n=20_000).values()
    assert np.std(r) == pytest.approx(0.0126, rel=0.35) and kernels.acf(r * r, 1) > 0.05 and abs(kernels.acf(r, 1)) < 0.06
    assert len(Synthetic("local_linear_trend").values()) == 240 and prices(r[:5])[0] == pytest.approx(10_000 * math.exp(r[0]))
    with pytest.raises(AdapterError):
        Synthetic("random_walk", speed=1)


def test_fred_file(spark, tmp_path):
    config = SeriesConfig(id="s")
    got = read_fred(spark, "ABC", config, str(tmp_path), lambda _: b"observation_date,ABC\n2020-01-01,1.5\n2020-02-01,.\n")
    assert [(r.unique_id, r.ds, r.y) for r in got.collect()] == [("s", "2020-01-01", "1.5"), ("s", "2020-02-01", None)]
    assert read_fred(spark, "ABC", config, str(tmp_path), lambda _: 1 / 0).count() == 2  # from the cache
    with pytest.raises(AdapterError):
        read_fred(spark, "ABC", config, str(tmp_path), lambda _: b"day,ABC\n1,2\n", refresh=True)


def test_blocks_do_not_wrap():
    rng = np.random.Generator(np.random.PCG64(1))
    at = kernels.block_indices(10, 23, 4, 500, rng)
    assert at.shape == (500, 23) and at.min() == 0 and at.max() == 9
    assert all(np.all(np.diff(at[:, k : k + 4]) == 1) for k in range(0, 20, 4)) and set(at[:, 0]) == set(range(7))
    assert kernels.block_indices(3, 3, 8, 5, rng).tolist() == [[0, 1, 2]] * 5


def plain_set(losses, at, alpha):
    """The confidence set of given resamples, written step by step."""
    alive, p, worst = list(range(losses.shape[1])), {}, 0.0
    while len(alive) > 1:
        m = losses[:, alive].mean(axis=0)
        d = m - m.mean()
        boot = np.array([losses[i][:, alive].mean(axis=0) for i in at])
        star = boot - boot.mean(axis=1, keepdims=True) - d
        sd = np.sqrt((star**2).mean(axis=0))
        t = [d[k] / sd[k] if sd[k] > 0 else 0.0 for k in range(len(alive))]
        beyond = np.mean([max(star[b, k] / sd[k] if sd[k] > 0 else 0.0 for k in range(len(alive))) > max(t) for b in range(len(at))])
        out = [alive[k] for k in range(len(alive)) if t[k] == max(t)]
        if len(out) == len(alive):
            break
        worst = max(worst, beyond)
        p |= {k: worst for k in out}
        alive = [k for k in alive if k not in out]
    return [p.get(k, 1.0) for k in range(losses.shape[1])]


def test_confidence_set_by_steps():
    rng = np.random.default_rng(4)
    losses = np.abs(rng.normal(size=(60, 4))) + np.array([0, 0.05, 0.2, 0.6])
    losses[:, 1] = losses[:, 0] + 0.01 * rng.normal(size=60)
    at = kernels.block_indices(60, 60, 3, 400, np.random.Generator(np.random.PCG64(8)))
    p, inside = kernels.confidence_set(losses, 3, 8, 0.1, 400)
    assert p == pytest.approx(plain_set(losses, at, 0.1)) and list(inside) == [x >= 0.1 for x in p]
    twins = np.column_stack([losses[:, 0], losses[:, 3], losses[:, 3]])
    p, _ = kernels.confidence_set(twins, 1, 2)
    assert p[1] == p[2] < 1 and p[0] == 1


def test_a_perfect_reference_counts_against_skill():
    a, b = np.ones(40), np.r_[np.zeros(39), 1.0]
    _, lo, _ = kernels.skill_bootstrap(a, b, 1, 3)
    assert lo == -np.inf


def test_shortfall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    gap, lo, hi, ok = kernels.shortfall_test(x, np.zeros(400), 1)
    assert lo < gap < hi and ok and hi - lo == pytest.approx(2 * 1.96 * x.std() / 20, rel=0.1)
    assert kernels.shortfall_test(x - 1, np.zeros(400), 1)[3] is False
    few = kernels.shortfall_test(x[:9], np.zeros(9), 1)
    assert few[3] is None and math.isnan(few[0])


def test_decayed_sums():
    rng = np.random.default_rng(1)
    for n in (5, 900):
        x = rng.random(n)
        for beta in (0.0, 1e-10, 0.01, 0.079, 0.08, 0.3, 0.9, 0.99, 1.0):
            want = [0.5]
            for v in x:
                want.append(v + beta * want[-1])
            assert np.allclose(kernels.decayed_sums(x, beta, 0.5), want, rtol=1e-12)


def test_parameter_draws(monkeypatch):
    r = Synthetic("garch11_returns", 5, n=1500).values()
    fit = kernels.Garch.fit(r, True)
    rng = np.random.Generator(np.random.PCG64(3))
    par, refused = kernels.draw_parameters(fit, 3000, rng)
    assert par.shape == (3000, 4) and 0 <= refused < 1 and kernels.inside_bounds(par).all()
    want = []
    for omega, alpha, beta, gamma in par[:50]:
        s = fit.start
        for x in fit.r:
            s = omega + (alpha + gamma * (x < 0)) * x * x + beta * s
        want.append(s)
    assert np.allclose(kernels.last_variances(fit, par)[:50], want, rtol=1e-3)
    monkeypatch.setattr(kernels.Garch, "covariance", lambda self: np.zeros((4, 4)))
    same, refused = kernels.draw_parameters(fit, 20, rng)
    assert np.array_equal(same, np.tile(fit.par, (20, 1))) and refused == 0
    assert np.allclose(kernels.last_variances(fit, same), fit.variances()[-1], rtol=1e-6)
    assert list(kernels.inside_bounds(np.array([[0, 0.1, 0.8, 0], [0.1, 0.1, 0.9, 0], [0.1, -0.1, 0.9, 0.2], [0.1, 0.1, 0.8, -0.2], [0.1, 0.0, 0.8, 0.0]]))) == [False, False, False, False, True]
    monkeypatch.setattr(kernels.Garch, "covariance", lambda self: np.full((4, 4), np.nan))
    with pytest.raises(FitError):
        kernels.draw_parameters(fit, 20, rng)


def test_residual_tests(spark):
    rng = np.random.default_rng(6)
    e = 0.5 + rng.normal(size=120) * (1 + (np.arange(120) % 40 < 20))
    for lag in (4, 12):
        s = e * e
        x = np.column_stack([np.ones(120 - lag), *(s[lag - k : 120 - k] for k in range(1, lag + 1))])
        rest = s[lag:] - x @ np.linalg.solve(x.T @ x, x.T @ s[lag:])
        want = (120 - lag) * (1 - (rest @ rest) / ((s[lag:] - s[lag:].mean()) ** 2).sum())
        assert kernels.arch_p(e, lag) == pytest.approx(chi2_tail(want, lag))
        df = spark.createDataFrame([("u", "w", "m", t, float(v)) for t, v in enumerate(e)], "unique_id string, window string, model string, origin_t long, e double")
        got = scoring.arch_lm(df, ["unique_id", "window", "model"], "e", lag).first()
        assert got.arch_lm == pytest.approx(want, rel=1e-9) and got.n == 120 - lag
        assert scoring.autocorrelation(df, ["unique_id", "window", "model"], "e", lag).first().lb_p == pytest.approx(kernels.ljung_box_p(e, lag))
    out = kernels.residual_tests(np.r_[e, np.nan], 12)
    assert out["n_resid"] == 120 and out["lb_p"] == kernels.ljung_box_p(e, 12) and out["lb_p_2m"] == kernels.ljung_box_p(e, 24) and out["arch_p"] == kernels.arch_p(e, 12)
    assert kernels.residual_tests(e[:30], 1)["lb_p_2m"] is None and kernels.residual_tests(np.ones(50), 12) == {"n_resid": 50, "lb_p": None, "lb_p_2m": None, "arch_p": None}
    assert kernels.residual_lags(1) == (10, None, 4) and kernels.residual_lags(12) == (12, 24, 12) and kernels.residual_lags(2) == (2, 4, 4)
    flat = spark.createDataFrame([("u", "w", "m", t, 1.0) for t in range(20)], df.schema)
    assert scoring.arch_lm(flat, ["unique_id", "window", "model"], "e", 4).first().arch_lm is None


def test_ewma_of_a_long_series(spark):
    """Over several runs of the weighted sums, with values missing, in both windows."""
    r = np.random.default_rng(3).normal(0, 0.01, 2500)
    y = 100 * np.exp(np.cumsum(r))
    dense = spark.createDataFrame([("u", k, k, None if k == 700 else float(v)) for k, v in enumerate(y)], "unique_id string, pos long, period long, y double")
    config = SeriesConfig(id="u", freq="trading_days", H=2, m=1, target="returns", initial_window=500, rolling_length=300, origin_step=97, n_dev=3, n_test=15, models=("ewma",))
    got = {(x.window, x.origin_t): x for x in folds.forecasts(dense, config).where("h = 1 AND status = 'ok'").collect()}
    assert len(got) > 30
    for (window, t), x in got.items():
        z = _slice(np.array([np.nan if k == 700 else a for k, a in enumerate(y)]), t, window, config)
        s = float(np.mean(z * z))
        for a in z:
            s = 0.94 * s + 0.06 * a * a
        assert (x.hi_80 - x.lo_80) / 2 / 1.2815515655446004 == pytest.approx(math.sqrt(s), rel=1e-9)
        assert x.n_outliers == kernels.count_outliers(z, 1)


@pytest.mark.parametrize("target", ["level", "returns"])
def test_slices_of_gappy_series(spark, target):
    """Rolling windows that begin inside gaps of any length: every model's forecast from the slice itself."""
    rng = np.random.default_rng(8)
    series_ = {}
    for k in range(6):
        y = 50 + np.cumsum(rng.normal(size=120))
        y[rng.random(120) < 0.25] = np.nan
        y[30 + k : 45 + 2 * k] = np.nan
        y[:k] = np.nan
        series_[f"s{k}"] = y
    rows = [(u, t, t, None if np.isnan(v) else float(v)) for u, y in series_.items() for t, v in enumerate(y)]
    dense = spark.createDataFrame(rows, "unique_id string, pos long, period long, y double")
    models = ("naive", "seasonal_naive", "drift", "sma") if target == "level" else ("zero_return", "mean_return", "ewma", "sma")
    config = SeriesConfig(id="x", freq="quarterly", H=2, m=4, target=target, initial_window=20, rolling_length=20, n_dev=20, n_test=70, models=models, sma_windows=(3,))
    got = {(r.unique_id, r.window, r.model, r.origin_t): r for r in folds.forecasts(dense, config).where("h = 1").collect()}
    checked = 0
    for (u, window, model, t), r in got.items():
        y = series_[u]
        if np.isnan(y[t]):
            assert r.status == "skipped" and r.mase_scale is None and r.n_train == (t + 1 if window == "expanding" else min(t + 1, 20 + config.offset))
            continue
        v = _slice(y, t, window, config)
        n, d, s = len(v), np.diff(v), v[4:] - v[:-4]
        assert r.n_train == n and r.n_outliers == kernels.count_outliers(v, 4)
        assert (r.mase_scale is None) == (n <= 4) and (n <= 4 or r.mase_scale == pytest.approx(np.abs(s).mean()))
        least = {"naive": 2, "seasonal_naive": 5, "drift": 3, "sma_3": 3, "zero_return": 1, "mean_return": 3, "ewma": 2}[model]
        assert (r.status == "ok") == (n >= least), (u, window, model, t, n)
        if n < max(least, 4):
            continue
        checked += 1
        half = None if r.hi_80 is None else (r.hi_80 - r.lo_80) / 2 / 1.2815515655446004
        if model == "naive":
            assert r.y_pred == pytest.approx(v[-1]) and half == pytest.approx(math.sqrt((d**2).mean()))
        if model == "seasonal_naive":
            assert r.y_pred == pytest.approx(v[-4]) and half == pytest.approx(math.sqrt((s**2).mean()))
        if model == "drift":
            slope = (v[-1] - v[0]) / (n - 1)
            assert r.y_pred == pytest.approx(v[-1] + slope) and half == pytest.approx(math.sqrt(((d - slope) ** 2).sum() / (n - 2) * (1 + 1 / (n - 1))), abs=1e-6)
        if model == "sma_3":
            assert r.y_pred == pytest.approx(v[-3:].mean())
        if model == "zero_return":
            assert half == pytest.approx(math.sqrt((v**2).mean()))
        if model == "mean_return":
            assert r.y_pred == pytest.approx(v.mean()) and half == pytest.approx(v.std(ddof=1) * math.sqrt(1 + 1 / n))
        if model == "ewma":
            s2 = float((v**2).mean())
            for a in v:
                s2 = 0.94 * s2 + 0.06 * a * a
            assert half == pytest.approx(math.sqrt(s2))
    assert checked > 1000


def test_values_of_a_cumulative_target_need_paths(spark):
    dense = spark.createDataFrame([("u", k, k, 100.0 + k) for k in range(400)], "unique_id string, pos long, period long, y double")
    config = SeriesConfig(id="u", freq="trading_days", H=2, m=1, target="cumulative_returns", initial_window=250, rolling_length=250, origin_step=5, n_dev=3, n_test=5, models=("zero_return",))
    assert {x.status for x in folds.forecasts(dense, config).collect()} == {"failed"}


def test_facts_of_gappy_series(spark):
    """Gaps as distances against the written-out calendar."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(40):
        keep = [k for k in range(60) if rng.random() > 0.15] or [0]
        rows += [(f"s{s}", f"{2000 + k // 12}-{k % 12 + 1:02d}-01", None if rng.random() < 0.1 else "1") for k in keep]
    raw = spark.createDataFrame(rows, "unique_id string, ds string, y string")
    config = SeriesConfig(id="x")
    got = {r.unique_id: r for r in series.facts(raw, config).collect()}
    dense = series.reindexed(series.parsed(raw, config).select("unique_id", "ds", "y"), "monthly")
    runs = {r.unique_id: r.n for r in series.islands(dense, F.col("y").isNull()).groupBy("unique_id").agg(F.max("length").alias("n")).collect()}
    for r in dense.groupBy("unique_id").agg(F.count("*").alias("n"), F.count("y").alias("seen")).collect():
        f = got[r.unique_id]
        assert (f.rows, f.seen, f.longest) == (r.n, r.seen, runs.get(r.unique_id, 0))
    steps = {r.unique_id: r.step for r in series.step_counts(series.parsed(raw, config), "monthly").collect()}
    assert all(got[k].step == v for k, v in steps.items())
    days = spark.createDataFrame([("u", d, "1") for d in ("2024-01-01", "2024-01-02", "2024-01-12", "2024-01-15")], "unique_id string, ds string, y string")
    f = series.facts(days, SeriesConfig(id="u", freq="trading_days", m=1)).first()
    gaps = series.trading_gaps(days.withColumn("ds", F.col("ds").cast("timestamp_ntz"))).first()
    assert (f.span, f.span - f.stamps, f.longest) == (gaps.weekdays, gaps.absent, gaps.longest) == (11, 7, 7)


def test_warnings(spark):
    rows = spark.createDataFrame([("u", "2020-01-01", "1", 1), ("u", "2021-01-01", "2", 1), ("u", "2021-01-01", "3", 1)], "unique_id string, ds string, y string, other int")
    said = [r.warning for r in series.warnings(rows, SeriesConfig(id="u", start="2020-06-01", duplicates="mean")).collect()]
    assert len(said) == 3 and any("before 2020-06-01 dropped: 1" in x for x in said) and any("by mean: 1" in x for x in said) and any("other" in x for x in said)


def test_period_labels(spark):
    r = spark.range(1).select(*[series.period_label(F.lit(n), f).alias(f) for f, n in (("monthly", 2020 * 12 + 4), ("quarterly", 2020 * 4 + 1), ("weekly", 1), ("trading_days", 4))]).first()
    assert (r.monthly, r.quarterly, r.weekly, r.trading_days) == ("2020-05", "2020Q2", "1970-01-12/1970-01-18", "1970-01-09")


def test_pit(spark):
    rows = [(0, -3.0, -2.0, -1.0, 1.0, 2.0), (1, 0.0, -2.0, -1.0, 1.0, 2.0), (2, 1.5, -2.0, -1.0, 1.0, 2.0), (3, 9.0, -2.0, -1.0, 1.0, 2.0), (4, 0.0, -2.0, 1.0, -1.0, 2.0), (5, 0.0, None, -1.0, 1.0, 2.0), (6, 2.0, -2.0, -1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, y_true double, lo_95 double, lo_80 double, hi_80 double, hi_95 double")
    got = {r.k: r.pit for r in calibration.pit(df, (0.8, 0.95)).collect()}
    assert got[0] == pytest.approx(0.025) and got[1] == pytest.approx(0.5) and got[2] == pytest.approx((0.9 + 0.975) / 2) and got[3] == got[6] == pytest.approx(0.975) and got[4] is None and got[5] is None


def test_confidence_set_of_buckets(spark):
    rng = np.random.default_rng(7)
    rows = [("u", "w", m, t, h, 0.0, float(rng.normal() * (1 + k))) for k, m in enumerate("ab") for t in range(40) for h in (1, 2, 3, 4) if not (m == "b" and t == 5 and h == 4)]
    df = spark.createDataFrame(rows, "unique_id string, window string, model string, origin_t long, h long, y_true double, y_pred double")
    loss = scoring.bucket_losses(df, 1, 4).collect()
    assert {r.bucket for r in loss} == {"very_short", "short", "long"} and not [r for r in loss if r.bucket == "long" and r.origin_t == 5]
    one = next(r for r in loss if r.bucket == "short" and r.model == "a" and r.origin_t == 3)
    assert one.loss == pytest.approx(np.mean([abs(x[6]) for x in rows if x[2] == "a" and x[3] == 3 and x[4] in (2, 3)])) and one.h_last == 3
    got = bucket_confidence_set(df, 1, 4, 1).collect()
    assert len(got) == 6 and {r.mcs_n for r in got if r.bucket == "long"} == {39} and all(r.mcs_in for r in got if r.model == "a")


def test_ranking_and_last_origin(spark):
    rows = [("u", "w", m, t, 1, "dev", "ok", False, 1.0, p, lo, 1.0) for t in range(3) for m, p, lo in (("naive", 1.0, 0.5), ("theta", 2.0, None), ("ets", 2.0, 0.5), ("ar", 4.0, 0.5))]
    df = spark.createDataFrame(rows, "unique_id string, window string, model string, origin_t long, h long, origin_role string, status string, y_true_missing boolean, y_true double, y_pred double, lo_80 double, mase_scale double")
    got = {r.model: (r.rank, r.chosen) for r in scoring.candidate_ranking(df.where("model <> 'ets'")).collect()}
    assert got == {"theta": (1, "point"), "ar": (2, "intervals")}
    assert [r.model for r in scoring.candidate_ranking(df).orderBy("rank").collect()] == ["ets", "theta", "ar"]
    assert {r.origin_t for r in scoring.latest_origin(df).collect()} == {2}
    choice = verdicts.chosen(df.where("model <> 'ets'")).first()
    assert (choice.candidate, choice.interval_model) == ("theta", "ar")


@pytest.fixture(scope="module")
def choice(spark):
    return spark.createDataFrame([("u", "w", "c", "c"), ("v", "w", None, None)], "unique_id string, window string, candidate string, interval_model string")


def answers(df):
    return {r.unique_id: r.answer for r in df.collect()}


def test_verdicts(spark, choice):
    def point(ps, mae=(1.0, 1.0, 1.0)):
        rows = [("u", "w", "c", h, 0.9, p, m, "naive") for h, (p, m) in enumerate(zip(ps, mae), 1)] + [("u", "w", "ets", h, 1.0, 0.5, 1.0, "naive") for h in (1, 2, 3)]
        return spark.createDataFrame(rows, "unique_id string, window string, model string, h long, rel_mae double, dm_p_better_holm double, mae double, reference string")

    for ps, want, then in (((0.01, 0.02, 0.03), "yes", "proceed"), ((0.01, 0.5, None), "partly", "proceed, restricted"), ((0.5, 0.5, 0.5), "no", "stop modelling"), ((None, None, None), "not testable", "stop modelling")):
        first = verdicts.beats_reference(point(ps), choice)
        assert answers(first) == {"u": want, "v": "not answerable"}
        assert answers(verdicts.exit_decision(point(ps), first, False)) == {"u": then, "v": "no decision"}
    assert answers(verdicts.exit_decision(point((0.01, 0.01, 0.01), (1.0, 0.69, 1.0)), first, False))["u"] == "leakage audit"
    assert answers(verdicts.exit_decision(point((0.01, 0.01, 0.01), (1.0, 0.71, 1.0)), first, False))["u"] != "leakage audit"

    h_star = spark.createDataFrame([("u", "w", "c", 2)], "unique_id string, window string, model string, h_star long")
    skill = spark.createDataFrame([("u", "w", "c", 1, 0.2, 0.1, 0.3)], "unique_id string, window string, model string, h long, skill double, lo double, hi double")
    assert answers(verdicts.reach(h_star, skill, choice)) == {"u": "h* = 2", "v": "not answerable"}

    def buckets(*rows):
        return spark.createDataFrame([("u", "w", "c", *r) for r in rows], "unique_id string, window string, model string, bucket string, level double, n_eff double, coverage double, band_lo double, band_hi double, kupiec_p double")

    fine, low, high, thin = ("a", 0.8, 50.0, 0.8, 0.7, 0.9, 0.9), ("b", 0.8, 50.0, 0.6, 0.7, 0.9, 0.9), ("c", 0.95, 50.0, 0.99, 0.9, 1.0, 0.01), ("d", 0.8, 9.5, 0.1, 0.7, 0.9, 0.0)
    for rows, want in (((fine, thin), "calibrated"), ((fine, low), "under-covers"), ((fine, high), "over-covers"), ((low, high), "miscalibrated"), ((thin,), "not answerable")):
        assert answers(verdicts.covers(buckets(*rows), choice)) == {"u": want, "v": "not answerable"}

    summary = spark.createDataFrame([("u", "w", "c", 0.6, 0.2, None)], "unique_id string, window string, model string, lb_reject_share double, lb_2m_reject_share double, arch_reject_share double")
    assert answers(verdicts.residuals(summary, choice))["u"] == "autocorrelation yes, ARCH n/a"
    assert answers(verdicts.residuals(summary.withColumn("lb_reject_share", F.lit(0.1)).withColumn("arch_reject_share", F.lit(0.05)), choice))["u"] == "autocorrelation mixed, ARCH no"

    sub = spark.createDataFrame([("u", "w", "c", 1, b, 0.9 if b < 3 else 1.1) for b in range(4)], "unique_id string, window string, model string, h long, block int, rel_mae double")
    for ratio, r, e, want in ((0.9, 0.01, 0.9, "rolling wins"), (1.1, 0.9, 0.01, "stable"), (1.0, 0.5, 0.5, "no significant gap")):
        gap = spark.createDataFrame([("u", "w", "c", 1, ratio, r, e)], "unique_id string, window string, model string, h long, ratio double, p_rolling_better_holm double, p_expanding_better_holm double")
        got = verdicts.windows_and_time(gap, sub, choice).where("unique_id = 'u'").first()
        assert got.answer == want and "3 of 4" in got.detail

    counts = spark.createDataFrame([("u", "log", 95, 0.95), ("u", "none", 5, 0.05)], "unique_id string, family string, n long, share double")
    assert answers(verdicts.transforms(counts, choice, "auto")) == {"u": "log", "v": "not applicable"} and answers(verdicts.transforms(counts, choice, "log"))["u"] == "log (configured)"
    assert answers(verdicts.transforms(counts.withColumn("share", F.lit(0.5)), choice, "auto"))["u"] == "mixed"

    first = verdicts.beats_reference(point((0.01, 0.02, 0.03)), choice)
    said = first.unionByName(verdicts.exit_decision(point((0.01, 0.02, 0.03)), first, False))
    got = {(r.unique_id, r.criterion): r.result for r in verdicts.criteria(point((0.01, 0.02, 0.03)), buckets(fine, low), sub, h_star, said, choice, {0.8: (0.7, 0.9)}).collect()}
    assert [got["u", k] for k in ("1 accuracy", "3 calibration", "5 stability", "decision")] == ["pass", "fail", "pass", "GO"]
    assert [got["v", k] for k in ("1 accuracy", "3 calibration", "5 stability", "decision")] == ["n/a", "n/a", "n/a", "NO DECISION"]


def test_beats(spark):
    rng = np.random.default_rng(1)
    rows = [("u", "w", m, "naive", t, 1, a, b) for t in range(60) for b in [abs(rng.normal()) + 0.1] for m, a in (("naive", b), ("good", 0.2 * b), ("same", b + 0.01 * rng.normal()))]
    df = spark.createDataFrame(rows, "unique_id string, window string, model string, reference string, origin_t long, h long, d_a double, d_b double")
    got = {r.model: r for r in verdicts.beats(df, (1,), 1).collect()}
    assert set(got) == {"good", "same"} and got["good"].hit and not got["same"].hit and got["good"].p_holm == pytest.approx(min(1, 2 * got["good"].p_better))


def test_chart():
    svg = line_chart("a < b", {"m": [(1, 0.9), (2, 1.1)], "n": [(1, 1.0), (2, None)]}, "h", "ratio", 1.0)
    assert svg.startswith("<svg") and svg.count("<polyline") == 3 and "a &lt; b" in svg and "no data" in line_chart("x", {}, "h", "y")


def test_shapes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60_000)
    assert abs(studies.excess_kurtosis(x)) < 0.1 and studies.linear_ratio(x, 10, 20) == pytest.approx(1, abs=0.05)
    ar = affine_scan(np.full(60_000, 0.5), x, 0.0)
    assert studies.linear_ratio(ar, 2, 4) == pytest.approx(math.sqrt(1 + 2 * 2 * 0.5 / 4), abs=0.02)
    r = Synthetic("garch11_returns", 1, n=600).values().tolist()
    shapes = studies.path_shapes(spark.createDataFrame([("u", 1, r), ("u", 2, r[:500])], "unique_id string, origin_t long, r array<double>"), "ewma", "ewma_block", 10, 4000)
    got = studies.shape_summary(shapes).first()
    assert got.n == 2 and 0.7 < got.sd_ratio_median < 1.4 and got.sd_ratio_min <= got.sd_ratio_max
    rows = [("u", "w", m, t, 1, "ok", -w, w) for t, k in enumerate((1.0, 1.2, 1.4)) for m, w in (("a", 1.0), ("b", k))]
    df = spark.createDataFrame(rows, "unique_id string, window string, model string, origin_t long, h long, status string, lo_80 double, hi_80 double")
    p = studies.paired_widening(df, "a", "b", (0.8,)).first()
    assert (p.n, p.mean, p.median) == (3, pytest.approx(1.2), pytest.approx(1.2)) and p.width_share == pytest.approx(1 - (1 + 1 / 1.2 + 1 / 1.4) / 3)


def test_index_downloads(spark, tmp_path):
    from foresail.sources import download
    from foresail.sources.canonical import read_csv

    csv = b"Date,Open,High,Low,Close,Volume\n2024-01-05,1,1,1,10.5,5\n2024-01-06,1,1,1,99,5\n2024-01-08,1,1,1,11,5\n2024-01-08,1,1,1,12,5\n2024-01-09,1,1,1,N/D,5\n"
    chart = b'{"chart":{"result":[{"meta":{"gmtoffset":-18000},"timestamp":[1704461400,1704720600],"indicators":{"quote":[{"close":[10.5,null]}]}}]}}'
    assert download.yahoo_closes(chart) == [("2024-01-05", 10.5)]
    sources = download.index_sources("^spx", "^GSPC")
    asked = []

    def fetch(url):
        asked.append(url)
        if "stooq" in url:
            raise OSError("no network")
        return chart

    assert download.first_that_answers(sources, fetch) == [("2024-01-05", 10.5)] and len(asked) == 2 and "%5Espx" in asked[0]
    with pytest.raises(AdapterError, match="no table of closes.*no chart"):
        download.first_that_answers(sources, lambda _: b"<html>")
    df = download.closes(spark, download.first_that_answers(sources, lambda _: csv))
    assert [(str(r.ds)[:10], r.y) for r in df.orderBy("ds").collect()] == [("2024-01-05", 10.5), ("2024-01-08", 12.0)]
    download.write_closes(df, str(tmp_path / "spx"))
    config = SeriesConfig(id="spx", columns={"date": "Date", "value": "Close"})
    assert [(r.ds, r.y) for r in read_csv(spark, str(tmp_path / "spx"), config).orderBy("ds").collect()] == [("05 Jan 2024", "10.5"), ("08 Jan 2024", "12.0")]
