"""What the queries of fitted models are registered with."""

import pytest

from foresail import queries
from foresail.config import parse_series
from foresail.errors import ConfigError
from foresail.operators import backtest
from foresail.plans.panels import DAILY, MONTHLY

SMALL = "/root/testdata/sf0.001"
FITTED = {
    "fc_sarima": MONTHLY, "fc_ets": MONTHLY, "fc_combination": MONTHLY, "transform_counts": MONTHLY, "fc_fhs": DAILY, "fc_garch": DAILY, "fc_gjr_garch": DAILY,
    "fc_garch_normal": DAILY, "sim_cumulative": DAILY, "sim_block": DAILY, "sim_parameter_uncertainty": DAILY, "es_backtest": DAILY,
}


class Caught(Exception):
    pass


@pytest.fixture
def asked(spark, monkeypatch):
    """The configuration and the other arguments with which a query asks for forecasts."""

    def caught(dense, config, levels, **others):
        raise Caught(config, others)

    monkeypatch.setattr(backtest, "fitted_forecasts", caught)

    def run(name):
        with pytest.raises(Caught) as e:
            queries.QUERIES[name](spark, SMALL)
        return e.value.args

    return run


@pytest.mark.parametrize("name", sorted(FITTED))
def test_every_origin_of_the_panel(asked, name):
    config, _ = asked(name)
    facts = lambda c: (c.windows, c.origin_step, c.n_dev, c.n_test, c.initial_window, c.rolling_length)
    assert facts(config) == facts(FITTED[name])


def test_combination_has_all_members(asked):
    config, _ = asked("fc_combination")
    assert {"ets", "sarima", "theta", "combination"} <= set(config.models)
    raw = {"id": "a", "source": "csv:a.csv", "freq": "monthly", "H": 12}
    for absent in ("ets", "sarima", "theta"):
        with pytest.raises(ConfigError, match=absent):
            parse_series(raw | {"models": [x for x in ("ets", "sarima", "theta", "combination") if x != absent]}, [])
    assert parse_series(raw | {"models": ["ets", "sarima", "theta", "combination"]}, []).models[-1] == "combination"


def test_operators_defaults_apply(asked, spark, monkeypatch):
    assert all("n_paths" not in asked(name)[1] for name in ("fc_fhs", "fc_garch", "sim_cumulative", "es_backtest"))
    for name, operator, most in (("skill_bootstrap", "bootstrap_skill", 2), ("h_star", "bootstrap_skill", 2), ("mcs", "model_confidence_set", 2)):
        def caught(*args, **others):
            raise Caught(args, others)

        monkeypatch.setattr(backtest, operator, caught)
        with pytest.raises(Caught) as e:
            queries.QUERIES[name](spark, SMALL)
        assert len(e.value.args[0]) == most and not e.value.args[1]
