"""The verdict's truth table, the declarations, and the sections of the report."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from plumbline.operators import evaluation as ev
from plumbline.operators.verdict import Thresholds, VerdictInputs, aligned_nets, decide, monotone
from plumbline.plans.report import EvalConfig, EvalContext, check_grid, evaluate_factor

GOOD = dict(
    sign=1, n_rebalances=600, n_eff=500.0, span_days=2000, icir=0.5, icir_ci=(0.4, 0.6), t=3.0, win=0.6, monotonicity=0.5, monotonicity_ci=(0.4, 0.6), oos_available=True, oos_sign_ok=True,
    book=True, incremental_icir=0.3, incremental_ci=(0.2, 0.4), gross=0.02, net_by_cost=((1.0, 0.01), (2.0, 0.0)), tradable=True, capacity_sufficient=True,
)


def verdict(**k):
    return decide(VerdictInputs(**{**GOOD, **k}))


def axes(**k):
    v = verdict(**k)
    return v.predictive, v.incremental, v.tradable, v.decision


def test_all_axes_pass():
    assert axes() == ("PASS", "PASS", "PASS", "Adopt")
    assert verdict(exploratory=True).decision == "Watch"
    mirrored = dict(sign=-1, icir=-0.5, icir_ci=(-0.6, -0.4), t=-3.0, monotonicity=-0.5, monotonicity_ci=(-0.6, -0.4), incremental_icir=-0.3, incremental_ci=(-0.4, -0.2), gross=-0.02, net_by_cost=((1.0, -0.03),))
    assert axes(**mirrored) == ("PASS", "PASS", "PASS", "Adopt")


def test_any_failed_axis_rejects():
    assert axes(capacity_sufficient=False) == ("PASS", "PASS", "FAIL", "Reject")
    assert axes(net_by_cost=((1.0, -0.01), (2.0, -0.02)))[2:] == ("FAIL", "Reject")
    assert axes(incremental_icir=0.01) == ("PASS", "FAIL", "PASS", "Reject")
    assert axes(icir=0.1)[0] == "FAIL" and axes(oos_sign_ok=False)[3] == "Reject"
    assert axes(monotonicity_ci=(-0.3, -0.1))[0] == "FAIL"


def test_a_known_reversal_fails_before_the_sample_is_asked():
    assert axes(n_eff=3.0, oos_sign_flipped=True) == ("FAIL", "INSUFFICIENT_DATA", "PASS", "Reject")
    assert verdict(oos_available=False, oos_sign_flipped=True).predictive == "INSUFFICIENT_DATA"


def test_open_axes():
    assert axes(oos_available=False) == ("INSUFFICIENT_DATA", "PASS", "PASS", "Watch")
    assert axes(n_eff=None, tradable=None, capacity_sufficient=None) == ("INSUFFICIENT_DATA", "INSUFFICIENT_DATA", "NOT_ASSESSED", "INSUFFICIENT-DATA")
    assert axes(icir_ci=(0.1, 0.9))[0] == "INSUFFICIENT_DATA" and axes(icir_ci=None)[0] == "INSUFFICIENT_DATA"
    assert axes(monotonicity_ci=(-0.1, 0.1))[0] == "INSUFFICIENT_DATA"
    assert axes(monotonicity_ci=(-0.1, 0.1), win=0.5)[0] == "FAIL", "an unknown order rescues nothing"
    assert axes(book=False)[1] == "NOT_ASSESSED" and axes(incremental_icir=None)[1] == "INSUFFICIENT_DATA"
    assert axes(capacity_sufficient=None)[2] == "INSUFFICIENT_DATA" and axes(net_by_cost=((1.0, None),))[2] == "INSUFFICIENT_DATA"


def test_costs_stay_costs_when_the_legs_turn_round():
    v = VerdictInputs(-1, gross=-0.05, net_by_cost=((1.0, -0.06), (2.0, -0.07)))
    assert {k: round(x, 9) for k, x in aligned_nets(v).items()} == {1.0: 0.04, 2.0: 0.03}
    assert aligned_nets(VerdictInputs(-1, net_by_cost=((1.0, -0.06),))) == {}


def test_order_of_buckets_falls_back():
    bar = Thresholds()
    assert monotone(VerdictInputs(1, monotonicity=0.1), bar) and not monotone(VerdictInputs(1, monotonicity=-0.1), bar)
    assert monotone(VerdictInputs(-1, pooled_monotonicity=-1.0), bar) and monotone(VerdictInputs(1), bar) is False


def test_declarations_are_checked():
    ok = dict(universe="u", universe_is_pit=True, start="2020-01-01", end="2020-12-31", is_exploratory=False, post_hoc_selected=False)
    c = EvalConfig(**ok)
    assert c.long_short == (5, 1) and c.periods_per_year == 252 and c.criteria == Thresholds()
    bad = (dict(universe=" "), dict(universe_is_pit=1), dict(post_hoc_selected=True), dict(n_quantiles=1), dict(long_short=(1, 5)), dict(cost_scenarios=(2.0,)), dict(cost_scenarios=(1.0, -1.0)),
           dict(view="decision"), dict(oos_split="soon"), dict(n_factors_screened=0), dict(max_participation_rate=0.0), dict(success_criteria=0.3))
    for b in bad:
        with pytest.raises((ValueError, KeyError)):
            EvalConfig(**{**ok, **b})
    for t in (dict(min_win=1.0), dict(min_n_eff=0.5), dict(min_t=-1.0), dict(min_icir=float("nan"))):
        with pytest.raises(ValueError):
            Thresholds(**t)


def test_the_grid_must_be_as_declared():
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(10)]
    assert check_grid("daily", days).startswith("OK") and check_grid("hourly", days).startswith("NOT") and check_grid("daily", days[:1]).startswith("NOT")
    with pytest.raises(ValueError, match="apart"):
        check_grid("monthly", days)


def test_effective_samples_keep_gaps_and_a_floor_of_lags():
    rng = np.random.default_rng(1)
    x = [float(v) for v in rng.normal(size=200)]
    x[50] = x[51] = None
    d = np.array([0 if v is None else v for v in x]) - np.where([v is None for v in x], 0, np.mean([v for v in x if v is not None]))
    rho = np.array([d[k:] @ d[: len(d) - k] for k in range(198)]) / (d @ d)
    lag = ev.newey_west_lag(198)
    cut = next((k for k in range(lag + 1, 198) if rho[k] <= 0), 198)
    assert ev.effective_sample_size(x) == pytest.approx(min(198, max(1, 198 / (1 + 2 * rho[1:cut].sum()))))
    assert ev.effective_sample_size([]) == 0 and ev.effective_sample_size([None, 2.0]) == 1 and ev.effective_sample_size([0.1] * 9) == 1
    assert ev.effective_sample_size([1.0, -1.0] * 30) == 60


def test_a_planted_signal_makes_the_report(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(400):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=k)
        f = rng.normal(size=15)
        r = 0.01 * (f + rng.normal(size=15))
        rows += [(day, f"s{i:02d}", float(f[i]), float(r[i]) if k < 399 else None, float(rng.normal())) for i in range(15)]
    df = spark.createDataFrame(rows, "date date, symbol string, f double, fwd double, other double")
    cfg = EvalConfig("all", True, "2020-01-01", "2021-02-03", False, False, oos_split="2020-10-01", n_factors_screened=5)
    ctx = EvalContext(known_factors=("other",), universe_symbols=("s00", "gone"), execution_capacity={"tradable": True, "capacity_sufficient": True}, min_history_bars=2)
    r = evaluate_factor(df, "f", 1, cfg, ctx)
    s = r.sections
    assert r.verdict["decision"] == "Adopt" and (r.verdict["predictive"], r.verdict["incremental"], r.verdict["tradable"]) == ("PASS",) * 3
    assert s["predictive_power"]["ic_mean"] > 0.5 and abs(s["predictive_power"]["stale"][1]) < 0.1 and s["predictive_power"]["periods"] == 399
    risk = s["return_risk"]
    assert list(risk["bucket_mean"].values()) == sorted(risk["bucket_mean"].values()) and risk["pooled_monotonicity"] == 1.0
    assert risk["net_by_cost"][1.0] - risk["net_by_cost"][4.0] == pytest.approx(3 * s["stability_cost"]["cost"][1.0], rel=0.01)
    assert s["stability_cost"]["cost_a_year"][2.0] == pytest.approx(504 * s["stability_cost"]["cost"][1.0])
    assert s["oos_generalization"]["sign_ok"] and s["oos_generalization"]["never_realised"] == 1
    assert s["data_coverage"]["dropped"] == 1 and s["data_coverage"]["warm_up_rows"] == 30 and s["data_coverage"]["size_median"] == 15
    assert s["caveats"]["bonferroni_alpha"] == 0.01 and "out-of-sample" not in " ".join(s["caveats"]["items"])
    assert "verdict" in r.to_markdown() and '"decision": "Adopt"' in r.to_json() and r.summary()["decision"] == "Adopt"
    with pytest.raises(ValueError, match="apart"):
        evaluate_factor(df, "f", 1, EvalConfig("all", True, "a", "b", False, False, rebalance="monthly"))
    empty = evaluate_factor(df.withColumn("fwd", df.fwd * math.nan), "f", 1, cfg, EvalContext())
    assert empty.sections["predictive_power"] is None and empty.sections["return_risk"] is None and empty.verdict["decision"] == "INSUFFICIENT-DATA"
