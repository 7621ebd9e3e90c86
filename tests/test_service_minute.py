"""Minute factors through the service, tail events, cash, liquidity and keys."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import factors_minute as fm
from plumbline.functions.registry import compute, resolve
from plumbline.operators import bars as B
from plumbline.operators import portfolio
from plumbline.plans import pipeline as P
from plumbline.plans import service
from plumbline.plans.policy import View, minutes_at
from plumbline.sources import harness, stores

SMALL = {
    "jump_amount_corr": dict(days=5, bar_seconds=900, z=0.0, least=2), "minute_ideal_amp": dict(days=5, least=4), "amp_marginal_anomaly_vol": dict(days=5, least=4, selected=2),
    "intraday_amp_cut": dict(days=5, least_bars=3, least_days=2), "volume_peak_count": dict(classifiable=1, least_days=1, baseline=5, least=2, bar_seconds=900), "mmp_ew": dict(window=3), "intraday_ret": {},
    "peak_interval_kurtosis": dict(classifiable=1, least_days=1, least_gaps=4, baseline=5, least=2, bar_seconds=900), "valley_price_quantile": dict(valley=1, least_days=1, baseline=5, least=2, bar_seconds=900),
}


@pytest.fixture(scope="module")
def bars(spark):
    return harness.bars(spark, "/root/testdata/sf0.01", 15).persist()


def test_every_minute_factor_is_bound():
    assert set(service.BINDINGS) == set(fm.MINUTE) and service.is_valid_day_pooled("volume_peak_count") and not service.is_valid_day_pooled("mmp_ew")
    with pytest.raises(KeyError, match="bound"):
        service.binding("unheard_of")


@pytest.mark.parametrize("factor", ["intraday_ret", "jump_amount_corr", "volume_peak_count", "intraday_amp_cut"])
def test_served_values_equal_the_factor_on_all_bars(spark, bars, tmp_path, factor):
    params, symbols = SMALL[factor], sorted(r[0] for r in bars.select("symbol").distinct().collect())
    days = sorted(r[0] for r in bars.select("trade_date").distinct().collect())
    start, end = str(days[len(days) // 2]), str(days[-1])
    svc = service.MinuteService(bars, stores.FactorValueStore(spark, f"file://{tmp_path}/v"), params={factor: params})
    second = {"least_names": 2} if factor == "intraday_amp_cut" else {}
    got = svc.panel(factor, symbols, start, end, **second)
    made = service.binding(factor).stage(minutes_at(bars, View.DECISION), **params)
    want = service.combine(made.where(F.col("trade_date") >= F.to_date(F.lit(start))), factor, symbols, **second)
    rows = lambda df: {(r.trade_date, r.symbol): round(r.value, 9) for r in df.where("value IS NOT NULL").collect()}
    first = rows(got)
    assert first == rows(want) and first
    assert rows(svc.panel(factor, symbols, start, end, **second)) == first and svc.computed == [factor]
    with pytest.raises(ValueError):
        svc.panel(factor, symbols, start, end, basis="close_to_close")


def test_reversal_needs_daily_prices(spark, bars, tmp_path):
    svc = service.MinuteService(bars, stores.FactorValueStore(spark, f"file://{tmp_path}/v"), params={"valley_price_quantile": SMALL["valley_price_quantile"]})
    with pytest.raises(ValueError, match="daily"):
        svc.panel("valley_price_quantile", ["x"], "2020-01-01", "2020-01-02")


D = [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 29)]


def test_tail_events_need_limits_and_count_what_is_blocked(spark):
    anchors = spark.createDataFrame(list(zip(D, D[1:], strict=False)), "entry date, exit date")
    prices = {"a": (10.0, 11.0, 12.0), "b": (10.0, 5.0, 6.0), "c": (None, 4.0, 4.0)}
    adj = {"a": (1.0, 1.0, 2.0), "b": (1.0, 2.0, 2.0), "c": (1.0, 1.0, 1.0)}
    bars = spark.createDataFrame([(D[k], s, p, adj[s][k]) for s, ps in prices.items() for k, p in enumerate(ps)], "date date, symbol string, price double, adj_factor double")
    limits = spark.createDataFrame([(D[0], "a", 10.0, 8.0), (D[0], "b", 12.0, 10.0), (D[1], "a", 12.0, 9.0), (D[1], "b", 12.0, 4.0)], "date date, symbol string, up_limit double, down_limit double")
    with pytest.raises(ValueError, match="1 entries"):
        P.tail_events(anchors, bars, bars, limits)
    e = {(r.date, r.symbol): r for r in P.tail_events(anchors, bars, bars, limits, require_coverage=False).collect()}
    a, b, c = (e[D[0], s] for s in "abc")
    assert (a.can_buy, a.can_sell, b.can_buy, b.can_sell, c.can_buy, c.can_sell) == (False, True, True, False, False, False)
    assert (round(a.ret, 9), round(b.ret, 9), c.ret) == (0.1, 0.0, 0.0) and round(e[D[1], "a"].ret, 9) == round(24 / 11 - 1, 9)
    n = {r.date: r for r in P.event_counts(P.tail_events(anchors, bars, bars, limits, require_coverage=False)).collect()}[D[0]]
    assert (n.names, n.no_bar, n.up_blocked, n.down_blocked, n.both_ways) == (3, 1, 1, 1, 0)
    assert P.tail_events(anchors, bars, bars).where("at_up OR at_down").count() == 0
    assert P.limit_coverage(bars.where("price > 0"), limits).first().asDict() == {"required": 8, "present": 4, "missing": 4}


def test_idle_cash_earns(spark):
    rows = [("s", D[0], "a", 0.5, True, True, 0.1), ("s", D[1], "a", 0.0, True, True, 0.1)]
    orders = spark.createDataFrame(rows, "strategy string, date date, symbol string, target double, can_buy boolean, can_sell boolean, ret double")
    got = [r.gross_return for r in portfolio.simulate(orders, portfolio.Costs(0.0, cash=0.01)).orderBy("date").collect()]
    assert got == pytest.approx([0.05 + 0.005, 0.01])
    assert P.derive_cell_config(P.StudyConfig(), {"top_n": 1}).top_n == 1
    with pytest.raises(ValueError):
        P.derive_cell_config(P.StudyConfig(), {"nothing": 1})


def test_liquidity_summary_and_the_most_constrained(spark):
    rows = [(D[0], "a", 0.0, 0.5, True, True, 100.0), (D[0], "b", 0.5, 0.0, True, False, 100.0), (D[0], "c", 0.0, 0.1, True, True, None), (D[1], "a", 0.2, 0.2, True, True, 1.0), (D[1], "d", 0.1, 0.3, True, True, 5000.0), (D[1], "e", 0.0, 0.5, True, True, 100.0)]
    t = B.liquidity_diagnostics(spark.createDataFrame(rows, "date date, symbol string, current double, target double, can_buy boolean, can_sell boolean, amount double"), 1000.0)
    s = B.liquidity_summary(t).first()
    assert (s.trades, s.blocked, s.missing, s.inspected, s.below) == (5, 1, 1, 3, 2) and s.least == pytest.approx(0.02) and s.median == pytest.approx(0.02) and s.p90 == pytest.approx(0.02 + 0.8 * (2.5 - 0.02))
    assert [(r.date, r.symbol) for r in B.most_constrained(t, 2).collect()] == [(D[0], "a"), (D[1], "e")]


def test_keys_variants_and_stores(spark, tmp_path):
    key = lambda **k: service.artifact_key(**{**dict(universe="u", start="2024-01-01", end="2024-02-01", symbols=["b", "a"], dates=["2024-01-02"], params={"lag": 1}), **k})[0]
    assert key() == key(symbols=["a", "b"]) and len({key(), key(params={"lag": 2}), key(dates=["2024-01-03"]), key(universe="v")}) == 4
    spec = resolve("momentum_20")[0]
    twin = service.intraday_spec_variant(spec)
    assert twin.intraday and twin.name == spec.name
    with pytest.raises(ValueError):
        service.intraday_spec_variant(twin)
    assert service.open_value_store(spark, "demo", "/s", "/e").root == "/e/demo" and service.open_value_store(spark, "files", "/s", "/e").root == "/s/files"
    with pytest.raises(ValueError):
        service.open_value_store(spark, "unknown", "/s", "/e")


def test_recompute_and_financial_factors(spark):
    panel = stores.demo_panel(spark, 60).withColumn("roe", F.lit(0.1))
    full = service.recompute_fn("momentum_5")(panel)
    old = full.where("date < '2024-03-01'")
    new = stores.tail_recompute(old, service.recompute_fn("momentum_5"), panel, 6, 3, "2024-03-01")
    assert new.exceptAll(full).count() == 0 and new.count() == full.count()
    assert compute(panel, ["roe"]).where("roe = 0.1").count() == panel.count()


def test_a_corrupt_store_is_a_miss(spark, tmp_path):
    store, key = stores.FactorValueStore(spark, f"file://{tmp_path}/v"), ("f", {}, "1", "close")
    grid = spark.createDataFrame([(D[0], "a"), (D[1], "a")], "date date, symbol string")
    calls = []

    def compute_(lack):
        calls.append(lack.count())
        return lack.withColumn("value", F.lit(1.5))

    assert [r.value for r in store.serve(key, grid, compute_).collect()] == [1.5, 1.5] and calls == [2]
    store.serve(key, grid, compute_)
    assert calls == [2]
    for f in (tmp_path / "v").glob("*/v-*/*.parquet"):
        f.write_bytes(b"no parquet")
        crc = f.with_name(f".{f.name}.crc")
        if crc.exists():
            crc.unlink()
    assert store.read_valid(key) is None
    assert [r.value for r in store.serve(key, grid, compute_).collect()] == [1.5, 1.5] and calls == [2, 2]
    assert store.serve(("g", {}, "1", "close"), grid.limit(0), compute_).count() == 0
