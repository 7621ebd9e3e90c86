from __future__ import annotations

import datetime as dt
import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import factors_minute as fm
from plumbline.functions.registry import FactorSpec, compute, names, register, resolve
from plumbline.operators import bars as B
from plumbline.operators import evaluation as ev
from plumbline.operators import pit, portfolio, quality, xsection
from plumbline.plans import policy, service
from plumbline.sources import feeds, stores


def D(s):
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def panel(spark):
    return stores.demo_panel(spark, 60)


def values(df, *keys, value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


# point-in-time joins


def test_asof_takes_the_whole_latest_row(spark):
    left = spark.createDataFrame([("a", D("2024-01-05")), ("a", D("2024-01-10")), ("a", D("2024-01-01")), ("b", D("2024-01-05"))], "symbol string, date date")
    right = spark.createDataFrame([("a", D("2024-01-02"), 1, 1.0), ("a", D("2024-01-05"), 2, None), ("a", D("2024-01-05"), 1, 9.0), ("a", D("2024-01-11"), 3, 7.0)], "symbol string, ann date, end int, v double")
    got = pit.asof_backward(left, right, "symbol", "date", "ann", ["end", "v"], ["end"])
    assert {(r.symbol, r.date.isoformat()): (r.end, r.v) for r in got.collect()} == {("a", "2024-01-05"): (2, None), ("a", "2024-01-10"): (2, None), ("a", "2024-01-01"): (None, None), ("b", "2024-01-05"): (None, None)}
    later = right.union(spark.createDataFrame([("a", D("2024-02-01"), 9, 99.0)], right.schema))
    assert sorted(pit.asof_backward(left, later, "symbol", "date", "ann", ["end", "v"], ["end"]).collect()) == sorted(got.collect())


def test_interval_ends(spark):
    left = spark.createDataFrame([("a", D("2024-01-10"))], "symbol string, date date")
    spans = spark.createDataFrame([("a", "x", None, D("2024-01-10")), ("a", "y", D("2024-01-10"), None), ("a", "w", D("2024-01-01"), None)], "symbol string, name string, valid_from date, valid_to date")
    assert pit.interval_join(left, spans, ["name"]).first().name == "y"
    only = spans.where("name = 'x'")
    assert pit.interval_join(left, only, ["name"]).first().name is None
    assert pit.interval_join(left, only, ["name"], closed=True).first().name == "x"


def test_intervals_touch_and_subtract(spark):
    rows = [("k", D("2024-01-01"), D("2024-01-03")), ("k", D("2024-01-04"), D("2024-01-05")), ("k", D("2024-01-02"), D("2024-01-02")), ("k", D("2024-01-08"), D("2024-01-09"))]
    cov = spark.createDataFrame(rows, "key string, start date, end date")
    assert [(r.start.day, r.end.day) for r in pit.merge_intervals(cov, ["key"]).orderBy("start").collect()] == [(1, 5), (8, 9)]
    ask = spark.createDataFrame([("k", D("2024-01-03"), D("2024-01-12")), ("n", D("2024-01-01"), D("2024-01-02"))], "key string, start date, end date")
    got = sorted((r.key, r.start.day, r.end.day) for r in pit.subtract_intervals(ask, cov, ["key"]).collect())
    assert got == [("k", 6, 7), ("k", 10, 12), ("n", 1, 2)]


def test_front_adjustment_keeps_the_last_price(spark):
    p = spark.createDataFrame([(D("2024-01-01"), "a", 10.0, 1.0), (D("2024-01-02"), "a", 6.0, 2.0)], "date date, symbol string, close double, adj_factor double")
    out = pit.front_adjust(p, ("close",)).orderBy("date").collect()
    assert [r.close for r in out] == [5.0, 6.0]
    assert [r.x for r in p.withColumn("x", pit.ex_date()).orderBy("date").collect()] == [False, True]


def test_decision_view_sees_only_the_open(panel):
    lagged = policy.daily_at(panel, policy.View.DECISION).where("symbol = '000001.SZ'").orderBy("date").collect()
    assert lagged[1].open == 101.0 and lagged[1].close == 100.0 and lagged[0].close is None


def test_legal_views_and_horizons():
    assert policy.require_legal("decision", "exec_to_exec")
    with pytest.raises(ValueError):
        policy.require_legal("close", "exec_to_exec")
    assert policy.revision_horizon("minute_bars", 5) == 0 and policy.revision_horizon("limits", 5) is None
    with pytest.raises(ValueError):
        policy.revision_horizon("fina", 5)
    assert policy.seen("market_daily", "open", policy.View.DECISION) is policy.Seen.SAME_DAY


# factors


def test_registry():
    assert resolve("momentum_5")[2] == 5 and "momentum_{w}" in names()
    with pytest.raises(KeyError):
        resolve("momentum")
    with pytest.raises(KeyError):
        resolve("nothing_3")
    with pytest.raises(ValueError):
        register(FactorSpec("momentum", 1, lambda w: w, ()))
    with pytest.raises(ValueError):
        FactorSpec("x", 0, lambda w: w, ())


def test_daily_factors_against_pandas(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in ("a", "b"):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 40)))
        c[7] = np.nan
        for i in range(40):
            rows.append((D("2024-01-01") + dt.timedelta(days=i), s, float(c[i] * 1.01), None if math.isnan(c[i]) else float(c[i]), float(rng.uniform(1, 9))))
    p = spark.createDataFrame(rows, "date date, symbol string, open double, close double, amount double")
    got = compute(p, ["momentum_5", "reversal_5", "volatility_5", "liquidity_5", "overnight_mom_5"]).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    g = got.groupby("symbol")
    want = g["close"].transform(lambda x: x / x.shift(5) - 1)
    pd.testing.assert_series_equal(got["momentum_5"], want, check_names=False)
    pd.testing.assert_series_equal(got["reversal_5"], -want, check_names=False)
    ret = g["close"].transform(lambda x: x.ffill() / x.ffill().shift() - 1)
    pd.testing.assert_series_equal(got["volatility_5"], ret.groupby(got["symbol"]).transform(lambda x: x.rolling(5).std()), check_names=False, rtol=1e-9)
    pd.testing.assert_series_equal(got["liquidity_5"], g["amount"].transform(lambda x: np.log(x.rolling(5).mean())), check_names=False)
    gap = np.log(got["open"] / g["close"].shift())
    pd.testing.assert_series_equal(got["overnight_mom_5"], gap.groupby(got["symbol"]).transform(lambda x: x.rolling(5).sum()), check_names=False, rtol=1e-9)


def bars_of(spark, rows):
    """rows: (day, minute, symbol, open, high, low, close, volume, amount)"""
    data = [(D("2024-01-01") + dt.timedelta(days=d), s, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, minutes=m - 1), dt.datetime(2024, 1, 1) + dt.timedelta(days=d, minutes=m), dt.datetime(2024, 1, 1) + dt.timedelta(days=d, minutes=m + 1), m, o, h, low, c, v, a) for d, m, s, o, h, low, c, v, a in rows]
    return spark.createDataFrame(data, "trade_date date, symbol string, bar_start timestamp_ntz, bar_end timestamp_ntz, available_time timestamp_ntz, slot int, open double, high double, low double, close double, volume double, amount double")


def test_bars_after_the_cutoff_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(d, m, "a", 10.0, 11.0, 9.0, float(rng.uniform(9, 11)), float(rng.uniform(1, 5)), float(rng.uniform(1, 50))) for d in range(3) for m in range(880, 900)]
    changed = [r if r[1] < 890 else (*r[:3], 1.0, 99.0, 0.5, 50.0, 1e6, 1e6) for r in rows]
    f = lambda x: values(B.asof_features(policy.minutes_at(bars_of(spark, x), policy.View.DECISION)), "trade_date", "symbol", value="vwap")
    assert f(rows) == f(changed)
    assert f(rows) != f([(*r[:6], 12.0, *r[7:8], 1e6) if r[1] == 885 else r for r in rows])


def test_bar_classes(spark):
    rows = []
    for d in range(13):
        for m in range(600, 606):
            v = 100.0 + (d % 2) + m - 600
            if d == 12 and m == 602:
                v = 1000.0
            if d == 12 and m in (604, 605):
                v = 1000.0
            rows.append((d, m, "a", 10.0, 11.0, 9.0, 10.0, v, 1.0))
    got = {r.slot: r for r in B.classify(bars_of(spark, rows), 60, 20, 10).where("trade_date = '2024-01-13'").collect()}
    assert got[602].peak and not got[602].ridge
    assert got[604].ridge and got[605].ridge and not got[604].peak
    assert got[601].mild and got[603].mild
    early = B.classify(bars_of(spark, rows), 60, 20, 10).where("trade_date = '2024-01-05'").collect()
    assert not any(r.classifiable for r in early)


def test_resampled_label_and_completeness(spark):
    rows = [(0, m, "a", float(m), float(m) + 1, float(m) - 1, float(m) + 0.5, 1.0, 2.0) for m in (601, 602, 603, 604, 605, 606, 607)]
    a, b = B.resample(bars_of(spark, rows), 5).orderBy("bar_end").collect()
    assert (a.open, a.high, a.low, a.close, a.volume, a.complete) == (601.0, 606.0, 600.0, 605.5, 5.0, True)
    assert b.bar_end == dt.datetime(2024, 1, 1, 10, 7) and not b.complete


def test_sample_kurtosis_matches_pandas(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    s = [F.lit(float(sum(v**p for v in x))) for p in (1, 2, 3, 4)]
    got = spark.range(1).select(B.excess_kurtosis(F.lit(float(len(x))), *s)).first()[0]
    assert got == pytest.approx(pd.Series(x).kurt())


def test_minute_factors_are_per_symbol(spark):
    rng = np.random.default_rng(4)
    rows = [(d, 570 + 15 * k, s, float(rng.uniform(9, 11)), 11.5, 8.5, float(rng.uniform(9, 11)), float(rng.uniform(1, 9)), float(rng.uniform(1, 99))) for d in range(14) for k in range(12) for s in ("a", "b")]
    whole, part = bars_of(spark, rows), bars_of(spark, [r for r in rows if r[2] == "a"])
    for f in (lambda x: fm.jump_amount_corr(x, 20, 900, 0.5, 3), lambda x: fm.minute_ideal_amp(x, 5, 0.25, 10), lambda x: fm.amp_marginal_anomaly_vol(x, 5, 10, 2), lambda x: fm.volume_peak_count(fm.class_days(x, 900, 10, 5), 10, 2, 2)):
        assert values(f(part), "trade_date", "symbol") == {k: v for k, v in values(f(whole), "trade_date", "symbol").items() if k[1] == "a"}


# cross-sections


def test_ranks_and_buckets(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "c", 1.0), (1, "d", None)], "date int, symbol string, x double")
    assert {r.symbol: r.r for r in df.withColumn("r", xsection.average_rank("x", "date")).collect()} == {"a": 2.5, "b": 2.5, "c": 1.0, "d": None}
    many = spark.createDataFrame([(1, f"s{i:02d}", float(i)) for i in range(13)], "date int, symbol string, x double")
    assert [r["count"] for r in xsection.buckets(many, "x", 5).groupBy("bucket").count().orderBy("bucket").collect()] == [3, 3, 3, 2, 2]


def test_zscore_without_variance_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0)], "date int, symbol string, x double")
    assert [r.z for r in df.withColumn("z", xsection.zscore("x", "date")).collect()] == [0.0, 0.0]


def test_neutralize_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 30
    ind, cap, y = rng.integers(0, 4, n), np.exp(rng.normal(10, 1, n)), rng.normal(size=n)
    df = spark.createDataFrame([(1, f"s{i}", f"i{ind[i]}", float(cap[i]), float(y[i])) for i in range(n)], "date int, symbol string, industry string, size double, y double")
    x = np.column_stack([np.log(cap), *[(ind == k).astype(float) for k in range(4)]])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r.symbol: r.neutral for r in xsection.neutralize(df, "y", "size", "industry").collect()}
    assert all(got[f"s{i}"] == pytest.approx(want[i], abs=1e-9) for i in range(n))
    few = df.where("symbol IN ('s0', 's1')")
    assert all(r.neutral is None for r in xsection.neutralize(few, "y", "size", "industry").collect())


def test_orthogonalize_equals_least_squares(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(25, 3))
    df = spark.createDataFrame([(1, f"s{i}", *map(float, a[i])) for i in range(25)], "date int, symbol string, y double, p double, q double")
    x = np.column_stack([np.ones(25), a[:, 1:]])
    want = a[:, 0] - x @ np.linalg.lstsq(x, a[:, 0], rcond=None)[0]
    got = {r.symbol: r.pure for r in xsection.orthogonalize(df, "y", ["p", "q"]).collect()}
    assert all(got[f"s{i}"] == pytest.approx(want[i], abs=1e-9) for i in range(25))


# portfolio


def test_fills():
    after, moved = portfolio.fill_orders({"a": 0.5, "b": 0.5}, {"c": 1.0}, {"c"}, {"a"})
    assert after == {"b": 0.5, "c": 0.5} and moved == pytest.approx(1.0)
    assert portfolio.fill_orders({}, {"a": 0.5, "b": 0.5}, {"a", "b"}, set())[0] == {"a": 0.5, "b": 0.5}
    assert portfolio.fill_orders({"a": 1.0}, {"b": 1.0}, {"b"}, set()) == ({"a": 1.0}, 0)


def test_turnover_charges_both_sides(spark):
    w = spark.createDataFrame([(D("2024-01-01"), "a", 1.0), (D("2024-01-02"), "b", 1.0), (D("2024-01-03"), "b", 1.0)], "date date, symbol string, weight double")
    assert [r.turnover for r in portfolio.turnover(w, w).orderBy("date").collect()] == [1.0, 2.0, 0.0]


def test_cap_is_a_single_pass(spark):
    w = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.1), (1, "c", 0.1)], "date int, symbol string, weight double")
    assert max(r.weight for r in portfolio.cap_weights(w, 0.5).collect()) == pytest.approx(0.5 / 0.7)


def test_ic_weights_use_only_realised_ics(spark):
    ic = spark.createDataFrame([(D("2024-01-01") + dt.timedelta(days=i), 0.1 + 0.001 * i, -0.3) for i in range(30)], "date date, f double, g double")
    base = values(portfolio.ic_weights(ic, ["f", "g"], 5, None, 20), "date", value="w_f")
    other = ic.withColumn("f", F.when(F.col("date") >= "2024-01-20", 99.0).otherwise(F.col("f")))
    changed = values(portfolio.ic_weights(other, ["f", "g"], 5, None, 20), "date", value="w_f")
    assert all(base[k] == changed[k] for k in base if k[0] < D("2024-01-25"))
    assert base[(D("2024-01-05"),)] == 0.5


# evaluation


def test_ic_against_pandas(spark):
    rng = np.random.default_rng(3)
    rows = [(d, f"s{i}", float(rng.integers(0, 6)), float(rng.normal())) for d in range(8) for i in range(9)]
    rows = [(d, s, None if rng.random() < 0.1 else x, y) for d, s, x, y in rows] + [(99, "s", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date int, symbol string, factor double, fwd double")
    got = values(ev.information_coefficient(df), "date", value="ic")
    for d, g in df.toPandas().dropna().groupby("date"):
        want = g["factor"].rank().corr(g["fwd"].rank()) if len(g) > 1 else None
        assert got[(d,)] == (pytest.approx(want) if want is not None else None)


def test_newey_west_and_samples(spark):
    rng = np.random.default_rng(5)
    x = [float(v) for v in rng.normal(0.1, 1, 60)]
    x[10] = None
    known = [v for v in x if v is not None]
    m = np.mean(known)
    d = np.array([0 if v is None else v - m for v in x])
    s = (d @ d + 2 * sum((1 - k / 4) * (d[k:] @ d[:-k]) for k in (1, 2, 3))) / len(known)
    want = m / math.sqrt(s / len(known))
    assert ev.newey_west_t(x, 3) == pytest.approx(want)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "date int, ic double")
    assert ev.newey_west_frame(df, "ic", 3).first().t == pytest.approx(want)
    assert ev.effective_sample_size([1.0] * 5) == 1
    assert ev.effective_sample_size([float(i) for i in range(50)]) < 10


def test_performance(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([0.1, -0.2, 0.05])], "date int, net_return double")
    p = ev.performance(df, 12).first()
    assert p.annual_return == pytest.approx((1.1 * 0.8 * 1.05) ** 4 - 1) and p.max_drawdown == pytest.approx(-0.2)


# quality, stores, feeds


def test_clean_data_has_no_hard_findings(panel):
    got = quality.findings(panel).collect()
    assert [(r.check, r.severity) for r in got] == [("extreme_change", "warning")]


def test_each_defect_is_found(spark, panel):
    p = panel.withColumn("low", F.when(F.col("symbol") == "000001.SZ", F.col("high") + 1).otherwise(F.col("low"))).unionByName(panel.where("symbol = '000003.SZ'").limit(1))
    got = {r.check: r for r in quality.findings(p).collect()}
    assert got["high_below_low"].n == 60 and len(got["high_below_low"].examples) == 5 and got["duplicate_key"].n == 2
    assert quality.redact_text("token=abc and password: x") == "token=*** and password: ***"


def test_versioned_table_ledger_and_read_through(spark, tmp_path):
    root = f"file://{tmp_path}/{uuid.uuid4().hex}"
    ledger, store = stores.CoverageLedger(spark, f"{root}/ledger"), stores.VersionedTable(spark, f"{root}/data")
    asked = []

    def fetch(gaps):
        asked.append(sorted((r.key, r.start.day, r.end.day) for r in gaps.collect()))
        return gaps.select("key", F.explode(F.sequence("start", "end")).alias("date")).where("key <> 'none'").withColumn("v", F.lit(len(asked)))

    ask = lambda *rows: spark.createDataFrame([(k, D(a), D(b)) for k, a, b in rows], "key string, start date, end date")
    stores.read_through(ledger, store, "e", ask(("a", "2024-01-01", "2024-01-03"), ("none", "2024-01-01", "2024-01-02")), fetch, ["key", "date"])
    out = stores.read_through(ledger, store, "e", ask(("a", "2024-01-02", "2024-01-05"), ("none", "2024-01-01", "2024-01-02")), fetch, ["key", "date"])
    assert asked == [[("a", 1, 3), ("none", 1, 2)], [("a", 4, 5)]] and out.count() == 5
    out = stores.read_through(ledger, store, "e", ask(("a", "2024-01-02", "2024-01-05")), fetch, ["key", "date"], refetch_days=1)
    assert asked[-1] == [("a", 5, 5)] and out.where("v = 3").count() == 1 and out.count() == 5


def test_panel_store_prunes_and_validates(spark, panel, tmp_path):
    s = stores.PanelStore(spark, f"file://{tmp_path}/p")
    s.write(panel)
    got = s.read("2024-01-10", "2024-02-10", ["000001.SZ"])
    assert got.count() == panel.where("symbol = '000001.SZ' AND date BETWEEN '2024-01-10' AND '2024-02-10'").count()
    with pytest.raises(ValueError):
        s.write(panel.unionByName(panel))
    with pytest.raises(ValueError):
        stores.normalize_panel(panel.drop("close"))


def test_service_computes_only_missing_cells(spark, panel, tmp_path):
    svc = service.FactorService(panel, stores.FactorValueStore(spark, f"file://{tmp_path}/f"))
    a = svc.panel(["momentum_5"], ["000001.SZ"], "2024-02-01", "2024-02-10").collect()
    assert svc.computed == ["momentum_5"]
    assert svc.panel(["momentum_5"], ["000001.SZ"], "2024-02-01", "2024-02-10").collect() == a and svc.computed == ["momentum_5"]
    both = svc.panel(["momentum_5"], ["000001.SZ", "000002.SZ"], "2024-02-01", "2024-02-10")
    want = compute(panel, ["momentum_5"]).select("date", "symbol", "momentum_5")
    assert both.join(want, ["date", "symbol", "momentum_5"]).count() == both.count()
    with pytest.raises(ValueError):
        svc.panel(["momentum_5"], ["000001.SZ"], "2024-02-01", "2024-02-10", basis="exec_to_exec")


def test_schema_guard(spark):
    g = stores.SchemaGuard({"e": {"a": "int", "b": "string"}})
    found = g.inspect("e", spark.createDataFrame([(1, 2)], "a long, c int"))
    assert {(d.kind, d.columns) for d in found} == {("missing", ("b",)), ("extra", ("c",)), ("type", ("a",))}
    with pytest.raises(ValueError):
        stores.SchemaGuard(g.declared, strict=True).inspect("e", spark.createDataFrame([(1,)], "a int"))


def test_run_log(spark, tmp_path):
    log = stores.RunLog(spark, f"file://{tmp_path}/log")
    for k, s in enumerate(("running", "done")):
        log.append(k, "job", s)
    assert log.current().first().status == "done"


def test_parsers_and_names(spark):
    raw = spark.createDataFrame([("20240102", "a", 1.0, float("nan"), 5)], "trade_date string, ts_code string, close double, vol double, junk int")
    r = feeds.parse(raw, "market_daily").first()
    assert (r.date, r.symbol, r.close, r.volume, r.open) == (D("2024-01-02"), "a", 1.0, None, None)
    with pytest.raises(ValueError):
        feeds.parse(raw, "adj_factor")
    bad = spark.createDataFrame([("a", "2024-13-99", None, "*st x")], "ts_code string, start_date string, end_date string, name string")
    st = feeds.st_intervals(feeds.parse(bad, "namechange")).first()
    assert st.is_st and st.start is None
    assert "stk_limit" in feeds.by_category("tradability")


def test_retry_and_rate():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 5:
            raise OSError("no")
        return 7

    assert feeds.with_retry(flaky, 5, waits.append) == 7 and waits == [1.0, 2.0, 4.0, 8.0]
    slept = []
    r = feeds.RateLimiter(60, clock=lambda: 0.0, sleep=slept.append)
    assert [r.acquire() for _ in range(3)] == [0.0, 1.0, 2.0] and slept == [1.0, 2.0]
    got = feeds.run_updates([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: None)])
    assert [o.ok for o in got] == [True, False, True]
    assert feeds.chunks("2024-01-01", "2024-01-10", 4)[-1] == ("2024-01-09", "2024-01-10")


def test_normalized_bars(spark):
    raw = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 9, 31), 1.0, 1), ("a", dt.datetime(2024, 1, 1, 9, 31), 2.0, 2)], "symbol string, bar_end timestamp_ntz, close double, seq int")
    b = feeds.normalize_bars(raw, order="seq")
    r = b.first()
    assert b.count() == 1 and r.close == 2.0 and r.bar_start == dt.datetime(2024, 1, 1, 9, 30) and r.slot == 571
    assert tuple(feeds.bar_violations(b).first()) == (0, 0, 0, 0)


def test_stream_equals_batch(spark, tmp_path, sf):
    from plumbline.streaming.live_bars import live_bars, upsert_batches

    src = f"{tmp_path}/in"
    t = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    t.repartitionByRange(3, "ts").write.parquet(src)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    store = stores.VersionedTable(spark, f"file://{tmp_path}/out")
    q = live_bars(stream, 60, "30 days").withColumn("seq", F.current_timestamp()).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(upsert_batches(store, ["symbol", "bar_start"], "seq")).start()
    q.processAllAvailable()
    q.stop()
    want = live_bars(t, 60)
    assert quality.content_hash(store.read().drop("seq")).collect() == quality.content_hash(want).collect()


def test_study_helpers(spark):
    from plumbline.operators import studies as st

    assert st.json_diff({"a": [1, 2.0], "b": None}, {"a": [1, 2.5, 3], "c": 1}) == [("$.a[1]", 2.0, 2.5), ("$.a.length", 2, 3), ("$.b", None, None), ("$.c", None, 1)]
    assert st.json_diff({"a": 1.0}, {"a": 1.0 + 1e-13}, 1e-12) == []
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.1)], "date int, symbol string, weight double")
    assert [(r.symbol, r["rank"]) for r in st.holdings(w).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    plan = st.trade_plan(w.where("symbol = 'a'"), w.where("symbol = 'b'"), w, w.select("date", "symbol", F.lit(9.0).alias("amount")))
    assert {r.symbol: r.delta for r in plan.collect()} == {"a": -0.5, "b": 0.5}
    with pytest.raises(ValueError):
        st.require_agreement(spark.createDataFrame([(0.5,)], "median double"))
    assert "## verdict" in st.render({"verdict": {"decision": "Adopt"}, "caveats": []})


def test_command_line(capsys):
    from plumbline.__main__ import main

    assert main(["queries"]) == 0
    assert "momentum_topn" in capsys.readouterr().out
