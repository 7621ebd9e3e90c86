"""Execution basis checks, coverage disclosures, and difference classes with caps and anchors."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import quality
from plumbline.operators import studies as st

D = [dt.date(2024, 1, d) for d in range(1, 9)]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = []
    for k, s in enumerate("abcde"):
        for i, d in enumerate(D):
            rows.append((d, s, 10.0 + k + (i * (k + 2)) % 5, 2.0 if s == "b" and i >= 4 else 1.0))
    p = spark.createDataFrame(rows, "date date, symbol string, price double, adj_factor double")
    w = "OVER (PARTITION BY symbol ORDER BY date)"
    p = p.selectExpr("*", f"lead(price * adj_factor) {w} / (price * adj_factor) - 1 AS fwd")
    return st.execution_pairs(p.withColumn("close_ret", F.col("fwd") + 0.0001 * F.col("price")))


def test_recomputed_returns_and_ex_dates(pairs):
    got = st.check_execution_basis(pairs, "close_ret")
    assert got["dates"] == 7 and got["median"] > 0.99 and got["worst_difference"] < 1e-12 and got["median_rank"] > 0.9
    with pytest.raises(ValueError, match="recomputation"):
        st.check_execution_basis(pairs.withColumn("fwd", F.col("fwd") + 1e-6), "close_ret")
    with pytest.raises(ValueError, match="median"):
        st.check_execution_basis(pairs.withColumn("close_ret", -F.col("fwd")), "close_ret")
    ex = st.ex_date_pairs(pairs).collect()
    assert [(r.date, r.symbol, r.exit_adj) for r in ex] == [(D[3], "b", 2.0)] and abs((1 + ex[0].fwd) - 2 * (1 + ex[0].unadjusted)) < 1e-12


def test_hand_checks_are_the_same_however_dealt(pairs):
    a, b = ([tuple(r) for r in st.hand_checks(df, 4).collect()] for df in (pairs, pairs.repartition(7, "date")))
    assert a == b and len(a) == 4 and max(r[-1] for r in a) < 1e-12
    assert st.hand_checks(pairs.limit(0)).count() == 0


def test_moments(pairs):
    m = {r.series: r for r in st.moments(pairs, ["fwd", "price"]).collect()}
    assert m["fwd"].n == 35 and m["price"].n == 40 and m["price"].least == 10.0 and m["price"].most == 18.0


def test_classes_caps_and_anchors(spark):
    rows = [("a", 1.0, 1.0), ("b", 5.0, 6.0), ("c", 5.0, 8.0), ("d", 0.5, 1.5), ("e", None, 1.0), ("f", 1.0, 1.0 + 1e-10), ("g", 1.0, None)]
    left, right = (spark.createDataFrame([(r[0], r[i]) for r in rows], "k string, v double") for i in (1, 2))
    c = quality.classify_differences(left, right, ["k"], "v", flip=1)
    assert {r.k: r["class"] for r in c.collect()} == {"a": "equal", "b": "threshold_flip", "c": "unclassified", "d": "unclassified", "e": "warmup_extension", "f": "float_tail", "g": "vanished"}
    caps = {r["class"]: (r.n, r.cap, r.ok) for r in quality.capped_classes(c, {"threshold_flip": 1, "unclassified": 1, "warmup_extension": 5}).collect()}
    assert caps == {"equal": (1, None, True), "threshold_flip": (1, 1, True), "unclassified": (2, 1, False), "warmup_extension": (1, 5, True), "float_tail": (1, 0, False), "vanished": (1, 0, False)}
    assert "threshold_flip" not in {r["class"] for r in quality.classify_differences(left, right, ["k"], "v").collect()}
    assert not any(r.ok for r in quality.capped_classes(c, {}).where("cap IS NOT NULL").collect())
    anchors = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("e", 1.0), ("g", None), ("zz", 1.0)], "k string, v double")
    assert {r.k: r.ok for r in quality.against_anchors(right, anchors, ["k"], "v").collect()} == {"a": True, "b": False, "e": True, "g": True, "zz": False}


def test_disclosures(spark):
    rows = [(120, 30, 12, 6, 12, 0.1), (120, 30, 5, 6, 5, 0.2), (50, 30, 12, 6, 12, 0.3), (120, 30, 25, 2, 25, 0.4)]
    days = spark.createDataFrame(rows, "n_class long, k_valley long, k_ridge long, k_peak long, k_ridge_ret long, r_ridge double")
    r = st.ridge_coverage(days).first()
    assert (r.rows, r.valid, r.classifiable, r.failed_ridge, r.valid_at_valley_gate, r.valley_median) == (4, 2, 3, 1, 1, 30.0) and r.rate_of_classifiable == pytest.approx(2 / 3)
    assert (st.ridge_return_coverage(days).first().valid, st.peak_coverage(days).first().valid) == (2, 1)
    before = spark.createDataFrame([(D[0], 1.0), (D[0], 2.0), (D[1], 1.0)], "trade_date date, value double")
    n = st.neutralization_coverage(before, before.where(F.col("trade_date") == F.lit(D[0]))).first()
    assert (n.before, n.after, n.dates_lost, n.most) == (3, 2, 1, 2) and n.kept == pytest.approx(2 / 3)
