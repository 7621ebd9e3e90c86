"""Interval joins that keep repeated rows; stores that rewrite only what changes, and a ledger that says what came."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import pit, xsection
from plumbline.sources import stores

D = dt.date


def test_interval_join_keeps_repeated_rows_and_outer_spans(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 5), 1), ("a", D(2024, 1, 5), 1), ("a", D(2024, 1, 20), 2), ("b", D(2024, 1, 5), 3), (None, D(2024, 1, 5), 4)], "symbol string, date date, v int")
    spans = spark.createDataFrame([("a", None, None, "wide"), ("a", D(2024, 1, 2), D(2024, 1, 10), "late"), ("a", D(2024, 1, 1), D(2024, 1, 10), "early")], "symbol string, valid_from date, valid_to date, name string")
    got = sorted((r.v, r.name) for r in pit.interval_join(left, spans, ["name"]).collect())
    assert got == [(1, "late"), (1, "late"), (2, "wide"), (3, None), (4, None)]


def test_ties_share_their_rank_in_one_sort(spark):
    df = spark.createDataFrame([(1, x) for x in (3.0, 1.0, 3.0, None, 2.0, None, 3.0)], "k int, x double")
    out = df.withColumn("r", xsection.average_rank("x", "k"))
    assert sorted((r.x, r.r) for r in out.where("x IS NOT NULL").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]
    assert [r.r for r in out.where("x IS NULL").collect()] == [None, None]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_versions_are_logged_and_old_ones_go(spark, tmp_path):
    t = stores.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    for k in range(4):
        t.write(spark.range(k + 1))
    assert t.read().count() == 4 and len(t.versions()) == 4
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2
    # a version without its line in the log doesn't count
    spark.range(99).write.parquet(f"{t.path}/v-lost")
    assert t.read().count() == 4


def bars(spark, rows):
    return spark.createDataFrame([(s, "1min", dt.datetime.fromisoformat(t), float(v)) for s, t, v in rows], "symbol string, freq string, bar_end timestamp_ntz, close double")


def test_intraday_store_rewrites_and_reads_only_months_it_needs(spark, tmp_path):
    s = stores.IntradayStore(spark, f"file://{tmp_path}/bars")
    with pytest.raises(FileNotFoundError):
        s.read_range(["a"], "2024-01-01", "2024-01-02")
    assert s.upsert(bars(spark, [("a", "2023-12-29 10:00", 1), ("a", "2024-01-02 10:00", 2), ("b", "2024-01-02 10:00", 3), ("a", "2024-02-01 10:00", 4)])) == 3
    stamp = lambda: {p.parent.name + p.parent.parent.name: p.stat().st_mtime_ns for p in tmp_path.glob("bars/data/**/*.parquet")}
    before = stamp()
    assert s.upsert(bars(spark, [("a", "2024-01-02 10:00", 20), ("a", "2024-01-03 10:00", 5)])) == 1
    after = stamp()
    assert len(before) == 3 and {k for k in before if before[k] != after[k]} == {"month=1year=2024"}
    got = s.read_range(["a"], "2023-12-30", "2024-01-31")
    assert sorted((r.bar_end.day, r.close) for r in got.collect()) == [(2, 20.0), (3, 5.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1] and "symbol" in plan.split("PushedFilters: [")[1]
    assert s.upsert(bars(spark, [("a", "2024-01-02 10:00", 20)]).limit(0)) == 0


def test_the_ledger_says_what_came(spark, tmp_path):
    ledger, store = stores.CoverageLedger(spark, f"file://{tmp_path}/l"), stores.VersionedTable(spark, f"file://{tmp_path}/d")
    ask = lambda a, b: spark.createDataFrame([("a", D(2024, 1, a), D(2024, 1, b))], "key string, start date, end date")
    rows = lambda until: lambda gaps: gaps.select("key", F.explode(F.sequence("start", "end")).alias("date")).where(F.dayofmonth("date") <= until)
    status = lambda: sorted((r.start.day, r.end.day, r.status) for r in ledger.read().collect())
    stores.read_through(ledger, store, "e", ask(1, 3), rows(31), ["key", "date"])
    # the key has older rows, but nothing came for this gap
    stores.read_through(ledger, store, "e", ask(4, 5), rows(0), ["key", "date"])
    assert status() == [(1, 3, "ok"), (4, 5, "empty")]
    stores.read_through(ledger, store, "e", ask(6, 10), rows(7), ["key", "date"], ready_until="2024-01-08")
    assert status()[2:] == [(6, 8, "ok"), (9, 10, "not_ready")]
    out = stores.read_through(ledger, store, "e", ask(6, 10), rows(31), ["key", "date"])
    assert out.where("date >= '2024-01-09'").count() == 2 and status()[-1] == (9, 10, "ok")


def test_snapshots_go_stale(spark, tmp_path):
    ledger, store = stores.CoverageLedger(spark, f"file://{tmp_path}/l"), stores.VersionedTable(spark, f"file://{tmp_path}/d")
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(len(calls))

    n = lambda day: stores.read_snapshot(ledger, store, "s", fetch, 7, day).count()
    assert [n("2024-01-01"), n("2024-01-08"), n("2024-01-09")] == [1, 1, 2]
