"""Mined rules against every combination of tokens, counted one by one."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from plumbline.llm import url_rules as U


def brute(sets, support, confidence, told):
    known = [(s, v) for s, v in sets if v]
    rows = {}
    for k, (s, _) in enumerate(known):
        for t in s:
            rows.setdefault(t, set()).add(k)
    twins = {}
    for t in sorted(rows):
        if len(rows[t]) >= support * len(known):
            twins.setdefault(frozenset(rows[t]), t)
    names = sorted(twins.values())
    found = {}
    for size in range(1, len(names) + 1):
        for c in itertools.combinations(names, size):
            of = [v for s, v in known if set(c) <= s]
            every = sum(set(c) <= s for s, _ in sets)
            for verdict in ("allow", "block"):
                hit = of.count(verdict)
                if hit >= support * len(known) and hit and hit >= confidence * len(of) and len(of) > told * every:
                    found[c, verdict] = hit / len(of)
        if size > max(len(s) for s, _ in sets):
            break
    return {(c, v): x for (c, v), x in found.items() if not any(w == v and set(d) < set(c) and y >= x for (d, w), y in found.items())}


def test_rules_equal_all_combinations(spark):
    rng = random.Random(8)
    for told in (0.0, 0.5):
        sets = []
        for _ in range(120):
            s = {x for x in "abcdefg" if rng.random() < 0.35} | ({"twin", "twin2"} if rng.random() < 0.3 else set())
            verdict = "block" if "a" in s and "b" in s else "allow" if "c" in s else None
            if verdict and rng.random() < 0.1:
                verdict = "block"
            sets.append((s, verdict))
        df = spark.createDataFrame([(sorted(s), v) for s, v in sets], "items array<string>, verdict string")
        got = {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in U.mine(spark, df, 0.05, 0.8, told).collect()}
        want = brute(sets, 0.05, 0.8, told)
        assert want and set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tokens_that_always_go_together_are_one(spark):
    rows = [(["x", *[f"always{i}" for i in range(40)]], "block")] * 30 + [(["y"], "allow")] * 30
    rules = U.mine(spark, spark.createDataFrame(rows, "items array<string>, verdict string"), 0.1, 0.9).collect()
    assert {(tuple(r["tokens"]), r["verdict"]) for r in rules} == {(("always0",), "block"), (("y",), "allow")}


def test_a_rule_is_silent_where_most_is_unlabelled(spark):
    labelled, free = [(["t"], "block")] * 20, [(["t"], None)] * 20
    mined = lambda rows: [r["tokens"] for r in U.mine(spark, spark.createDataFrame(rows, "items array<string>, verdict string"), 0.1, 0.9).collect()]
    assert mined(labelled + free) == []
    assert mined([*labelled, (["t"], "block"), *free]) == [["t"]]
    # b stands in the same labelled URLs as a, but in no others, and so may speak for both
    assert mined([(["a", "b"], "block")] * 20 + [(["a"], None)] * 30) == [["b"]]
    none = spark.createDataFrame(free, "items array<string>, verdict string")
    assert U.mine(spark, none).count() == 0 and U.mine(spark, none.limit(0)).count() == 0


def test_mined_rules_decide_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = U.judge(spark, pages).where("rule IS NULL")
    n = {r["verdict"]: r["count"] for r in out.where(F.col("mined").isNotNull()).groupBy("verdict").count().collect()}
    assert n["block"] > 0 and sum(n.values()) < out.count()
