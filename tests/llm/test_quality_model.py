from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality_model as Q


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    right = [0.999, 0.9, 0.75, 0.6]
    cover = [0.3, 0.8, 0.9, 0.7]
    v = np.zeros((len(good), 4), dtype=int)
    for j in range(4):
        said = np.where(rng.random(len(good)) < right[j], np.where(good, 1, -1), np.where(good, -1, 1))
        v[:, j] = np.where(rng.random(len(good)) < cover[j], said, 0)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    table, prior = Q.estimate([(tuple(p), int(c)) for p, c in zip(patterns, counts, strict=True)])
    assert abs(prior - 0.7) < 0.03
    for j in (1, 2, 3):
        acc = (prior * table[j, 1, 2] + (1 - prior) * table[j, 0, 0]) / (prior * (table[j, 1, 0] + table[j, 1, 2]) + (1 - prior) * (table[j, 0, 0] + table[j, 0, 2]))
        assert abs(acc - right[j]) < 0.04
    assert ((Q.posterior(v, table, prior) > 0.5) == good).mean() > 0.88


def test_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    model = Q.fit(spark, d, labels.where("h <> 0").drop("h"))
    held = Q.score(d.select("doc_id", "text").join(labels.where("h = 0"), "doc_id"), model).withColumn("k", F.col("quality_score") >= Q.THRESHOLD)
    share = {(r["quality"], r["toxic"]): r["s"] for r in held.groupBy("quality", "toxic").agg(F.avg(F.col("k").cast("int")).alias("s")).collect()}
    assert share[1, 0] > 0.98 and share[1, 1] < 0.15 and share[0, 0] < 0.05


def test_nulls_empty_repeats_and_clashes(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "plain words in a row " * 30, 5.0), (3, "plain words in a row " * 30, 5.0)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(3, 1, None), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = Q.fit(spark, docs, labels)
    rows = Q.score(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert Q.fit(spark, docs.limit(0), labels).fitted_on == 0
    assert Q.score(docs.limit(0), model).count() == 0
    Q.fit(spark, docs, labels.limit(0))


def test_any_bad_row_makes_a_bad_label(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0), (3, 0, None), (4, None, None)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["gold"] for r in Q.label_votes(labels).collect()} == {1: -1, 2: 1, 3: -1}


def _prose(n, seed=1):
    """n words, most of them common ones."""
    return [f"w{x}" for x in np.random.default_rng(seed).zipf(1.3, n) % 5000]


def _votes(words):
    return dict(zip(Q.LABELLERS[1:], Q.votes(Q.measures(" ".join(words), Q.word_hashes(" ".join(words)))), strict=True))


def test_repetition_is_measured_over_the_whole_text():
    clean, loop = [f"word{chr(97 + i % 26)}{i}" for i in range(2000)], ["round", "and", "round", "it", "goes"] * 1200
    assert _votes(clean + loop)["repeats"] == -1, "a loop behind a clean start"
    assert _votes(loop[:2000] + [f"fine{i}" for i in range(40_000)])["repeats"] == 1, "a looping start of a clean text"
    assert _votes([f"x{i}" for i in range(3000)] * 5)["repeats"] == -1, "what comes again after more than a block"


def test_variety_votes_bad_at_any_length_and_not_for_length():
    assert [_votes(["all", "the", "same"] * n)["variety"] for n in (300, 334, 1000, 20_000)] == [-1] * 4
    short, long_ = (Q.measures(" ".join(w), Q.word_hashes(" ".join(w))) for w in (_prose(1000), _prose(60_000)))
    assert abs(short["variety"] - long_["variety"]) < 0.05 and abs(short["pairs"] - long_["pairs"]) < 0.15
    assert _votes(_prose(60_000))["variety"] == _votes(_prose(1000))["variety"] != -1
