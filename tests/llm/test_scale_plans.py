"""Bounds that keep work in proportion: blocks, cells, linear prefixes, a ledger that has met everything."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as D
from plumbline.llm import embedding_cells as E
from plumbline.llm import secret_ledger as L
from plumbline.llm import shared


def test_large_groups_make_many_blocks_and_small_ones_one(spark):
    sizes = [1, 2, 255, 256, 257, 1000, 4000, 16_384, 100_000]
    got = [r["n"] for r in spark.createDataFrame([(x,) for x in sizes], "s long").select("s", shared.block_count(F.col("s"), 1024).alias("n")).orderBy("s").collect()]
    assert got == [1, 1, 1, 1, 2, 4, 16, 16, 98]
    assert all(s / n <= 1024 for s, n in zip(sizes, got, strict=True))


def test_least_labels_equal_a_plain_search():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        for m in (0, 1, n // 2, 3 * n):
            i, j = rng.integers(0, n, m), rng.integers(0, n, m)
            want = list(range(n))
            for _ in range(n):
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    want[a] = want[b] = min(want[a], want[b])
            assert shared.least_labels(n, i, j).tolist() == want
    chain = np.arange(5000)
    assert not shared.least_labels(5000, chain[:-1], chain[1:]).any()


def test_small_weighs_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 5, "t string")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(shared.small(df, 10, F.octet_length("t"), 6000))
    assert not hinted(shared.small(df, 10, F.octet_length("t"), 4000)) and not hinted(shared.small(df, 4, F.octet_length("t"), 6000))
    assert hinted(shared.small(df.limit(0), 10, F.octet_length("t"), 0))


def test_cells_grow_in_number_with_the_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 8))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    few, many = len(E.split_cells(x, 1.0, 10_000)), len(E.split_cells(x, 50.0, 10_000))
    assert 3 <= few <= 16 and 120 <= many <= 500
    assert len(E.split_cells(x, 1e9, 10_000)) <= 500 and len(E.split_cells(x, 1e9, 20)) <= 20
    assert len(E.split_cells(np.repeat(x[:1], 4000, axis=0), 1e6, 10_000)) == 1


def test_a_scan_of_known_blobs_moves_no_text(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"password=secret{i % 7}") for i in range(50)], "doc_id long, text string")
    at = f"file://{tmp_path}/ledger"
    first = L.update(spark, docs, at).count()
    seen = spark.read.parquet(f"{at}/scanned")
    run = shared.Scratch(spark, "due")
    due = L.unseen_blobs(docs, seen, run=run)
    assert due.count() == 0 and "todo" in due.columns
    assert spark.read.parquet(f"{run.root}/due").count() == 0
    assert L.update(spark, docs, at).count() == first == 7
    more = docs.unionByName(spark.createDataFrame([(99, "token: abcdefgh")], docs.schema))
    assert L.unseen_blobs(more, seen).count() == L.unseen_blobs(more, seen, run=shared.Scratch(spark, "due")).count() == 1
    run.clear()


def test_rarest_words_of_a_long_item_take_linear_rows(spark):
    item = " ".join(f"w{i % 3000}" for i in range(20_000))
    its = D.items(spark.createDataFrame([(1, item)], "item_id long, text string"))
    split = D.tokenized(spark.createDataFrame([(1, item)], "doc_id long, text string"))
    pre = D.rarest_words(its, split)
    plan = pre._jdf.queryExecution().executedPlan().toString()
    assert "starts" not in plan and pre.agg(F.max("hi"), F.min("lo")).first() == (19_990, 0)


@pytest.mark.parametrize("window", [3, 10])
def test_windows_are_of_the_asked_length(spark, window):
    item = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, "x c d e y"), (2, "b c d e f g h i j k z"), (3, "a c e")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in D.report(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"), window).collect()}
    assert got == ({1: 3, 2: 10, 3: 0} if window == 3 else {1: 0, 2: 10, 3: 0})
