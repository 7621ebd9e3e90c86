from __future__ import annotations

import random
import re

import numpy as np
import pytest

from plumbline.llm import shingle_forest as S


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, n=5, t=0.8):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    ids = [d for d, _ in rows]
    link = [[i != j and bool(a) and bool(b) and len(a & b) >= t * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    low = list(ids)
    for _ in rows:
        low = [min([low[i], *[low[j] for j in range(len(rows)) if link[i][j]]]) for i in range(len(rows))]
    return {d: (sum(link[i]), low[i]) for i, d in enumerate(ids)}


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_links"], r["class_id"]) for r in S.near_duplicates(spark, df, **more).collect()}


@pytest.fixture(scope="module")
def corpus():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(12):
        base = [random.choice(vocabulary) for _ in range(random.randint(20, 160))]
        for _ in range(random.randint(1, 9)):
            w = list(base)
            for _ in range(random.randint(0, 5)):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, rows[0][1]), (k + 1, rows[0][1].upper().replace(" ", "  ")), (k + 2, None), (k + 3, ""), (k + 4, "one"), (k + 5, "one!"), (k + 6, "a b c d"), (k + 7, "a b c d e")]
    return rows


def test_equals_brute_force(spark, corpus):
    assert result(spark, corpus) == brute(corpus)


def test_blocks_and_thresholds_lose_nothing(spark, corpus):
    assert result(spark, corpus, block=4) == brute(corpus)
    assert result(spark, corpus, threshold=0.6) == brute(corpus, t=0.6)


def test_hot_group_of_near_copies(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(60)]
    got = result(spark, rows, block=16)
    assert set(got.values()) == {(59, 0)}


def test_empty_table(spark):
    assert S.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_shorten_until_the_recall_is_reached():
    assert S.depths() == [6, 4]
    k = S.depths()[-1]
    assert 1 - (1 - S.THRESHOLD**k) ** S.TREES >= S.RECALL


def test_word_hashes_see_words_only():
    a, b = S.word_hashes("Été, one-two THREE"), S.word_hashes("  été?one two three ")
    assert len(a) == 4 and np.array_equal(a[1:], b[1:]) and a[0] != b[0]  # only A-Z are lower-cased
    assert S.word_hashes("x" * 300_000).shape == (1,)


def test_null_ids_and_heavy_groups(spark, monkeypatch):
    text = " ".join(f"z{i}" for i in range(40))
    rows = [(None, text), (None, text + " more"), (3, text + " here"), (4, text + " there")]
    got = S.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got if r["doc_id"]) == [(3, 1), (4, 1)] and len(got) == 4
    monkeypatch.setattr(S, "SHINGLES", 100)
    many = [(i, text + f" tail{i}") for i in range(20)]
    assert set(result(spark, many).values()) == {(19, 0)}
