"""Rows that share an id, or have none, lose nothing of their own to one another."""

from __future__ import annotations

import threading

import pytest

import corpus_pipeline as C
from plumbline.llm import line_templates as L
from plumbline.llm import shared
from plumbline.llm import shingle_forest as S

FOOT = "all rights reserved by " + " ".join(f"holder{chr(97 + i)}" for i in range(20))


def texts(n, seed):
    return " ".join(f"{seed}{i}" for i in range(n))


def lines(spark, rows):
    return sorted((str(r["doc_id"]), r["text"]) for r in L.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_line_dedup_keeps_what_only_one_row_has(spark):
    a, b = f"{FOOT}\nkeep this line of nine", f"unique alpha beta gamma delta\n{FOOT}"
    for i in (9, None):
        assert lines(spark, [(1, FOOT), (i, a), (i, b)]) == sorted([("1", FOOT), (str(i), "keep this line of nine"), (str(i), "unique alpha beta gamma delta")])
        assert lines(spark, [(i, a), (i, b)]) == sorted([(str(i), a), (str(i), b)])


def test_links_of_every_text_under_one_id(spark):
    a, b = texts(60, "a"), texts(60, "b")
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z")]
    got = sorted((r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in S.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


def test_one_row_of_a_class_stays_and_no_other_text_goes(spark, sf):
    a, b = texts(60, "a"), texts(60, "b")
    rows = [(5, a), (5, a), (5, b), (6, a + " z"), (6, texts(30, "own")), (8, None), (8, None), (9, "one word"), (9, "one word")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r["doc_id"], r["text"] or "") for r in C.near_dedup(spark, docs, sf).collect())
    assert kept == sorted([(5, a), (5, b), (6, texts(30, "own")), (8, ""), (8, ""), (9, "one word")])


def test_owned_tables_are_deleted_and_only_the_own_ones(spark):
    other = []

    def elsewhere():
        s = shared.Scratch(spark, "other")
        other.append((s, s.keep(spark.range(3), "t")))

    with shared.owned():
        mine = shared.Scratch(spark, "mine")
        t = mine.keep(spark.range(5), "t")
        assert t.count() == 5
        th = threading.Thread(target=elsewhere)
        th.start()
        th.join()
    assert other[0][1].count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(f"{mine.root}/t").count()
    other[0][0].clear()


class _Context:
    def __init__(self, master, at=None):
        self.master, self.at = master, at

    def getCheckpointDir(self):
        return self.at

    def setCheckpointDir(self, at):
        self.at = at


class _Session:
    def __init__(self, context):
        self.sparkContext = context
        self.conf = self

    def get(self, key, default=None):
        return default


def test_a_cluster_without_a_shared_folder_is_refused():
    local = _Session(_Context("local[2]"))
    assert shared.shared_dir(local) == shared.shared_dir(local) == local.sparkContext.at
    assert shared.shared_dir(_Session(_Context("spark://x", "hdfs://a/b/"))) == "hdfs://a/b"
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared.shared_dir(_Session(_Context(master)))
