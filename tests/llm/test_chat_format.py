from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat_format as C


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def back(spark, data):
    out = C.format_conversations(rows(spark, data)).withColumn("t", C.read_back(F.col("formatted")))
    return {r["conv_id"]: r for r in out.collect()}


def test_machine_and_loss(spark):
    got = back(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "x"), (3, 0, "system", "s"), (3, 1, "user", "u"), (4, 0, "user", "u"), (4, 1, "user", "v"), (4, 2, "assistant", "w")])
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False}
    assert got[1]["formatted"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == ["yo"]


def test_nulls_ties_and_empty(spark):
    got = back(spark, [(None, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, None, "user", "z"), (5, 1, "user", "a")])
    assert [(t["role"], t["text"]) for t in got[None]["t"]] == [("", "")]
    assert [t["text"] for t in got[5]["t"]] == ["z", "a", "a", "b"]
    assert C.format_conversations(rows(spark, [(1, 1, "user", "x")]).limit(0)).count() == 0


pieces = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "&", "&lt;|", "&amp;", "&nl;", "<", "|", "\n", "é", "a", "\\"]), max_size=6).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(pieces, pieces), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    got = back(spark, [(i, 0, r, t) for i, (r, t) in enumerate(turns)])
    for i, (r, t) in enumerate(turns):
        assert [(x["role"], x["text"]) for x in got[i]["t"]] == [(r, t)]


def test_query_has_the_probe(spark, sf):
    out = {r["conv_id"]: r for r in C.op4_chat_format(spark, sf).collect()}
    assert out[-1]["n_turns"] == 2 and out[-1]["loss_chars"] == len(C.PROBE) and out[-1]["valid"]
