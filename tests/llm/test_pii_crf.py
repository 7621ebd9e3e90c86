from __future__ import annotations

import random
import re

import numpy as np

from plumbline.llm import pii_crf as P


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and P.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    random.seed(2)
    for _ in range(20_000):
        t = "".join(random.choice("01459.@+- ()a%_é٣") for _ in range(random.randint(1, 30)))
        assert P.base_spans(t) == brute(t), repr(t)


def test_luhn():
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487")


def test_long_runs_are_linear():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "@a" * 100_000):
        P.spans(t, P.train([]))


def test_distant_repeats_share_labels():
    docs = [P.mentions(f"call +1 (555) 01{i:02d}-4477 today, or else 99887766{i:02d}1 in the book") for i in range(60)]
    field = P.train(docs)
    assert field.skip[0, 0] > 0
    text = "call +1 (555) 0199-4477 today. " + "filler " * 200 + "again: 1 555 0199 4477"
    other = text.replace("1 555 0199 4477", "1 555 0188 2233")
    nodes = P.mentions(text)
    assert P.edges(nodes)[1] == [(0, 1)]
    assert P.edges(P.mentions(other))[1] == []
    p, q = field.marginals(nodes)[1][3], field.marginals(P.mentions(other))[1][3]
    assert p > 1.5 * q


def test_marginals_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(0)
    field = P.Field(rng.normal(size=(len(P.FEATURES), 5)), rng.normal(size=(5, 5)), np.eye(5))
    nodes = [P.Mention(i, i + 1, P.OTHER, False, [i, 15], f"unlike{i}00000{i}{i}{i}{i}{i}{i}{i}") for i in range(3)]
    got = field.marginals(nodes, rounds=200)
    u = [field.unary(m) for m in nodes]
    z = np.array([[[u[0][a] + u[1][b] + u[2][c] + field.chain[a, b] + field.chain[b, c] for c in range(5)] for b in range(5)] for a in range(5)])
    e = np.exp(z - z.max())
    want = np.array([e.sum(axis=(1, 2)), e.sum(axis=(0, 2)), e.sum(axis=(0, 1))]) / e.sum()
    assert np.allclose(got, want, atol=1e-4)


def test_table(spark, sf):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a@b.co and 1.2.3.4", 0), (3, "a@b.co and 1.2.3.4", 0)], "doc_id long, text string, spans int")
    field = P.fit(df)
    rows = sorted((r["doc_id"], r["n_email"], r["n_ip"]) for r in P.find(df, field).collect())
    assert rows == [(1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1)]
    assert P.find(df.limit(0), P.fit(df.limit(0))).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op7_pii_crf(spark, sf).collect():
        base = P.written(brute(texts[r["doc_id"]]))
        every = set(r["spans"].split(",")) if r["spans"] else set()
        assert set(base.split(",") if base else []) <= every
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(base.count(f"{k}:") for k in P.KINDS)
