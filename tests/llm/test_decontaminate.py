from __future__ import annotations

import random
import re

from plumbline.llm import decontaminate as D


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for i, t in items:
            x = words_of(t)
            n = min(10, len(x))
            windows = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else []:
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found.add(str(i))
        out[d] = (len(w), len(hit), len(found), ",".join(sorted(found)))
    return out


def result(spark, docs, items):
    import hashlib

    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {r["doc_id"]: r for r in D.report(spark, d, b).collect()}
    for k, (n, h, m, ids) in want.items():
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, h, m, hashlib.sha256(ids.encode()).hexdigest(), h > 0), (k, r, want[k])
    assert len(got) == len(want)
    return d, b, want


def test_random_overlaps_match_brute_force(spark):
    random.seed(7)
    small = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(random.choice(small) for _ in range(random.choice([1, 2, 5, 9, 10, 11, 25])))) for i in range(25)] + [(90, ""), (91, None), (92, "UPPER Été case words here to be found by the tenth word")]
    docs = [(0, None), (1, ""), (2, "..."), (3, "upper Été! case, words here to be found by the tenth word")]
    for k in range(4, 40):
        w = [random.choice(small) for _ in range(random.randint(0, 60))]
        if k % 2:
            x = (random.choice(items)[1] or "").split()
            at = random.randint(0, len(w))
            w[at:at] = x[random.randint(0, 2) :]
        docs.append((k, "; ".join(w)))
    d, b, want = result(spark, docs, items)
    left = {r["doc_id"] for r in D.clean(spark, d, b).collect()}
    assert left == {k for k, v in want.items() if not v[1]}


def test_repeats_empty_and_clashes(spark):
    text = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, text, 0, 0), (1, text, 0, 0), (1, "other", 0, 0)], "doc_id long, text string, k1 int, hit int")
    b = spark.createDataFrame([(7, text, 1), (8, text, 1)], "item_id long, text string, row int")
    got = sorted((r["n_hit"], r["n_items"]) for r in D.report(spark, d, b).collect())
    assert got == [(0, 0), (11, 2), (11, 2)]
    assert [r["text"] for r in D.clean(spark, d, b).collect()] == ["other"]
    assert D.report(spark, d, b.limit(0)).where("contaminated").count() == 0
    assert D.report(spark, d.limit(0), b).count() == 0


def test_a_long_document(spark):
    body = " ".join(f"x{i % 977}" for i in range(40_000))
    result(spark, [(1, body + " a b c d e f g h i j " + body)], [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")])
