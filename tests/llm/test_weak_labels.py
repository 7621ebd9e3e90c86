"""EM and the lexicons against plain sums, and what posteriors of unlabelled documents are."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality_model as Q


def plain_em(rows, trust=Q.TRUST, rounds=200):
    """The same model over single documents' votes, by loops."""
    width, n = len(rows[0]), len(rows)
    told = [r for r in rows if r[0]]
    share = {c: sum(r[0] == c for r in told) for c in (-1, 1)}
    q = None
    for _ in range(rounds):
        table = [[[0.5, 0.0, 0.5] for _ in range(2)] for _ in range(width)]
        if q is None:
            prior = share[1] / len(told)
        else:
            prior = sum(q) / n
            for r, x in zip(rows, q, strict=True):
                for j, v in enumerate(r):
                    table[j][1][v + 1] += x
                    table[j][0][v + 1] += 1 - x
        for r in told:
            for j, v in enumerate(r):
                if j:
                    table[j][int(r[0] > 0)][v + 1] += 1.0 if q is None else n / len(told)
        for c, wrong, right in ((1, 0, 2), (0, 2, 0)):
            said = table[0][c][0] + table[0][c][2]
            table[0][c][right] = said * (table[0][c][right] + trust * len(told)) / (said + len(told))
            table[0][c][wrong] = said - table[0][c][right]
        new = []
        for r in rows:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(r):
                if v:
                    good, bad = (table[j][c][v + 1] / (table[j][c][0] + table[j][c][2]) for c in (1, 0))
                    odds += math.log(good) - math.log(bad)
            new.append(1 / (1 + math.exp(-max(-35, min(35, odds)))))
        if q is not None and max(abs(a - b) for a, b in zip(q, new, strict=True)) < 1e-7:
            break
        q = new
    return q, prior


def drawn(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        good = rng.random() < 0.7
        say = lambda acc, cover: 0 if rng.random() > cover else (1 if good else -1) * (1 if rng.random() < acc else -1)
        rows.append((say(0.98, 0.4), say(0.8, 0.9), say(0.7, 0.8), say(0.9, 0.5)))
    return rows


def test_em_over_patterns_equals_em_over_documents():
    rows = drawn()
    patterns = sorted(Counter(rows).items())
    table, prior = Q.estimate(patterns)
    want, share = plain_em(rows)
    got = dict(zip([p for p, _ in patterns], Q.posterior(np.array([p for p, _ in patterns]), table, prior), strict=True))
    assert abs(prior - share) < 1e-5
    assert max(abs(got[r] - x) for r, x in zip(rows, want, strict=True)) < 1e-4


def test_posteriors_of_unlabelled_documents_come_from_the_other_labellers():
    patterns = sorted(Counter(drawn(5000)).items())
    table, prior = Q.estimate(patterns)
    p = {v: float(x) for v, x in zip([p for p, _ in patterns], Q.posterior(np.array([p for p, _ in patterns]), table, prior), strict=True)}
    free = {v: x for v, x in p.items() if not v[0] and any(v)}
    assert len({round(x, 3) for x in free.values()}) > 10 and any(0.05 < x < 0.95 for x in free.values())
    assert all(p[0, 1, 1, 1] >= x >= p[0, -1, -1, -1] for x in free.values())
    accuracy = Q.accuracies(table, prior, ("labels", "a", "b", "c"))
    assert [round(accuracy[k], 1) for k in ("labels", "a", "b", "c")] == [1.0, 0.8, 0.7, 0.9]
    # a label is outvoted where all others agree, if labels are often wrong
    assert Q.estimate(patterns, trust=0.6)[0][0, 1, 2] < table[0, 1, 2]


def test_lexicons_equal_plain_counts(spark):
    rng = random.Random(5)
    rows, abuse = [], []
    for i in range(200):
        bad = i % 4 == 0
        words = [f"plain{rng.randrange(50)}" for _ in range(30)] + (["vile", "nasty"] if bad and i % 3 else [])
        rows.append((i, " ".join(words)))
        abuse.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gold = Q.label_votes(spark.createDataFrame(abuse, "doc_id long, quality int, toxic int"))
    got = Q.lexicons_of(docs, gold)
    for which in (0, 1):
        bad, good = Counter(), Counter()
        for (_, text), (_, _, toxic) in zip(rows, abuse, strict=True):
            (bad if toxic else good).update(Q._hashed(text)[which].tolist())
        want = set()
        for w, b in bad.items():
            n = b + good[w]
            p = b / n
            gain = n * (p * math.log(p / 0.25) + ((1 - p) * math.log((1 - p) / 0.75) if p < 1 else 0))
            if p >= Q.LEXICON_SHARE and gain >= math.log((1 << Q.BITS) / Q.LEXICON_LUCK):
                want.add(w)
        assert want and set(np.flatnonzero(got[which]).tolist()) == want


def test_unlabelled_documents_are_fitted_on_at_every_size(spark):
    fine = " ".join(f"word{i}" for i in range(60))
    junk = "!! ## $$ %% && " * 30
    docs = spark.createDataFrame([(i, f"{junk if i % 3 == 0 else fine} end{i}") for i in range(90)], "doc_id long, text string")
    for labelled in (4, 12, 90):
        labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(labelled)], "doc_id long, quality int, toxic int")
        model = Q.fit(spark, docs, labels)
        assert model.fitted_on == 90
        kept = {r["doc_id"] for r in Q.score(docs, model).where(F.col("quality_score") >= Q.THRESHOLD).collect()}
        assert kept == {i for i in range(90) if i % 3}
    assert Q.fit(spark, docs, labels, sample=30).fitted_on <= 30
    small = Q.fit(spark, docs, labels, most_bytes=4000).fitted_on
    assert 0 < small < 30
    same = spark.createDataFrame([(None, fine)] * 20 + [(7, junk)] * 20, "doc_id long, text string")
    assert Q.fit(spark, same, labels).fitted_on == 40
