from __future__ import annotations

import numpy as np
import pytest

from plumbline.llm import embedding_cells as E

NAN, INF = float("nan"), float("inf")


def brute(rows, t=0.98):
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    link = np.zeros((len(rows), len(rows)), dtype=bool)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and ok[i] and ok[j] and la == lb and len(a) == len(b):
                x, y = (np.array(v, dtype=np.float32).astype(float) for v in (a, b))
                link[i, j] = (x @ y) / np.sqrt((x @ x) * (y @ y)) >= t
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[i], *[low[j] for j in np.flatnonzero(link[i])]]) for i in range(len(rows))]
    return {r[0]: (int(link[i].sum()), low[i]) for i, r in enumerate(rows)}


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.near_duplicates(spark, df, **more).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out, k = [], 0
    for label in (1, 2):
        for _ in range(6):
            c = rng.normal(size=12)
            for _ in range(12):
                out.append((k, [float(x) for x in c + rng.normal(size=12) * rng.choice([0.02, 0.15, 0.4])], label))
                k += 1
    out += [(k, out[0][1], 1), (k + 1, out[0][1], 2), (k + 2, out[0][1], None), (k + 3, None, 1), (k + 4, [0.0] * 12, 1), (k + 5, [NAN] + [1.0] * 11, 1), (k + 6, [INF] + [1.0] * 11, 1), (k + 7, [], 1), (k + 8, [2 * x for x in out[0][1]], 1), (k + 9, [1.0, 2.0], 1), (k + 10, [1.0, 2.0], 1), (k + 11, [None] + [1.0] * 11, 1)]
    return out


def test_equals_brute_force_with_many_cells_and_small_blocks(spark, rows, monkeypatch):
    want = brute(rows)
    assert result(spark, rows) == want
    monkeypatch.setattr(E, "PER_CELL", 5)
    assert max(len(c) for c in E.fit_cells(spark.createDataFrame([(r[2], r[1]) for r in rows[:140]], "label int, vec array<float>")).values()) > 3
    assert result(spark, rows, block=7) == want


def test_repeated_rows_and_empty(spark, rows):
    got = E.near_duplicates(spark, spark.createDataFrame([rows[0], rows[0]], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got] == [(1, 0, True)] * 2
    assert E.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_hot_vector(spark):
    v = [1.0, 2.0, 3.0]
    got = result(spark, [(i, v if i % 3 else [1.0, 2.0, 3.0 + i * 1e-4], 1) for i in range(90)], block=8)
    assert set(got.values()) == {(89, 0)}


def test_null_ids(spark):
    got = E.near_duplicates(spark, spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (2, [1.0, 2.01], 1), (3, [1.0, 2.02], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"]) == [(2, 1), (3, 1)] and len(got) == 4
