"""Embedding near-duplicates by spherical k-means cells and blocked cosine products (operator 9).

Cells are fitted on a bounded sample; every vector is then assigned. Exact copies collapse to one
representative with a count. A vector is also shown to each later cell that could hold a partner beyond the
bisecting plane: for unit vectors x in cell a and y in cell b with cosine >= t, |x - y| <= sqrt(2 - 2t), so
x . (c_a - c_b) <= sqrt(2 - 2t) |c_a - c_b|. No link is lost, whatever the cells. Within a cell, hashed
blocks are compared pair by pair; a task holds two blocks and returns link counts and a spanning forest,
never the pairs. Components come from the forests (shared.components).

There are about as many cells as PER_CELL vectors each make, up to CELLS: beyond PER_CELL * CELLS vectors of one label
the cells grow, and with them the work of a vector.

Defined results: null, zero, empty or non-finite vectors, and null labels, link with nothing; vectors of
unequal length don't link; repeated rows are vectors of their own that link with each other (rows with one
vec_id share its component); vectors with a null vec_id link with their copies only; kept marks the smallest
vec_id of a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, components, least_labels, stream_groups, table

THRESHOLD = 0.98
#: Fitting sample: at most so many vectors in all; vectors that a cell should hold; cells of all labels together, and
#: children of one cell, at most.
SAMPLE, PER_CELL, CELLS, CHILDREN = 60_000, 1_000, 6_000, 64
#: Rows of a block; a task holds two blocks (of vectors of a thousand numbers, 64 MB).
BLOCK = 4_096


def usable(vector, label):
    """Whether a vector can link: present, finite and not zero, with a label."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, each row's own) by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        new = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        if np.allclose(new, c):
            break
        c = new
    return c, (x @ c.T).argmax(axis=1)


def split_cells(x: np.ndarray, scale: float, most: int, seed: int = 7) -> np.ndarray:
    """At most `most` unit centroids for rows x, each of which stands for `scale` vectors: a cell that would hold more
    than PER_CELL is split again, into CHILDREN at most, as long as its rows suffice (eight a child)."""
    done: list[np.ndarray] = []
    todo = [x]
    while todo:
        rows = todo.pop()
        left = most - len(done) - len(todo)
        k = int(min(CHILDREN, left, len(rows) // 8, round(len(rows) * scale / PER_CELL)))
        if k < 2:
            mean = rows.sum(axis=0)
            norm = float(np.sqrt((mean * mean).sum()))
            done.append(mean / norm if norm > 1e-12 else rows[0])
            continue
        c, at = _kmeans(rows, k, seed)
        parts = [rows[at == i] for i in range(k) if (at == i).any()]
        if len(parts) < 2:
            done.append(c[0])
        else:
            todo += sorted(parts, key=len)
    return np.array(done)


def fit_cells(rows: DataFrame, seed: int = 7) -> dict:
    """{(label, dim): unit centroids} by spherical k-means, level by level, over at most SAMPLE vectors (label, vec).

    The sample is by hash of the vector, so it is the same however the table is dealt out; the driver holds
    SAMPLE vectors at most, as arrays. Labels that the sample misses have one cell, which is exact as well."""
    n = rows.count()
    part = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < int(900_000 * SAMPLE / n))
    got = part.select("label", "vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(SAMPLE).drop("h").toArrow()
    labels, vecs = got.column("label").to_pylist(), got.column("vec").combine_chunks()
    flat, off = np.asarray(vecs.values, dtype=np.float64), np.asarray(vecs.offsets)
    groups: dict = {}
    for i, key in enumerate(zip(labels, (off[1:] - off[:-1]).tolist(), strict=True)):
        groups.setdefault(key, []).append(i)
    scale, out, left = max(1.0, n / SAMPLE), {}, CELLS
    for key in sorted(groups, key=lambda k: (-len(groups[k]), str(k))):
        x = _unit(np.stack([flat[off[i] : off[i + 1]] for i in groups[key]]))
        c = split_cells(x[np.lexsort(x.T)], scale, left, seed)
        if len(c) > 1:
            left -= len(c)
            out[key] = c
    return out


def assign(reps: DataFrame, cells: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(label, cell, home, rep, n, vec): each representative in its own cell, and in later cells near enough."""
    shared = reps.sparkSession.sparkContext.broadcast(cells)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, vecs = b.column(0).to_pylist(), b.column(3)
            flat, off = np.asarray(vecs.values, dtype=np.float64), np.asarray(vecs.offsets)
            take: list[int] = []
            cell: list[int] = []
            home: list[bool] = []
            by: dict = {}
            for i, key in enumerate(zip(labels, (off[1:] - off[:-1]).tolist(), strict=True)):
                by.setdefault(key, []).append(i)
            for key, idx in by.items():
                if (c := shared.value.get(key)) is None:
                    take += idx
                    cell += [0] * len(idx)
                    home += [True] * len(idx)
                    continue
                x = _unit(np.stack([flat[off[i] : off[i + 1]] for i in idx]))
                dots = x @ c.T
                own = dots.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
                near = dots[np.arange(len(x)), own][:, None] - dots <= reach * apart[own]
                near &= np.arange(len(c))[None, :] >= own[:, None]
                near[np.arange(len(x)), own] = True
                r, k = np.nonzero(near)
                take += [idx[i] for i in r]
                cell += k.tolist()
                home += (own[r] == k).tolist()
            t = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), pa.array(cell, pa.int32()), pa.array(home), b.column(1).take(t), b.column(2).take(t), vecs.take(t)], names=["label", "cell", "home", "rep", "n", "vec"])

    kinds = dict(reps.dtypes)
    return reps.select("label", "rep", "n", "vec").mapInArrow(run, f"label {kinds['label']}, cell int, home boolean, rep bigint, n bigint, vec {kinds['vec']}")


def _compare(threshold: float):
    def work(t: pa.Table) -> pa.RecordBatch | None:
        """Links of one pair of blocks: counts for each side and one edge for each vector to its local root."""
        side = t.column("side").to_numpy()
        home, rep, n = t.column("home").to_numpy(), t.column("rep").to_numpy(), t.column("n").to_numpy()
        vecs = t.column("vec").combine_chunks()
        dims = np.diff(np.asarray(vecs.offsets))
        same = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
        flat, off = np.asarray(vecs.values, dtype=np.float64), np.asarray(vecs.offsets)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            raw = np.stack([flat[off[i] : off[i + 1]] for i in rows])
            x = _unit(raw)
            left = np.flatnonzero(side[rows] == 0)
            right = left if same else np.flatnonzero(side[rows] == 1)
            for s in range(0, len(left), 512):
                a = left[s : s + 512]
                cos = x[a] @ x[right].T
                p, q = np.nonzero(cos >= threshold - 1e-9)
                i, j = a[p], right[q]
                gi, gj = rows[i], rows[j]
                ok = (gi < gj) if same else np.ones(len(i), dtype=bool)
                ok &= (home[gi] | home[gj]) & (rep[gi] != rep[gj])
                close = np.abs(cos[p, q] - threshold) <= 1e-9
                for m in np.flatnonzero(ok & close):
                    u, v = raw[i[m]], raw[j[m]]
                    ok[m] = float((u * v).sum()) / (float(np.sqrt((u * u).sum())) * float(np.sqrt((v * v).sum()))) >= threshold
                found.append((gi[ok], gj[ok]))
        if not found:
            return None
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        links = np.bincount(i, n[j], len(rep)).astype(np.int64) + np.bincount(j, n[i], len(rep)).astype(np.int64)
        hit = np.flatnonzero(links)
        if not len(hit):
            return None
        return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit]), pa.array(rep[least_labels(len(rep), i, j)[hit]])], names=["rep", "links", "root"])

    return work


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, embedding, label): see the module."""
    run = Scratch(spark, "cells")
    rows = vectors.select("vec_id", "label", F.when(usable(F.col("embedding"), F.col("label")), F.col("embedding")).alias("vec"))
    key = [F.xxhash64("vec", "label").alias("k1"), F.hash("label", "vec").alias("k2")]
    good = rows.where("vec IS NOT NULL").select("vec_id", "label", "vec", *key)
    reps = run.keep(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec")), "reps")
    members = run.keep(assign(reps.where("rep IS NOT NULL"), fit_cells(reps), threshold), "members")
    blocks = members.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    placed = members.join(blocks, ["label", "cell"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    pairs = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        F.xxhash64("label", "cell", F.least("b", "o"), F.greatest("b", "o")).alias("g"), F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"),
        F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "home", "rep", "n", "vec", "label", "cell",
    )
    sized = pairs.repartition("g").sortWithinPartitions("g", "label", "cell", "bi", "bj", "rep")
    found = run.keep(sized.mapInArrow(stream_groups(["g", "cell", "bi", "bj"], _compare(threshold)), "rep bigint, links bigint, root bigint"), "links")
    comp = components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b")), run, "cc").withColumnRenamed("node", "rep")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    out = reps.select("k1", "k2", "rep", "n").join(totals, "rep", "left").join(comp, "rep", "left")
    out = out.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    full = good.select("vec_id", "k1", "k2").join(out, ["k1", "k2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return full.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS m FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.m > 0 AND b.m > 0 AND list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.x LEFT JOIN k ON vec_id = k.x"""
