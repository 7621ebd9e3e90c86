"""N-gram Jaccard join by a MinHash LSH forest with exact verification (operator 3).

Documents with the same words are one class. Each class has a MinHash signature, read as TREES labels of DEPTH
hashes; a bucket at depth k is a node of the prefix trie of one tree (a run of the sorted labels). Matched
prefixes start long and are shortened until the recall expected at the threshold, 1 - (1 - s^k)^TREES, reaches
the target; at each step, buckets whose members are already together cost nothing more. Within a bucket,
blocks of signatures are compared; pairs whose estimate is over five standard deviations below the threshold
part. What is then connected is verified: every pair within such a group, by exact Jaccard over its shingles, in
blocks. Tasks return link counts and spanning forests, never pairs, so nothing grows with the square of a group.

Words are lower-cased in A-Z; digits, letters and characters beyond ASCII are word characters. Shingles take
five words; a text of fewer has one shingle. Shingles are 64-bit hashes.

Defined results: null texts and texts without words have no shingles and link with nothing; copies link with
each other and share their class's links (n_links counts documents); repeated rows are documents of their own, and
so are rows with one doc_id but other texts (class_id is the least id of a group, so such rows may name one class_id
and be of one class or two); texts whose ids are all null link with their copies only; very long texts are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, WORD, Scratch, block_count, components, least_labels, stream_groups, table

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH, STEP = 20, 6, 2
#: Signature estimates have a standard deviation of at most sqrt(s (1 - s) / 120) = 0.037 at s = 0.8.
SLACK = 0.2
#: A block holds about so many documents, and verified ones so many shingles, at most; a task holds two blocks.
BLOCK, SHINGLES = 1_024, 2_000_000

_U = np.uint64
_rng = np.random.default_rng(20_240_131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_SEAT = _rng.integers(1, 2**63, N, dtype=np.uint64) * _U(2) + _U(1)
_MUL = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown by doubling."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = [np.concatenate(([_U(1)], np.multiply.accumulate(np.full(size - 1, b, dtype=np.uint64)))) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order, by sums over the text's bytes."""
    return word_and_stem_hashes(text, 0)[0]


def word_and_stem_hashes(text: str, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes(text), and as many hashes of the words' first `stem` bytes (empty for 0)."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    none = np.zeros(0, dtype=np.uint64)
    if not len(data):
        return none, none
    inside = np.concatenate(([False], _IS_WORD[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _power_table(len(data))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    hashed = lambda end: _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashed(end), hashed(np.minimum(end, start + stem)) if stem else none


def shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h += words[j : len(words) - k + 1 + j] * _SEAT[j]
    return np.unique(_mix(h))


def signature(sh: np.ndarray) -> np.ndarray:
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(sh), 2048):
        part = ((sh[s : s + 2048][None, :] * _MUL[:, None] + _ADD[:, None]) >> _U(32)).min(axis=1).astype(np.uint32)
        np.minimum(out, part, out=out)
    return out


def _fingerprint(words: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sign(docs: DataFrame, id_col: str = "doc_id", n: int = N) -> DataFrame:
    """(doc, d1, d2, f1, f2, m, sig) of every document: d1, d2 stand for its id and text, f1, f2 for its words, m is
    its number of shingles; null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f1, f2, m, sig = [], [], [], []
            for x in b.column(3):
                w = word_hashes(x.as_py() or "")
                if not len(w):
                    f1.append(None), f2.append(None), m.append(None), sig.append(None)
                    continue
                a, c = _fingerprint(w)
                sh = shingles(w, n)
                f1.append(a), f2.append(c), m.append(len(sh)), sig.append(signature(sh).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(m, pa.int64()), pa.array(sig, pa.binary())], names=["doc", "d1", "d2", "f1", "f2", "m", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), *row_key(id_col), "text").mapInArrow(run, "doc bigint, d1 bigint, d2 int, f1 bigint, f2 bigint, m bigint, sig binary")


def row_key(id_col: str) -> list[Column]:
    """96 bits that stand for a row's id and text."""
    return [F.xxhash64(id_col, "text").alias("d1"), F.hash("text", id_col).alias("d2")]


def depths(threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """Prefix lengths from the longest down to the first that reaches the recall."""
    out, k = [], DEPTH
    while True:
        out.append(k)
        if k <= 1 or 1 - (1 - threshold**k) ** TREES >= recall:
            return out
        k = max(1, k - STEP)


def _in_blocks(rows: DataFrame, group: str, n_blocks: Column, keep: list[str]) -> DataFrame:
    """rows of each group dealt into hashed blocks, one copy for each pair of blocks that a row is in."""
    at = rows.withColumn("nb", n_blocks.cast("int")).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("b", "o"), F.greatest("b", "o")
    out = at.select(F.xxhash64(group, lo, hi).alias("g"), F.col(group).alias("key"), lo.alias("bi"), hi.alias("bj"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "node", *keep)
    return out.repartition("g").sortWithinPartitions("g", "key", "bi", "bj", "node")


GROUP = ["g", "key", "bi", "bj"]


def _similar(least: float):
    def work(t: pa.Table) -> pa.RecordBatch | None:
        """Edges of one pair of blocks: each member to the first of those that it is connected with by signature."""
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint32).reshape(len(node), -1)
        same = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        need = least * sig.shape[1]
        if not len(left) or not len(right):
            return None
        step, found = max(1, 4_000_000 // (len(right) * sig.shape[1])), []
        for s in range(0, len(left), step):
            a = left[s : s + step]
            p, q = np.nonzero((sig[a][:, None, :] == sig[right][None, :, :]).sum(axis=2) >= need)
            i, j = a[p], right[q]
            ok = i < j if same else i != j
            found.append((i[ok], j[ok]))
        top = least_labels(len(node), *(np.concatenate(x) for x in zip(*found, strict=True)))
        hit = np.flatnonzero(top != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[top[hit]])], names=["a", "b"]) if len(hit) else None

    return work


def candidates(spark: SparkSession, classes: DataFrame, run: Scratch, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame | None:
    """(node, component): groups of classes (node, sig) that may hold links; classes that are alone are absent."""
    comp, edges = None, None
    for k in depths(threshold, recall):
        own = classes.select("node", F.col("node").alias("comp"), "sig") if comp is None else classes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), "sig")
        prefixes = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 1 + 4 * DEPTH * t, 4 * k)) for t in range(TREES)])
        at = own.select("node", "comp", F.explode(prefixes).alias("bucket"))
        live = at.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", "size")
        members = at.join(live, "bucket").select("bucket", "size", "node").join(classes.select("node", "sig"), "node")
        found = _in_blocks(members, "bucket", block_count(F.col("size"), block), ["sig"]).mapInArrow(stream_groups(GROUP, _similar(threshold - SLACK)), "a bigint, b bigint")
        found = run.keep(found.distinct(), f"edges-{k}")
        edges = found if edges is None else edges.unionByName(found)
        comp = run.keep(components(spark, edges, run, f"near-{k}"), f"groups-{k}")
    return comp


def _verify(threshold: float):
    def work(t: pa.Table) -> pa.RecordBatch | None:
        """Exact links of one pair of blocks: (node, links weighted by copies, local root)."""
        node, first = np.unique(t.column("node").to_numpy(), return_index=True)
        side, n = t.column("side").to_numpy()[first], t.column("n").to_numpy()[first]
        raw = t.column("sh")
        sets = [np.frombuffer(raw[i].as_py(), dtype=np.uint64) for i in first.tolist()]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        same = t.column("bi")[0].as_py() == t.column("bj")[0].as_py()
        m = len(node)
        both = np.zeros((m, m), dtype=np.float32) if m > 2 else None
        if m == 2:
            both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2, dtype=np.float32)
        elif m > 2:
            value, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(m), size)
            shared = count > 1
            place = np.cumsum(shared) - 1
            keep = shared[col]
            row, col, width = row[keep], place[col[keep]], int(shared.sum())
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            for s in range(0, width, 4096):
                lo, hi = np.searchsorted(col, [s, s + 4096])
                part = np.zeros((m, min(4096, width - s)), dtype=np.float32)
                part[row[lo:hi], col[lo:hi] - s] = 1
                both += part @ part.T
        else:
            return None
        jac = both / (size[:, None] + size[None, :] - both)
        ok = np.triu(jac >= threshold - 1e-5, 1)
        if not same:
            ok &= side[:, None] != side[None, :]
        i, j = np.nonzero(ok)
        inter = both[i, j].astype(np.float64)
        sure = inter / (size[i] + size[j] - inter) >= threshold
        i, j = i[sure], j[sure]
        links = np.bincount(i, n[j], m).astype(np.int64) + np.bincount(j, n[i], m).astype(np.int64)
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[least_labels(m, i, j)[hit]])], names=["node", "links", "root"]) if len(hit) else None

    return work


def judged(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id_col, d1, d2, n_links, class_id, kept) of every document; kept: of the smallest id of its class, or no words.

    The nodes of the graph are classes of documents with the same words, numbered as their table is written, so that
    neither a repeated id nor a hash can merge two texts."""
    run = Scratch(spark, "forest")
    signed = run.keep(sign(docs, id_col, n), "signed")
    some = signed.where("sig IS NOT NULL")
    found = some.groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.count("*").alias("n"), F.first("m").alias("m"), F.first("sig").alias("sig"))
    classes = run.keep(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = candidates(spark, classes.where("rep IS NOT NULL"), run, threshold, recall, block)
    weighed = groups.join(classes.select("node", "m"), "node").groupBy("component").agg(F.count("*").alias("size"), F.sum("m").alias("weight"))
    sized = groups.join(weighed, "component")
    chosen = classes.select("f1", "f2", "node", F.col("rep").alias("doc"), "n").join(sized, "node")
    # one row of each class, of its smallest id: rows with that id but other words are told apart by their words
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), "text").join(chosen, "doc").select("node", "component", "size", "weight", "n", "f1", "f2", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, take = [], []
            for i, (f1, f2, x) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist(), b.column(7), strict=True)):
                w = word_hashes(x.as_py() or "")
                if len(w) and _fingerprint(w) == (f1, f2):
                    take.append(i)
                    got.append(shingles(w, n).tobytes())
            t = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(t) for k in range(5)], pa.array(got, pa.binary())], names=["node", "component", "size", "weight", "n", "sh"])

    sets = texts.mapInArrow(cut, "node bigint, component bigint, size bigint, weight bigint, n bigint, sh binary")
    blocks = F.greatest(block_count(F.col("size"), block), F.ceil(F.col("weight") / SHINGLES).cast("int"))
    links = run.keep(_in_blocks(sets, "component", blocks, ["n", "sh"]).mapInArrow(stream_groups(GROUP, _verify(threshold)), "node bigint, links bigint, root bigint"), "links")
    comp = components(spark, links.select(F.col("node").alias("a"), F.col("root").alias("b")), run, "cc")
    least = comp.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    totals = links.groupBy("node").agg(F.sum("links").alias("links")).join(comp, "node", "left").join(least, "component", "left")
    per = classes.select("f1", "f2", "rep", "n", "node").join(totals, "node", "left")
    per = per.select("f1", "f2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"))
    own = [F.col("doc").alias(id_col), "d1", "d2"]
    out = some.select("doc", "d1", "d2", "f1", "f2").join(per, ["f1", "f2"]).select(*own, "n_links", "class_id")
    bare = signed.where("sig IS NULL").select(*own, F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("class_id"))
    return out.unionByName(bare).withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id_col, n_links, class_id, kept) of every document."""
    return judged(spark, docs, id_col, threshold, n, recall, block).drop("d1", "d2")


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that near-duplicate detection keeps, all columns: of a class, the document of the smallest id,
    once however often the row is repeated (by the id and text); of several texts with that id, each. Documents
    without words all stay."""
    seen = judged(spark, docs, id_col).groupBy("d1", "d2").agg(F.count("*").alias("n"), F.max("n_links").alias("links"), F.max("kept").alias("kept"))
    told = Scratch(spark, "told").keep(seen.where("NOT kept OR (n > 1 AND links > 0)").select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "kept"), "rows")
    d1, d2 = row_key(id_col)
    keyed = docs.withColumns({"__d1": d1, "__d2": d2})
    alone = keyed.join(told.drop("kept"), ["__d1", "__d2"], "left_anti")
    repeated = keyed.join(told.where("kept").drop("kept"), ["__d1", "__d2"], "left_semi").dropDuplicates(["__d1", "__d2"])
    return alone.unionByName(repeated).drop("__d1", "__d2")


def op3_shingle_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def rows_sql(docs: str) -> str:
    """DuckDB CTEs (to follow WITH RECURSIVE) that end in `near` (doc_id, n_links, class_id)."""
    return f"""
nd AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), $p${WORD}$p$) AS dw FROM {docs}),
ns AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(dw) - {N} + 1, 1) + 1), lambda s: array_to_string(dw[s:s + {N} - 1], ' '))) AS sh FROM nd WHERE len(dw) > 0),
nx AS (SELECT doc_id, len(sh) AS m, unnest(sh) AS s FROM ns),
np AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.m) + any_value(b.m) AS t, count(*) AS i FROM nx a JOIN nx b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
nl AS (SELECT x, y FROM np WHERE 5 * i >= 4 * (t - i)),
nr AS (SELECT doc_id AS x, doc_id AS y FROM {docs} UNION SELECT nr.x, nl.y FROM nr JOIN nl ON nr.y = nl.x),
near AS (SELECT r.x AS doc_id, class_id, coalesce(n_links, 0) AS n_links FROM (SELECT x, min(y) AS class_id FROM nr GROUP BY x) r LEFT JOIN (SELECT x, count(*) AS n_links FROM nl GROUP BY x) k ON r.x = k.x)"""


ORACLE = f"WITH RECURSIVE {rows_sql('documents')} SELECT doc_id, n_links, class_id, doc_id = class_id AS kept FROM near"
