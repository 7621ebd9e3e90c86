"""What several corpus operators need: shared-folder tables, word patterns, components, group streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir as shared_dir

#: Words after A-Z are lower-cased: digits, a-z and every character beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table may be broadcast up to so many rows of at most a few hundred bytes; callers count first.
BROADCAST_ROWS = 200_000
#: And where rows have no bound of their own, up to so many bytes in all.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """A-Z lower-cased, all else kept; plain lower() only where every character is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def once(x, f):
    """f(x) with x evaluated once, however often f names it (inside a lambda Spark shares no subexpressions)."""
    return F.element_at(F.transform(F.array(x), f), 1)


_owner: ContextVar[list[Scratch] | None] = ContextVar("owner", default=None)


@contextmanager
def owned() -> Iterator[None]:
    """The tables of every Scratch that this thread opens inside are deleted at the end; write the result before."""
    mine: list[Scratch] = []
    before = _owner.set(mine)
    try:
        yield
    finally:
        _owner.reset(before)
        for s in mine:
            s.clear()


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor.

    A lazy result may still read them, so they stay until clear(), or the end of the owned() block around."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if (mine := _owner.get()) is not None:
            mine.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else as it is, to be joined by shuffle. size: the
    bytes of a row, if rows may be of any size; then all of them may have `most` together."""
    if size is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= most else df


def block_count(size: Column, block: int) -> Column:
    """Blocks that a group of so many rows is dealt into: of `block` rows, or down to a quarter of that where the group
    would else make few tasks. One block if the group fits into the smaller ones."""
    return F.ceil(size / F.greatest(F.lit(max(1, block // 4)), F.least(F.lit(block), F.ceil(size / 16)))).cast("int")


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For places 0..n-1 linked by (i, j), the least place of each one's component; by halving of paths."""
    top = np.arange(n)
    while len(i):
        low = np.minimum(top[i], top[j])
        new = top.copy()
        np.minimum.at(new, top[i], low)
        np.minimum.at(new, top[j], low)
        while (flat := new[new]).tobytes() != new.tobytes():
            new = flat
        if np.array_equal(new, top):
            break
        top = new
    return top


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: (a, b) long.

    Alternates large-star and small-star until the edge set is its own image; each round is written to the
    shared folder. Nodes without edges are absent. Hot nodes are pre-aggregated before the shuffle, and the
    joins back are plain equi-joins that adaptive execution can split.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e, f"{name}-0")
    was, k = mark(e), 0
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.join(least(large), "u")
        e2 = low.select("u", F.col("m").alias("v")).unionByName(low.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e2 = scratch.keep(e2.where("u <> v").distinct(), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
        now, k, e = mark(e2), k + 1, e2
        if now == was:
            break
        was = now
    # every node now has one edge, to the smallest node of its component
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def stream_groups(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | pa.Table | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows that are sorted by keys within each partition: work on one group at a time.

    Holds one group (and one batch) in memory; many small groups cost no task or Python call of their own
    beyond work itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            out = work(t)
            if out is not None and out.num_rows:
                yield from pa.Table.from_batches([out]).to_batches() if isinstance(out, pa.RecordBatch) else out.to_batches()

        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(b.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols)
            starts = [0, *np.flatnonzero(new).tolist()]
            ends = [*starts[1:], b.num_rows]
            for s, e in zip(starts, ends, strict=True):
                piece = b.slice(s, e - s)
                if s == 0 and held and first == last:
                    held.append(piece)
                    continue
                if held:
                    yield from emit(pa.Table.from_batches(held))
                held = [piece]
            last = tuple(c[-1] for c in cols)
        if held:
            yield from emit(pa.Table.from_batches(held))

    return run
