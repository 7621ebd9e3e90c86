"""Live bars and bursts from a tick stream, and incremental values by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import PartitionedTable, VersionedTable


def live_bars(ticks: DataFrame, minutes: int = 1, late: str = "2 minutes") -> DataFrame:
    """OHLCV by symbol and step of (symbol, ts, price, volume); ticks later than `late` are dropped. Works on a
    batch as well, with the same result. A bar holds the ticks of [start, end)."""
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    at = F.struct("ts", "price")
    out = rows.groupBy(F.window("ts", f"{minutes} minutes"), "symbol").agg(
        F.min(at).alias("a"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at).alias("b"), F.sum("volume").alias("volume"), F.count("*").alias("n"),
    )
    return out.select(F.col("window.start").alias("bar_start"), F.col("window.end").alias("bar_end"), "symbol", F.col("a.price").alias("open"), "high", "low", F.col("b.price").alias("close"), "volume", "n")


def bursts(ticks: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a symbol's ticks that lie less than `gap` apart: (symbol, start, end, n)."""
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    out = rows.groupBy(F.session_window("ts", gap), "symbol").agg(F.count("*").alias("n"))
    return out.select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_batches(store: VersionedTable | PartitionedTable, keys: list[str], order: str, day_of: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key; the same batch written twice changes nothing.

    A versioned table is written anew at each batch. A table partitioned by `day`, the date of column day_of, has only
    the days rewritten that a batch falls in, whatever is stored."""

    def sink(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch.withColumn("day", F.to_date(day_of)) if day_of else batch, keys, order)

    return sink
