"""A stream into a table by days equals the batch, and leaves other days' files alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import quality
from plumbline.sources import stores
from plumbline.streaming.live_bars import live_bars, upsert_batches


def test_days_are_rewritten_only_where_ticks_fall(spark, tmp_path, sf):
    src = f"{tmp_path}/in"
    t = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    t.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(src)
    store = stores.PartitionedTable(spark, f"file://{tmp_path}/out", ("day",))
    sink, first = upsert_batches(store, ["symbol", "bar_start"], "seq", "bar_start"), {}

    def stamp():
        return {p.parent.name: p.stat().st_mtime_ns for p in tmp_path.glob("out/data/*/*.parquet")}

    def watched(batch, k):
        before, days = stamp(), {f"day={r[0]}" for r in batch.select(F.to_date("bar_start")).distinct().collect()}
        sink(batch, k)
        first[k] = {d for d, at in stamp().items() if before.get(d) != at} <= days

    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live_bars(stream, 60, "30 days").withColumn("seq", F.current_timestamp()).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(watched).start()
    q.processAllAvailable()
    q.stop()
    assert len(first) >= 3 and all(first.values())
    want = live_bars(t, 60)
    assert quality.content_hash(store.read().select(*want.columns)).collect() == quality.content_hash(want).collect()
    assert not list(tmp_path.glob("out/staged-*"))
