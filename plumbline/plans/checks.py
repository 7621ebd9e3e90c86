"""Queries that check, reconcile and serve data, and the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import compute
from ..functions.scalar import round6
from ..operators import quality as q
from ..operators.evaluation import information_coefficient
from ..sources import harness
from ..sources.harness import oracle
from ..sources.stores import demo_panel, tail_recompute, upsert
from ..streaming.live_bars import bursts, live_bars
from .daily import MOM, R, W

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with defects planted by rule, and some rows twice."""
    k = F.dayofmonth("date") + F.substring("symbol", 7, 9).cast("int")
    p = harness.panel_daily(spark, sf).withColumn("k", k)
    p = p.withColumns({
        "low": F.when(F.col("k") % 17 == 0, F.col("high") + 1).otherwise(F.col("low")), "close": F.when(F.col("k") % 19 == 0, None).otherwise(F.col("close")),
        "volume": F.when(F.col("k") % 23 == 0, -1.0).otherwise(F.col("volume")), "adj_factor": F.when(F.col("k") % 29 == 0, 0.5).otherwise(F.col("adj_factor")),
    })
    return p.unionByName(p.where("k % 31 = 0")).drop("k")


DIRTY = """SELECT date, symbol, open, high, CASE WHEN k % 17 = 0 THEN high + 1 ELSE low END AS low, CASE WHEN k % 19 = 0 THEN NULL ELSE close END AS close, CASE WHEN k % 23 = 0 THEN -1.0 ELSE volume END AS volume, amount, CASE WHEN k % 29 = 0 THEN 0.5 ELSE adj_factor END AS adj_factor
  FROM (SELECT *, day(date) + CAST(substr(symbol, 7) AS INT) AS k FROM panel), (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR k % 31 = 0"""
ONCE = "SELECT * FROM dirty"


@query("quality_findings", oracle("""SELECT "check", severity, CAST(n AS BIGINT) AS n FROM (SELECT 'duplicate_key' AS "check", 'hard' AS severity, sum(c) AS n FROM (SELECT count(*) AS c FROM dirty GROUP BY date, symbol HAVING count(*) > 1)
  UNION ALL SELECT 'nonpositive_ohlc', 'hard', count(*) FILTER (NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0, false)) FROM dirty UNION ALL SELECT 'high_below_low', 'hard', count(*) FILTER (high < low) FROM dirty
  UNION ALL SELECT 'close_outside_range', 'hard', count(*) FILTER (close < low OR close > high) FROM dirty UNION ALL SELECT 'negative_volume', 'hard', count(*) FILTER (volume < 0 OR amount < 0) FROM dirty
  UNION ALL SELECT 'bad_adj_factor', 'hard', count(*) FILTER (NOT coalesce(adj_factor > 0, false)) FROM dirty UNION ALL SELECT 'adj_factor_fell', 'warning', count(*) FILTER (adj_factor < pa * 0.99::DOUBLE) FROM lagged
  UNION ALL SELECT 'extreme_change', 'warning', count(*) FILTER (abs(close / pc - 1) > 0.5) FROM lagged) WHERE n > 0""", "panel", dirty=DIRTY, lagged=f"SELECT *, lag(adj_factor) OVER s AS pa, lag(close) OVER s AS pc FROM dirty {W}"))
def quality_findings(spark: SparkSession, sf: str) -> DataFrame:
    return q.findings(_dirty(spark, sf)).select("check", "severity", "n")


@query("missing_dates", oracle("SELECT c.date, s.symbol FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM panel GROUP BY symbol) s JOIN (SELECT DISTINCT date FROM panel) c ON c.date BETWEEN a AND b WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.date = c.date AND p.symbol = s.symbol)", "panel"))
def missing_dates(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf)
    return q.missing_cells(p, p)


def _other(p: DataFrame) -> DataFrame:
    """The panel's closes with some changed, missing or gone."""
    k = F.dayofmonth("date")
    return p.where(k != 30).withColumn("close", F.when(k == 1, None).when(k == 2, F.col("close") + 1).when(k == 3, F.col("close") * (1 + 1e-13)).otherwise(F.col("close")))


OTHER = "SELECT date, symbol, CASE WHEN day(date) = 1 THEN NULL WHEN day(date) = 2 THEN close + 1 ELSE close END AS close, day(date) = 3 AS near FROM panel WHERE day(date) <> 30"


@query("panel_compare", oracle("SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.symbol IS NULL THEN 'left_only' WHEN o.close IS NULL THEN 'right_null' WHEN near THEN 'close' WHEN o.close = p.close THEN 'equal' ELSE 'different' END AS status FROM panel p LEFT JOIN o USING (date, symbol)) GROUP BY status", "panel", o=OTHER))
def panel_compare(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf).where("close > 1")
    return q.compare_cells(p, _other(p), ["date", "symbol"], "close", 1e-12)


@query("difference_classes", oracle("SELECT class, count(*) AS n FROM (SELECT CASE WHEN o.close IS NULL THEN 'vanished' WHEN near THEN 'within_exact' WHEN o.close = p.close THEN 'equal' ELSE 'unclassified' END AS class FROM panel p LEFT JOIN o USING (date, symbol)) GROUP BY class", "panel", o=OTHER))
def difference_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf)
    return q.classify_differences(p, _other(p), ["date", "symbol"], "close").groupBy("class").agg(F.count("*").alias("n"))


@query("content_hash_equal", oracle("SELECT count(*) AS n, true AS same FROM panel", "panel"))
def content_hash_equal(spark: SparkSession, sf: str) -> DataFrame:
    """A table's hash doesn't depend on how its rows are dealt out."""
    p = harness.panel_daily(spark, sf).select("date", "symbol", "close")
    a, b = q.content_hash(p), q.content_hash(p.repartition(7, "symbol").sort("close"))
    return a.join(b.select(F.col("n").alias("m"), F.col("hash").alias("h"))).select("n", ((F.col("hash") == F.col("h")) & (F.col("n") == F.col("m"))).alias("same"))


@query("upsert_latest", oracle("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type"))
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of events; the latest row of each user and type is kept."""
    e = harness.read(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id").drop("event_id")


@query("incremental_equals_full", oracle(f"SELECT date, symbol, {R('mom', 'value')} FROM mom", "panel", mom=MOM))
def incremental_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum up to 1999, then only the tail recomputed over a window that reaches back far enough."""
    p = harness.panel_daily(spark, sf)
    full = lambda x: compute(x, ["momentum_20"]).select("date", "symbol", F.col("momentum_20").alias("value"))
    old = full(p.where("date < '1999-06-01'"))
    return tail_recompute(old, full, p, lookback=21, horizon=10, since="1999-06-01").select("date", "symbol", round6(F.col("value")).alias("value"))


@query("live_bars", oracle(f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bar_start, event_type AS symbol, {R('first(value ORDER BY ts, value)', 'open')}, {R('max(value)', 'high')}, {R('min(value)', 'low')}, {R('last(value ORDER BY ts, value)', 'close')}, count(*) AS n FROM events GROUP BY 1, 2"))
def live_bars_batch(spark: SparkSession, sf: str) -> DataFrame:
    t = harness.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    b = live_bars(t, 30)
    return b.select(F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "symbol", *[round6(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "n")


@query("bursts", oracle("SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT event_type AS symbol, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY symbol, g"))
def tick_bursts(spark: SparkSession, sf: str) -> DataFrame:
    t = harness.read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    b = bursts(t, "20 minutes")
    return b.select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("demo_ic")
def demo_ic(spark: SparkSession, sf: str) -> DataFrame:
    """IC by date of 20-day momentum on the synthetic five-symbol panel (reads no table)."""
    from ..operators.evaluation import forward_returns

    p = forward_returns(compute(demo_panel(spark), ["momentum_20"]))
    return information_coefficient(p.where("momentum_20 IS NOT NULL"), "momentum_20").select("date", round6(F.col("ic")).alias("ic"), "n")
