"""Domain tables derived from the star schema, and the same derivations as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def panel_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, symbol, open, high, low, close, volume, amount, adj_factor): one row for each brand and ship day."""
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = l.join(p, l.l_partkey == p.p_partkey).select(
        F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct(*ORDER).alias("at"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_quantity").cast("bigint").alias("qty"),
    )
    out = rows.groupBy("date", "symbol").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("qty").cast("double").alias("volume"), (F.sum("cents") / 100.0).alias("amount"),
    )
    return out.withColumn("adj_factor", 1 + 0.05 * (F.year("date") - 1995))


def covariates(panel: DataFrame) -> DataFrame:
    """panel with industry (first digit of the brand), market cap, and price ratios pe, pb (some not positive)."""
    cap = F.col("volume") * 1000 * (1 + F.month("date") / 100)
    return panel.withColumns({"industry": F.substring("symbol", 7, 1), "market_cap": cap, "pe": F.col("close") / 40 - 20, "pb": F.when(F.dayofmonth("date") % 7 != 0, F.col("close") / 500)})


def fina(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosures (symbol, ann_date, end_date, value): orders by customer bucket, several reports a date."""
    o = read(spark, sf_dir, "orders")
    name = F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1)
    rows = o.select(name.alias("symbol"), F.to_date("o_orderdate").alias("ann_date"), F.to_date(F.date_trunc("quarter", F.add_months("o_orderdate", (-3 * (F.col("o_orderkey") % 2)).cast("int")))).alias("end_date"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), "o_orderstatus")
    return rows.groupBy("symbol", "ann_date", "end_date").agg(F.when(F.max("o_orderstatus") != "P", F.sum("cents") / 100.0).alias("value"))


def snapshots(panel: DataFrame) -> DataFrame:
    """Membership snapshots (snap, symbol) at month starts; a brand is out every fifth month in turn."""
    months = panel.select(F.to_date(F.date_trunc("month", "date")).alias("snap")).distinct()
    names = panel.select("symbol").distinct()
    k = F.substring("symbol", 7, 9).cast("int")
    return months.crossJoin(names).where((k + F.year("snap") * 12 + F.month("snap")) % 5 != 0)


def bars(spark: SparkSession, sf_dir: str, minutes: int = 15, wide: bool = False) -> DataFrame:
    """Intraday bars (trade_date, symbol, bar_start, bar_end, available_time, slot, OHLC, volume, amount).

    A tick belongs to the bar that ends at the next full step. wide: twenty symbols by user, else event types."""
    e = read(spark, sf_dir, "events")
    step = minutes * 60
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    end = F.ceil(sec / step) * step
    symbol = F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")) if wide else F.col("event_type")
    t = e.select(symbol.alias("symbol"), "ts", end.alias("e"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.col("value") * 100).cast("bigint").alias("c"))
    t = t.where("price IS NOT NULL")
    out = t.groupBy("symbol", "e").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"),
        F.sum("k").cast("double").alias("volume"), (F.sum(F.col("c") * F.col("k")) / 100.0).alias("amount"),
    )
    stamp = lambda s: F.timestamp_seconds(s).cast("timestamp_ntz")
    return out.select(
        F.to_date(stamp(F.col("e") - 1)).alias("trade_date"), "symbol", stamp(F.col("e") - step).alias("bar_start"), stamp(F.col("e")).alias("bar_end"), stamp(F.col("e") + 60).alias("available_time"),
        (((F.col("e") - 1) % 86400 + 1) / 60).cast("int").alias("slot"), "open", "high", "low", "close", "volume", "amount",
    )


#: Days of dense_bars, and minutes of a day's two sessions (the first bar ends at 09:31, the last at 15:00).
DENSE_DAYS, DENSE_MINUTES = 30, 240


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars of whole sessions, of the columns of bars(): one symbol for each nation, figures by whole-number
    arithmetic. As dense as real ones, so that the factors' own least counts are met."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    days = n.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DENSE_DAYS - 1).cast("long"))))
    t = days.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DENSE_MINUTES - 1).cast("long"))))
    t = t.selectExpr("*", "(k * 7919 + d * 104729 + m * 1299709 + m * m * 31 + k * m * 17 + d * m * 13) % 1000 AS u", "(k * 131 + d * 2713 + m * 7717 + m * m * 7 + d * d * 11 + k * d * m * 3) % 1000 AS w")
    t = t.selectExpr("*", "50 + k + (u % 97) / 10D AS open", "50 + k + (w % 101) / 10D AS close", "cast(100 + u + if(w < 60, 3000, 0) AS double) AS volume", "cast(if(m < 120, 571, 661) + m AS int) AS slot")
    t = t.withColumn("e", F.lit(1_704_067_200) + F.col("d") * 86_400 + F.col("slot") * 60)
    stamp = lambda s: F.timestamp_seconds(s).cast("timestamp_ntz")
    return t.select(
        F.to_date(stamp(F.col("e") - 1)).alias("trade_date"), F.concat(F.lit("N"), F.col("k").cast("string")).alias("symbol"), stamp(F.col("e") - 60).alias("bar_start"), stamp(F.col("e")).alias("bar_end"), stamp(F.col("e") + 60).alias("available_time"), "slot",
        "open", (F.greatest("open", "close") + F.col("u") % 13 / 10.0).alias("high"), (F.least("open", "close") - F.col("w") % 11 / 10.0).alias("low"), "close", "volume", (F.col("volume") * F.col("close")).alias("amount"),
    )


_ROW = ", ".join(ORDER)
CTES: dict[str, str] = {
    "panel": f"""SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS symbol, first(l_extendedprice / l_quantity ORDER BY {_ROW}) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_ROW}) AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS amount, 1 + 0.05::DOUBLE * (year(CAST(l_shipdate AS DATE)) - 1995) AS adj_factor
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 9""",
    "cov": """SELECT *, substr(symbol, 7, 1) AS industry, volume * 1000 * (1 + month(date) / 100.0::DOUBLE) AS market_cap, close / 40 - 20 AS pe, CASE WHEN day(date) % 7 <> 0 THEN close / 500 END AS pb FROM panel""",
    "fina": """SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS ann_date,
  CAST(date_trunc('quarter', CAST(o_orderdate AS DATE) - to_months(CAST(3 * (o_orderkey % 2) AS INTEGER))) AS DATE) AS end_date,
  CASE WHEN max(o_orderstatus) <> 'P' THEN CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 END AS value FROM orders GROUP BY 1, 2, 3""",
    "snaps": """SELECT snap, symbol FROM (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS snap FROM panel), (SELECT DISTINCT symbol FROM panel)
  WHERE (CAST(substr(symbol, 7) AS INT) + year(snap) * 12 + month(snap)) % 5 <> 0""",
}
for _name, _step, _symbol in (("bars", 900, "event_type"), ("wide", 3600, "'U' || CAST(user_id % 20 AS VARCHAR)")):
    CTES[_name] = f"""SELECT CAST(make_timestamp((e - 1) * 1000000) AS DATE) AS trade_date, symbol, make_timestamp((e - {_step}) * 1000000) AS bar_start, make_timestamp(e * 1000000) AS bar_end, make_timestamp((e + 60) * 1000000) AS available_time,
  CAST(((e - 1) % 86400 + 1) // 60 AS INTEGER) AS slot, first(value ORDER BY ts) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts) AS close,
  CAST(sum(k) AS DOUBLE) AS volume, CAST(sum(CAST(round(value * 100) AS BIGINT) * k) AS DOUBLE) / 100.0 AS amount
  FROM (SELECT *, {_symbol} AS symbol, CAST(ceil(epoch_us(ts) / 1e6 / {_step}) AS BIGINT) * {_step} AS e, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE value IS NOT NULL) GROUP BY symbol, e"""

CTES["dense"] = f"""SELECT CAST(make_timestamp((e - 1) * 1000000) AS DATE) AS trade_date, 'N' || k AS symbol, make_timestamp((e - 60) * 1000000) AS bar_start, make_timestamp(e * 1000000) AS bar_end, make_timestamp((e + 60) * 1000000) AS available_time, CAST(slot AS INTEGER) AS slot,
  open, greatest(open, close) + u % 13 / 10.0::DOUBLE AS high, least(open, close) - w % 11 / 10.0::DOUBLE AS low, close, volume, volume * close AS amount FROM (SELECT *, 50 + k + (u % 97) / 10.0::DOUBLE AS open, 50 + k + (w % 101) / 10.0::DOUBLE AS close, CAST(100 + u + CASE WHEN w < 60 THEN 3000 ELSE 0 END AS DOUBLE) AS volume, 1704067200 + d * 86400 + slot * 60 AS e
  FROM (SELECT *, (k * 7919 + d * 104729 + m * 1299709 + m * m * 31 + k * m * 17 + d * m * 13) % 1000 AS u, (k * 131 + d * 2713 + m * 7717 + m * m * 7 + d * d * 11 + k * d * m * 3) % 1000 AS w, m + CASE WHEN m < 120 THEN 571 ELSE 661 END AS slot
  FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation), (SELECT unnest(range(0, {DENSE_DAYS})) AS d), (SELECT unnest(range(0, {DENSE_MINUTES})) AS m)))"""


def oracle(final: str, *names: str, **more: str) -> str:
    """WITH the named derivations and more of them, in order, then final."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final
