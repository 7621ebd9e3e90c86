"""Point-in-time joins and visibility: what may be read at a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, fields: list[str], tie: list[str] | None = None) -> DataFrame:
    """left with the fields of the latest right row at or before left_on; a NULL field of that row stays NULL.

    One union and one running window: rows are never multiplied, whatever the history's length. Among right
    rows of one key and time, the greatest by `tie` counts."""
    at = F.col(left_on)
    packed = F.struct(*fields)
    best = right.groupBy(by, right_on).agg(F.max_by(packed, F.struct(*(tie or fields))).alias("_r")).where(F.col(right_on).isNotNull())
    cols = left.columns
    l = left.select(F.col(by).alias("_by"), at.alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_l"), F.lit(None).cast(best.schema["_r"].dataType).alias("_r"))
    r = best.select(F.col(by).alias("_by"), F.col(right_on).cast(dict(left.dtypes)[left_on]).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), "_r")
    w = Window.partitionBy("_by").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_l.*", *[F.col("_r")[f].alias(f) for f in fields])


def members_asof(dates: DataFrame, snapshots: DataFrame, date: str = "date", snap: str = "snap") -> DataFrame:
    """(date, symbol): members by the latest snapshot at or before each date; none before the first one."""
    d = dates.select(date).distinct().withColumn("_k", F.lit(0))
    s = snapshots.select(snap).distinct().withColumn("_k", F.lit(0))
    on = asof_backward(d, s, "_k", date, snap, [snap])
    return on.where(F.col(snap).isNotNull()).join(snapshots, snap).select(date, "symbol")


def interval_join(left: DataFrame, spans: DataFrame, fields: list[str], by: str = "symbol", date: str = "date", start: str = "valid_from", end: str = "valid_to", closed: bool = False) -> DataFrame:
    """left with the fields of the span that holds its date: [start, end), or [start, end] if closed; a missing
    end is open, a missing start is from ever; of several the latest start counts. Hash join on the key; rows are told
    apart by a number of their own, so repeated ones stay, and the choice is a window of the join's partitioning."""
    s = spans.select(F.col(by).alias("_b"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*fields).alias("_f"))
    inside = (F.col("_s").isNull() | (F.col("_s") <= F.col(date))) & (F.col("_e").isNull() | ((F.col(date) <= F.col("_e")) if closed else (F.col(date) < F.col("_e"))))
    both = left.withColumn("_row", F.monotonically_increasing_id()).join(s, (F.col(by) == F.col("_b")) & inside, "left")
    latest = Window.partitionBy(by, "_row").orderBy(F.coalesce("_s", F.lit("0001-01-01").cast("date")).desc(), F.col("_f").desc())
    best = both.withColumn("_i", F.row_number().over(latest)).where("_i = 1")
    return best.select(*left.columns, *[F.col("_f")[f].alias(f) for f in fields])


def front_adjust(panel: DataFrame, prices: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices times adj_factor over the symbol's last known adj_factor."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = F.col("adj_factor") / F.last("adj_factor", ignorenulls=True).over(w)
    return panel.withColumns({p: F.col(p) * k for p in prices})


def decision_lag(panel: DataFrame, same_day: tuple[str, ...] = ("open",)) -> DataFrame:
    """Every column but the keys and same-day ones as of the symbol's row before."""
    w = Window.partitionBy("symbol").orderBy("date")
    return panel.select(*[c if c in ("date", "symbol", *same_day) else F.lag(c, 1).over(w).alias(c) for c in panel.columns])


def ex_date(adj: str = "adj_factor") -> Column:
    """Whether adj_factor differs from the row before (a first row doesn't; known after missing does)."""
    w = Window.partitionBy("symbol").orderBy("date")
    return F.coalesce((F.row_number().over(w) > 1) & ~F.col(adj).eqNullSafe(F.lag(adj, 1).over(w)), F.lit(False))


def visible_bars(bars: DataFrame, cutoff_minutes: int, available: str = "available_time", day: str = "trade_date") -> DataFrame:
    """Bars that are available at the decision time of their day; must come before any window."""
    limit = F.col(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(cutoff_minutes), F.lit(0.0))
    return bars.where(F.col(available) <= limit)


def unserved(requested: DataFrame, served: DataFrame, keys: list[str]) -> DataFrame:
    return requested.select(*keys).distinct().join(served.select(*keys), keys, "left_anti")


def tradability(panel: DataFrame, suspended: DataFrame, limits: DataFrame, st: DataFrame, tol: float = 1e-6) -> DataFrame:
    """panel with trade_status (not suspended), is_st, limit_up, limit_down by raw close and the day's band."""
    out = panel.join(suspended.select("date", "symbol").distinct().withColumn("_susp", F.lit(True)), ["date", "symbol"], "left")
    out = out.join(limits.select("date", "symbol", "up_limit", "down_limit"), ["date", "symbol"], "left")
    keep = [*panel.columns, "_susp", "up_limit", "down_limit"]
    out = interval_join(out.select(*keep), st, ["is_st"], start="start", end="end", closed=True)
    return out.select(
        *panel.columns, F.col("_susp").isNull().alias("trade_status"), F.coalesce("is_st", F.lit(False)).alias("is_st"),
        F.coalesce(F.col("close") >= F.col("up_limit") - tol, F.lit(False)).alias("limit_up"), F.coalesce(F.col("close") <= F.col("down_limit") + tol, F.lit(False)).alias("limit_down"),
    )


def tradable(panel: DataFrame, suspended: bool = True, st: bool = True, limit: bool = True, min_listing_days: int | None = None) -> DataFrame:
    """Rows that may be held: close known; by choice not suspended, not ST, at neither limit, listed long enough
    (calendar days; an unknown list_date passes)."""
    ok = F.col("close").isNotNull()
    if suspended:
        ok &= F.col("trade_status")
    if st:
        ok &= ~F.col("is_st")
    if limit:
        ok &= ~F.col("limit_up") & ~F.col("limit_down")
    if min_listing_days is not None:
        ok &= F.col("list_date").isNull() | (F.datediff("date", "list_date") >= min_listing_days)
    return panel.where(ok)


def merge_intervals(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union of day intervals by key; intervals that touch or overlap (start <= last end + 1 day) become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) <= F.date_add(reach, 1), 0).otherwise(1)
    isles = spans.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy(*keys, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isle")


def subtract_intervals(requests: DataFrame, covered: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The days of each request (one for a key) that no covered interval holds, as intervals."""
    merged = merge_intervals(covered, keys, start, end).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    cut = requests.join(merged, keys, "left").where(F.col("_s").isNull() | ((F.col("_s") <= F.col(end)) & (F.col("_e") >= F.col(start))))
    every = requests.select(*keys, start, end).join(cut.select(*keys, "_s", "_e"), keys, "left")
    w = Window.partitionBy(*keys).orderBy("_s")
    left = every.select(*keys, F.when(F.lag("_e").over(w).isNull(), F.col(start)).otherwise(F.date_add(F.lag("_e").over(w), 1)).alias("_a"), F.when(F.col("_s").isNull(), F.col(end)).otherwise(F.date_sub("_s", 1)).alias("_b"))
    tail = every.groupBy(*keys).agg(F.max("_e").alias("_m"), F.max(end).alias("_b")).where("_m IS NOT NULL").select(*keys, F.date_add("_m", 1).alias("_a"), "_b")
    return left.unionByName(tail).where("_a <= _b").select(*keys, F.col("_a").alias(start), F.col("_b").alias(end))
