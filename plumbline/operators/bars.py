"""Operators over intraday bars: resampling, daily features, bar classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = ["symbol", "trade_date"]


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of a longer step: a bar goes to the step that its end falls in or on; the label is the last bar's end.
    Keeps `complete`: whether that end is the step's."""
    sec = F.unix_micros(F.col("bar_end").cast("timestamp")) / 1e6
    at = F.ceil(sec / (minutes * 60)) * (minutes * 60)
    out = bars.withColumn("_at", at).groupBy(*DAY, "_at").agg(
        F.min_by("open", "bar_end").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_end").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.min("bar_start").alias("bar_start"), F.max("bar_end").alias("bar_end"), F.max("available_time").alias("available_time"),
    )
    return out.withColumn("complete", F.unix_micros(F.col("bar_end").cast("timestamp")) == (F.col("_at") * 1_000_000).cast("bigint")).drop("_at")


def asof_features(bars: DataFrame, last_minutes: int = 30) -> DataFrame:
    """(trade_date, symbol, ret, realized_vol, vwap, last_ret) of bars that are visible already.

    realized_vol needs two bars and positive closes; vwap positive volume; last_ret looks back from the last bar
    to the last one at least `last_minutes` before it."""
    w = Window.partitionBy(*DAY).orderBy("bar_end")
    whole = Window.partitionBy(*DAY)
    b = bars.withColumn("_g", F.when((F.col("close") > 0) & (F.lag("close").over(w) > 0), F.log(F.col("close") / F.lag("close").over(w)))).withColumn("_last", F.max("bar_end").over(whole))
    ref = F.col("bar_end") <= F.col("_last") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(last_minutes), F.lit(0.0))
    out = b.groupBy(*DAY).agg(
        F.min_by("open", "bar_end").alias("o"), F.max_by("close", "bar_end").alias("c"), F.count("*").alias("n"), F.min("close").alias("low"), F.sum(F.col("_g") * F.col("_g")).alias("g"),
        F.sum("amount").alias("a"), F.sum("volume").alias("v"), F.max_by("close", F.when(ref, F.col("bar_end"))).alias("r"), F.max(F.when(ref, F.col("bar_end"))).alias("has"),
    )
    return out.select(
        "trade_date", "symbol", (F.try_divide("c", "o") - 1).alias("ret"), F.when((F.col("n") >= 2) & (F.col("low") > 0), F.sqrt("g")).alias("realized_vol"),
        F.when(F.col("v") > 0, F.try_divide("a", "v")).alias("vwap"), F.when(F.col("has").isNotNull(), F.try_divide("c", "r") - 1).alias("last_ret"),
    )


def guarded_amplitude(bars: DataFrame) -> DataFrame:
    return bars.where((F.col("low") > 0) & (F.col("high") >= F.col("low"))).withColumn("amp", F.col("high") / F.col("low") - 1)


def positive_trade() -> Column:
    fine = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    return fine("volume") & fine("amount")


def day_index(bars: DataFrame) -> DataFrame:
    """Adds day_idx, the number of the day among the symbol's own trading days."""
    return bars.withColumn("day_idx", F.dense_rank().over(Window.partitionBy("symbol").orderBy("trade_date")))


def classify(bars: DataFrame, bar_seconds: int = 60, days: int = 20, least: int = 10, k: float = 1.0) -> DataFrame:
    """Adds classifiable, eruptive, mild (valley), peak, ridge, by volume against the same slot of the symbol's
    `days` trading days before (a day without that slot counts as one of them).

    eruptive: above mean + k deviations; mild: classifiable and not eruptive; peak: eruptive, with the bars
    exactly one step before and after both mild; ridge: any other eruptive one."""
    slot = Window.partitionBy("symbol", "slot").orderBy("day_idx").rangeBetween(-days, -1)
    near = Window.partitionBy(*DAY).orderBy("bar_end")
    b = day_index(bars).withColumn("_n", F.count("volume").over(slot)).withColumn("_m", F.avg("volume").over(slot)).withColumn("_s", F.stddev_samp("volume").over(slot))
    b = b.withColumn("classifiable", F.coalesce((F.col("_n") >= least) & F.col("_s").isNotNull() & F.col("volume").isNotNull(), F.lit(False)))
    b = b.withColumn("eruptive", F.col("classifiable") & F.coalesce(F.col("volume") > F.col("_m") + k * F.col("_s"), F.lit(False))).withColumn("mild", F.col("classifiable") & ~F.col("eruptive"))
    end = F.unix_micros(F.col("bar_end").cast("timestamp"))
    b = b.withColumn("_e", end)
    step = bar_seconds * 1_000_000
    before = F.coalesce((F.col("_e") - F.lag("_e").over(near) == step) & F.lag("mild").over(near), F.lit(False))
    after = F.coalesce((F.lead("_e").over(near) - F.col("_e") == step) & F.lead("mild").over(near), F.lit(False))
    b = b.withColumn("peak", F.col("eruptive") & before & after)
    return b.withColumn("ridge", F.col("eruptive") & ~F.col("peak")).drop("_n", "_m", "_s", "_e")


def excess_kurtosis(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """Bias-corrected sample excess kurtosis from power sums; NULL under four values or without variance."""
    m = F.try_divide(s1, n)
    m2 = F.try_divide(s2, n) - m * m
    m4 = F.try_divide(s4, n) - 4 * m * F.try_divide(s3, n) + 6 * m * m * F.try_divide(s2, n) - 3 * m * m * m * m
    g2 = F.try_divide(m4, m2 * m2) - 3
    return F.when((n >= 4) & (m2 > 1e-12), F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def rolling_valid(df: DataFrame, window: int) -> object:
    """The frame of the last `window` rows of a symbol; filter to valid days before using it."""
    return Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-(window - 1), 0)


def pool(bars: DataFrame, days: int) -> DataFrame:
    """bars (with day_idx) repeated for each of the symbol's days whose last `days` trading days hold them: adds
    `asof`. Grows the bars by `days` at most, whatever the history's length."""
    calendar = bars.groupBy("symbol", "day_idx").agg(F.max("trade_date").alias("asof")).withColumnRenamed("day_idx", "_k")
    each = bars.withColumn("_k", F.explode(F.sequence(F.col("day_idx"), F.col("day_idx") + days - 1)))
    return each.join(calendar, ["symbol", "_k"]).drop("_k")


def execution_price(bars: DataFrame, first_slot: int, last_slot: int, basis: str = "vwap") -> DataFrame:
    """(trade_date, symbol, price, amount, status) of the earliest bar in a window of slots: ok, bad_vwap. Days
    without such a bar are absent; the caller joins them as no_bar."""
    w = Window.partitionBy(*DAY).orderBy("bar_end")
    b = bars.where(F.col("slot").between(first_slot, last_slot)).withColumn("_i", F.row_number().over(w)).where("_i = 1")
    raw = F.try_divide("amount", "volume") if basis == "vwap" else F.col("close")
    good = F.coalesce(raw > 0, F.lit(False))
    return b.select("trade_date", "symbol", F.when(good, raw).alias("price"), "amount", F.when(good, "ok").otherwise("bad_vwap").alias("status"))


def exec_forward_returns(panel: DataFrame, prices: DataFrame, horizon: int = 1) -> DataFrame:
    """panel (trade_date, symbol, adj_factor) with status and fwd: adjusted execution price `horizon` grid rows later
    over this one. status: ok, no_bar, bad_vwap or bad_adj_factor."""
    j = panel.select("trade_date", "symbol", "adj_factor").join(prices, ["trade_date", "symbol"], "left")
    bad = ~F.coalesce(F.col("adj_factor") > 0, F.lit(False))
    j = j.withColumn("status", F.when(F.col("status").isNull(), "no_bar").when(F.col("status") != "ok", F.col("status")).when(bad, "bad_adj_factor").otherwise("ok"))
    j = j.withColumn("adjusted", F.when(F.col("status") == "ok", F.col("price") * F.col("adj_factor")))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return j.withColumn("exit_status", F.lead("status", horizon).over(w)).withColumn("fwd", F.lead("adjusted", horizon).over(w) / F.col("adjusted") - 1)


def coverage_loss(returns: DataFrame) -> DataFrame:
    """(cause, n): pairs that have an exit row, as ok or by what lost them, the entry's cause first."""
    cause = F.when(F.col("status") != "ok", F.col("status")).otherwise(F.col("exit_status"))
    return returns.where("exit_status IS NOT NULL").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def liquidity(trades: DataFrame, capital: float, share: float = 0.1) -> DataFrame:
    """trades (.., delta, amount) with direction, desired notional, capacity (a share of the bar's amount), ratio."""
    d = trades.withColumn("direction", F.when(F.col("delta") > 0, "buy").when(F.col("delta") < 0, "sell").otherwise("hold"))
    d = d.withColumn("desired", F.abs("delta") * capital).withColumn("capacity", F.coalesce(F.col("amount"), F.lit(0.0)) * share)
    return d.withColumn("ratio", F.when(F.col("desired") > 0, F.try_divide("capacity", "desired")))


def liquidity_diagnostics(trades: DataFrame, capital: float, share: float = 0.1, fee_tolerance: float = 1e-12) -> DataFrame:
    """trades (date, symbol, current, target, can_buy, can_sell, amount) that want to move, with direction, desired
    notional, blocked (the direction is not feasible), missing (no amount to measure by), capacity and ratio of those
    that were inspected."""
    d = trades.withColumn("delta", F.coalesce("target", F.lit(0.0)) - F.coalesce("current", F.lit(0.0))).where(F.abs("delta") > fee_tolerance)
    buys = F.col("delta") > 0
    d = d.withColumn("direction", F.when(buys, "buy").otherwise("sell")).withColumn("desired", F.abs("delta") * capital)
    d = d.withColumn("blocked", ~F.coalesce(F.when(buys, F.col("can_buy")).otherwise(F.col("can_sell")), F.lit(False)))
    seen = F.coalesce(F.col("amount") > 0, F.lit(False))
    d = d.withColumn("missing", ~F.col("blocked") & ~seen).withColumn("capacity", F.when(~F.col("blocked") & seen, F.col("amount") * share))
    return d.withColumn("ratio", F.try_divide("capacity", "desired"))


def liquidity_summary(diagnosed: DataFrame) -> DataFrame:
    """One row: trades, blocked, missing, inspected, below (ratio under 1), and least, p10, median, p90 of the ratios."""
    q = F.percentile("ratio", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    s = diagnosed.agg(F.count("*").alias("trades"), F.count_if("blocked").alias("blocked"), F.count_if("missing").alias("missing"), F.count("ratio").alias("inspected"), F.count(F.when(F.col("ratio") < 1, 1)).alias("below"), F.min("ratio").alias("least"), q.alias("_q"))
    return s.select("trades", "blocked", "missing", "inspected", "below", "least", *[F.col("_q")[i].alias(k) for i, k in enumerate(("p10", "median", "p90"))])


def most_constrained(diagnosed: DataFrame, n: int) -> DataFrame:
    """The n inspected trades of the least ratio; ties by date and symbol. A top-k: no sort of the whole."""
    return diagnosed.where("ratio IS NOT NULL").orderBy("ratio", "date", "symbol").limit(n)
