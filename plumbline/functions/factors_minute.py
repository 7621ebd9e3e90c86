"""Factors from intraday bars. Each takes visible bars (and its own bounds, with production defaults) and returns
(trade_date, symbol, value); bar width and least counts are parameters. Stages that read one symbol end before
those that read one date, so stored intermediates don't depend on the universe asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.bars import DAY, classify, day_index, excess_kurtosis, guarded_amplitude, pool, positive_trade, rolling_valid
from ..operators.xsection import residual

MINUTE: dict[str, tuple[int, int, Callable[..., DataFrame]]] = {}


def minute_factor(name: str, sign: int, depth: int):
    """Registers a builder with its expected sign and lookback in trading days."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MINUTE[name] = (sign, depth, f)
        return f

    return add


def _sum_if(c: Column, x: Column) -> Column:
    return F.sum(F.when(c, x))


def _n_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


@minute_factor("jump_amount_corr", -1, 20)
def jump_amount_corr(bars: DataFrame, days: int = 20, bar_seconds: int = 60, z: float = 1.0, least: int = 10) -> DataFrame:
    """Pooled correlation over `days` days of the amounts of a jump bar and the bar right after it. A jump's
    amplitude lies over z session deviations above the session's mean. Days without pairs stay in the frame."""
    s, near = Window.partitionBy(*DAY), Window.partitionBy(*DAY).orderBy("bar_end")
    b = guarded_amplitude(bars)
    e = F.unix_micros(F.col("bar_end").cast("timestamp"))
    b = b.withColumn("_z", F.try_divide(F.col("amp") - F.avg("amp").over(s), F.stddev_samp("amp").over(s))).withColumn("_d", F.lead(e).over(near) - e).withColumn("_y", F.lead("amount").over(near))
    pair = (F.col("_z") > z) & (F.col("_d") == bar_seconds * 1_000_000) & F.col("amount").isNotNull() & F.col("_y").isNotNull()
    x, y = F.when(pair, F.col("amount")), F.when(pair, F.col("_y"))
    d = b.groupBy(*DAY).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in (("n", F.when(pair, 1.0)), ("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))])
    w = rolling_valid(d, days)
    r = d.select(*DAY, *[F.sum(c).over(w).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    sx, sy, sxy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y"), n * F.col("xy") - F.col("x") * F.col("y")
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(sxy, F.sqrt(F.when((sx > 0) & (sy > 0), sx * sy)))))
    return r.select(*DAY, F.when((n >= least) & (sx > 0) & (sy > 0), value).alias("value"))


@minute_factor("minute_ideal_amp", -1, 10)
def minute_ideal_amp(bars: DataFrame, days: int = 10, share: float = 0.25, least: int = 1150) -> DataFrame:
    """Over the pooled bars of `days` days: mean amplitude of the highest closes less that of the lowest ones."""
    p = pool(day_index(guarded_amplitude(bars)), days)
    key = ["symbol", "asof"]
    p = p.withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    up, down = Window.partitionBy(*key).orderBy("close", "bar_end"), Window.partitionBy(*key).orderBy(F.desc("close"), F.desc("bar_end"))
    k = F.floor(F.col("_n") * share)
    p = p.withColumn("_lo", F.row_number().over(up) <= k).withColumn("_hi", F.row_number().over(down) <= k)
    out = p.groupBy(*key).agg(F.max("_n").alias("n"), (F.avg(F.when(F.col("_hi"), F.col("amp"))) - F.avg(F.when(F.col("_lo"), F.col("amp")))).alias("v"))
    return out.select(F.col("asof").alias("trade_date"), "symbol", F.when(F.col("n") >= least, F.col("v")).alias("value"))


@minute_factor("amp_marginal_anomaly_vol", +1, 20)
def amp_marginal_anomaly_vol(bars: DataFrame, days: int = 20, least: int = 460, selected: int = 20) -> DataFrame:
    """Over the pooled bars of `days` days (complete steps only): deviation of returns where the amplitude changes by
    more than the pool's mean + deviation of such changes."""
    w = Window.partitionBy(*DAY).orderBy("bar_end")
    b = day_index(guarded_amplitude(bars))
    b = b.withColumn("d", F.abs(F.col("amp") - F.lag("amp").over(w))).withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1)
    b = b.withColumns({"d": F.when(F.col("r").isNotNull(), F.col("d")), "r": F.when(F.col("d").isNotNull(), F.col("r"))})
    p = pool(b, days)
    key = Window.partitionBy("symbol", "asof")
    p = p.withColumn("_n", F.count("d").over(key)).withColumn("_t", F.avg("d").over(key) + F.stddev_samp("d").over(key))
    hit = F.col("d") > F.col("_t")
    out = p.groupBy("symbol", "asof").agg(F.max("_n").alias("n"), _n_if(hit).alias("k"), F.stddev_samp(F.when(hit, F.col("r"))).alias("v"))
    return out.select(F.col("asof").alias("trade_date"), "symbol", F.when((F.col("n") >= least) & (F.col("k") >= selected), F.col("v")).alias("value"))


def amp_cut_days(bars: DataFrame, days: int = 10, share: float = 0.2, least_bars: int = 100, least_days: int = 6) -> DataFrame:
    """Stage one of intraday_amp_cut: (trade_date, symbol, v_mean, v_std) over valid days. A day's value is the mean
    amplitude of the bars with the highest returns (on the bar before, same day) less that of the lowest."""
    w = Window.partitionBy(*DAY).orderBy("bar_end")
    b = guarded_amplitude(bars).withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1).where("r IS NOT NULL")
    b = b.withColumn("_n", F.count("*").over(Window.partitionBy(*DAY)))
    k = F.floor(F.col("_n") * share)
    up, down = Window.partitionBy(*DAY).orderBy("r", "bar_end"), Window.partitionBy(*DAY).orderBy(F.desc("r"), F.desc("bar_end"))
    b = b.where(F.col("_n") >= least_bars).withColumn("_lo", F.row_number().over(up) <= k).withColumn("_hi", F.row_number().over(down) <= k)
    d = b.groupBy(*DAY).agg((F.avg(F.when(F.col("_hi"), F.col("amp"))) - F.avg(F.when(F.col("_lo"), F.col("amp")))).alias("v")).where("v IS NOT NULL")
    f = rolling_valid(d, days)
    enough = F.count("v").over(f) >= least_days
    return d.select(*DAY, F.when(enough, F.avg("v").over(f)).alias("v_mean"), F.when(enough, F.stddev_samp("v").over(f)).alias("v_std"))


def amp_cut_combine(stats: DataFrame, least_names: int = 10) -> DataFrame:
    """Stage two: mean of both statistics' z-scores (sample deviation) over a date's names."""
    both = stats.where("v_mean IS NOT NULL AND v_std IS NOT NULL")
    w = Window.partitionBy("trade_date")
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))
    return both.select(*DAY, F.when(F.count("*").over(w) >= least_names, (z("v_mean") + z("v_std")) / 2).alias("value"))


@minute_factor("intraday_amp_cut", -1, 10)
def intraday_amp_cut(bars: DataFrame, days: int = 10, share: float = 0.2, least_bars: int = 100, least_days: int = 6, least_names: int = 10) -> DataFrame:
    return amp_cut_combine(amp_cut_days(bars, days, share, least_bars, least_days), least_names)


@minute_factor("mmp_ew", +1, 1)
def mmp_ew(bars: DataFrame, window: int = 20, eps: float = 1e-12) -> DataFrame:
    """Mean over a day of the distance of close from the bar's middle, weighted by volume, body and range against
    the `window` bars before, of the same day (pass in-session bars)."""
    w = Window.partitionBy(*DAY).orderBy("bar_end")
    prior = w.rowsBetween(-window, -1)
    hl, mid = F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2
    med = F.when(F.count("volume").over(prior) >= window, F.percentile("volume", 0.5).over(prior))
    rng = F.when(F.count(hl).over(prior) >= window, F.avg(hl).over(prior))
    b = bars.withColumn("_med", med).withColumn("_rng", rng)
    term = F.try_divide(F.col("close") - mid, F.when(mid > 0, mid)) * F.sqrt(F.try_divide("volume", F.when(F.col("_med") > 0, F.col("_med")))) * (F.abs(F.col("close") - F.col("open")) / (hl + eps)) * (hl / (F.col("_rng") + eps))
    return b.groupBy(*DAY).agg(F.avg(term).alias("value"))


@minute_factor("intraday_ret", -1, 1)
def intraday_ret(bars: DataFrame) -> DataFrame:
    out = bars.groupBy(*DAY).agg(F.min_by("open", "bar_end").alias("o"), F.max_by("close", "bar_end").alias("c"))
    return out.select(*DAY, (F.try_divide("c", "o") - 1).alias("value"))


def class_days(bars: DataFrame, bar_seconds: int = 60, baseline: int = 20, least: int = 10, k: float = 1.0) -> DataFrame:
    """One row a day with all sums that the bar-class factors need, so that the classes are found once."""
    w = Window.partitionBy(*DAY).orderBy("bar_end")
    b = classify(bars, bar_seconds, baseline, least, k).withColumn("_p", F.try_divide("close", F.lag("close").over(w)) - 1).withColumn("_ok", positive_trade())
    c = F.col
    return b.groupBy(*DAY).agg(
        F.max("day_idx").alias("day_idx"), _n_if(c("classifiable")).alias("n_class"), _n_if(c("peak")).alias("n_peak"), _n_if(c("mild")).alias("n_mild"), _n_if(c("ridge")).alias("n_ridge"),
        _n_if(c("mild") & c("_ok")).alias("k_valley"), _sum_if(c("mild") & c("_ok"), c("amount")).alias("a_valley"), _sum_if(c("mild") & c("_ok"), c("volume")).alias("v_valley"),
        _n_if(c("ridge") & c("_ok")).alias("k_ridge"), _sum_if(c("ridge") & c("_ok"), c("amount")).alias("a_ridge"), _sum_if(c("ridge") & c("_ok"), c("volume")).alias("v_ridge"),
        _n_if(c("peak") & c("_ok")).alias("k_peak"), _sum_if(c("peak") & c("_ok"), c("amount")).alias("a_peak"), _sum_if(c("_ok"), c("amount")).alias("a_day"), _sum_if(c("_ok"), c("volume")).alias("v_day"),
        _sum_if(c("ridge"), c("_p")).alias("r_ridge"), _n_if(c("ridge") & c("_p").isNotNull()).alias("k_ridge_ret"), F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", "bar_end").alias("last_close"),
    )


def _over_valid(days: DataFrame, valid: Column, window: int, value: Callable[[object], Column], least_days: int) -> DataFrame:
    d = days.where(valid)
    w = rolling_valid(d, window)
    return d.select(*DAY, F.when(F.count("*").over(w) >= least_days, value(w)).alias("value"))


@minute_factor("volume_peak_count", +1, 40)
def volume_peak_count(days: DataFrame, window: int = 20, classifiable: int = 100, least_days: int = 10) -> DataFrame:
    return _over_valid(days, F.col("n_class") >= classifiable, window, lambda w: F.sum("n_peak").over(w).cast("double"), least_days)


@minute_factor("valley_relative_vwap", +1, 40)
def valley_relative_vwap(days: DataFrame, window: int = 20, valley: int = 20, least_days: int = 10) -> DataFrame:
    q = F.try_divide(F.try_divide("a_valley", "v_valley"), F.try_divide("a_day", "v_day"))
    return _over_valid(days.withColumn("_q", q), (F.col("k_valley") >= valley) & F.col("_q").isNotNull(), window, lambda w: F.avg("_q").over(w), least_days)


@minute_factor("valley_ridge_vwap_ratio", +1, 40)
def valley_ridge_vwap_ratio(days: DataFrame, window: int = 20, valley: int = 20, ridge: int = 10, least_days: int = 10) -> DataFrame:
    q = F.try_divide(F.try_divide("a_valley", "v_valley"), F.try_divide("a_ridge", "v_ridge"))
    return _over_valid(days.withColumn("_q", q), (F.col("k_valley") >= valley) & (F.col("k_ridge") >= ridge) & F.col("_q").isNotNull(), window, lambda w: F.avg("_q").over(w), least_days)


@minute_factor("ridge_minute_return", -1, 40)
def ridge_minute_return(days: DataFrame, window: int = 20, ridge: int = 10, least_days: int = 10) -> DataFrame:
    return _over_valid(days, F.col("k_ridge_ret") >= ridge, window, lambda w: F.sum("r_ridge").over(w), least_days)


@minute_factor("peak_ridge_amount_ratio", +1, 40)
def peak_ridge_amount_ratio(days: DataFrame, window: int = 20, peak: int = 5, ridge: int = 10, least_days: int = 10) -> DataFrame:
    return _over_valid(days, (F.col("k_peak") >= peak) & (F.col("k_ridge") >= ridge), window, lambda w: F.try_divide(F.sum("a_peak").over(w), F.sum("a_ridge").over(w)), least_days)


@minute_factor("peak_interval_kurtosis", +1, 40)
def peak_interval_kurtosis(bars: DataFrame, window: int = 20, bar_seconds: int = 60, baseline: int = 20, least: int = 10, classifiable: int = 100, least_days: int = 10, least_gaps: int = 20, k: float = 1.0) -> DataFrame:
    """Sample excess kurtosis of the gaps, in bars, between a day's peaks, pooled over valid days by power sums."""
    w = Window.partitionBy(*DAY).orderBy("bar_end")
    b = classify(bars, bar_seconds, baseline, least, k).withColumn("_i", F.row_number().over(w))
    last = F.last(F.when(F.col("peak"), F.col("_i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("peak"), F.col("_i") - last).cast("double")
    d = b.withColumn("_g", gap).groupBy(*DAY).agg(_n_if(F.col("classifiable")).alias("n_class"), F.count("_g").alias("k"), *[F.coalesce(F.sum(F.pow("_g", F.lit(float(p)))), F.lit(0.0)).alias(f"s{p}") for p in (1, 2, 3, 4)])
    d = d.where(F.col("n_class") >= classifiable)
    f = rolling_valid(d, window)
    s = d.select(*DAY, F.count("*").over(f).alias("days"), F.sum("k").over(f).alias("n"), *[F.sum(f"s{p}").over(f).alias(f"s{p}") for p in (1, 2, 3, 4)])
    n = F.col("n").cast("double")
    return s.select(*DAY, F.when((F.col("days") >= least_days) & (n >= least_gaps), excess_kurtosis(n, *[F.col(f"s{p}") for p in (1, 2, 3, 4)])).alias("value"))


def valley_quantile_days(days: DataFrame, window: int = 20, valley: int = 20, least_days: int = 10) -> DataFrame:
    """Stage one of valley_price_quantile: mean over valid days of where the valleys' vwap lies in the day's range,
    which takes in the last visible close of the day before, valid or not."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    d = days.withColumn("_c", F.lag("last_close").over(w))
    hi, lo = F.greatest("hi", "_c"), F.least("lo", "_c")
    q = F.try_divide(F.try_divide("a_valley", "v_valley") - lo, F.when(hi > lo, hi - lo))
    return _over_valid(d.withColumn("_q", q), (F.col("k_valley") >= valley) & F.col("_q").isNotNull(), window, lambda f: F.avg("_q").over(f), least_days)


@minute_factor("valley_price_quantile", +1, 40)
def valley_price_quantile(days: DataFrame, reversal: DataFrame, window: int = 20, valley: int = 20, least_days: int = 10, least_names: int = 10) -> DataFrame:
    """Stage two: residual on the daily reversal (trade_date, symbol, reversal) for each date."""
    j = valley_quantile_days(days, window, valley, least_days).join(reversal, DAY).where("value IS NOT NULL AND reversal IS NOT NULL")
    return j.select(*DAY, residual(F.col("value"), F.col("reversal"), ["trade_date"], least_names).alias("value"))
