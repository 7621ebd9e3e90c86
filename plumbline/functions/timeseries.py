"""Per-symbol window functions, ordered by date. A result needs min_periods known values in its frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .scalar import ratio


def by_symbol(symbol: str = "symbol", date: str = "date") -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(date)


def _over(x: Column, window: int, w: WindowSpec, agg, min_periods: int | None) -> Column:
    frame = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(frame) >= (window if min_periods is None else min_periods), agg(x).over(frame))


def ts_lag(x: Column, k: int = 1, w: WindowSpec | None = None) -> Column:
    if k < 1:
        raise ValueError("a lag looks back by one row at least")
    return F.lag(x, k).over(w or by_symbol())


def ts_window_return(x: Column, window: int, w: WindowSpec | None = None) -> Column:
    return ratio(x, F.lag(x, window).over(w or by_symbol())) - 1


def ts_pct_change(x: Column, w: WindowSpec | None = None) -> Column:
    """One-row change; a missing value is first filled with the last known one."""
    w = w or by_symbol()
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return ratio(F.last(x, ignorenulls=True).over(upto), F.last(x, ignorenulls=True).over(before)) - 1


def ts_std(x: Column, window: int, w: WindowSpec | None = None, min_periods: int | None = None) -> Column:
    return _over(x, window, w or by_symbol(), F.stddev_samp, min_periods)


def ts_mean(x: Column, window: int, w: WindowSpec | None = None, min_periods: int | None = None) -> Column:
    return _over(x, window, w or by_symbol(), F.avg, min_periods)


def ts_sum(x: Column, window: int, w: WindowSpec | None = None, min_periods: int | None = None) -> Column:
    return _over(x, window, w or by_symbol(), F.sum, min_periods)


def prior_median(x: Column, window: int, w: WindowSpec) -> Column:
    """Median of the `window` rows before this one, all of them known."""
    frame = w.rowsBetween(-window, -1)
    return F.when(F.count(x).over(frame) >= window, F.percentile(x, 0.5).over(frame))


def compound(r: Column, w: WindowSpec) -> Column:
    """Running product of 1 + r, missing returns counting as 0."""
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(nav: Column, w: WindowSpec) -> Column:
    """nav over its running maximum (1 at least, the start), less 1."""
    return nav / F.greatest(F.lit(1.0), F.max(nav).over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1
