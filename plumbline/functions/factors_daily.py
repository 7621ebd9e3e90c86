"""Daily factors: each is a column on (date, symbol) with an expected sign and a lookback in trading days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import FactorSpec, register
from .scalar import inverse_positive, log_positive, ratio
from .timeseries import by_symbol, ts_lag, ts_mean, ts_pct_change, ts_std, ts_sum, ts_window_return


@register(FactorSpec("momentum", +1, lambda w: w + 1, ("close",), prefix=True))
def momentum(window: int = 20) -> Column:
    return ts_window_return(F.col("close"), window)


@register(FactorSpec("reversal", -1, lambda w: w + 1, ("close",), prefix=True))
def reversal(window: int = 20) -> Column:
    return -momentum(window)


@register(FactorSpec("volatility", -1, lambda w: w + 1, ("close",), prefix=True, staged="ret"))
def volatility(window: int = 20) -> Column:
    """Needs `ret`, the one-row change, as a column: a window cannot stand inside another."""
    return ts_std(F.col("ret"), window)


def daily_return() -> Column:
    return ts_pct_change(F.col("close"))


@register(FactorSpec("liquidity", -1, lambda w: w, ("amount",), prefix=True))
def liquidity(window: int = 20) -> Column:
    return log_positive(ts_mean(F.col("amount"), window))


@register(FactorSpec("overnight_mom", +1, lambda w: w + 1, ("open", "close"), prefix=True, staged="gap"))
def overnight_momentum(window: int = 20) -> Column:
    """Needs `gap`, the log of open over the close before."""
    return ts_sum(F.col("gap"), window)


def overnight_gap() -> Column:
    return log_positive(ratio(F.col("open"), ts_lag(F.col("close"), 1, by_symbol())))


@register(FactorSpec("value_ep", +1, lambda w: 1, ("pe",)))
def value_ep() -> Column:
    return inverse_positive(F.col("pe"))


@register(FactorSpec("value_bp", +1, lambda w: 1, ("pb",)))
def value_bp() -> Column:
    return inverse_positive(F.col("pb"))


@register(FactorSpec("roe", +1, lambda w: 1, ("roe",)))
def roe() -> Column:
    """As disclosed: the panel's column comes from the as-of join of disclosures."""
    return F.col("roe")


@register(FactorSpec("netprofit_yoy", +1, lambda w: 1, ("netprofit_yoy",)))
def netprofit_yoy() -> Column:
    return F.col("netprofit_yoy")


@register(FactorSpec("grossprofit_margin", +1, lambda w: 1, ("grossprofit_margin",)))
def grossprofit_margin() -> Column:
    return F.col("grossprofit_margin")


STAGED = {"ret": daily_return, "gap": overnight_gap}
