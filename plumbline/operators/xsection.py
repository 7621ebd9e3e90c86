"""Operators over one date's cross-section: ranks, buckets, standardising, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_rank(x: str, *keys: str) -> Column:
    """Rank among the known values of a group; ties share their mean rank. NULL stays NULL. One sort of the group."""
    w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(x).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def buckets(df: DataFrame, x: str, q: int, date: str = "date", symbol: str = "symbol", out: str = "bucket") -> DataFrame:
    """Known values in q buckets of a date, 1 lowest; the first n % q are larger by one; ties by symbol."""
    w = Window.partitionBy(date).orderBy(x, symbol)
    return df.where(F.col(x).isNotNull()).withColumn(out, F.ntile(q).over(w))


def zscore(x: str, *keys: str) -> Column:
    """(x - mean) / population deviation; where that is 0 only the mean is taken off."""
    w = Window.partitionBy(*keys)
    m, s = F.avg(x).over(w), F.stddev_pop(x).over(w)
    return F.when(s > 0, (F.col(x) - m) / s).when(s == 0, F.col(x) - m)


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna("any", subset=cols)


def winsorize(df: DataFrame, cols: list[str]) -> DataFrame:
    """The identity, by definition: the step has a place in the order of processing and no effect."""
    return df


def residual(y: Column, x: Column, keys: list[str], least: int = 3) -> Column:
    """y less its least-squares line on x within a group, over rows that know both. NULL under `least` such rows
    or where x doesn't vary. Centred sums, so that nothing cancels."""
    w = Window.partitionBy(*keys)
    both = y.isNotNull() & x.isNotNull()
    yy, xx = F.when(both, y), F.when(both, x)
    dy, dx = yy - F.avg(yy).over(w), xx - F.avg(xx).over(w)
    # a window inside a window isn't allowed, so the slope is by moments about the group's means
    n = F.count(xx).over(w)
    sxy, sxx = F.covar_samp(xx, yy).over(w), F.var_samp(xx).over(w)
    return F.when(both & (n >= least) & (sxx > 0), dy - F.try_divide(sxy, sxx) * dx)


def neutralize(df: DataFrame, y: str, size: str, industry: str, date: str = "date", out: str = "neutral", least: int = 3) -> DataFrame:
    """Residual of y on ln(size) and a full set of industry dummies for each date.

    By partialling out: y and ln(size) are centred within (date, industry); the slope is over the date. Where
    ln(size) doesn't vary within industries the centred y remains. NULL unless n >= least and n > 1 + industries."""
    ln = F.when(F.col(size) > 0, F.log(size))
    ok = F.col(y).isNotNull() & ln.isNotNull() & F.col(industry).isNotNull()
    inner, outer = Window.partitionBy(date, industry, "_ok"), Window.partitionBy(date, "_ok")
    base = df.withColumn("_ok", ok).withColumn("_l", ln)
    base = base.withColumn("_dy", F.col(y) - F.avg(y).over(inner)).withColumn("_dx", F.col("_l") - F.avg("_l").over(inner))
    sxy, sxx = F.sum(F.col("_dy") * F.col("_dx")).over(outer), F.sum(F.col("_dx") * F.col("_dx")).over(outer)
    # an industry counts once, at the first of its rows
    first = F.row_number().over(inner.orderBy(size)) == 1
    base = base.withColumn("_g", first.cast("int"))
    n, g = F.count("*").over(outer), F.sum("_g").over(outer)
    slope = F.when(sxx > 1e-18, sxy / F.when(sxx > 1e-18, sxx)).otherwise(0.0)
    return base.withColumn(out, F.when(F.col("_ok") & (n >= least) & (n > 1 + g), F.col("_dy") - slope * F.col("_dx"))).drop("_ok", "_l", "_dy", "_dx", "_g")


def orthogonalize(df: DataFrame, y: str, anchors: list[str], date: str = "date", out: str = "pure") -> DataFrame:
    """Residual on several anchors: each anchor is first made orthogonal to those before it."""
    done: list[str] = []
    for k, a in enumerate(anchors):
        df = df.withColumn(f"_a{k}", F.col(a))
        for d in done:
            df = df.withColumn(f"_a{k}", residual(F.col(f"_a{k}"), F.col(d), [date]))
        done.append(f"_a{k}")
    df = df.withColumn(out, F.col(y))
    for d in done:
        df = df.withColumn(out, residual(F.col(out), F.col(d), [date]))
    return df.drop(*done)


def process(df: DataFrame, factors: list[str], date: str = "date", size: str | None = None, industry: str | None = None) -> DataFrame:
    """Drop missing, winsorise, neutralise (if size and industry are given), standardise: in this order."""
    df = winsorize(drop_missing(df, factors), factors)
    if size and industry:
        for f in factors:
            df = neutralize(df, f, size, industry, date, "_n").drop(f).withColumnRenamed("_n", f)
    return df.withColumns({f: zscore(f, date) for f in factors})
