"""Signal evaluation: forward returns, information coefficients, buckets, turnover, significance, verdict."""

from __future__ import annotations

import math
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .portfolio import turnover
from .xsection import average_rank, buckets


def forward_returns(panel: DataFrame, periods: int = 1, price: str = "close", out: str = "fwd") -> DataFrame:
    """price `periods` rows later over price, less 1; NULL where either price isn't positive."""
    good = F.when(F.col(price) > 0, F.col(price))
    return panel.withColumn(out, F.lead(good, periods).over(Window.partitionBy("symbol").orderBy("date")) / good - 1)


def _pairs(df: DataFrame, f: str, r: str) -> DataFrame:
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.where(fine(f) & fine(r))


def _finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def date_correlations(df: DataFrame, pairs: dict[str, tuple[str, str, bool]], date: str = "date") -> DataFrame:
    """(date, <name>, n_<name> ...): for each name -> (a, b, by rank) the correlation over rows that know both, clipped to
    [-1, 1]; NULL under two pairs or where a side is constant. Every date of df is there.

    Any number of pairs takes one shuffle by date: ranks and centred sums (two passes, so that nothing cancels) are
    windows of that partitioning."""
    w, of = Window.partitionBy(date), range(len(pairs))
    both = [_finite(F.col(a).cast("double")) & _finite(F.col(b).cast("double")) for a, b, _ in pairs.values()]
    side = {f"_{s}{k}": F.when(ok, F.col(c).cast("double")) for k, (ok, (a, b, _)) in enumerate(zip(both, pairs.values(), strict=True)) for s, c in (("x", a), ("y", b))}
    p = df.select(date, *[c.alias(n) for n, c in side.items()])
    ranked = [f"_{s}{k}" for k, (_, _, rank) in enumerate(pairs.values()) if rank for s in "xy"]
    p = p.select(date, *[(average_rank(n, date) if n in ranked else F.col(n)).alias(n) for n in side])
    p = p.select("*", *[(F.col(n) - F.avg(n).over(w)).alias(f"_d{n}") for n in side])
    sums = []
    for k in of:
        x, y = f"_d_x{k}", f"_d_y{k}"
        sums += [F.count(f"_x{k}").alias(f"_n{k}"), F.sum(F.col(x) * F.col(y)).alias(f"_xy{k}"), F.sum(F.col(x) * F.col(x)).alias(f"_xx{k}"), F.sum(F.col(y) * F.col(y)).alias(f"_yy{k}")]
        sums += [((F.min(f"_x{k}") < F.max(f"_x{k}")) & (F.min(f"_y{k}") < F.max(f"_y{k}"))).alias(f"_v{k}")]
    s, out = p.groupBy(date).agg(*sums), [F.col(date)]
    for k, name in enumerate(pairs):
        value = F.when((F.col(f"_n{k}") >= 2) & F.col(f"_v{k}"), F.try_divide(f"_xy{k}", F.sqrt(F.col(f"_xx{k}") * F.col(f"_yy{k}"))))
        out += [F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).alias(name), F.col(f"_n{k}").alias(f"n_{name}")]
    return s.select(*out)


def correlation(df: DataFrame, a: str, b: str, key: str, out: str = "ic") -> DataFrame:
    """(key, out, n): Pearson correlation; see date_correlations."""
    return date_correlations(df, {out: (a, b, False)}, key).withColumnRenamed(f"n_{out}", "n")


def information_coefficient(df: DataFrame, f: str = "factor", r: str = "fwd", method: str = "spearman", date: str = "date") -> DataFrame:
    """(date, ic, n): rank (or plain) correlation of factor and forward return for each date."""
    return date_correlations(df, {"ic": (f, r, method == "spearman")}, date).withColumnRenamed("n_ic", "n")


def ic_summary(ic: DataFrame, col: str = "ic") -> DataFrame:
    """mean, std (sample), ir = mean / std, n of the known values: one row."""
    s = ic.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n"))
    return s.withColumn("ir", F.try_divide("mean", "std"))


def quantile_returns(df: DataFrame, q: int, f: str = "factor", r: str = "fwd") -> DataFrame:
    """(date, bucket, ret, n): mean forward return by factor bucket over rows that know both."""
    return buckets(_pairs(df, f, r), f, q).groupBy("date", "bucket").agg(F.avg(r).alias("ret"), F.count("*").alias("n"))


def quantile_turnover(df: DataFrame, q: int, f: str = "factor") -> DataFrame:
    """(bucket, date, turnover) of equal-weight buckets; each bucket's first date is charged in full."""
    b = buckets(df, f, q)
    w = b.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("date", "bucket"))).select("bucket", "date", "symbol", "weight")
    return turnover(w, b, ["bucket"])


def long_short(df: DataFrame, q: int, fee: float, sign: int = 1, f: str = "factor", r: str = "fwd") -> DataFrame:
    """(date, gross, cost, aligned): top less bottom bucket, both legs' turnover times fee, sign * gross - cost."""
    ret = quantile_returns(df, q, f, r)
    leg = lambda b: F.max(F.when(F.col("bucket") == b, F.col("ret")))
    gross = ret.groupBy("date").agg((leg(q) - leg(1)).alias("gross"))
    cost = quantile_turnover(_pairs(df, f, r), q, f).where(F.col("bucket").isin(1, q)).groupBy("date").agg((F.sum("turnover") * fee).alias("cost"))
    return gross.join(cost, "date").withColumn("aligned", sign * F.col("gross") - F.col("cost"))


def rank_autocorrelation(df: DataFrame, lag: int, f: str = "factor") -> DataFrame:
    """(date, ic, n): rank correlation of a factor with itself `lag` rows of the symbol before."""
    w = Window.partitionBy("symbol").orderBy("date")
    return information_coefficient(df.withColumn("_was", F.lag(f, lag).over(w)), f, "_was")


def monotonicity(ret: DataFrame) -> DataFrame:
    """(date, ic, n): rank correlation of bucket number and bucket return by date, over three buckets or more."""
    out = information_coefficient(ret.withColumn("_b", F.col("bucket").cast("double")), "_b", "ret")
    return out.withColumn("ic", F.when(F.col("n") >= 3, F.col("ic")))


def performance(nav: DataFrame, periods: int = 252, ret: str = "net_return") -> DataFrame:
    """One row: n, log_growth, annual_return, volatility, sharpe, max_drawdown. Returns in date order; volatility and
    Sharpe need two; a loss of everything leaves growth and what follows from it NULL. Growth is summed as logs, so
    that no length overflows. The series has one row a period, so one partition holds it."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.when(F.col(ret) > -1, F.log(1 + F.col(ret)))
    n = nav.where(F.col(ret).isNotNull()).withColumn("_g", gain).withColumn("_log", F.sum("_g").over(w))
    n = n.withColumn("_dd", F.exp(log_drawdown("_log", w)) - 1)
    s = n.agg(F.count("*").alias("n"), F.count("_g").alias("k"), F.sum("_g").alias("g"), F.stddev_samp(ret).alias("sd"), F.avg(ret).alias("m"), F.min("_dd").alias("max_drawdown"))
    g = F.when(F.col("k") == F.col("n"), F.col("g"))
    return s.select(
        "n", g.alias("log_growth"), (F.exp(g * periods / F.col("n")) - 1).alias("annual_return"), (F.col("sd") * math.sqrt(periods)).alias("volatility"),
        (F.try_divide("m", F.when(F.col("sd") > 0, F.col("sd"))) * math.sqrt(periods)).alias("sharpe"), F.when(F.col("k") == F.col("n"), F.col("max_drawdown")).alias("max_drawdown"),
    )


def log_drawdown(log_nav: str, w) -> Column:
    """Log of NAV over its running maximum (the start included). w: the frame up to each row."""
    return F.col(log_nav) - F.greatest(F.lit(0.0), F.max(log_nav).over(w))


def series(df: DataFrame, col: str, date: str = "date", most: int = 100_000) -> list[float | None]:
    """A per-date series on the driver, in order: one value a date, refused beyond `most` dates."""
    rows = df.select(date, col).orderBy(date).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} dates")
    return [None if r[1] is None or r[1] != r[1] else float(r[1]) for r in rows]


def newey_west_t(x: list[float | None], lag: int | None = None) -> float | None:
    """t of the mean with Bartlett weights; a gap keeps its place and deviates by nothing."""
    known = [v for v in x if v is not None]
    n = len(known)
    if n < 2:
        return None
    mean = math.fsum(known) / n
    d = [0.0 if v is None else v - mean for v in x]
    lag = newey_west_lag(n) if lag is None else lag
    s = math.fsum(a * a for a in d) / n
    for k in range(1, min(lag, len(d) - 1) + 1):
        s += 2 * (1 - k / (lag + 1)) * math.fsum(a * b for a, b in zip(d[k:], d, strict=False)) / n
    return mean / math.sqrt(s / n) if s > 0 else None


def newey_west_frame(df: DataFrame, col: str, lag: int, date: str = "date") -> DataFrame:
    """The same as one row (t, n), for a fixed lag, without leaving Spark."""
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    m = df.agg(F.avg(col).alias("_m"), F.count(col).alias("_n"))
    d = df.crossJoin(F.broadcast(m)).withColumn("_d", F.coalesce(F.col(col) - F.col("_m"), F.lit(0.0)))
    d = d.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lag + 1)})
    s = F.sum(F.col("_d") * F.col("_d"))
    for k in range(1, lag + 1):
        s = s + 2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(f"_p{k}"), F.lit(0.0))
    out = d.agg((s / F.max("_n")).alias("_s"), F.max("_m").alias("_m"), F.max("_n").alias("n"))
    return out.select(F.when((F.col("n") >= 2) & (F.col("_s") > 0), F.col("_m") / F.sqrt(F.col("_s") / F.col("n"))).alias("t"), "n")


def newey_west_lag(n: int) -> int:
    return int(4 * (n / 100) ** (2 / 9))


def effective_sample_size(x: list[float | None]) -> float:
    """n / (1 + 2 sum of autocorrelations), between 1 and n. Lags go up to Newey and West's, and on as long as the next
    autocorrelation is positive. A gap keeps its place and deviates by nothing, so no pair bridges it. A constant series
    is one sample; negative sums count as none."""
    known = [v for v in x if v is not None]
    n = len(known)
    if n < 2:
        return float(n)
    m = math.fsum(known) / n
    d = [0.0 if v is None else v - m for v in x]
    v0 = math.fsum(a * a for a in d)
    if v0 <= 0 or min(known) == max(known):
        return 1.0
    most, total = min(len(d) - 1, n - 1), 0.0
    for k in range(1, most + 1):
        rho = math.fsum(a * b for a, b in zip(d[k:], d, strict=False)) / v0
        if k > newey_west_lag(n) and rho <= 0:
            break
        total += rho
    by = 1 + 2 * total
    return float(n) if by <= 0 else min(float(n), max(1.0, n / by))


def mean_interval(x: list[float | None], z: float = 1.959963984540054) -> tuple[float, float] | None:
    """Normal interval of the mean by the effective sample size."""
    known = [v for v in x if v is not None]
    n = len(known)
    if n < 2:
        return None
    m = math.fsum(known) / n
    sd = math.sqrt(math.fsum((v - m) ** 2 for v in known) / (n - 1))
    if sd <= 0:
        return None
    half = z * sd / math.sqrt(effective_sample_size(known))
    return m - half, m + half


def information_ratio_interval(ir: float, n_eff: float, z: float = 1.959963984540054) -> tuple[float, float]:
    half = z * math.sqrt((1 + 0.5 * ir * ir) / n_eff)
    return ir - half, ir + half


def half_life(rho: float | None) -> float | None:
    return math.log(0.5) / math.log(rho) if rho is not None and 0 < rho < 1 else None


def sortino(x: list[float | None], periods: int = 252) -> float | None:
    """Mean over downside deviation, which counts all returns; NULL without a downside."""
    known = [v for v in x if v is not None]
    if len(known) < 2:
        return None
    down = math.sqrt(math.fsum(min(v, 0.0) ** 2 for v in known) / len(known))
    return math.fsum(known) / len(known) / down * math.sqrt(periods) if down > 0 else None


def win_rate(x: list[float | None], sign: int) -> float | None:
    known = [v for v in x if v is not None]
    return sum(v * sign > 0 for v in known) / len(known) if known else None


def split_oos(df: DataFrame, split: str, realized: str = "realized_date") -> DataFrame:
    """df with part: train iff realised before the split date, else test."""
    return df.withColumn("part", F.when(F.col(realized) < F.to_date(F.lit(split)), "train").when(F.col(realized).isNotNull(), "test"))


def perf_of_nav(nav: list[float], periods: int) -> dict[str, float]:
    """Annual return, volatility, Sharpe and maximum drawdown of a NAV at its rebalances (one value a period)."""
    if len(nav) < 2:
        return {"annual_return": 0.0, "volatility": 0.0, "sharpe": 0.0, "max_drawdown": 0.0}
    r = [b / a - 1 for a, b in zip(nav, nav[1:], strict=False)]
    growth, mean = nav[-1] / nav[0], sum(r) / len(r)
    sd = math.sqrt(sum((x - mean) ** 2 for x in r) / (len(r) - 1)) if len(r) > 1 else 0.0
    top, worst = nav[0], 0.0
    for x in nav:
        top = max(top, x)
        worst = min(worst, x / top - 1)
    return {"annual_return": growth ** (periods / len(r)) - 1 if growth > 0 else growth - 1, "volatility": sd * math.sqrt(periods), "sharpe": mean / sd * math.sqrt(periods) if sd > 0 else 0.0, "max_drawdown": worst}


def evaluate(df: DataFrame, f: str, sign: int, q: int = 5, fee: float = 0.001, split: str | None = None, book: list[str] | None = None, capacity: dict | None = None) -> dict:
    """plans.report.evaluate_factor() for a factor without declarations: its sections, verdict inputs and verdict.

    The frequency isn't declared and so not checked; returns are realised at df's realized_date (the latest of a date)
    or else on the next date. Of the out-of-sample section only the means of both parts; capacity is passed on."""
    from ..plans.report import EvalConfig, EvalContext, evaluate_factor

    cfg = EvalConfig("undeclared", True, "undeclared", "undeclared", False, False, rebalance="undeclared", n_quantiles=q, oos_split=split)
    r = evaluate_factor(df, f, sign, cfg, EvalContext(fee, tuple(book or ()), execution_capacity=capacity))
    oos = r.sections["oos_generalization"]
    short = {"oos_generalization": oos and {k: oos[k] for k in ("train", "test")}, "execution_capacity": capacity}
    return {**r.sections, **short, "inputs": asdict(r.inputs), "verdict": r.verdict}
