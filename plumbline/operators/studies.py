"""Composites that studies and reports are made of."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import correlation, date_correlations
from .portfolio import turnover

POINTS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def group_backtest(df: DataFrame, group: str, fee: float, ret: str = "fwd") -> DataFrame:
    """(group, date, gross, turnover, net, cum) of equal-weight groups of (date, symbol, group, ret); cum sums net."""
    w = Window.partitionBy("date", group)
    own = df.where(F.col(group).isNotNull()).withColumn("weight", 1.0 / F.count("*").over(w))
    gross = own.groupBy(group, "date").agg(F.avg(F.coalesce(ret, F.lit(0))).alias("gross"))
    turn = turnover(own.select(group, "date", "symbol", "weight"), own, [group])
    out = gross.join(turn, [group, "date"]).withColumn("net", F.col("gross") - fee * F.col("turnover"))
    return out.withColumn("cum", F.sum("net").over(Window.partitionBy(group).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def spread(groups: DataFrame, group: str, top: int, bottom: int, value: str = "net") -> DataFrame:
    """(date, spread, cum): top less bottom group, and its running sum over dates where both are there."""
    leg = lambda k: F.max(F.when(F.col(group) == k, F.col(value)))
    s = groups.groupBy("date").agg((leg(top) - leg(bottom)).alias("spread")).where("spread IS NOT NULL")
    return s.withColumn("cum", F.sum("spread").over(Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def disclosure(df: DataFrame, value: str, gates: dict[str, Column]) -> DataFrame:
    """One row: rows, valid (rows that pass every gate), rate, each gate's failures, percentiles of value where valid."""
    ok = F.lit(True)
    for g in gates.values():
        ok &= F.coalesce(g, F.lit(False))
    flagged = df.withColumn("_ok", ok)
    failed = [F.count(F.when(~F.coalesce(g, F.lit(False)), 1)).alias(f"failed_{k}") for k, g in gates.items()]
    q = F.percentile(F.when(F.col("_ok"), F.col(value)), F.array(*map(F.lit, POINTS)))
    s = flagged.agg(F.count("*").alias("rows"), F.count(F.when(F.col("_ok"), 1)).alias("valid"), *failed, q.alias("_q"))
    return s.withColumn("rate", F.try_divide("valid", "rows")).select("rows", "valid", "rate", *[f"failed_{k}" for k in gates], *[F.col("_q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(POINTS)])


def basis_agreement(df: DataFrame, a: str, b: str, date: str = "date") -> DataFrame:
    """One row over the dates' correlations of two return bases: n, p10, median, p90."""
    c = correlation(df, a, b, date)
    q = F.percentile("ic", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return c.agg(F.count("ic").alias("n"), q.alias("_q")).select("n", *[F.col("_q")[i].alias(k) for i, k in enumerate(("p10", "median", "p90"))])


def require_agreement(df: DataFrame, least: float = 0.9) -> None:
    r = df.first()
    if r["median"] is None or r["median"] < least:
        raise ValueError(f"the two bases agree by a median of {r['median']}, under {least}")


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series, n, mean, std, least, median, most) of each column's known values, one row a column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select("v.*").where("x IS NOT NULL AND NOT isnan(x)")
    return long.groupBy("series").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.percentile("x", F.lit(0.5)).alias("median"), F.max("x").alias("most"))


def execution_pairs(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """panel (date, symbol, price, adj_factor, fwd) with exit_date, exit_price, exit_adj, and by_hand: fwd computed once
    more from raw prices and factors at both ends."""
    w = Window.partitionBy("symbol").orderBy("date")
    p = panel.withColumns({"exit_date": F.lead("date", horizon).over(w), "exit_price": F.lead("price", horizon).over(w), "exit_adj": F.lead("adj_factor", horizon).over(w)})
    paid, got = F.col("price") * F.col("adj_factor"), F.col("exit_price") * F.col("exit_adj")
    return p.withColumn("by_hand", F.try_divide(got, F.when(paid > 0, paid)) - 1)


def hand_checks(pairs: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    """n pairs, the same for a seed however the table is dealt out, with the difference of fwd from by_hand: a report."""
    known = pairs.where("fwd IS NOT NULL")
    return known.withColumn("difference", F.abs(F.col("fwd") - F.col("by_hand"))).orderBy(F.xxhash64(F.lit(seed), "symbol", "date"), "symbol", "date").limit(n).select("date", "symbol", "exit_date", "price", "adj_factor", "exit_price", "exit_adj", "fwd", "by_hand", "difference")


def ex_date_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs over whose holding the adjustment factor changes: where an unadjusted return would be wrong, and by how much."""
    raw = F.try_divide("exit_price", F.when(F.col("price") > 0, F.col("price"))) - 1
    return pairs.where("fwd IS NOT NULL AND exit_adj <> adj_factor").withColumn("unadjusted", raw).select("date", "symbol", "exit_date", "adj_factor", "exit_adj", "fwd", "unadjusted")


def check_execution_basis(pairs: DataFrame, close: str, least: float = 0.9, tol: float = 1e-9) -> dict:
    """Agreement of fwd with the column of close returns by date (plain and by rank), and the largest difference from the
    recomputation over ALL pairs; raises where the median is under `least` or a difference over `tol`."""
    c = date_correlations(pairs, {"plain": ("fwd", close, False), "rank": ("fwd", close, True)})
    q = F.percentile("plain", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    r = c.agg(F.count("plain").alias("dates"), q.alias("q"), F.percentile("rank", F.lit(0.5)).alias("rank")).first()
    worst = pairs.where("fwd IS NOT NULL").agg(F.max(F.abs(F.col("fwd") - F.col("by_hand")))).first()[0]
    p10, median, p90 = r["q"] or (None, None, None)
    if median is None or median < least:
        raise ValueError(f"the two bases agree by a median of {median} over {r['dates']} dates, under {least}")
    if worst is not None and worst > tol:
        raise ValueError(f"a return differs from its recomputation by {worst:.3e}")
    return {"dates": r["dates"], "p10": p10, "median": median, "p90": p90, "median_rank": r["rank"], "worst_difference": worst}


#: Fixed gates of the coverage disclosures.
CLASSIFIABLE, VALLEY, RIDGE, PEAK = 100, 20, 10, 5


def ridge_coverage(days: DataFrame, classifiable: int = CLASSIFIABLE, valley: int = VALLEY, ridge: int = RIDGE) -> DataFrame:
    """Of the bar-class days of valley and ridge factors: disclosure() of ridge bars, the days that classify, the rate of
    valid ones among them, the median of valley bars, and how many would pass if ridges were held to the valleys' gate."""
    gates = {"ridge": F.col("k_ridge") >= ridge, "valley": F.col("k_valley") >= valley, "classifiable": F.col("n_class") >= classifiable}
    base = disclosure(days, "k_ridge", gates)
    more = days.agg(F.count_if(gates["classifiable"]).alias("classifiable"), F.percentile("k_valley", F.lit(0.5)).alias("valley_median"), F.count_if(gates["classifiable"] & gates["valley"] & (F.col("k_ridge") >= valley)).alias("valid_at_valley_gate"))
    return base.crossJoin(more).withColumn("rate_of_classifiable", F.try_divide("valid", "classifiable"))


def ridge_return_coverage(days: DataFrame, classifiable: int = CLASSIFIABLE, ridge: int = RIDGE) -> DataFrame:
    return disclosure(days, "r_ridge", {"ridge": F.col("k_ridge_ret") >= ridge, "classifiable": F.col("n_class") >= classifiable})


def peak_coverage(days: DataFrame, classifiable: int = CLASSIFIABLE, peak: int = PEAK, ridge: int = RIDGE) -> DataFrame:
    return disclosure(days, "k_peak", {"peak": F.col("k_peak") >= peak, "ridge": F.col("k_ridge") >= ridge, "classifiable": F.col("n_class") >= classifiable})


def neutralization_coverage(before: DataFrame, after: DataFrame, value: str = "value", date: str = "trade_date") -> DataFrame:
    """One row: cells known before and after neutralising, the share kept, dates with none left, and the names of a date
    that are left (least, median, most)."""
    kept = after.where(F.col(value).isNotNull()).groupBy(date).agg(F.count("*").alias("_k"))
    d = before.where(F.col(value).isNotNull()).groupBy(date).agg(F.count("*").alias("_n")).join(kept, date, "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    s = d.agg(F.sum("_n").alias("before"), F.sum("_k").alias("after"), F.count_if(F.col("_k") == 0).alias("dates_lost"), F.min("_k").alias("least"), F.percentile("_k", F.lit(0.5)).alias("median"), F.max("_k").alias("most"))
    return s.withColumn("kept", F.try_divide("after", "before"))


def tail_rebalance(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """(entry, gross, n, omitted): sum of weight * (exit price / entry price - 1), names without both left out.

    weights: (entry, exit, symbol, weight); prices: (date, symbol, price)."""
    p = lambda on, name: prices.select(F.col("date").alias(on), "symbol", F.col("price").alias(name))
    j = weights.join(p("entry", "_a"), ["entry", "symbol"], "left").join(p("exit", "_b"), ["exit", "symbol"], "left")
    r = F.try_divide("_b", F.when(F.col("_a") > 0, F.col("_a"))) - 1
    return j.groupBy("entry").agg(F.coalesce(F.sum(F.col("weight") * r), F.lit(0.0)).alias("gross"), F.count(r).alias("n"), F.count(F.when(r.isNull(), 1)).alias("omitted"))


def holdings(weights: DataFrame) -> DataFrame:
    """weights with rank by weight, then symbol, within a date."""
    return weights.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("weight"), "symbol")))


def trade_plan(current: DataFrame, target: DataFrame, fills: DataFrame, amounts: DataFrame) -> DataFrame:
    """(date, symbol, current, target, filled, delta, amount) over every name that is held or wanted."""
    keys = ["date", "symbol"]
    j = current.select(*keys, F.col("weight").alias("current")).join(target.select(*keys, F.col("weight").alias("target")), keys, "full")
    j = j.join(fills.select(*keys, F.col("weight").alias("filled")), keys, "left").join(amounts.select(*keys, "amount"), keys, "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("current", "target", "filled")}
    return j.withColumns(zero).withColumn("delta", F.col("target") - F.col("current")).select(*keys, "current", "target", "filled", "delta", "amount")


def json_diff(a: object, b: object, tol: float = 0.0, path: str = "$") -> list[tuple[str, object, object]]:
    """The leaves in which two JSON values differ: (path, left, right)."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in sorted({*a, *b}) for d in (json_diff(a[k], b[k], tol, f"{path}.{k}") if k in a and k in b else [(f"{path}.{k}", a.get(k), b.get(k))])]
    if isinstance(a, list) and isinstance(b, list):
        out = [d for i, (x, y) in enumerate(zip(a, b, strict=False)) for d in json_diff(x, y, tol, f"{path}[{i}]")]
        return out + ([(f"{path}.length", len(a), len(b))] if len(a) != len(b) else [])
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        same = a == b or (a != a and b != b) or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
        return [] if same else [(path, a, b)]
    return [] if a == b else [(path, a, b)]


def render(report: dict) -> str:
    """A report of sections as Markdown; the same as JSON by json.dumps."""
    lines = ["# Evaluation", ""]
    for name, section in report.items():
        lines += [f"## {name.replace('_', ' ')}", ""]
        if isinstance(section, dict):
            lines += ["| item | value |", "|-|-|", *(f"| {k} | {v if not isinstance(v, float) else f'{v:.6g}'} |" for k, v in section.items()), ""]
        else:
            lines += [json.dumps(section, default=str), ""]
    return "\n".join(lines)
