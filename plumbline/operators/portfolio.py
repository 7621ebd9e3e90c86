"""Scores, portfolio construction, rebalancing, fills and simulation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def equal_weight_score(factors: list[str]) -> Column:
    """Mean of the known factors; NULL where none is known."""
    total = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in factors[1:]), F.coalesce(F.col(factors[0]), F.lit(0.0)))
    n = sum((F.col(f).isNotNull().cast("int") for f in factors[1:]), F.col(factors[0]).isNotNull().cast("int"))
    return F.when(n > 0, total / n)


def ic_weights(ic: DataFrame, factors: list[str], horizon: int = 1, window: int | None = 60, least: int = 20) -> DataFrame:
    """(date, w_<factor>): mean of the ICs realised by each date over their absolute sum.

    ic: (date, <factor> ...), one row a date of the calendar. An IC of date d is known `horizon` rows later. If
    any factor has under `least` known ICs, all weigh the same. The series is one row a date, so the single
    partition of its window stays small whatever the panel's width."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    frame = w.rowsBetween(-(horizon + window - 1), -horizon) if window else w.rowsBetween(Window.unboundedPreceding, -horizon)
    stats = ic.select("date", *[F.avg(f).over(frame).alias(f"m_{f}") for f in factors], *[F.count(f).over(frame).alias(f"n_{f}") for f in factors])
    enough = F.least(*[F.col(f"n_{f}") for f in factors]) >= least if len(factors) > 1 else F.col(f"n_{factors[0]}") >= least
    norm = sum((F.abs(F.col(f"m_{f}")) for f in factors[1:]), F.abs(F.col(f"m_{factors[0]}")))
    return stats.select("date", *[F.when(enough & (norm > 0), F.col(f"m_{f}") / F.when(norm > 0, norm)).otherwise(1.0 / len(factors)).alias(f"w_{f}") for f in factors])


def weighted_score(df: DataFrame, weights: DataFrame, factors: list[str]) -> DataFrame:
    """score by date's weights; NULL unless every factor is known."""
    score = sum((F.col(f) * F.col(f"w_{f}") for f in factors[1:]), F.col(factors[0]) * F.col(f"w_{factors[0]}"))
    return df.join(weights, "date").withColumn("score", score)


def top_n(df: DataFrame, n: int, score: str = "score") -> DataFrame:
    """(date, symbol, rank, weight): the n highest scores of a date at equal weight; ties by symbol."""
    w = Window.partitionBy("date").orderBy(F.col(score).desc(), "symbol")
    picked = df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return picked.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("date")))


def equal_weight_all(df: DataFrame, score: str = "score") -> DataFrame:
    return df.where(F.col(score).isNotNull()).withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("date")))


def cap_weights(df: DataFrame, cap: float, weight: str = "weight") -> DataFrame:
    """Weights clipped to [0, cap], then scaled to sum to 1 for each date; a single pass, so one may exceed cap again."""
    clipped = F.least(F.greatest(F.col(weight), F.lit(0.0)), F.lit(cap))
    total = F.sum("_w").over(Window.partitionBy("date"))
    return df.withColumn("_w", clipped).withColumn(weight, F.when(total > 0, F.col("_w") / F.when(total > 0, total)).otherwise(F.col("_w"))).drop("_w")


def monthly_anchors(dates: DataFrame) -> DataFrame:
    """(entry, exit): last trading day of each month to that of the next, the last one to the final day; periods
    of no length are skipped."""
    ends = dates.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("entry"))
    w = Window.partitionBy(F.lit(0)).orderBy("entry")
    last = dates.agg(F.max("date").alias("last"))
    out = ends.withColumn("next", F.lead("entry").over(w)).crossJoin(F.broadcast(last))
    return out.select("entry", F.coalesce("next", "last").alias("exit")).where("exit > entry")


def turnover(weights: DataFrame, calendar: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(date, turnover): sum of |w - w before| over symbols between consecutive calendar dates; the first date is
    charged in full. weights: (date, symbol, weight). A symbol absent on a date weighs 0 there; each weight
    meets only the next date, so nothing is densified."""
    keys = keys or []
    cal = calendar.select("date").distinct().withColumn("_n", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")))
    now = weights.select(*keys, "date", "symbol", F.col("weight").alias("_w"), F.lit(0.0).alias("_b"))
    then = weights.join(cal, "date").where("_n IS NOT NULL").select(*keys, F.col("_n").alias("date"), "symbol", F.lit(0.0).alias("_w"), F.col("weight").alias("_b"))
    net = now.unionByName(then).groupBy(*keys, "date", "symbol").agg(F.abs(F.sum("_w") - F.sum("_b")).alias("_t"))
    return net.groupBy(*keys, "date").agg(F.sum("_t").alias("turnover"))


@dataclass(frozen=True)
class Costs:
    """fee on turnover; cash: what uninvested capital earns a period."""

    fee: float = 0.001
    tolerance: float = 1e-9
    cash: float = 0.0


def fill_orders(current: dict[str, float], target: dict[str, float], can_buy: set[str], can_sell: set[str], tol: float = 1e-9) -> tuple[dict[str, float], float]:
    """(positions, turnover) after selling what can be sold and buying what the cash allows, buys scaled alike."""
    after = dict(current)
    for s, w in current.items():
        t = target.get(s, 0.0)
        if t < w - tol and s in can_sell:
            after[s] = t
    cash = 1.0 - sum(after.values())
    wants = {s: t - after.get(s, 0.0) for s, t in target.items() if t - after.get(s, 0.0) > tol and s in can_buy}
    scale = min(1.0, max(0.0, cash) / need) if (need := sum(wants.values())) > tol else 0.0
    for s, d in wants.items():
        after[s] = after.get(s, 0.0) + d * scale
    after = {s: w for s, w in after.items() if w > tol}
    moved = sum(abs(after.get(s, 0.0) - current.get(s, 0.0)) for s in {*after, *current})
    return after, moved


def simulate(orders: DataFrame, costs: Costs = Costs(), strategy: str = "strategy") -> DataFrame:
    """NAV of each strategy, stateful: orders (strategy, date, symbol, target, can_buy, can_sell, ret).

    Positions carry over from one rebalance to the next and don't drift; a missing target is 0, a missing return
    earns nothing, a missing flag forbids, what isn't invested earns the cash return. One group is one strategy's rebalances, which are few and small;
    strategies run side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, float] = {}
        nav, out = 1.0, []
        for date, g in pdf.sort_values(["date", "symbol"]).groupby("date", sort=True):
            target = {s: float(t) for s, t in zip(g["symbol"], g["target"], strict=True) if t == t and t > 0}
            flags = [{s for s, f in zip(g["symbol"], g[c], strict=True) if f is True or f == 1} for c in ("can_buy", "can_sell")]
            held, moved = fill_orders(held, target, *flags, tol=costs.tolerance)
            ret = {s: float(r) for s, r in zip(g["symbol"], g["ret"], strict=True) if r == r and r is not None}
            gross = sum(w * ret.get(s, 0.0) for s, w in sorted(held.items())) + (1.0 - sum(w for _, w in sorted(held.items()))) * costs.cash
            cost = moved * costs.fee
            nav *= 1 + gross - cost
            out.append((pdf[strategy].iloc[0], date, gross, cost, moved, gross - cost, nav, len(held)))
        return pd.DataFrame(out, columns=[strategy, "date", "gross_return", "cost", "turnover", "net_return", "nav", "n_held"])

    kind = dict(orders.dtypes)
    schema = f"{strategy} {kind[strategy]}, date {kind['date']}, gross_return double, cost double, turnover double, net_return double, nav double, n_held long"
    return orders.groupBy(strategy).applyInPandas(run, schema)


def iter_cells(universes: list[str], windows: list[str], skips: set[tuple[str, str]] | None = None) -> Iterator[tuple[str, str]]:
    """The study matrix, universes by windows, less the skipped cells."""
    for u in universes:
        for w in windows:
            if (u, w) not in (skips or set()):
                yield u, w
