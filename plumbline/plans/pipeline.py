"""The daily study end to end: panel, factors, processing, scores, rebalancing, analytics, report."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import factors_daily  # noqa: F401  registers the factors
from ..functions.registry import compute
from ..operators import evaluation as ev
from ..operators.pit import front_adjust, tradable
from ..operators.portfolio import Costs, equal_weight_score, ic_weights, monthly_anchors, simulate, weighted_score
from ..operators.xsection import process
from ..sources.stores import normalize_panel


@dataclass(frozen=True)
class StudyConfig:
    """A strict declaration of a study: unknown keys and impossible values raise."""

    factors: tuple[str, ...] = ("momentum_20",)
    alpha: str = "equal_weight"
    top_n: int = 3
    fee: float = 0.001
    cash_return: float = 0.0
    periods: tuple[int, ...] = (1, 5, 20)
    quantiles: int = 5
    filters: tuple[str, ...] = ()
    neutralize: bool = False
    periods_per_year: int = 12
    min_listing_days: int | None = None

    def __post_init__(self) -> None:
        if self.alpha not in ("equal_weight", "ic_weight"):
            raise ValueError(f"no alpha model {self.alpha!r}")
        if self.top_n < 1 or self.quantiles < 2 or self.fee < 0 or not self.factors or min(self.periods) < 1:
            raise ValueError("top_n, quantiles, fee, factors or periods out of range")
        if bad := set(self.filters) - {"suspended", "st", "limit"}:
            raise ValueError(f"no filters {sorted(bad)}")

    @classmethod
    def load(cls, values: dict) -> StudyConfig:
        if bad := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(bad)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


@dataclass
class StudyResult:
    config: StudyConfig
    nav: DataFrame
    ic: dict[str, DataFrame]
    summary: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"config": asdict(self.config), "summary": self.summary}, sort_keys=True, default=str)

    def to_markdown(self) -> str:
        lines = ["# Study", "", f"Factors: {', '.join(self.config.factors)}. Top {self.config.top_n}, fee {self.config.fee:g}.", "", "| figure | value |", "|-|-|"]
        return "\n".join([*lines, *(f"| {k} | {v:.6f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in self.summary.items())]) + "\n"


def execution_feasibility(price: Column, up: Column, down: Column, tol: float = 1e-6) -> tuple[Column, Column]:
    """(can_buy, can_sell) at a raw execution price: without one neither; at the upper limit no buying, at the lower
    no selling; an unknown limit stops nothing."""
    has = F.coalesce(price > 0, F.lit(False))
    return has & ~F.coalesce(price >= up - tol, F.lit(False)), has & ~F.coalesce(price <= down + tol, F.lit(False))


def daily_feasibility(panel: DataFrame) -> tuple[Column, Column]:
    """(can_buy, can_sell) by the day's flags, as far as the panel has them; a missing close allows neither."""
    ok = F.col("close").isNotNull()
    if "trade_status" in panel.columns:
        ok &= F.coalesce("trade_status", F.lit(True))
    up = F.coalesce("limit_up", F.lit(False)) if "limit_up" in panel.columns else F.lit(False)
    down = F.coalesce("limit_down", F.lit(False)) if "limit_down" in panel.columns else F.lit(False)
    return ok & ~up, ok & ~down


def holding_returns(prices: DataFrame, anchors: DataFrame, price: str = "close") -> DataFrame:
    """(date, symbol, ret): price at the exit over that at the entry less 1, missing or zero starts earning 0."""
    a = prices.join(F.broadcast(anchors), F.col("date") == F.col("entry")).select("entry", "exit", "symbol", F.col(price).alias("p"))
    b = prices.select(F.col("date").alias("exit"), "symbol", F.col(price).alias("q"))
    ret = F.when(F.col("p").isNotNull() & F.col("q").isNotNull() & (F.col("p") != 0), F.try_divide("q", "p") - 1).otherwise(0.0)
    return a.join(b, ["exit", "symbol"], "left").select(F.col("entry").alias("date"), "symbol", ret.alias("ret"))


def exec_holding_returns(prices: DataFrame, anchors: DataFrame) -> DataFrame:
    """The same from execution to execution, on prices (date, symbol, price, adj_factor), adjusted at both ends."""
    return holding_returns(prices.withColumn("_p", F.col("price") * F.col("adj_factor")), anchors, "_p")


def limit_coverage(required: DataFrame, limits: DataFrame) -> DataFrame:
    """One row: how many required (date, symbol) have a row of raw price limits: required, present, missing."""
    keys = ["date", "symbol"]
    there = limits.where("up_limit IS NOT NULL OR down_limit IS NOT NULL").select(*keys).distinct().withColumn("_l", F.lit(True))
    j = required.select(*keys).distinct().join(there, keys, "left")
    return j.agg(F.count("*").alias("required"), F.count("_l").alias("present"), F.count(F.when(F.col("_l").isNull(), 1)).alias("missing"))


def tail_events(anchors: DataFrame, symbols: DataFrame, bars: DataFrame, limits: DataFrame | None = None, require_coverage: bool = True, tol: float = 1e-6) -> DataFrame:
    """(date, symbol, price, adj_factor, bar_missing, at_up, at_down, can_buy, can_sell, ret) at each entry: what a
    rebalance in the day's tail may trade, and what it earns from execution to execution, adjusted at both ends.

    bars: (date, symbol, price, adj_factor), raw execution prices. Without a bar neither side trades; at the upper limit
    none buys, at the lower none sells. A price at an entry without a row of limits raises, unless coverage isn't required
    (then nothing stops it): a missing row must not pass for a check that was made. limits None: no check is asked for."""
    at = anchors.select(F.col("entry").alias("date")).distinct().crossJoin(F.broadcast(symbols.select("symbol").distinct()))
    e = at.join(bars.select("date", "symbol", "price", "adj_factor"), ["date", "symbol"], "left")
    if limits is not None:
        if require_coverage and (lacks := limit_coverage(e.where("price > 0"), limits).first()["missing"]):
            raise ValueError(f"{lacks} entries have a price but no raw price limits")
        e = e.join(limits.select("date", "symbol", "up_limit", "down_limit"), ["date", "symbol"], "left")
    else:
        e = e.withColumns({"up_limit": F.lit(None).cast("double"), "down_limit": F.lit(None).cast("double")})
    p = F.col("price")
    buy, sell = execution_feasibility(p, F.col("up_limit"), F.col("down_limit"), tol)
    seen = F.coalesce(p > 0, F.lit(False))
    up, down = seen & F.coalesce(p >= F.col("up_limit") - tol, F.lit(False)), seen & F.coalesce(p <= F.col("down_limit") + tol, F.lit(False))
    e = e.select("date", "symbol", "price", "adj_factor", (~seen).alias("bar_missing"), up.alias("at_up"), down.alias("at_down"), buy.alias("can_buy"), sell.alias("can_sell"))
    return e.join(exec_holding_returns(bars, anchors), ["date", "symbol"], "left")


def event_counts(events: DataFrame) -> DataFrame:
    """(date, names, no_bar, up_blocked, down_blocked, both_ways) of tail_events, by entry."""
    n = lambda c: F.count_if(c)
    return events.groupBy("date").agg(
        F.count("*").alias("names"), n(F.col("bar_missing")).alias("no_bar"), n(F.col("at_up")).alias("up_blocked"), n(F.col("at_down")).alias("down_blocked"), n(F.col("can_buy") & F.col("can_sell")).alias("both_ways")
    )


def derive_cell_config(base: StudyConfig, overrides: dict) -> StudyConfig:
    """A cell of the study matrix: the base with some settings replaced, checked anew."""
    from dataclasses import replace

    if bad := set(overrides) - {f.name for f in fields(StudyConfig)}:
        raise ValueError(f"unknown settings {sorted(bad)}")
    return replace(base, **overrides)


def orders_for(scores: DataFrame, panel: DataFrame, anchors: DataFrame, returns: DataFrame, top_n: int, strategy: Column | None = None) -> DataFrame:
    """What simulate() takes: targets of the best scores at each entry, with flags and returns of every symbol there."""
    at = panel.join(F.broadcast(anchors.select(F.col("entry").alias("date"))), "date")
    buy, sell = daily_feasibility(at)
    flags = at.select("date", "symbol", buy.alias("can_buy"), sell.alias("can_sell"))
    w = Window.partitionBy("date").orderBy(F.desc("score"), "symbol")
    best = scores.where("score IS NOT NULL").join(F.broadcast(anchors.select(F.col("entry").alias("date"))), "date").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n)
    target = best.withColumn("target", 1.0 / F.count("*").over(Window.partitionBy("date"))).select("date", "symbol", "target")
    out = flags.join(target, ["date", "symbol"], "left").join(returns, ["date", "symbol"], "left")
    return out.select((strategy if strategy is not None else F.lit("main")).alias("strategy"), "date", "symbol", F.coalesce("target", F.lit(0.0)).alias("target"), "can_buy", "can_sell", "ret")


def run_study(panel: DataFrame, config: StudyConfig = StudyConfig()) -> StudyResult:
    """Limits and flags refer to raw prices, so they come before the adjustment; ICs use the first period."""
    raw = normalize_panel(panel)
    adjusted = front_adjust(raw)
    fs = list(config.factors)
    valued = compute(adjusted, fs)
    keys = tradable(valued, "suspended" in config.filters, "st" in config.filters, "limit" in config.filters, config.min_listing_days)
    done = process(keys, fs, size="market_cap" if config.neutralize else None, industry="industry" if config.neutralize else None)
    fwd = ev.forward_returns(adjusted, config.periods[0]).select("date", "symbol", "fwd")
    judged = valued.select("date", "symbol", *fs).join(fwd, ["date", "symbol"])
    ic = {f: ev.information_coefficient(judged, f) for f in fs}
    if config.alpha == "equal_weight":
        scores = done.withColumn("score", equal_weight_score(fs))
    else:
        table = None
        for f in fs:
            one = ic[f].select("date", F.col("ic").alias(f))
            table = one if table is None else table.join(one, "date")
        scores = weighted_score(done, ic_weights(table, fs, config.periods[0]), fs)
    anchors = monthly_anchors(adjusted.select("date").distinct()).persist()
    orders = orders_for(scores.select("date", "symbol", "score"), adjusted, anchors, holding_returns(adjusted, anchors), config.top_n)
    nav = simulate(orders, Costs(config.fee, cash=config.cash_return)).persist()
    rows = nav.orderBy("date").collect()
    summary = {**ev.perf_of_nav([r["nav"] for r in rows], config.periods_per_year)}
    summary |= {"avg_turnover": sum(r["turnover"] for r in rows) / len(rows) if rows else 0.0, "cost_drag": sum(r["cost"] for r in rows), "n_rebalances": len(rows)}
    for f in fs:
        s = ev.ic_summary(ic[f]).first()
        summary |= {f"ic_mean_{f}": s["mean"], f"ic_ir_{f}": s["ir"]}
    return StudyResult(config, nav, ic, summary)


def split_holdings(nav: DataFrame, split: str) -> DataFrame:
    """nav (entry, exit, ...) with part: train iff the holding ends before the split, test iff it begins at or after
    it; one that straddles the split has none."""
    day = F.to_date(F.lit(split))
    return nav.withColumn("part", F.when(F.col("exit") < day, "train").when(F.col("entry") >= day, "test"))


def sign_flips(weights: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, flips): how often a factor's weight changes sign between consecutive dates, zeros aside."""
    long = weights.select("date", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.signum(f"w_{f}").alias("s")) for f in factors])).alias("x")).select("date", "x.*").where("s <> 0")
    w = Window.partitionBy("factor").orderBy("date")
    return long.withColumn("_p", F.lag("s").over(w)).groupBy("factor").agg(F.count(F.when(F.col("s") != F.col("_p"), 1)).alias("flips"))


def matrix_verdict(holds: list[bool | None], settled: int | None = None, least: int = 12) -> str:
    """Of pre-declared hypotheses on one independent cell: each holds if the factor's mean IC has the expected sign in both
    halves (None, an unknown IC, doesn't). All hold: SUPPORTED; some: PARTIAL; none: NOT SUPPORTED. Under `least` settled
    rebalances the sample says nothing either way."""
    if settled is not None and settled < least:
        return "INSUFFICIENT-DATA"
    if not holds:
        return "NO-HYPOTHESES"
    n = sum(bool(h) for h in holds)
    return "SUPPORTED" if n == len(holds) else "PARTIAL" if n else "NOT SUPPORTED"


def hypothesis_holds(expected: int, train: float | None, test: float | None) -> bool:
    """Whether both halves' mean ICs are known, not zero, and of the expected sign."""
    return all(x is not None and x == x and x * expected > 0 for x in (train, test))
