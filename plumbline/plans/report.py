"""The evaluation of one factor: declared configuration, sections of measured facts, and the verdict on them."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation as ev
from ..operators.studies import render
from ..operators.verdict import Thresholds, VerdictInputs, decide
from ..operators.xsection import buckets, orthogonalize, residual
from .policy import View, require_legal

#: Days between periods, and periods a year, of the labels that are known.
SPACING = {"daily": 1.0, "weekly": 7.0, "biweekly": 14.0, "monthly": 365.25 / 12, "quarterly": 365.25 / 4, "annual": 365.25, "yearly": 365.25}
PERIODS = {"daily": 252, "weekly": 52, "biweekly": 26, "monthly": 12, "quarterly": 4, "annual": 1, "yearly": 1}
TOLERANCE, LAGS, FEW = 2.0, (1, 2, 3, 5), 24
SECTIONS = ("predictive_power", "return_risk", "stability_cost", "purity", "oos_generalization", "execution_capacity", "data_coverage", "caveats")


@dataclass(frozen=True)
class EvalConfig:
    """What a run declares before it sees results; impossible or dishonest declarations raise."""

    universe: str
    universe_is_pit: bool
    start: str
    end: str
    is_exploratory: bool
    post_hoc_selected: bool
    rebalance: str = "daily"
    n_quantiles: int = 5
    long_short: tuple[int, int] | None = None
    cost_scenarios: tuple[float, ...] = (1.0, 2.0, 4.0)
    limit_feasibility: bool = True
    capacity_notional: float | None = None
    max_participation_rate: float = 0.05
    oos_split: str | None = None
    independent_cells: tuple = ()
    winsorize: str | None = "mad"
    standardize: str | None = "zscore"
    neutralization: tuple[str, ...] = ("industry", "size")
    industry_level: str = "L1"
    tuned: bool = False
    n_factors_screened: int | None = None
    data_snapshot_id: str | None = None
    view: str = "close"
    return_basis: str = "close_to_close"
    book_view: str | None = None
    success_criteria: Thresholds | None = None

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(f"EvalConfig: {what}")

        number = lambda x: not isinstance(x, bool) and isinstance(x, (int, float)) and math.isfinite(x)
        need(all(isinstance(x, str) and x.strip() for x in (self.universe, self.start, self.end, self.rebalance)), "universe, start, end and rebalance must be said")
        need(all(isinstance(x, bool) for x in (self.universe_is_pit, self.is_exploratory, self.post_hoc_selected, self.limit_feasibility, self.tuned)), "flags must be True or False")
        need(self.is_exploratory or not self.post_hoc_selected, "a factor that was selected after the fact makes an exploratory run")
        need(isinstance(self.n_quantiles, int) and not isinstance(self.n_quantiles, bool) and self.n_quantiles >= 2, "two buckets or more")
        legs = tuple(self.long_short or (self.n_quantiles, 1))
        need(len(legs) == 2 and all(isinstance(x, int) and 1 <= x <= self.n_quantiles for x in legs) and legs[0] > legs[1], "the long leg must be a higher bucket than the short one")
        object.__setattr__(self, "long_short", legs)
        need(not isinstance(self.cost_scenarios, str) and all(number(x) and x > 0 for x in self.cost_scenarios) and any(abs(x - 1) < 1e-9 for x in self.cost_scenarios), "cost scenarios must be positive and hold 1.0")
        object.__setattr__(self, "cost_scenarios", tuple(float(x) for x in self.cost_scenarios))
        need(self.n_factors_screened is None or (isinstance(self.n_factors_screened, int) and self.n_factors_screened >= 1), "n_factors_screened must be 1 or more")
        need(self.capacity_notional is None or (number(self.capacity_notional) and self.capacity_notional > 0), "capacity_notional must be positive")
        need(number(self.max_participation_rate) and 0 < self.max_participation_rate <= 1, "max_participation_rate must be in (0, 1]")
        need(self.success_criteria is None or isinstance(self.success_criteria, Thresholds), "success_criteria must be Thresholds")
        need(self.book_view is None or self.book_view in [str(x) for x in View], "no such view of the book")
        if self.oos_split is not None:
            dt.date.fromisoformat(self.oos_split)
        require_legal(View(self.view), self.return_basis)

    @property
    def periods_per_year(self) -> int:
        return PERIODS.get(self.rebalance.strip().lower(), PERIODS["daily"])

    @property
    def criteria(self) -> Thresholds:
        return self.success_criteria or Thresholds()


@dataclass(frozen=True)
class EvalContext:
    """What a section needs beyond the panel. execution_capacity: facts that were measured elsewhere."""

    fee_rate: float = 0.001
    known_factors: tuple[str, ...] = ()
    universe_symbols: tuple[str, ...] = ()
    execution_capacity: Mapping | None = None
    horizon: int = 1
    min_history_bars: int = 0
    version: str = "1"


@dataclass
class Report:
    sections: dict
    inputs: VerdictInputs
    verdict: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({**self.sections, "inputs": asdict(self.inputs), "verdict": self.verdict}, sort_keys=True, default=str)

    def to_markdown(self) -> str:
        return render({**self.sections, "verdict": self.verdict})

    def summary(self) -> dict:
        """One line of a table of factors."""
        p, r = self.sections["predictive_power"] or {}, self.sections["return_risk"] or {}
        return {k: v for k, v in (("ic_mean", p.get("ic_mean")), ("ic_ir", p.get("ic_ir")), ("t", p.get("t")), ("gross", r.get("gross")), *self.verdict.items()) if k != "reasons"}


def check_grid(rebalance: str, dates: list[dt.date]) -> str:
    """Whether the dates are as far apart as the label says, to a factor of two; if not, the run stops, as its number of
    rebalances would be one that doesn't exist at that frequency."""
    want, gaps = SPACING.get(rebalance.strip().lower()), sorted((b - a).days for a, b in zip(dates, dates[1:], strict=False))
    if want is None or not gaps:
        return f"NOT CHECKED: {rebalance!r} has no known spacing" if want is None else "NOT CHECKED: under two periods"
    half = len(gaps) // 2
    gap = gaps[half] if len(gaps) % 2 else (gaps[half - 1] + gaps[half]) / 2
    if not want / TOLERANCE <= gap <= want * TOLERANCE:
        raise ValueError(f"{rebalance!r} means {want:.2f} days between periods, but these are {gap:.2f} apart: resample, or declare what they are")
    return f"OK: {gap:.2f} days apart over {len(dates)} periods, {want:.2f} declared"


def _mean(x: list[float | None]) -> float | None:
    known = [v for v in x if v is not None]
    return math.fsum(known) / len(known) if known else None


def _stats(x: list[float | None]) -> dict:
    """mean, std, ir, their intervals by effective samples, n."""
    known = [v for v in x if v is not None]
    m = _mean(x)
    sd = math.sqrt(math.fsum((v - m) ** 2 for v in known) / (len(known) - 1)) if len(known) > 1 else None
    ir = m / sd if sd else None
    n_eff = ev.effective_sample_size(known)
    return {"mean": m, "std": sd, "ir": ir, "n": len(known), "n_eff": n_eff, "interval": ev.mean_interval(known) if sd else None, "ir_interval": ev.information_ratio_interval(ir, n_eff) if ir is not None else None}


def _spearman(x: list[float | None], y: list[float | None]) -> float | None:
    """Rank correlation of two short lists over places that know both; None under two or where a side is constant."""
    both = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
    if len(both) < 2:
        return None
    rank = lambda v: [sum(w < u for w in v) + (sum(w == u for w in v) + 1) / 2 for u in v]
    a, b = (rank([p[k] for p in both]) for k in (0, 1))
    ma, mb = math.fsum(a) / len(a), math.fsum(b) / len(b)
    aa, bb = math.fsum((u - ma) ** 2 for u in a), math.fsum((u - mb) ** 2 for u in b)
    return max(-1.0, min(1.0, math.fsum((u - ma) * (v - mb) for u, v in zip(a, b, strict=True)) / math.sqrt(aa * bb))) if aa and bb else None


@dataclass
class Measured:
    """Per-date figures of a factor, in order of dates: what all sections read. One value a date each."""

    dates: list[dt.date]
    by: dict[str, list]
    ret: dict[int, list[float | None]]
    turn: dict[int, list[float | None]]
    realized: list[dt.date | None]
    cover: dict


def measure(df: DataFrame, f: str, cfg: EvalConfig, ctx: EvalContext) -> Measured:
    """Three actions over one kept table: all correlations of a date in one pass, the buckets, the counts.

    df: (date, symbol, f, fwd) and the known factors; one row of a symbol is one period."""
    book = list(ctx.known_factors)
    own = Window.partitionBy("symbol").orderBy("date")
    clean = lambda c: F.when(ev._finite(F.col(c).cast("double")), F.col(c).cast("double"))
    base = df.select("date", "symbol", clean(f).alias("_f"), clean("fwd").alias("_fwd"), *[clean(b).alias(b) for b in book], *(["realized_date"] if "realized_date" in df.columns else []))
    base = base.withColumns({f"_lag{k}": F.lag("_f", k).over(own) for k in LAGS} | {"_warm": F.row_number().over(own) <= ctx.min_history_bars}).persist()
    wide = base
    for k, b in enumerate(book):
        wide = wide.withColumn(f"_orth{k}", residual(F.col("_f"), F.col(b), ["date"]))
    wide = orthogonalize(wide, "_f", book, out="_pure") if book else wide
    pairs = {"ic": ("_f", "_fwd", True), "pearson": ("_f", "_fwd", False)}
    pairs |= {f"stale_{k}": (f"_lag{k}", "_fwd", True) for k in LAGS} | {f"auto_{k}": ("_f", f"_lag{k}", True) for k in LAGS}
    for k, b in enumerate(book):
        pairs |= {f"corr_{k}": ("_f", b, True), f"orth_{k}": (f"_orth{k}", "_fwd", True)}
    if book:
        pairs["pure"] = ("_pure", "_fwd", True)
    seen = ev.date_correlations(wide, pairs)
    if "realized_date" in df.columns:
        seen = seen.join(base.groupBy("date").agg(F.max("realized_date").alias("realized")), "date")
    rows = seen.orderBy("date").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100000 dates")
    dates = [r["date"] for r in rows]
    labelled = buckets(base, "_f", cfg.n_quantiles)
    ret = labelled.groupBy("date", "bucket").agg(F.avg("_fwd").alias("ret"))
    cells = {(r["date"], r["bucket"]): r for r in ret.join(ev.quantile_turnover(base, cfg.n_quantiles, "_f"), ["date", "bucket"], "full").collect()}
    cell = lambda name: {q: [c[name] if (c := cells.get((d, q))) else None for d in dates] for q in range(1, cfg.n_quantiles + 1)}
    known = F.col("_f").isNotNull()
    cover = base.agg(F.count("*").alias("rows"), F.count("_f").alias("known"), F.count("_fwd").alias("known_fwd"), F.count(F.when(F.col("_warm"), 1)).alias("warm"), F.count(F.when(known & ~F.col("_warm"), 1)).alias("known_after"), F.countDistinct("symbol").alias("symbols")).first().asDict()
    declared = sorted(set(map(str, ctx.universe_symbols)))
    if declared:
        there = {r[0] for r in base.where(F.col("symbol").isin(declared)).select("symbol").distinct().collect()}
        cover["dropped"] = [s for s in declared if s not in there]
    base.unpersist()
    by = {name: [r[name] for r in rows] for name in pairs} | {"size": [r["n_ic"] for r in rows]}
    realized = [r["realized"] for r in rows] if "realized_date" in df.columns else [*dates[ctx.horizon :], *[None] * min(ctx.horizon, len(dates))]
    return Measured(dates, by, cell("ret"), cell("turnover"), realized, cover)


def predictive_power(m: Measured, sign: int) -> dict | None:
    ic = m.by["ic"]
    s, pearson = _stats(ic), _stats(m.by["pearson"])
    if not s["n"]:
        return None
    return {
        "ic_mean": s["mean"], "ic_std": s["std"], "ic_ir": s["ir"], "ic_interval": s["interval"], "ic_ir_interval": s["ir_interval"], "t": ev.newey_west_t(ic),
        "win_rate": ev.win_rate(ic, sign), "periods": s["n"], "periods_without": len(ic) - s["n"], "pearson_mean": pearson["mean"], "pearson_ir": pearson["ir"],
        "stale": {k: _mean(m.by[f"stale_{k}"]) for k in LAGS},
    }


def _legs(m: Measured, cfg: EvalConfig) -> tuple[list[float | None], list[float]]:
    """(gross spread, both legs' turnover) by date."""
    top, bottom = cfg.long_short
    gross = [a - b if a is not None and b is not None else None for a, b in zip(m.ret[top], m.ret[bottom], strict=True)]
    return gross, [(a or 0.0) + (b or 0.0) for a, b in zip(m.turn[top], m.turn[bottom], strict=True)]


def by_date_monotonicity(m: Measured) -> list[float]:
    """Rank correlation of bucket and return on each date that knows three buckets or more."""
    out = []
    for k in range(len(m.dates)):
        row = [m.ret[q][k] for q in m.ret]
        if sum(v is not None for v in row) >= 3 and (r := _spearman([float(q) for q in m.ret], row)) is not None:
            out.append(r)
    return out


def return_risk(m: Measured, sign: int, cfg: EvalConfig, ctx: EvalContext) -> dict | None:
    if not any(v is not None for q in m.ret for v in m.ret[q]):
        return None
    gross, turn = _legs(m, cfg)
    net = {c: [g - ctx.fee_rate * c * t if g is not None else None for g, t in zip(gross, turn, strict=True)] for c in cfg.cost_scenarios}
    grown = lambda x: math.prod(1 + v for v in x if v is not None)
    mean, mono = {q: _mean(x) for q, x in m.ret.items()}, by_date_monotonicity(m)
    base = [sign * g - ctx.fee_rate * t for g, t in zip(gross, turn, strict=True) if g is not None]
    nav, out = [], {}
    for r in base:
        nav.append((nav[-1] if nav else 1.0) * (1 + r))
    if len(nav) >= 2:
        out = {f"aligned_{k}": v for k, v in ev.perf_of_nav(nav, cfg.periods_per_year).items()} | {"aligned_sortino": ev.sortino(base, cfg.periods_per_year), "aligned_final_nav": nav[-1]}
    s = _stats(mono)
    return {
        "legs": f"{cfg.long_short[0]} less {cfg.long_short[1]}", "bucket_mean": mean, "bucket_nav": {q: grown(x) for q, x in m.ret.items()}, "gross": _mean(gross),
        "net_by_cost": {c: _mean(x) for c, x in net.items()}, "net_growth_by_cost": {c: grown(x) - 1 for c, x in net.items()}, "aligned": _mean(base), "aligned_interval": _stats(base)["interval"],
        "pooled_monotonicity": _spearman([float(q) for q in mean], list(mean.values())), "monotonicity": s["mean"], "monotonicity_interval": s["interval"], "monotonicity_dates": s["n"], **out,
    }


def stability_cost(m: Measured, cfg: EvalConfig, ctx: EvalContext) -> dict:
    _, turn = _legs(m, cfg)
    rho = {k: _mean(m.by[f"auto_{k}"]) for k in LAGS}
    cost = {c: ctx.fee_rate * c * (_mean(turn) or 0.0) for c in cfg.cost_scenarios}
    base = next(v for c, v in cost.items() if abs(c - 1) < 1e-9)
    return {
        "turnover": {q: _mean(x) for q, x in m.turn.items()}, "legs_turnover": _mean(turn), "rank_autocorrelation": rho, "half_life": ev.half_life(rho[1]),
        "cost": cost, "cost_over_base": {c: v - base for c, v in cost.items()}, "cost_a_year": {c: v * cfg.periods_per_year for c, v in cost.items()},
    }


def purity(m: Measured, ctx: EvalContext) -> dict:
    book = ctx.known_factors
    if not book:
        return {"book": [], "incremental_ir": None}
    s = _stats(m.by["pure"])
    return {
        "book": list(book), "correlation": {b: _mean(m.by[f"corr_{k}"]) for k, b in enumerate(book)}, "ic_beside": {b: _mean(m.by[f"orth_{k}"]) for k, b in enumerate(book)},
        "ic_raw": _mean(m.by["ic"]), "incremental_mean": s["mean"], "incremental_ir": s["ir"], "incremental_interval": s["ir_interval"],
    }


def oos_generalization(m: Measured, sign: int, split: str | None) -> dict | None:
    """Periods by the date that their return is realised on; the expected sign must hold in both halves of the test part."""
    if split is None:
        return None
    day = dt.date.fromisoformat(split)
    part = [None if d is None else "test" if d >= day else "train" for d in m.realized]
    of = lambda p: [v for v, x in zip(m.by["ic"], part, strict=True) if x == p]
    train, test = of("train"), of("test")
    halves = [_mean(test[: len(test) // 2]), _mean(test[len(test) // 2 :])] if len(test) >= 2 else [None, None]
    there = _mean(train) is not None and _mean(test) is not None
    late = {q: _mean([v for v, p in zip(x, part, strict=True) if p == "test"]) for q, x in m.ret.items()}
    return {
        "split": split, "train": _mean(train), "test": _mean(test), "train_periods": sum(v is not None for v in train), "test_periods": sum(v is not None for v in test),
        "never_realised": part.count(None), "halves": halves, "available": there, "sign_ok": there and all(h is not None and sign * h > 0 for h in halves),
        "sign_flipped": there and sign * _mean(test) < 0, "test_monotonicity": _spearman([float(q) for q in late], list(late.values())) if there else None,
    }


def execution_capacity(ctx: EvalContext) -> dict | None:
    """The facts as supplied; they are measured by simulations, which this module doesn't run."""
    if ctx.execution_capacity is None:
        return None
    if not isinstance(ctx.execution_capacity, Mapping):
        raise TypeError("execution_capacity must be a mapping of measured facts")
    facts = dict(ctx.execution_capacity)
    return facts | {f"{k}_status": "UNKNOWN" for k in ("tradable", "capacity_sufficient") if not isinstance(facts.get(k), bool)}


def data_coverage(m: Measured, cfg: EvalConfig, ctx: EvalContext, grid: str) -> dict:
    ic, c, size = m.by["ic"], m.cover, sorted(m.by["size"])
    known = [d for d, v in zip(m.dates, ic, strict=True) if v is not None]
    share = lambda a, b: 1 - a / b if b else None
    half = len(size) // 2
    out = {
        "rebalances": len(known), "n_eff": ev.effective_sample_size(ic), "span_days": (known[-1] - known[0]).days if known else 0, "periods": len(m.dates), "declared": cfg.rebalance, "grid": grid,
        "symbols": c["symbols"], "rows": c["rows"], "factor_missing": share(c["known"], c["rows"]), "factor_missing_after_warm_up": share(c["known_after"], c["rows"] - c["warm"]), "warm_up_rows": c["warm"],
        "return_missing": share(c["known_fwd"], c["rows"]), "size_mean": _mean(size), "size_min": size[0] if size else None, "size_max": size[-1] if size else None,
        "size_median": None if not size else size[half] if len(size) % 2 else (size[half - 1] + size[half]) / 2, "periods_without_pairs": size.count(0),
    }
    if "dropped" in c:
        return out | {"symbols_declared": len(set(map(str, ctx.universe_symbols))), "dropped": len(c["dropped"]), "dropped_examples": c["dropped"][:5]}
    return out | {"symbols_declared": 0, "dropped": None}


def caveats(m: Measured, cfg: EvalConfig, ctx: EvalContext) -> dict:
    n = sum(v is not None for v in m.by["ic"])
    flags = (
        (cfg.is_exploratory, "exploratory: no claim of returns"), (cfg.post_hoc_selected, "selected after the fact: quantifies, doesn't confirm"), (cfg.tuned, "tuned: the fit in sample is optimistic"),
        (not cfg.universe_is_pit, "the universe isn't point-in-time: survivorship"), (cfg.oos_split is None, "no out-of-sample split was asked for"),
        (not cfg.independent_cells, "no independent cell was declared"), (True, "the spread is the difference of two long-only legs"), (n < FEW, f"small sample: {n} periods"),
    )
    screened = cfg.n_factors_screened
    return {
        "items": [text for on, text in flags if on], "screened": screened, "bonferroni_alpha": 0.05 / screened if screened else None, "false_positives_expected": 0.05 * screened if screened else None,
        "independent_cells": len(cfg.independent_cells), "snapshot": cfg.data_snapshot_id, "window": f"{cfg.start} .. {cfg.end}", "version": ctx.version, "view": cfg.view, "book_view": cfg.book_view,
        "criteria": "declared" if cfg.success_criteria else "default",
    }


def verdict_inputs(sections: dict, sign: int, cfg: EvalConfig) -> VerdictInputs:
    p, r, u, o, x, d = (sections[k] or {} for k in ("predictive_power", "return_risk", "purity", "oos_generalization", "execution_capacity", "data_coverage"))
    fact = lambda k: x[k] if isinstance(x.get(k), bool) else None
    return VerdictInputs(
        sign, d["rebalances"], d["n_eff"], d["span_days"], p.get("ic_ir"), p.get("ic_ir_interval"), p.get("t"), p.get("win_rate"), r.get("monotonicity"), r.get("monotonicity_interval"), r.get("pooled_monotonicity"),
        bool(o.get("available")), bool(o.get("sign_ok")), bool(o.get("sign_flipped")), False, bool(u["book"]), u["incremental_ir"], u.get("incremental_interval"),
        r.get("gross"), tuple((r.get("net_by_cost") or {}).items()), fact("tradable"), fact("capacity_sufficient"), cfg.is_exploratory,
    )


def evaluate_factor(df: DataFrame, f: str, sign: int, cfg: EvalConfig, ctx: EvalContext = EvalContext()) -> Report:
    """The eight sections of a factor and the verdict; a section without data is None."""
    m = measure(df, f, cfg, ctx)
    grid = check_grid(cfg.rebalance, m.dates)
    got = (predictive_power(m, sign), return_risk(m, sign, cfg, ctx), stability_cost(m, cfg, ctx), purity(m, ctx), oos_generalization(m, sign, cfg.oos_split), execution_capacity(ctx), data_coverage(m, cfg, ctx, grid), caveats(m, cfg, ctx))
    sections = dict(zip(SECTIONS, got, strict=True))
    inputs = verdict_inputs(sections, sign, cfg)
    return Report(sections, inputs, asdict(decide(inputs, cfg.criteria)))
