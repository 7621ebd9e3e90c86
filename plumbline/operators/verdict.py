"""The verdict on a factor: three axes from measured facts, and the decision they give. An unknown never convicts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

PASS, FAIL, SHORT, NONE = "PASS", "FAIL", "INSUFFICIENT_DATA", "NOT_ASSESSED"
Interval = tuple[float, float] | None


@dataclass(frozen=True)
class Thresholds:
    """The bar that a verdict is held against; declared before a run. The defaults are fixed values."""

    min_rebalances: int = 12
    min_n_eff: float = 24.0
    min_span_days: int = 365
    min_icir: float = 0.30
    min_incremental: float = 0.15
    min_win: float = 0.55
    min_t: float = 2.0
    min_monotonicity: float = 0.0

    def __post_init__(self) -> None:
        real = lambda x: not isinstance(x, bool) and isinstance(x, (int, float)) and math.isfinite(x)
        if bad := [k for k, v in vars(self).items() if not real(v) or v < 0]:
            raise ValueError(f"thresholds {bad} must be numbers of 0 or more")
        if self.min_rebalances < 1 or self.min_n_eff < 1 or self.min_win >= 1 or self.min_monotonicity >= 1:
            raise ValueError("a threshold that always or never holds gates nothing")


@dataclass(frozen=True)
class VerdictInputs:
    """What the axes read, as measured (signs not yet aligned with the hypothesis). None is unknown."""

    sign: int
    n_rebalances: int = 0
    n_eff: float | None = None
    span_days: float | None = None
    icir: float | None = None
    icir_ci: Interval = None
    t: float | None = None
    win: float | None = None
    monotonicity: float | None = None
    monotonicity_ci: Interval = None
    pooled_monotonicity: float | None = None
    oos_available: bool = False
    oos_sign_ok: bool = False
    oos_sign_flipped: bool = False
    oos_monotonicity_reversed: bool = False
    book: bool = False
    incremental_icir: float | None = None
    incremental_ci: Interval = None
    gross: float | None = None
    net_by_cost: tuple[tuple[float, float | None], ...] = ()
    tradable: bool | None = None
    capacity_sufficient: bool | None = None
    exploratory: bool = False


@dataclass(frozen=True)
class Verdict:
    predictive: str
    incremental: str
    tradable: str
    decision: str
    reasons: tuple[str, ...]


def _aligned(sign: int, ci: Interval) -> Interval:
    return None if ci is None else (min(sign * ci[0], sign * ci[1]), max(sign * ci[0], sign * ci[1]))


def _over(x: float | None, bar: float) -> bool:
    return x is not None and math.isfinite(x) and x > bar


def sample_gaps(v: VerdictInputs, bar: Thresholds) -> list[str]:
    """What the sample lacks: rebalances, effective samples, days."""
    held = (("rebalances", v.n_rebalances, bar.min_rebalances), ("effective samples", v.n_eff, bar.min_n_eff), ("days", v.span_days, bar.min_span_days))
    return [f"{name}: {have if have is not None else 'unknown'} of {want}" for name, have, want in held if have is None or have < want]


def monotone(v: VerdictInputs, bar: Thresholds) -> bool | None:
    """Whether buckets are in the order of the hypothesis, by the interval of the dates' correlations; None if it can't be
    told. Without an interval the mean decides, without that the pooled figure, and an unknown one is a no."""
    if (ci := _aligned(v.sign, v.monotonicity_ci)) is not None:
        return True if ci[0] > bar.min_monotonicity else False if ci[1] < 0 else None
    point = v.monotonicity if v.monotonicity is not None else v.pooled_monotonicity
    return point is not None and v.sign * point > bar.min_monotonicity


def predictive(v: VerdictInputs, bar: Thresholds) -> tuple[str, list[str]]:
    """A known reversal fails before the sample is asked; then the sample, then points, then the interval."""
    reversed_ = [what for what, is_ in (("sign flipped out of sample", v.oos_sign_flipped), ("buckets reversed on an independent cell", v.oos_monotonicity_reversed)) if is_]
    if v.oos_available and reversed_:
        return FAIL, reversed_
    if lacks := sample_gaps(v, bar) + ([] if v.oos_available else ["no out-of-sample evidence"]):
        return SHORT, lacks
    order = monotone(v, bar)
    size = lambda x: None if x is None else abs(x)
    missed = [
        what
        for what, ok in (
            ("sign out of sample", v.oos_sign_ok), ("information ratio", _over(size(v.icir), bar.min_icir)), ("t", _over(size(v.t), bar.min_t)),
            ("win rate", _over(v.win, bar.min_win)), ("order of buckets", order is not False),
        )
        if not ok
    ]
    if missed:
        return FAIL, missed
    if order is None:
        return SHORT, ["the order of buckets can't be told from none"]
    low = _aligned(v.sign, v.icir_ci)
    return (PASS, []) if low and low[0] > bar.min_icir else (SHORT, ["the information ratio's lower bound is under the bar"])


def incremental(v: VerdictInputs, bar: Thresholds) -> tuple[str, list[str]]:
    if not v.book:
        return NONE, ["no book of known factors"]
    if lacks := sample_gaps(v, bar):
        return SHORT, lacks
    if v.incremental_icir is None:
        return SHORT, ["what is left beside the book is unknown"]
    if not _over(v.sign * v.incremental_icir, bar.min_incremental):
        return FAIL, ["nothing is left beside the book in the stated direction"]
    low = _aligned(v.sign, v.incremental_ci)
    return (PASS, []) if low and low[0] > bar.min_incremental else (SHORT, ["the lower bound beside the book is under the bar"])


def aligned_nets(v: VerdictInputs) -> dict[float, float]:
    """Net spread by cost multiple in the direction of the hypothesis: the legs turn round, the cost stays a cost."""
    known = {m: net for m, net in v.net_by_cost if net is not None and math.isfinite(net)}
    if v.sign > 0:
        return known
    return {} if v.gross is None else {m: -v.gross - (v.gross - net) for m, net in known.items()}


def tradable(v: VerdictInputs, bar: Thresholds) -> tuple[str, list[str]]:
    if v.tradable is None and v.capacity_sufficient is None:
        return NONE, ["no facts of execution"]
    nets = aligned_nets(v)
    failed = [what for what, is_ in (("not tradable", v.tradable is False), ("capacity", v.capacity_sufficient is False), ("no spread at any cost", bool(nets) and max(nets.values()) <= 0)) if is_]
    if failed:
        return FAIL, failed
    if v.tradable and v.capacity_sufficient and _over(nets.get(1.0), 0.0):
        return PASS, []
    return SHORT, ["fills, capacity and the spread at base cost are not all established"]


def decide(v: VerdictInputs, bar: Thresholds = Thresholds()) -> Verdict:
    """Adopt if all axes pass (Watch if the run is exploratory), Reject if any fails, Watch if some pass and the rest is
    open, else INSUFFICIENT-DATA."""
    axes: dict[str, Callable] = {"predictive": predictive, "incremental": incremental, "tradable": tradable}
    got = {name: axis(v, bar) for name, axis in axes.items()}
    states = [state for state, _ in got.values()]
    why = [f"{name}: {r}" for name, (_, reasons) in got.items() for r in reasons]
    if FAIL in states:
        decision = "Reject"
    elif states.count(PASS) == len(states):
        decision = "Watch" if v.exploratory else "Adopt"
        why += ["capped: the run is exploratory"] if v.exploratory else []
    else:
        decision = "Watch" if PASS in states else "INSUFFICIENT-DATA"
    return Verdict(*states, decision, tuple(why))
