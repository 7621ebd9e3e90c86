"""Who may see which field when, and which returns may judge which view. A table of rules and pure transforms."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pit import decision_lag, visible_bars


class View(StrEnum):
    DECISION = "decision"
    CLOSE = "close"


class Basis(StrEnum):
    EXEC_TO_EXEC = "exec_to_exec"
    CLOSE_TO_CLOSE = "close_to_close"


class Seen(StrEnum):
    """From when a value may be read: the same day, the next trading day, by its own availability time, by its
    announcement date (or the day after), as of its snapshot, or always."""

    SAME_DAY = "same_day"
    NEXT_DAY = "next_day"
    CUTOFF = "cutoff"
    ANNOUNCED = "announced"
    ANNOUNCED_NEXT_DAY = "announced_next_day"
    AS_OF = "as_of"
    ALWAYS = "always"


#: The legal pairs: what is known at the decision is judged from execution to execution, what is known at the close
#: from close to close.
LEGAL = {View.DECISION: Basis.EXEC_TO_EXEC, View.CLOSE: Basis.CLOSE_TO_CLOSE}

#: (source, field or None for all others): (at the close, at the decision). Fixed rules.
RULES: dict[tuple[str, str | None], tuple[Seen, Seen]] = {
    ("market_daily", "open"): (Seen.SAME_DAY, Seen.SAME_DAY),
    ("market_daily", None): (Seen.SAME_DAY, Seen.NEXT_DAY),
    ("adj_factor", None): (Seen.SAME_DAY, Seen.NEXT_DAY),
    ("minute_bars", None): (Seen.SAME_DAY, Seen.CUTOFF),
    ("daily_basic", None): (Seen.SAME_DAY, Seen.NEXT_DAY),
    ("fina", None): (Seen.ANNOUNCED, Seen.ANNOUNCED_NEXT_DAY),
    ("limits", None): (Seen.SAME_DAY, Seen.SAME_DAY),
    ("suspensions", None): (Seen.SAME_DAY, Seen.SAME_DAY),
    ("names", None): (Seen.SAME_DAY, Seen.SAME_DAY),
    ("index_weight", None): (Seen.AS_OF, Seen.AS_OF),
    ("industry", None): (Seen.AS_OF, Seen.AS_OF),
    ("listing", None): (Seen.ALWAYS, Seen.ALWAYS),
}
IMMUTABLE, NO_INPUT = {"minute_bars"}, {"limits", "suspensions", "names", "index_weight", "industry", "listing"}


def require_legal(view: str, basis: str) -> tuple[View, Basis]:
    v, b = View(view), Basis(basis)
    if LEGAL[v] is not b:
        raise ValueError(f"view {v} may only be judged by {LEGAL[v]}, not by {b}")
    return v, b


def seen(source: str, field: str | None, view: View) -> Seen:
    if (source, None) not in RULES and (source, field) not in RULES:
        raise ValueError(f"unknown source {source!r}")
    return RULES.get((source, field)) and RULES[source, field][view is View.DECISION] or RULES[source, None][view is View.DECISION]


def revision_horizon(source: str, recent_days: int, overrides: dict[str, int] | None = None) -> int | None:
    """Trading days in which stored rows may still change; None for what feeds no factor. Disclosures need an
    override of their own: a short default would miss late ones."""
    if (source, None) not in RULES:
        raise ValueError(f"unknown source {source!r}")
    if source in NO_INPUT:
        return None
    if source in IMMUTABLE:
        return 0
    days = recent_days
    if source == "fina":
        if "fina" not in (overrides or {}):
            raise ValueError("disclosures need an override of the revision horizon")
        days = overrides["fina"]
    if isinstance(days, bool) or not isinstance(days, int) or days < 0:
        raise ValueError(f"{days!r} is no count of days")
    return days


def daily_at(panel: DataFrame, view: View) -> DataFrame:
    """The panel as that view may read it."""
    same = tuple(c for c in panel.columns if c not in ("date", "symbol") and seen("market_daily", c, View.DECISION) is Seen.SAME_DAY)
    return decision_lag(panel, same) if view is View.DECISION else panel


def minutes_at(bars: DataFrame, view: View, cutoff_minutes: int = 14 * 60 + 50) -> DataFrame:
    return visible_bars(bars, cutoff_minutes) if view is View.DECISION else bars


def disclosures_at(fina: DataFrame, view: View) -> DataFrame:
    """Disclosures with the date from which they may be read as ann_date."""
    return fina.withColumn("ann_date", F.date_add("ann_date", 1)) if view is View.DECISION else fina
