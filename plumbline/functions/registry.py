"""Factor metadata and the registry of builders, by exact name or by prefix_window."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class FactorSpec:
    """name, expected sign, lookback in trading days by window, columns needed, whether the name takes a window,
    the helper column that must be computed first, and the version that cached values are keyed by."""

    name: str
    sign: int
    lookback: Callable[[int], int]
    requires: tuple[str, ...]
    prefix: bool = False
    staged: str | None = None
    version: str = "1"
    intraday: bool = False

    def __post_init__(self) -> None:
        if self.sign not in (1, -1):
            raise ValueError(f"{self.name}: sign must be 1 or -1")
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.name):
            raise ValueError(f"{self.name!r}: not a factor name")


_registry: dict[str, tuple[FactorSpec, Callable[..., Column]]] = {}


def register(spec: FactorSpec) -> Callable:
    if spec.name in _registry:
        raise ValueError(f"{spec.name} is registered already")

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        _registry[spec.name] = (spec, build)
        return build

    return add


def resolve(name: str) -> tuple[FactorSpec, Callable[..., Column], int | None]:
    """(spec, builder, window) of an exact name, or of the longest registered prefix with a window."""
    if name in _registry:
        spec, build = _registry[name]
        if spec.prefix:
            raise KeyError(f"{name} needs a window, as in {name}_20")
        return spec, build, None
    m = re.fullmatch(r"(.+)_([1-9][0-9]*)", name)
    if m and m[1] in _registry and _registry[m[1]][0].prefix:
        return *_registry[m[1]], int(m[2])
    raise KeyError(f"no factor {name}; known: {', '.join(names())}")


def names() -> list[str]:
    return sorted(f"{n}_{{w}}" if s.prefix else n for n, (s, _) in _registry.items())


def compute(panel: DataFrame, wanted: list[str]) -> DataFrame:
    """panel with the wanted daily factors as columns; helper columns are computed once and dropped."""
    from .factors_daily import STAGED

    found = [(n, *resolve(n)) for n in wanted]
    missing = {c for _, s, _, _ in found for c in s.requires} - set(panel.columns)
    if missing:
        raise ValueError(f"the panel lacks {sorted(missing)}")
    helpers = {s.staged for _, s, _, _ in found if s.staged}
    out = panel.withColumns({h: STAGED[h]() for h in sorted(helpers)}) if helpers else panel
    out = out.withColumns({n: (b(w) if w else b()) for n, _, b, w in found})
    return out.drop(*(h for h in helpers if h not in panel.columns))
