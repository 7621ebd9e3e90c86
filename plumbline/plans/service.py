"""Factor values on demand: materialise over a range, store what doesn't depend on the universe, combine on read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import factors_daily, factors_minute  # noqa: F401  registers the factors
from ..functions.registry import FactorSpec, compute, resolve
from ..operators.bars import DAY
from ..operators.pit import ex_date
from ..operators.xsection import residual
from ..sources.stores import FactorValueStore, trim_to_days
from .policy import View, daily_at, minutes_at, require_legal


def requested_universe(symbols: list) -> list[str]:
    """As strings, each once, in the order of first mention."""
    return list(dict.fromkeys(str(s) for s in symbols))


def emit_range(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    return df.where((F.col(date) >= F.to_date(F.lit(start))) & (F.col(date) <= F.to_date(F.lit(end))))


def materialize(panel: DataFrame, factor: str, start: str, end: str, view: View = View.CLOSE, mask_ex_dates: bool = False) -> DataFrame:
    """(date, symbol, value) of a daily factor over a range: warm-up by its lookback, then the view, the factor, the
    mask (decision view only: values of ex-dates are NULL), and the emitted range."""
    spec, _, window = resolve(factor)
    warm = trim_to_days(panel.where(F.col("date") <= F.to_date(F.lit(end))), F.to_date(F.lit(start)), spec.lookback(window or 1) + 1)
    masked = warm.withColumn("_ex", ex_date())
    out = compute(daily_at(masked, view).drop("_ex"), [factor]).select("date", "symbol", F.col(factor).alias("value"))
    if mask_ex_dates and view is View.DECISION:
        out = out.join(masked.select("date", "symbol", "_ex"), ["date", "symbol"]).withColumn("value", F.when(~F.col("_ex"), F.col("value"))).drop("_ex")
    return emit_range(out, start, end)


@dataclass(frozen=True)
class Binding:
    """How a minute factor is served: stage() makes what is stored, (trade_date, symbol, fields ...), from visible bars of
    one symbol alone; combine() turns stored rows of a universe into values. lookback in trading days; valid_days: whether
    the pool counts valid days only, so that warm-up can't be told from the calendar; reversal: whether the combine reads
    daily reversals; session_open: bars before this minute of the day are left out."""

    stage: Callable[..., DataFrame]
    lookback: int
    fields: tuple[str, ...] = ("value",)
    combine: Callable[..., DataFrame] | None = None
    valid_days: bool = True
    reversal: bool = False
    session_open: int | None = None


def _of_classes(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A factor over bar-class days as one over bars; class parameters go to the classes, the rest to the factor."""
    named = ("bar_seconds", "baseline", "least", "k")

    def run(bars: DataFrame, **params) -> DataFrame:
        return f(factors_minute.class_days(bars, **{k: v for k, v in params.items() if k in named}), **{k: v for k, v in params.items() if k not in named})

    return run


def _on_reversal(stored: DataFrame, reversal: DataFrame, least_names: int = 10) -> DataFrame:
    j = stored.join(reversal, DAY).where("value IS NOT NULL AND reversal IS NOT NULL")
    return j.select(*DAY, residual(F.col("value"), F.col("reversal"), ["trade_date"], least_names).alias("value"))


fm = factors_minute
#: Every minute factor.
BINDINGS: dict[str, Binding] = {
    "jump_amount_corr": Binding(fm.jump_amount_corr, 20, valid_days=False),
    "minute_ideal_amp": Binding(fm.minute_ideal_amp, 10, valid_days=False),
    "amp_marginal_anomaly_vol": Binding(fm.amp_marginal_anomaly_vol, 20, valid_days=False),
    "intraday_amp_cut": Binding(fm.amp_cut_days, 10, ("v_mean", "v_std"), fm.amp_cut_combine),
    "volume_peak_count": Binding(_of_classes(fm.volume_peak_count), 40),
    "valley_relative_vwap": Binding(_of_classes(fm.valley_relative_vwap), 40),
    "valley_ridge_vwap_ratio": Binding(_of_classes(fm.valley_ridge_vwap_ratio), 40),
    "ridge_minute_return": Binding(_of_classes(fm.ridge_minute_return), 40),
    "peak_ridge_amount_ratio": Binding(_of_classes(fm.peak_ridge_amount_ratio), 40),
    "peak_interval_kurtosis": Binding(fm.peak_interval_kurtosis, 40),
    "valley_price_quantile": Binding(_of_classes(fm.valley_quantile_days), 40, combine=_on_reversal, reversal=True),
    "mmp_ew": Binding(fm.mmp_ew, 1, valid_days=False, session_open=9 * 60 + 30),
    "intraday_ret": Binding(fm.intraday_ret, 1, valid_days=False),
}
TWO_STAGE = {n: (b.stage, b.combine) for n, b in BINDINGS.items() if b.combine}


def binding(factor: str) -> Binding:
    if factor not in BINDINGS:
        raise KeyError(f"no minute factor {factor}; bound: {', '.join(sorted(BINDINGS))}")
    return BINDINGS[factor]


def is_valid_day_pooled(factor: str) -> bool:
    return binding(factor).valid_days


def materialize_intermediate(bars: DataFrame, factor: str, start: str, end: str, view: View = View.DECISION, **params) -> DataFrame:
    """The stage before any cross-section, over the emitted range. A pool of valid days may reach back any number of
    days, so all history up to the end is one plan; other factors read their lookback only."""
    b, seen = binding(factor), minutes_at(bars, view).where(F.col("trade_date") <= F.to_date(F.lit(end)))
    if b.session_open is not None:
        seen = seen.where(F.hour("bar_end") * 60 + F.minute("bar_end") >= b.session_open)
    if not b.valid_days:
        seen = trim_to_days(seen, F.to_date(F.lit(start)), b.lookback, "trade_date")
    return emit_range(b.stage(seen, **params), start, end, "trade_date")


def combine(stored: DataFrame, factor: str, symbols: list[str], **params) -> DataFrame:
    """The cross-section over the universe that is asked for."""
    own, b = stored.where(F.col("symbol").isin(requested_universe(symbols))), binding(factor)
    return b.combine(own, **params) if b.combine else own.select(*DAY, "value")


def with_reversal(stored: DataFrame, daily: DataFrame, window: int = 20, view: View = View.DECISION) -> DataFrame:
    """stored joined with minus the daily return over `window` rows, as the view may read it."""
    w = Window.partitionBy("symbol").orderBy("date")
    seen = daily_at(daily, view)
    rev = seen.select(F.col("date").alias("trade_date"), "symbol", (-(F.try_divide("close", F.lag("close", window).over(w)) - 1)).alias("reversal"))
    return stored.join(rev, DAY, "left")


@dataclass
class FactorService:
    """panel() and cross_section() of daily factors, served from a store and filled where cells are missing."""

    panel_source: DataFrame
    store: FactorValueStore
    version: str = "1"
    view: View = View.CLOSE
    computed: list[str] = field(default_factory=list)

    def panel(self, factors: list[str], symbols: list[str], start: str, end: str, basis: str = "close_to_close") -> DataFrame:
        """(date, symbol, factor ...) on the source's grid of those symbols and dates; every cell is there."""
        require_legal(self.view, basis)
        own = self.panel_source.where(F.col("symbol").isin(requested_universe(symbols)))
        out = emit_range(own, start, end).select("date", "symbol")
        grid = out
        for f in factors:

            def fill(_: DataFrame, f: str = f) -> DataFrame:
                self.computed.append(f)
                return materialize(own, f, start, end, self.view)

            v = self.store.serve((f, {}, self.version, str(self.view)), grid, fill)
            out = out.join(v.withColumnRenamed("value", f), ["date", "symbol"], "left")
        return out

    def cross_section(self, factors: list[str], symbols: list[str], date: str, basis: str = "close_to_close") -> DataFrame:
        return self.panel(factors, symbols, date, date, basis)


@dataclass
class MinuteService:
    """Values of minute factors: the stage before the cross-section is stored by cell, whatever the universe, and
    combined over the universe that is asked for. bars: all visible fields of bars; daily: for reversals."""

    bars: DataFrame
    store: FactorValueStore
    daily: DataFrame | None = None
    version: str = "1"
    view: View = View.DECISION
    params: dict[str, dict] = field(default_factory=dict)
    computed: list[str] = field(default_factory=list)

    def panel(self, factor: str, symbols: list[str], start: str, end: str, basis: str = "exec_to_exec", **second) -> DataFrame:
        """(trade_date, symbol, value) on the grid of the symbols' days with bars. second: settings of the combine."""
        require_legal(self.view, basis)
        b, params = binding(factor), self.params.get(factor, {})
        if b.reversal and self.daily is None:
            raise ValueError(f"{factor} needs daily prices")
        own = self.bars.where(F.col("symbol").isin(requested_universe(symbols)))
        grid = emit_range(own, start, end, "trade_date").select(F.col("trade_date").alias("date"), "symbol").distinct()

        def fill(_: DataFrame) -> DataFrame:
            self.computed.append(factor)
            made = materialize_intermediate(own, factor, start, end, self.view, **params)
            return made.select(F.col("trade_date").alias("date"), "symbol", F.struct(*b.fields).alias("value"))

        v = self.store.serve((factor, params, self.version, str(self.view)), grid, fill)
        stored = v.select(F.col("date").alias("trade_date"), "symbol", *[F.col("value")[f].alias(f) for f in b.fields])
        if b.reversal:
            second = {"reversal": with_reversal(stored.select(*DAY), self.daily, view=self.view).select(*DAY, "reversal"), **second}
        return combine(stored, factor, symbols, **second)


def open_value_store(spark: SparkSession, source: str, shared: str, ephemeral: str) -> FactorValueStore:
    """Values of real sources are shared; a synthetic source gets a store of its own, which no other run reads."""
    roots = {"demo": ephemeral, "files": shared, "vendor": shared}
    if source not in roots:
        raise ValueError(f"no source {source!r}; known: {', '.join(sorted(roots))}")
    return FactorValueStore(spark, f"{roots[source]}/{source}")


def recompute_fn(factor: str, view: View = View.CLOSE) -> Callable[[DataFrame], DataFrame]:
    """A daily factor as what stores.tail_recompute() calls on trimmed source rows."""
    return lambda source: compute(daily_at(source, view), [factor]).select("date", "symbol", F.col(factor).alias("value"))


def intraday_spec_variant(spec: FactorSpec) -> FactorSpec:
    """A daily factor's specification as judged from execution to execution; a variant has none of its own."""
    if spec.intraday:
        raise ValueError(f"{spec.name} is judged by execution already")
    return replace(spec, intraday=True)


def artifact_key(universe: str, start: str, end: str, symbols: list[str], dates: list[str], params: dict, schema: int = 1) -> tuple[str, dict]:
    """(key, payload) of a table of execution prices: whatever its numbers depend on is in the payload."""
    sha = lambda xs: hashlib.sha1("|".join(xs).encode()).hexdigest()
    payload = {"schema": schema, "universe": universe, "start": start, "end": end, "params": params, "n_symbols": len(symbols), "n_dates": len(dates), "symbols": sha(sorted(map(str, symbols))), "dates": sha([str(d)[:10] for d in dates])}
    return hashlib.sha1(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16], payload
