"""Sources of raw tables: declared endpoints, parsing to canonical columns, retry and rate limits, updates."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import compact_date
from .stores import normalize_panel


@dataclass(frozen=True)
class Endpoint:
    """columns: canonical name -> (type, raw name, whether a raw table must have it). dates: raw compact strings
    that become dates, with NULL for what is none."""

    name: str
    category: str
    columns: dict[str, tuple[str, str, bool]]
    keys: tuple[str, ...]
    dates: tuple[str, ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()


def _cols(**spec: str) -> dict[str, tuple[str, str, bool]]:
    """canonical="type raw" with ? for optional."""
    return {k: (t, raw.rstrip("?"), not raw.endswith("?")) for k, (t, raw) in ((k, v.split()) for k, v in spec.items())}


_KEY = {"date": "date trade_date", "symbol": "string ts_code"}
#: The catalogue of endpoints; raw names and keys are fixed by the data.
ENDPOINTS = {
    e.name: e
    for e in (
        Endpoint("market_daily", "market", _cols(**_KEY, open="double open?", high="double high?", low="double low?", close="double close?", volume="double vol?", amount="double amount?"), ("date", "symbol"), ("date",)),
        Endpoint("adj_factor", "market", _cols(**_KEY, adj_factor="double adj_factor"), ("date", "symbol"), ("date",)),
        Endpoint("index_weight", "universe", _cols(index_code="string index_code", date="date trade_date", symbol="string con_code", weight="double weight?"), ("date", "symbol"), ("date",)),
        Endpoint("suspend_d", "tradability", _cols(**_KEY, suspend_type="string suspend_type?"), ("date", "symbol", "suspend_type"), ("date",), (("suspend_type", "S"),)),
        Endpoint("stk_limit", "tradability", _cols(**_KEY, up_limit="double up_limit?", down_limit="double down_limit?"), ("date", "symbol"), ("date",)),
        Endpoint("namechange", "tradability", _cols(symbol="string ts_code", start_date="date start_date", end_date="date end_date?", name="string name"), ("symbol", "start_date", "end_date", "name"), ("start_date", "end_date")),
        Endpoint("stock_basic", "reference", _cols(symbol="string ts_code", list_date="date list_date?"), ("symbol",), ("list_date",)),
        Endpoint("daily_basic", "fundamental", _cols(**_KEY, pe="double pe?", pb="double pb?", total_mv="double total_mv?"), ("date", "symbol"), ("date",)),
        Endpoint("fina_indicator", "fundamental", _cols(date="date end_date", symbol="string ts_code", ann_date="date ann_date", end_date="date end_date", roe="double roe?", netprofit_yoy="double netprofit_yoy?", grossprofit_margin="double grossprofit_margin?"), ("symbol", "end_date", "ann_date"), ("date", "ann_date", "end_date")),
        Endpoint("index_member_all", "reference", _cols(symbol="string ts_code", in_date="date in_date", out_date="date out_date?", l1_name="string l1_name?", l2_name="string l2_name?", l3_name="string l3_name?"), ("symbol", "in_date", "out_date", "l1_name", "l2_name", "l3_name"), ("in_date", "out_date")),
        Endpoint("stk_mins_1min", "intraday", _cols(symbol="string ts_code", bar_end="timestamp_ntz trade_time", open="double open", high="double high", low="double low", close="double close", volume="double vol", amount="double amount"), ("symbol", "bar_end")),
    )
}


#: The raw field that dates a row of an endpoint, and when the row is known.
TIMING = {
    "market_daily": ("trade_date", "eod"),
    "adj_factor": ("trade_date", "eod"),
    "index_weight": ("trade_date", "asof_snapshot"),
    "suspend_d": ("trade_date", "eod"),
    "stk_limit": ("trade_date", "eod"),
    "namechange": ("start_date", "dimension_snapshot"),
    "stock_basic": ("list_date", "dimension_snapshot"),
    "daily_basic": ("trade_date", "same_day_publish"),
    "fina_indicator": ("ann_date", "ann_date_disclosure"),
    "index_member_all": ("in_date", "asof_interval"),
    "stk_mins_1min": ("trade_time", "intraday"),
}


def known_at(endpoint: str, dated: Column, decided: Column, after_close: bool = False) -> Column:
    """Whether a row dated so may be read on the day of a decision: what is known at the end of a day only after its close,
    or on a later day; the rest from its own day on. Bars of a day are a matter of minutes: see pit.visible_bars."""
    if endpoint not in TIMING:
        raise KeyError(f"no endpoint {endpoint}; known: {', '.join(sorted(TIMING))}")
    when = TIMING[endpoint][1]
    if when == "intraday":
        raise ValueError(f"{endpoint} is known by the minute")
    late = when == "eod" and not after_close
    return F.coalesce(dated < decided if late else dated <= decided, F.lit(False))


def by_category(category: str) -> list[str]:
    return sorted(e.name for e in ENDPOINTS.values() if e.category == category)


def parse(raw: DataFrame, endpoint: str) -> DataFrame:
    """Canonical typed columns of a raw table: optional columns that lack are NULL or their default, a required one
    raises; NaN is NULL; others are dropped."""
    e = ENDPOINTS[endpoint]
    out, defaults = [], dict(e.defaults)
    for name, (kind, source, required) in e.columns.items():
        if source not in raw.columns:
            if required:
                raise ValueError(f"{endpoint} lacks {source}")
            out.append(F.lit(defaults.get(name)).cast(kind).alias(name))
            continue
        c = F.col(source)
        c = compact_date(c.cast("string")) if name in e.dates else F.nullif(c.cast("double"), F.lit(float("nan"))) if kind == "double" else c.cast(kind)
        out.append(c.alias(name))
    return raw.select(*out)


class DataSource(Protocol):
    """Where daily panels come from."""

    def bars(self, symbols: list[str], start: str, end: str) -> DataFrame: ...


@dataclass
class ParquetSource:
    """Daily rows and adjustment factors in two Parquet tables; filters reach the scan."""

    spark: SparkSession
    daily: str
    adj: str | None = None

    def bars(self, symbols: list[str], start: str, end: str) -> DataFrame:
        own = lambda p: self.spark.read.parquet(p).where(F.col("symbol").isin(symbols) & F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
        return normalize_panel(with_adjustment(own(self.daily), own(self.adj) if self.adj else None))


def with_adjustment(daily: DataFrame, adj: DataFrame | None) -> DataFrame:
    """daily with adj_factor, 1 where there is none."""
    if adj is None:
        return daily.withColumn("adj_factor", F.lit(1.0))
    return daily.drop("adj_factor").join(adj.select("date", "symbol", "adj_factor"), ["date", "symbol"], "left").withColumn("adj_factor", F.coalesce("adj_factor", F.lit(1.0)))


def st_intervals(names: DataFrame) -> DataFrame:
    """(symbol, is_st, start, end) of names; a name with ST in it is special treatment. End inclusive, NULL open."""
    return names.select("symbol", F.upper("name").contains("ST").alias("is_st"), F.col("start_date").alias("start"), F.col("end_date").alias("end"))


def normalize_bars(raw: DataFrame, minutes: int = 1, lag_minutes: int = 1, order: str | None = None) -> DataFrame:
    """Bars with bar_start, available_time, trade_date and slot; of repeated (symbol, bar_end) the last by `order`."""
    step = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m), F.lit(0.0))
    df = raw
    if order:
        w = Window.partitionBy("symbol", "bar_end").orderBy(F.desc(order))
        df = df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")
    end = F.col("bar_end")
    return df.withColumns({"bar_start": end - step(minutes), "available_time": end + step(lag_minutes), "trade_date": F.to_date("bar_end"), "slot": F.hour("bar_end") * 60 + F.minute("bar_end"), "freq": F.lit(f"{minutes}min")})


def bar_violations(bars: DataFrame) -> DataFrame:
    """One row of counts: missing keys, repeated keys, bars that are available before they end or start after it."""
    w = Window.partitionBy("symbol", "bar_end")
    n = lambda c: F.count(F.when(c, 1))
    return bars.withColumn("_n", F.count("*").over(w)).agg(
        n(F.col("symbol").isNull() | F.col("bar_end").isNull()).alias("missing_key"), n(F.col("_n") > 1).alias("repeated_key"),
        n(F.col("available_time") < F.col("bar_end")).alias("early"), n(F.col("bar_start") >= F.col("bar_end")).alias("reversed"),
    )


def with_retry(call: Callable[[], object], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> object:
    """call() again after 1, 2, 4, 8, 8 ... seconds; the last error rises."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(2.0**k, 8.0))
    raise ValueError("attempts must be positive")


class RateLimiter:
    """At most one call an interval, over all threads."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next, self.lock = 60.0 / per_minute, clock, sleep, float("-inf"), threading.Lock()

    def acquire(self) -> float:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)
        return at


@dataclass(frozen=True)
class Outcome:
    endpoint: str
    ok: bool
    detail: str = ""


def run_updates(jobs: Iterable[tuple[str, Callable[[], object]]]) -> list[Outcome]:
    """Each endpoint's job; one that fails doesn't stop the others."""
    out = []
    for name, job in jobs:
        try:
            got = job()
            out.append(Outcome(name, True, "" if got is None else str(got)))
        except Exception as e:
            out.append(Outcome(name, False, f"{type(e).__name__}: {e}"))
    return out


def chunks(start: str, end: str, days: int) -> list[tuple[str, str]]:
    """A range cut into pieces of `days` days, for backfills."""
    from datetime import date, timedelta

    a, b, out = date.fromisoformat(start), date.fromisoformat(end), []
    while a <= b:
        e = min(b, a + timedelta(days=days - 1))
        out.append((a.isoformat(), e.isoformat()))
        a = e + timedelta(days=1)
    return out
