"""Report-only data checks and reconciliation of results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITY = {"hard": 0, "warning": 1, "info": 2}
OHLC = ("open", "high", "low", "close")


def _bad(ok: Column) -> Column:
    """A check that can't be made counts as failed."""
    return ~F.coalesce(ok, F.lit(False))


def row_checks(daily: bool = True, drop: float = 0.01, jump: float = 0.5, time: str = "date") -> dict[str, tuple[str, Column]]:
    """name -> (severity, whether a row violates it)."""
    w = Window.partitionBy("symbol").orderBy(time)
    c = F.col
    checks = {
        "nonpositive_ohlc": ("hard", _bad(reduce(lambda a, b: a & b, [c(x) > 0 for x in OHLC]))),
        "high_below_low": ("hard", F.coalesce(c("high") < c("low"), F.lit(False))),
        "close_outside_range": ("hard", F.coalesce((c("close") < c("low")) | (c("close") > c("high")), F.lit(False))),
        "negative_volume": ("hard", F.coalesce((c("volume") < 0) | (c("amount") < 0), F.lit(False))),
    }
    if daily:
        checks["bad_adj_factor"] = ("hard", _bad(c("adj_factor") > 0))
        checks["adj_factor_fell"] = ("warning", F.coalesce(c("adj_factor") < F.lag("adj_factor").over(w) * (1 - drop), F.lit(False)))
        checks["extreme_change"] = ("warning", F.coalesce(F.abs(F.try_divide("close", F.lag("close").over(w)) - 1) > jump, F.lit(False)))
    return checks


def findings(df: DataFrame, daily: bool = True, time: str = "date", examples: int = 5) -> DataFrame:
    """(check, severity, n, examples) of the checks that something violates, hard ones first. One pass flags all
    rows; only the few examples are ranked."""
    w = Window.partitionBy("symbol", time)
    checks = row_checks(daily, time=time)
    flags = df.withColumns({f"_{k}": v for k, (_, v) in checks.items()}).withColumn("_duplicate_key", F.count("*").over(w) > 1)
    level = {"duplicate_key": "hard"} | {k: s for k, (s, _) in checks.items()}
    hits = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"), F.lit(SEVERITY[s]).alias("order"))) for k, s in level.items()]))
    rows = flags.select(F.concat_ws(" ", F.col("symbol"), F.col(time).cast("string")).alias("at"), F.explode(hits).alias("h")).select("at", "h.*")
    first = Window.partitionBy("check").orderBy("at")
    ex = rows.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= examples).groupBy("check").agg(F.array_sort(F.collect_list("at")).alias("examples"))
    n = rows.groupBy("check", "severity", "order").agg(F.count("*").alias("n"))
    return n.join(ex, "check").orderBy("order", "check").select("check", "severity", "n", "examples")


def missing_cells(df: DataFrame, calendar: DataFrame, time: str = "date") -> DataFrame:
    """(time, symbol) that the calendar has within a symbol's first and last row and df hasn't."""
    span = df.groupBy("symbol").agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    want = span.join(calendar.select(time).distinct(), (F.col(time) >= F.col("_a")) & (F.col(time) <= F.col("_b"))).select(time, "symbol")
    return want.join(df.select(time, "symbol"), [time, "symbol"], "left_anti")


def non_monotonic(df: DataFrame, seq: str, time: str = "bar_end") -> DataFrame:
    """Rows whose time doesn't follow that of the row before in order of arrival."""
    w = Window.partitionBy("symbol").orderBy(seq)
    return df.where(True).withColumn("_p", F.lag(time).over(w)).where(F.col("_p").isNotNull() & (F.col(time) <= F.col("_p"))).drop("_p")


#: Fixed words after which a value is secret.
_SECRET = re.compile(r"(?i)\b(token|password|passwd|secret|api[_-]?key)\b(\s*[=:]\s*)\S+")


def redact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b(token|password|passwd|secret|api[_-]?key)\b(\s*[=:]\s*)\S+", "$1$2***")


def redact_text(text: str) -> str:
    return _SECRET.sub(r"\1\2***", text)


def compare_cells(left: DataFrame, right: DataFrame, keys: list[str], value: str, tol: float = 1e-12) -> DataFrame:
    """(status, n): equal, close (within tol, relative), different, left_null, right_null, left_only, right_only."""
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    j = a.join(b, keys, "full")
    gap = F.abs(F.col("_a") - F.col("_b")) <= tol * F.greatest(F.abs("_a"), F.abs("_b"), F.lit(1.0))
    status = (
        F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "equal")
        .when(F.col("_a").isNull(), "left_null").when(F.col("_b").isNull(), "right_null").when(gap, "close").otherwise("different")
    )
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def classify_differences(left: DataFrame, right: DataFrame, keys: list[str], value: str, exact: float = 1e-12, tail: float = 1e-9, flip: float | None = None) -> DataFrame:
    """(keys, class) of every key: equal, within_exact, float_tail, warmup_extension (only right knows it),
    vanished (only left knows it) or unclassified. flip: of a factor that counts, whole-numbered values that differ by
    that many at most are threshold_flip, as when rounding moves one event over its threshold."""
    j = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys, "full")
    rel = F.abs(F.col("_a") - F.col("_b")) / F.greatest(F.abs("_a"), F.abs("_b"), F.lit(1e-300))
    kind = (
        F.when(F.col("_a").eqNullSafe(F.col("_b")), "equal").when(F.col("_a").isNull(), "warmup_extension").when(F.col("_b").isNull(), "vanished")
        .when(rel <= exact, "within_exact").when(rel <= tail, "float_tail")
    )
    if flip is not None:
        whole = (F.col("_a") == F.floor("_a")) & (F.col("_b") == F.floor("_b"))
        kind = kind.when(whole & (F.abs(F.col("_a") - F.col("_b")) <= flip), "threshold_flip")
    return j.select(*keys, kind.otherwise("unclassified").alias("class"))


def capped_classes(classified: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(class, n, cap, ok): how often each class occurs against what it may; equal and within_exact are free, a class
    without a cap may not occur."""
    n = classified.groupBy("class").agg(F.count("*").alias("n"))
    cap = F.create_map(*[F.lit(x) for k, v in caps.items() for x in (k, v)]) if caps else F.create_map().cast("map<string,int>")
    free = F.col("class").isin("equal", "within_exact")
    limit = F.when(~free, F.coalesce(F.try_element_at(cap, F.col("class")), F.lit(0)).cast("long"))
    return n.select("class", "n", limit.alias("cap"), F.coalesce(F.col("n") <= limit, F.lit(True)).alias("ok"))


def against_anchors(df: DataFrame, anchors: DataFrame, keys: list[str], value: str, tol: float = 1e-9) -> DataFrame:
    """anchors (keys, value), written down by hand, with what df holds there (actual) and ok: both absent, or within tol
    of each other, relative to the larger."""
    j = anchors.select(*keys, F.col(value).alias("expected")).join(df.select(*keys, F.col(value).alias("actual")), keys, "left")
    near = F.abs(F.col("expected") - F.col("actual")) <= tol * F.greatest(F.abs("expected"), F.abs("actual"), F.lit(1.0))
    return j.withColumn("ok", F.coalesce(near, F.col("expected").isNull() & F.col("actual").isNull()))


def content_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n, hash) of a table, whatever the order of its rows: a sum of row hashes modulo 2^64."""
    cols = columns or sorted(df.columns)
    h = F.xxhash64(*cols).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h) % F.lit(str(2**64)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).cast("string").alias("hash"))
