"""Parquet-backed stores: coverage ledger, panel store, factor values, run log. All commit by Spark's protocol."""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.pit import merge_intervals, subtract_intervals

LEDGER = T.StructType([T.StructField(n, t) for n, t in (("endpoint", T.StringType()), ("key", T.StringType()), ("start", T.DateType()), ("end", T.DateType()), ("status", T.StringType()), ("fields_hash", T.StringType()), ("fetched_at", T.TimestampType()))])
COVERING = ("ok", "empty")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of both with the latest row of each key by `order`."""
    both = new if old is None else old.unionByName(new)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


@dataclass
class VersionedTable:
    """A table that is replaced as a whole: each version is a folder of its own, and a log names them in order, so
    nothing is read and overwritten at once. A version counts from the moment that its line is appended to the log; a
    write that fails before leaves the old one in place. The last `keep` versions stay for those who still read them."""

    spark: SparkSession
    path: str
    keep: int = 2

    def versions(self) -> list[str]:
        """Names of the versions, the current one first."""
        if not exists(self.spark, f"{self.path}/current"):
            return []
        rows = self.spark.read.schema("seq long, name string").json(f"{self.path}/current").collect()
        return [r.name for r in sorted(rows, key=lambda r: (r.seq, r.name), reverse=True)]

    def read(self) -> DataFrame | None:
        at = self.versions()
        return self.spark.read.parquet(f"{self.path}/{at[0]}") if at else None

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        name, before = f"v-{uuid.uuid4().hex}", self.versions()
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(len(before) + 1, name)], "seq long, name string").coalesce(1).write.mode("append").json(f"{self.path}/current")
        for old in before[self.keep - 1 :]:
            delete(self.spark, f"{self.path}/{old}")

    def upsert(self, new: DataFrame, keys: list[str], order: str, partition_by: tuple[str, ...] = ()) -> None:
        self.write(upsert(self.read(), new, keys, order), partition_by)


@dataclass
class PartitionedTable:
    """A table in folders by partition columns, of which an upsert rewrites only those that new rows fall in. What they
    will hold is staged beside the table first, so no folder is read and replaced at once."""

    spark: SparkSession
    path: str
    partition_by: tuple[str, ...]

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/data") if exists(self.spark, f"{self.path}/data") else None

    def upsert(self, new: DataFrame, keys: list[str], order: str) -> int:
        """The number of partitions that were rewritten. Of rows with equal keys the latest by `order` stays."""
        parts, staged = list(self.partition_by), f"{self.path}/staged-{uuid.uuid4().hex}"
        touched = [r.asDict() for r in new.select(*parts).distinct().collect()]
        if not touched:
            return 0
        old = self.read()
        if old is not None:
            # literals, so that folders are pruned before anything is read
            hit = functools.reduce(lambda a, b: a | b, [functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in t.items()]) for t in touched])
            old = old.where(hit).select(*new.columns)
        upsert(old, new, keys, order).write.parquet(staged)
        rows = self.spark.read.schema(new.schema).parquet(staged)
        rows.repartition(*parts).sortWithinPartitions(*parts, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/data")
        delete(self.spark, staged)
        return len(touched)


BAR_PARTS = ("freq", "year", "month")


@dataclass
class IntradayStore:
    """Bars (symbol, freq, bar_end, ...) in folders by frequency and month, sorted by symbol within; a range reads only
    its months, and the symbols reach the files' statistics."""

    spark: SparkSession
    path: str

    def _table(self) -> PartitionedTable:
        return PartitionedTable(self.spark, self.path, BAR_PARTS)

    def upsert(self, bars: DataFrame) -> int:
        """The number of months that were rewritten; of bars with one key the last that was stored stays."""
        at = bars.withColumns({"year": F.year("bar_end"), "month": F.month("bar_end"), "stored_at": F.current_timestamp()})
        return self._table().upsert(at, ["symbol", "freq", "bar_end"], "stored_at")

    def read_range(self, symbols: list[str], start: str, end: str, freq: str = "1min") -> DataFrame:
        """Bars of the days from start to end, both included."""
        df = self._table().read()
        if df is None:
            raise FileNotFoundError(self.path)
        first, last = (int(x[:4]) * 12 + int(x[5:7]) - 1 for x in (start, end))
        months = functools.reduce(lambda a, b: a | b, [(F.col("year") == m // 12) & (F.col("month") == m % 12 + 1) for m in range(first, last + 1)], F.lit(False))
        day = F.to_date("bar_end")
        out = df.where((F.col("freq") == freq) & months & F.col("symbol").isin(symbols) & (day >= F.to_date(F.lit(start))) & (day <= F.to_date(F.lit(end))))
        return out.drop("year", "month", "stored_at")


@dataclass
class CoverageLedger:
    """Append-only log of what was fetched; only ok and empty count as covered."""

    spark: SparkSession
    path: str

    def record(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], LEDGER)

    def covered(self, endpoint: str) -> DataFrame:
        own = self.read().where((F.col("endpoint") == endpoint) & F.col("status").isin(*COVERING))
        return merge_intervals(own.select("key", "start", "end"), ["key"])

    def gaps(self, endpoint: str, requests: DataFrame) -> DataFrame:
        """requests (key, start, end), one a key; what is left to fetch."""
        return subtract_intervals(requests, self.covered(endpoint), ["key"])

    def last_fields_hash(self, endpoint: str) -> DataFrame:
        return self.read().where(F.col("endpoint") == endpoint).groupBy("key").agg(F.max_by("fields_hash", "fetched_at").alias("fields_hash"))


def read_through(ledger: CoverageLedger, store: VersionedTable, endpoint: str, requests: DataFrame, fetch: Callable[[DataFrame], DataFrame], keys: list[str], refetch_days: int = 0, ready_until: str | None = None) -> DataFrame:
    """Fetch only what the ledger lacks (and the last refetch_days of each request), store it, record it, read all.

    fetch: gaps (key, start, end) -> rows with a `key` column. A gap without rows is recorded as empty; its days after
    ready_until, which the source may not have yet, as not_ready, and are asked for again."""
    spark = ledger.spark
    gaps = ledger.gaps(endpoint, requests)
    if refetch_days:
        tail = requests.select("key", F.greatest("start", F.date_sub("end", refetch_days - 1)).alias("start"), "end")
        gaps = merge_intervals(gaps.unionByName(tail), ["key"])
    gaps = spark.createDataFrame(gaps.collect(), gaps.schema)  # a request list is small, and must not change under way
    if ready_until:
        late = F.to_date(F.lit(ready_until))
        ready = gaps.where(F.col("start") <= late).withColumn("end", F.least("end", late)).withColumn("late", F.lit(False))
        gaps = ready.unionByName(gaps.where(F.col("end") > late).withColumn("start", F.greatest("start", F.date_add(late, 1))).withColumn("late", F.lit(True)))
    else:
        gaps = gaps.withColumn("late", F.lit(False))
    if not gaps.isEmpty():
        for late in (False, True):
            part = gaps.where(F.col("late") == late).drop("late")
            if part.isEmpty():
                continue
            got = fetch(part).withColumn("_at", F.current_timestamp()).persist()
            store.upsert(got, keys, "_at")
            has = got.select("key").distinct().withColumn("_h", F.lit(True))
            status = F.when(F.col("_h"), "ok").otherwise("not_ready" if late else "empty")
            ledger.record(part.join(has, "key", "left").select(F.lit(endpoint).alias("endpoint"), "key", "start", "end", status.alias("status"), F.lit(fields_hash(got.drop("_at").columns)).alias("fields_hash"), F.current_timestamp().alias("fetched_at")))
            got.unpersist()
    out = store.read()
    return out.drop("_at") if out is not None else out


def read_snapshot(ledger: CoverageLedger, store: VersionedTable, endpoint: str, fetch: Callable[[], DataFrame], max_age_days: int, today: str) -> DataFrame:
    """A table without dates, fetched as a whole if the last successful fetch is more than max_age_days before today."""
    day = F.to_date(F.lit(today))
    last = ledger.read().where((F.col("endpoint") == endpoint) & (F.col("status") == "ok")).agg(F.max("end")).first()[0]
    if last is None or ledger.spark.range(1).select(F.datediff(day, F.lit(last))).first()[0] > max_age_days:
        got = fetch()
        store.write(got)
        ledger.record(ledger.spark.range(1).select(F.lit(endpoint).alias("endpoint"), F.lit("*").alias("key"), day.alias("start"), day.alias("end"), F.lit("ok").alias("status"), F.lit(fields_hash(got.columns)).alias("fields_hash"), F.current_timestamp().alias("fetched_at")))
    return store.read()


def fields_hash(columns: list[str]) -> str:
    return hashlib.sha256(json.dumps(sorted(columns)).encode()).hexdigest()


@dataclass(frozen=True)
class Drift:
    endpoint: str
    kind: str
    severity: str
    columns: tuple[str, ...]


class SchemaGuard:
    """Declared columns against those that arrive: required missing (hard), unknown (warning), wrong type (hard),
    another hash than stored (hard). Reports, or raises in strict mode."""

    def __init__(self, declared: dict[str, dict[str, str]], optional: dict[str, set[str]] | None = None, strict: bool = False):
        self.declared, self.optional, self.strict, self.found = declared, optional or {}, strict, []

    def inspect(self, endpoint: str, df: DataFrame, stored_hash: str | None = None) -> list[Drift]:
        want, have = self.declared[endpoint], dict(df.dtypes)
        missing = tuple(sorted(c for c in want if c not in have and c not in self.optional.get(endpoint, set())))
        extra = tuple(sorted(set(have) - set(want)))
        wrong = tuple(sorted(c for c in want if c in have and have[c] != want[c]))
        out = [Drift(endpoint, k, s, c) for k, s, c in (("missing", "hard", missing), ("extra", "warning", extra), ("type", "hard", wrong)) if c]
        if stored_hash and stored_hash != fields_hash(df.columns):
            out.append(Drift(endpoint, "hash", "hard", tuple(sorted(have))))
        self.found += out
        if self.strict and any(d.severity == "hard" for d in out):
            raise ValueError(f"{endpoint}: {[d for d in out if d.severity == 'hard']}")
        return out

    def summary(self) -> dict[str, int]:
        return {s: sum(d.severity == s for d in self.found) for s in ("hard", "warning")}


CORE = {"date": "date", "symbol": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "amount": "double", "adj_factor": "double"}


def normalize_panel(df: DataFrame) -> DataFrame:
    """Keys and core columns by their types, NaN as NULL; other columns stay. A missing core column raises."""
    if lacking := [c for c in CORE if c not in df.columns]:
        raise ValueError(f"the panel lacks {lacking}")
    return df.withColumns({c: F.col(c).cast(t) if t != "double" else F.nullif(F.col(c).cast(t), F.lit(float("nan"))) for c, t in CORE.items()})


def validate_panel(df: DataFrame) -> DataFrame:
    """df, or an error that says how many keys repeat or are missing."""
    bad = df.groupBy("date", "symbol").count().where("count > 1 OR date IS NULL OR symbol IS NULL").count()
    if bad:
        raise ValueError(f"{bad} keys are missing or repeat")
    return df


@dataclass
class PanelStore:
    """A validated panel by year, read by date and symbol with pruning and pushdown."""

    spark: SparkSession
    path: str

    def write(self, panel: DataFrame) -> None:
        VersionedTable(self.spark, self.path).write(validate_panel(normalize_panel(panel)).withColumn("year", F.year("date")), ("year",))

    def read(self, start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
        df = VersionedTable(self.spark, self.path).read()
        if df is None:
            raise FileNotFoundError(self.path)
        for bound, op in ((start, "__ge__"), (end, "__le__")):
            if bound:
                df = df.where(getattr(F.col("date"), op)(F.to_date(F.lit(bound))) & getattr(F.col("year"), op)(int(bound[:4])))
        return (df.where(F.col("symbol").isin(symbols)) if symbols else df).drop("year")


def factor_key(factor: str, params: dict, version: str, view: str) -> str:
    return f"{factor}-{hashlib.sha256(json.dumps([params, version, view], sort_keys=True).encode()).hexdigest()[:16]}"


@dataclass
class FactorValueStore:
    """Values (date, symbol, value) by factor, parameters, code version and view. A stored NULL says that a cell was
    computed and is empty, so absence always means not computed."""

    spark: SparkSession
    root: str

    def table(self, factor: str, params: dict, version: str, view: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{factor_key(factor, params, version, view)}")

    def read_valid(self, key: tuple[str, dict, str, str]) -> DataFrame | None:
        """What is stored, or None: a table that is absent, can't be read, or lacks a column is a miss."""
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import PySparkException

        try:
            have = self.table(*key).read()
            if have is None or not {"date", "symbol", "value"} <= set(have.columns):
                return None
            have.agg(F.count("date")).first()
            return have
        except (PySparkException, Py4JJavaError):
            return None

    def serve(self, key: tuple[str, dict, str, str], wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Values of wanted (date, symbol): stored ones, and the missing cells computed once, stored and added."""
        t, cells = self.table(*key), ["date", "symbol"]
        have = self.read_valid(key)
        lack = wanted.select(*cells).distinct()
        if have is not None:
            lack = lack.join(have.select(*cells), cells, "left_anti")
        elif lack.isEmpty():
            return wanted.select(*cells).join(compute(lack).select(*cells, "value"), cells, "left")
        if not lack.isEmpty():
            new = lack.join(compute(lack).select(*cells, "value"), cells, "left").withColumn("at", F.current_timestamp())
            t.write(upsert(have, new, cells, "at"))
        return wanted.select(*cells).join(t.read().select(*cells, "value"), cells, "left")

    def invalidate(self, key: tuple[str, dict, str, str], symbols: DataFrame) -> None:
        """Forget the symbols, as after an adjustment of their prices."""
        t = self.table(*key)
        if (have := t.read()) is not None:
            t.write(have.join(symbols.select("symbol").distinct(), "symbol", "left_anti"))


def trim_to_days(df: DataFrame, first: Column, days: int, date: str = "date") -> DataFrame:
    """Rows from `first` on and, of those before, the last `days` of each symbol's own trading days."""
    before = F.col(date) < first
    back = F.dense_rank().over(Window.partitionBy("symbol", before).orderBy(F.desc(date)))
    return df.withColumn("_k", F.when(before, back)).where(F.col("_k").isNull() | (F.col("_k") <= days)).drop("_k")


def tail_recompute(old: DataFrame, full: Callable[[DataFrame], DataFrame], source: DataFrame, lookback: int, horizon: int, since: str) -> DataFrame:
    """old with every value from `since` less `horizon` calendar days on recomputed, from source rows that reach back
    by `lookback` of each symbol's own trading days. Equal to a full recompute if lookback covers the factor's."""
    first = F.date_sub(F.to_date(F.lit(since)), horizon)
    new = full(trim_to_days(source, first, lookback)).where(F.col("date") >= first)
    return old.where(F.col("date") < first).unionByName(new.select(*old.columns))


@dataclass
class RunLog:
    """Append-only JSON lines of runs; the latest of each key counts."""

    spark: SparkSession
    path: str

    def append(self, seq: int, key: str, status: str, detail: dict | None = None) -> None:
        self.spark.createDataFrame([(seq, key, status, json.dumps(detail or {}, sort_keys=True))], "seq long, key string, status string, detail string").coalesce(1).write.mode("append").json(self.path)

    def current(self) -> DataFrame:
        df = self.spark.read.schema("seq long, key string, status string, detail string").json(self.path)
        return df.groupBy("key").agg(F.max_by(F.struct("status", "seq", "detail"), "seq").alias("x")).select("key", "x.*")


def demo_panel(spark: SparkSession, days: int = 250, start: str = "2024-01-01") -> DataFrame:
    """Five symbols over business days: rising, decaying by 1 %, flat, half-slope, and a step to three times."""
    d = spark.range(int(days * 1.6) + 10).select(F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int")).alias("date")).where("dayofweek(date) BETWEEN 2 AND 6")
    t = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1
    d = d.withColumn("t", t).where(F.col("t") < days)
    names = F.explode(F.array(*[F.lit(f"00000{i}.SZ") for i in range(1, 6)]))
    close = (
        F.when(F.col("symbol") == "000001.SZ", 100.0 + F.col("t")).when(F.col("symbol") == "000002.SZ", 100.0 * F.pow(F.lit(0.99), F.col("t"))).when(F.col("symbol") == "000003.SZ", 100.0)
        .when(F.col("symbol") == "000004.SZ", 100.0 + F.col("t") / 2).otherwise(F.when(F.col("t") >= 30, 300.0).otherwise(100.0))
    )
    p = d.withColumn("symbol", names).withColumn("close", close.cast("double")).withColumn("volume", 1e6 + 1000.0 * F.substring("symbol", 6, 1).cast("int"))
    return p.select("date", "symbol", F.col("close").alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", "volume", (F.col("volume") * F.col("close")).alias("amount"), F.lit(1.0).alias("adj_factor"))
