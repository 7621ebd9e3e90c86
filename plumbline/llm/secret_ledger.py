"""Secret scans by an incremental blob ledger (operator 1).

Every version of every path is content-addressed; each distinct blob is scanned once for each rule version
it has not met, the ledger remembers the pair, and findings are joined back to all paths with that blob.
DataFrame functions only.

Defined results: null text is the empty blob, which has no findings; repeated rows are paths of their own
with the same findings; very long texts are scanned whole, in linear time; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import Scratch, small, table


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind. hint: a text that each match holds, cheap to look for. A match fails if group
    `group` has fewer than `least` characters. Raise version when the rule changes: blobs are scanned again."""

    kind: str
    pattern: str
    version: str = "1"
    hint: str | None = None
    group: int = 0
    least: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values of the contract; either case is spelled out so that every regex engine agrees.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: In the order of the kinds. The last two match maximal runs, so the least length can stand in the pattern.
RULES = (
    Rule("assign", ASSIGN, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
FOUND = "array<struct<rank:int,gap:int,size:int,ok:boolean>>"
SCANNED = T.StructType([T.StructField("blob_id", T.BinaryType()), T.StructField("rule_ids", T.ArrayType(T.StringType()))])


def content_address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, run: Scratch | None = None) -> DataFrame:
    """(blob_id, text, todo): each distinct blob once, with the ids of the rules that it has not met.

    The ledger is asked by address alone; then only texts that are due are shuffled, none if nothing is. Copies are
    combined before the shuffle, so a blob with many paths costs no more than another. run: where the addresses that
    are due are kept, so that they are known before any text is moved; else they are part of the plan."""
    at, text = content_address(F.col("text")).alias("blob_id"), F.coalesce("text", F.lit("")).alias("text")
    every = F.array(*[F.lit(r.id) for r in rules])
    if ledger is None:
        return versions.select(at, text).groupBy("blob_id").agg(F.first("text").alias("text")).withColumn("todo", every)
    met = ledger.select("blob_id", F.explode("rule_ids").alias("r")).groupBy("blob_id").agg(F.collect_set("r").alias("met"))
    left = F.array_except(every, F.coalesce("met", F.array().cast("array<string>"))).alias("todo")
    due = versions.select(at).distinct().join(met, "blob_id", "left").select("blob_id", left).where(F.size("todo") > 0)
    if run is not None:
        due = small(run.keep(due, "due"))
    return versions.select(at, text).join(due, "blob_id").groupBy("blob_id").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def _candidates(rule: Rule, rank: int) -> Column:
    """One entry for each match, in order: what lies before it, its length, whether it holds; else empty."""
    text, p = F.col("text"), F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), lambda x: F.length(x) >= rule.least).alias("ok"),
    )
    rows = F.transform(parts, lambda x: F.struct(F.lit(rank).alias("rank"), x["gap"].alias("gap"), x["size"].alias("size"), x["ok"].alias("ok")))
    due = F.array_contains("todo", rule.id) & (text.contains(rule.hint) if rule.hint else F.lit(True)) & text.rlike(rule.pattern)
    return F.when(due, rows.cast(FOUND)).otherwise(F.array().cast(FOUND))


def scan(unseen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, rule_ids, found): one row for each unseen blob, without its text."""
    return unseen.select("blob_id", F.col("todo").alias("rule_ids"), F.concat(*[_candidates(r, k) for k, r in enumerate(rules)]).alias("found"))


def place(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, kind, rank, rule_id, start, end): code points, end exclusive; failing matches are gone.

    Offsets are running sums over the matches of a blob, so any number of matches takes linear time."""
    rows = scanned.where(F.size("found") > 0).select("blob_id", F.posexplode("found").alias("i", "x")).select("blob_id", "i", "x.*").where("size IS NOT NULL")
    upto = Window.partitionBy("blob_id", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.repartition("blob_id").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("ok")
    named = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("rank") + 1)
    return ends.select("blob_id", named(lambda r: r.kind).alias("kind"), "rank", named(lambda r: r.id).alias("rule_id"), (F.col("end") - F.col("size")).alias("start"), "end")


def update(spark: SparkSession, versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at path has not met, append to it, and return its findings for the rules.

    The ledger has two tables: scanned (blob_id, rule_ids), findings (as of place()). Findings are appended
    before scanned pairs, each by Spark's commit protocol: a job lost in between is run again, and the
    duplicates that it may leave are removed on reading."""
    seen = _read(spark, f"{path}/scanned", SCANNED)
    run = Scratch(spark, "scan")
    scanned = run.keep(scan(unseen_blobs(versions, seen, rules, run), rules), "rows")
    place(scanned, rules).write.mode("append").parquet(f"{path}/findings")
    scanned.select("blob_id", "rule_ids").write.mode("append").parquet(f"{path}/scanned")
    run.clear()
    return spark.read.parquet(f"{path}/findings").where(F.col("rule_id").isin([r.id for r in rules])).dropDuplicates(["blob_id", "rule_id", "start"])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def join_back(versions: DataFrame, findings: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each path with the findings of its blob: (id_col, blob_id, spans array of (start, rank, end, kind))."""
    lists = findings.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("hits"))
    paths = versions.select(id_col, content_address(F.col("text")).alias("blob_id"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return paths.join(lists, "blob_id", "left").withColumn("hits", F.coalesce("hits", empty))


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = update(spark, docs, Scratch(spark, "ledger").root)
    count = lambda kind: F.size(F.filter("hits", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return join_back(docs, found).select("doc_id", *[count(r.kind) for r in RULES], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _oracle() -> str:
    one = lambda kind, rank, p, group, least: f"""
    SELECT doc_id, '{kind}' AS kind, {rank} AS r, unnest(range(1, len(h) + 1)) AS i, g, h, v FROM (
      SELECT doc_id, string_split_regex(t, $p${p}$p$) AS g, regexp_extract_all(t, $p${p}$p$, 0) AS h, regexp_extract_all(t, $p${p}$p$, {group}) AS v FROM d)"""  # noqa: E731
    union = "\n    UNION ALL".join(one(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(RULES))
    least = "CASE r " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES)) + " END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({union}),
s AS (SELECT doc_id, kind, r, coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in h[1:i-1]]), 0) AS a, length(h[i]) AS n
      FROM m WHERE length(v[i]) >= {least}),
f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, r) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f ON d.doc_id = f.doc_id"""


ORACLE = _oracle()
