"""Line dedup by a log-template tree (operator 2). DataFrame functions only.

Each line is parsed at a fixed depth: token count, then the leading tokens, then a leaf of templates. Tokens
with digits are variable fields. In a longer line, one third of the tokens behind the leading ones may vary
as well: the line belongs to one template for each third, so two lines share a template if they agree on
count, leading tokens and the other two thirds. A template that recurs across documents is dropped from all
but its first document (the smallest doc_id), so a text that was copied survives once; with keep_first=False
it is dropped from every document.

A template recurs at MIN_DOCS documents, a long one at two; lines under MIN_TOKENS tokens are too short to
tell and stay. Templates are 96-bit hashes. Counting is partial before the shuffle, so a line that a third of
all documents share costs one row a task.

Defined results: null text is empty and comes back as null if nothing is dropped from it; blank lines stay;
a line that repeats within one document only is kept; rows that share a doc_id, whatever their texts, each count
towards recurrence, and what recurs stays in all rows of the first id, as it does in rows without an id where no
row with one has it; what a row loses depends on its own lines only; very long texts are parsed whole, line by
line; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, once, table

LEAD, PARTS, MIN_TOKENS, GENERAL, LONG, MIN_DOCS = 2, 3, 4, 12, 20, 3
FIELD = "<*>"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def masked_lines(text: Column) -> Column:
    """The lines with single spaces between tokens, none at the ends, and <*> for tokens with digits."""
    odd = lambda x: functools.reduce(lambda a, b: a | b, [x.contains(c) for c in ("  ", "\t", "\r", "\x0b", "\f")])
    spaced = once(F.coalesce(text, F.lit("")), lambda x: F.when(odd(x), F.regexp_replace(x, r"[ \t\x0B\f\r]+", " ")).otherwise(x))
    masked = once(spaced, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[^ \n]*[0-9][^ \n]*", FIELD)).otherwise(x))
    return F.transform(F.split(masked, "\n", -1), lambda x: F.trim(x))


def template_paths(lines: Column) -> Column:
    """The templates of masked lines: array of (k1, k2, line), none for lines that are too short. Whether a line
    is long stands in the last bit of k1, so a count is known to be enough from the key alone.

    In stages (count, cut, hash), as an expression inside a lambda is evaluated wherever it is named."""
    counted = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("n")))
    cut = lambda s, k: F.call_function("substring_index", s["x"], F.lit(" "), k)
    at = lambda s, q: F.lit(LEAD) + F.floor((s["n"] - LEAD) * q / PARTS).cast("int")
    piece = lambda part, before, after: F.struct(F.lit(part).alias("part"), before.alias("before"), after.alias("after"))

    def cuts(s: Column) -> Column:
        exact = piece(0, s["x"], F.lit(""))
        varied = [piece(q + 1, cut(s, at(s, q)), cut(s, at(s, q + 1) - s["n"])) for q in range(PARTS)]
        many = F.when(s["n"] >= GENERAL, F.array(exact, *varied)).otherwise(F.array(exact))
        return F.struct(s["i"].alias("i"), s["n"].alias("n"), cut(s, F.lit(LEAD)).alias("lead"), many.alias("many"))

    def keys(s: Column, c: Column) -> Column:
        path = (s["n"], s["lead"], c["part"], c["before"], c["after"])
        return F.struct((F.shiftleft(F.xxhash64(*path), 1) + (s["n"] >= LONG).cast("long")).alias("k1"), F.hash(*reversed(path)).alias("k2"), s["i"].alias("line"))

    parsed = F.transform(F.filter(counted, lambda s: s["n"] >= MIN_TOKENS), cuts)
    return F.flatten(F.transform(parsed, lambda s: F.transform(s["many"], lambda c: keys(s, c))))


def _key(id_col: str) -> list[Column]:
    """96 bits that stand for a row's id and text, so that rows with one id but other texts stay apart."""
    return [F.xxhash64(id_col, "text").alias("d1"), F.hash("text", id_col).alias("d2")]


def parse(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, d1, d2, paths array of (k1, k2, line)) sorted by key; line is -1 - line for repeats within a document."""
    own = [id_col, "d1", "d2"]
    rows = docs.select(id_col, *_key(id_col), F.array_sort(template_paths(masked_lines(F.col("text")))).alias("paths"))
    pairs = rows.select(*own, F.arrays_zip(F.col("paths").alias("x"), F.concat(F.array(F.lit(None).cast("struct<k1:bigint,k2:int,line:int>")), "paths").alias("before")).alias("pairs"))
    again = lambda p: F.coalesce((p["before"]["k1"] == p["x"]["k1"]) & (p["before"]["k2"] == p["x"]["k2"]), F.lit(False))
    flag = lambda p: F.struct(p["x"]["k1"].alias("k1"), p["x"]["k2"].alias("k2"), F.when(again(p), -1 - p["x"]["line"]).otherwise(p["x"]["line"]).alias("line"))
    return pairs.select(*own, F.transform(F.filter("pairs", lambda p: p["x"].isNotNull()), flag).alias("paths"))


def recurring(parsed: DataFrame, id_col: str = "doc_id", min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, n_docs, first): templates that recur across documents."""
    every = parsed.select(id_col, F.inline("paths"))
    count = every.groupBy("k1", "k2").agg(F.sum((F.col("line") >= 0).cast("long")).alias("n_docs"), F.min(id_col).alias("first"))
    return count.where((F.col("n_docs") >= min_docs) | ((F.col("k1").bitwiseAND(1) == 1) & (F.col("n_docs") >= 2)))


def dropped_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """(d1, d2, gone array of line numbers) for the documents that lose lines."""
    parsed = Scratch(spark, "templates").keep(parse(docs, id_col), "parsed")
    each = parsed.select(id_col, "d1", "d2", F.inline("paths")).join(recurring(parsed, id_col, min_docs), ["k1", "k2"])
    if keep_first:
        each = each.where(~F.col(id_col).eqNullSafe(F.col("first")))
    line = F.when(F.col("line") < 0, -1 - F.col("line")).otherwise(F.col("line"))
    return each.groupBy("d1", "d2").agg(F.collect_set(line).alias("gone"))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """docs with recurring lines gone from text, and n_lines, n_dropped added (or replaced)."""
    gone = dropped_lines(spark, docs.select(id_col, "text"), id_col, min_docs, keep_first).select(*[F.col(c).alias(f"__{c}") for c in ("d1", "d2", "gone")])
    d1, d2 = _key(id_col)
    keyed = docs.withColumns({"__a": d1, "__b": d2})
    both = keyed.join(gone, (F.col("__a") == F.col("__d1")) & (F.col("__b") == F.col("__d2")), "left").drop("__a", "__b", "__d1", "__d2")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(left, lambda i: F.col("__lines")[i]), "\n")
    out = both.withColumn("__lines", lines_of(F.col("text"))).withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
    return out.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}).drop("__lines", "__gone")


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def rows_sql(docs: str) -> str:
    """DuckDB CTEs that end in `deduped` (doc_id, text, n_lines, n_dropped), of a relation with doc_id and text."""
    third = lambda q: f"{LEAD} + floor((n - {LEAD}) * {q} / {PARTS})::BIGINT"
    return f"""
l AS (SELECT doc_id, text AS whole, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM {docs})),
t AS (SELECT *, list_transform(list_filter(string_split_regex(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) AS m FROM l),
n AS (SELECT *, len(m) AS n FROM t),
k AS (SELECT doc_id, i, n, array_to_string(m, ' ') AS key FROM n WHERE n >= {MIN_TOKENS}
  UNION ALL SELECT doc_id, i, n, q || '|' || n || '|' || array_to_string(m[1:{third("q")}], ' ') || ' | ' || array_to_string(m[{third("(q + 1)")} + 1:], ' ')
  FROM n, (SELECT unnest(range(0, {PARTS})) AS q) WHERE n >= {GENERAL}),
r AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= CASE WHEN any_value(n) >= {LONG} THEN 2 ELSE {MIN_DOCS} END),
g AS (SELECT DISTINCT doc_id, i FROM k JOIN r USING (key) WHERE doc_id <> first),
deduped AS (SELECT l.doc_id, CASE WHEN count(g.i) = 0 THEN any_value(whole) ELSE coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') END AS text, count(*) AS n_lines, count(g.i) AS n_dropped
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)"""


ORACLE = f"WITH {rows_sql('documents')} SELECT doc_id, n_lines, n_dropped, text FROM deduped"
