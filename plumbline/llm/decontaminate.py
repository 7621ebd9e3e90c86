"""Benchmark decontamination by a prefix-filtered set join (operator 6). DataFrame functions only.

A window of an item (10 consecutive words; all of them in a shorter item) can only lie where its rarest word
lies, so the necessary prefix of a window is one word, the one seen least in all documents, and a neighbour of it
within the window. Document words join those prefixes; length and positional bounds drop placements that leave the
document; the distinct placements of an item over a document are then verified word by word over item-sized windows.

Texts are split into words once, into a table that the counts read, and texts with a placement once more where they
are verified: only those are shuffled. What is broadcast (the prefix words, the items) is weighed in bytes first.

Defined results: null and empty texts have no words and are clean; an item without words is never found;
items that share an id are one item with several texts; repeated documents get the same result each; very long
texts and items are read whole; an empty benchmark leaves all clean, an empty table gives an empty result; other
columns are ignored. Characters beyond ASCII are word characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BETWEEN, LOWER, UPPER, Scratch, ascii_lower, once, small, table

WINDOW = 10


def words(text: Column) -> Column:
    """Split at what is no word character, which is several times as fast as extracting the words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _key(id_col: str) -> list[Column]:
    """96 bits that stand for a document's id and text, so that rows with one id but other texts stay apart."""
    return [F.xxhash64(id_col, "text").alias("k1"), F.hash("text", id_col).alias("k2")]


def items(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id") -> DataFrame:
    """(row, item_id, iw array of words, w length of its windows), items without words gone."""
    out = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col("text")).alias("iw")).where("size(iw) > 0").distinct()
    return out.select(F.xxhash64("item_id", "iw").alias("row"), "item_id", "iw", F.least(F.lit(window), F.size("iw")).alias("w"))


def tokenized(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(k1, k2, id_col, n, dw array of words) of every row."""
    return docs.select(*_key(id_col), id_col, words(F.col("text")).alias("dw")).select("k1", "k2", id_col, F.size("dw").alias("n"), "dw")


def rarest_words(its: DataFrame, split: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, near, ahead, row, off, lo, hi, w): a word that some windows of item `row` need at offset off, and the
    word that they need after it (or before it, if not ahead; none in windows of one word); lo and hi: the least and the
    greatest start of those windows. Rarity counts every occurrence in all documents. The rarest word of each window is
    a running minimum over an item's words."""
    at = its.select("row", "w", F.size("iw").alias("n"), F.posexplode(F.transform("iw", lambda x, i: F.struct(x.alias("word"), F.get("iw", i + 1).alias("next"), F.get("iw", i - 1).alias("prev")))).alias("off", "x")).select("row", "w", "n", "off", "x.*")
    vocabulary = small(at.select("word").distinct(), size=F.octet_length("word") + 16)
    seen = split.select(F.explode("dw").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("df"))
    ranked = at.join(seen, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = Window.partitionBy("row").orderBy("off").rowsBetween(0, window - 1)
    best = ranked.select("row", "w", "n", F.col("off").alias("s"), F.min(F.struct("df", "word", "off", "next", "prev")).over(ahead).alias("best")).where("s <= n - w AND best.df > 0")
    follows = F.col("best.off") + 1 < F.col("s") + F.col("w")
    near = F.when(F.col("w") > 1, F.when(follows, F.col("best.next")).otherwise(F.col("best.prev")))
    return best.groupBy("best.word", near.alias("near"), follows.alias("ahead"), "row", "best.off").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.first("w").alias("w"))


def placed_items(split: DataFrame, pre: DataFrame) -> DataFrame:
    """(k1, k2, row, shift): item `row` may lie over a document with its first word at position shift."""
    zipped = F.arrays_zip(F.col("dw").alias("word"), F.slice("dw", 2, F.greatest("n", F.lit(1))).alias("next"), F.concat(F.array(F.lit(None).cast("string")), "dw").alias("prev"))
    each = split.select("k1", "k2", "n", F.posexplode(zipped).alias("pos", "x")).select("k1", "k2", "n", "pos", "x.*")
    at = each.join(small(pre, size=2 * F.octet_length("word") + 64), "word")
    beside = F.col("near").isNull() | (F.col("near") == F.when(F.col("ahead"), F.col("next")).otherwise(F.col("prev")))
    shift = F.col("pos") - F.col("off")
    return at.where(beside & (shift + F.col("hi") >= 0) & (shift + F.col("lo") + F.col("w") <= F.col("n"))).select("k1", "k2", "row", shift.alias("shift")).distinct()


def prefixes(its: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """rarest_words() over documents (doc_id, text)."""
    return rarest_words(its, tokenized(docs), window)


def placements(docs: DataFrame, pre: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """placed_items() over documents (id_col, text)."""
    return placed_items(tokenized(docs, id_col), pre)


def verify(docs: DataFrame, placed: DataFrame, its: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(k1, k2, hit, found): positions of document words inside true windows, and the items found; both empty
    where no placement is true. An item's words meet a document once, however often it is placed there."""
    per_item = placed.groupBy("k1", "k2", "row").agg(F.collect_list("shift").alias("shifts"))
    known = per_item.join(small(its, size=F.octet_length(F.array_join("iw", " ")) + 64), "row")
    per = known.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "shifts", "iw", "w")).alias("ps"))
    due = docs.select(*_key(id_col), "text").join(small(placed.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi")
    both = due.join(per, ["k1", "k2"]).select("k1", "k2", words(F.col("text")).alias("dw"), "ps")

    def starts(dw: Column, p: Column, shift: Column) -> Column:
        """Where true windows of the item begin in the document: runs of equal words, as a string of 0 and 1."""
        same = F.transform(p["iw"], lambda x, i: F.when(x == F.get(dw, i + shift), "1").otherwise("0"))
        true = once(F.array_join(same, ""), lambda bits: F.filter(F.sequence(F.lit(0), F.size(p["iw"]) - p["w"]), lambda s: F.substring(bits, s + 1, p["w"]) == F.repeat(F.lit("1"), p["w"])))
        return F.transform(true, lambda s: s + shift)

    def judged(x: Column) -> Column:
        each = F.transform(x["ps"], lambda p: F.struct(p["item_id"].alias("item_id"), p["w"].alias("w"), F.flatten(F.transform(p["shifts"], lambda k: starts(x["dw"], p, k))).alias("at")))
        got = F.filter(each, lambda g: F.size(g["at"]) > 0)
        spread = lambda g: F.flatten(F.flatten(F.transform(g, lambda y: F.transform(y["at"], lambda s: F.sequence(s, s + y["w"] - 1)))))
        return once(got, lambda g: F.struct(F.array_distinct(spread(g)).alias("hit"), F.array_sort(F.array_distinct(F.transform(g, lambda y: y["item_id"]))).alias("found")))

    # inside a lambda the words are an argument, so they are split once
    out = both.select("k1", "k2", once(F.struct("dw", "ps"), judged).alias("x"))
    return out.select("k1", "k2", "x.*").dropDuplicates(["k1", "k2"])


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(k1, k2, hit, found) of the contaminated documents, and the words of all (see tokenized)."""
    run = Scratch(spark, "leaks")
    split = run.keep(tokenized(docs.select(id_col, "text"), id_col), "words")
    its = run.keep(items(benchmark, window), "items")
    pre = run.keep(rarest_words(its, split, window), "prefixes")
    placed = run.keep(placed_items(split, pre), "placed")
    return run.keep(verify(docs, placed, its, id_col), "hits").where("size(hit) > 0"), split


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each document."""
    leaked, split = hits(spark, docs, benchmark, window)
    out = split.select("doc_id", "k1", "k2", F.col("n").cast("long").alias("n_words")).join(leaked, ["k1", "k2"], "left")
    n_hit = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """The documents without any benchmark window, all columns."""
    leaked = hits(spark, docs, benchmark, window, id_col)[0].select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    a, b = _key(id_col)
    return docs.withColumns({"__k1": a, "__k2": b}).join(leaked, ["__k1", "__k2"], "left_anti").drop("__k1", "__k2")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), $p$[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+$p$)"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_split} AS dw FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_split} AS iw FROM benchmark),
w AS (SELECT DISTINCT item_id, least({WINDOW}, len(iw)) AS n, array_to_string(iw[s:s + least({WINDOW}, len(iw)) - 1], ' ') AS t
      FROM (SELECT *, unnest(range(1, len(iw) - least({WINDOW}, len(iw)) + 2)) AS s FROM b WHERE len(iw) > 0)),
g AS (SELECT doc_id, s, n, array_to_string(dw[s:s + n - 1], ' ') AS t FROM (SELECT doc_id, dw, n, unnest(range(1, len(dw) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(dw) >= n)),
h AS (SELECT doc_id, s, g.n, item_id FROM g JOIN w ON g.t = w.t AND g.n = w.n),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(dw) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""
