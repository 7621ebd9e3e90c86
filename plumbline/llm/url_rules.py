"""URL filters by association rules (operator 5).

URLs become token sets (domain, subdomain labels, path segments with digits masked, file ending, query keys).
Labels are the verdicts of a curated rule list. Spark's FP-growth mines the token combinations of labelled URLs, with
the label as one more item; support and confidence are over labelled URLs. A rule may speak for others only if more
than TOLD of all URLs that it fits are labelled: what it has seen must outweigh what it would decide. Tokens that stand
in the same labelled URLs are mined as one, so that tokens which always go together don't multiply the combinations:
the commonest of them that is mostly labelled, or else the rarest.
Rules that a part of their tokens explains as well are pruned; the rest is indexed by the rarest token, and matched
through that index. The curated rule decides where one fits; else the best mined rule; else the URL is allowed.

Defined results: a null URL or one without :// has an empty host and path, no rule and is allowed; repeated
pages are judged each; ties between mined rules go to confidence, support, more tokens, then block; very long URLs are
read whole; without labelled URLs there are no mined rules; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import LOWER, UPPER, Scratch, small, table


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
SUPPORT, CONFIDENCE = 0.002, 0.95
#: The share of labelled ones among the URLs that a rule fits must be above this.
TOLD = 0.5
LABEL = "label:"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)(#?.*)$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[HostRule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        said = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, said) if out is None else out.when(fits, said)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.", -1)
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    domain = F.array(F.concat(F.lit("domain:"), F.substring_index(host, ".", -2)), F.concat(F.lit("top:"), F.substring_index(host, ".", -1)))
    above = tagged("sub:", F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))))
    segments = F.filter(F.split(F.translate(path, UPPER, LOWER), "/", -1), lambda x: x != "")
    plain = tagged("dir:", F.transform(segments, lambda x: F.regexp_replace(x, "[0-9]+", "9")))
    keys = F.filter(F.regexp_extract_all(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), F.lit(r"[?&]([^=&]+)"), F.lit(1)), lambda x: x != "")
    return F.array_distinct(F.concat(domain, above, plain, tagged("key:", keys)))


RULE = "tokens array<string>, verdict string, confidence double, support double, rarest string"


def _fits(sets: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """sets (items, ...) with each rule (rarest, tokens, ...) whose tokens they hold: through an index by rarest token."""
    return sets.select(*keep, "items", F.explode("items").alias("rarest")).join(small(rules), "rarest").where(F.size(F.array_except("tokens", "items")) == 0)


def mine(spark: SparkSession, sets: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, told: float = TOLD) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support, rarest) of sets (items array, verdict or null).

    Tokens under the support are gone before the mining, so at most 1 / support of the average URL's are left."""
    from pyspark.ml.fpm import FPGrowth

    run = Scratch(spark, "rules")
    known = sets.where("verdict IS NOT NULL").select("items", "verdict")
    n = known.count()
    if not n:
        return spark.createDataFrame([], f"rule_id int, {RULE}")
    # tokens of the same labelled URLs have the same sums of two hashes of them; of these the commonest that is mostly
    # labelled stands for all, or else the rarest
    hashed = lambda *c: F.sum(F.when(F.col("verdict").isNotNull(), F.xxhash64(*c).cast("decimal(38,0)")))
    counted = sets.select("items", "verdict", F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count("verdict").alias("freq"), hashed("items", "verdict").alias("h"), hashed("verdict", "items").alias("g"))
    tokens_ = counted.where((F.col("freq") > 0) & (F.col("freq") >= support * n)).groupBy("freq", "h", "g").agg(F.min_by("token", F.struct(F.when(F.col("freq") > told * F.col("n"), -F.col("n")).otherwise(F.col("n")).alias("o"), "token")).alias("token"))
    tokens_ = run.keep(tokens_.select("token", "freq"), "tokens")
    baskets = known.withColumn("i", F.monotonically_increasing_id()).select("i", "verdict", F.explode("items").alias("token")).join(small(tokens_), "token")
    baskets = baskets.groupBy("i", "verdict").agg(F.collect_list("token").alias("items")).select(F.array_append("items", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    # items are counted against all labelled URLs, also those of which no token is left
    rows = run.keep(baskets, "baskets")
    left = rows.count()
    if not left:
        return spark.createDataFrame([], f"rule_id int, {RULE}")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / left), minConfidence=confidence).fit(rows)
    said = F.element_at("consequent", 1)
    own = model.associationRules.where((F.size("consequent") == 1) & said.startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    found = own.select(F.array_sort("antecedent").alias("tokens"), F.substring(said, len(LABEL) + 1, 99).alias("verdict"), "confidence", (F.col("support") * left / n).alias("support"))
    first = found.select("tokens", F.explode("tokens").alias("token")).join(small(tokens_), "token").groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    found = run.keep(found.join(first, "tokens"), "found")
    # equal token sets are counted once, however many URLs have them
    alike = sets.select(F.array_sort("items").alias("items"), "verdict").groupBy("items").agg(F.count("*").alias("n"), F.count("verdict").alias("k"))
    seen = _fits(alike, found.select("tokens", "rarest").distinct(), ["n", "k"]).groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    heard = run.keep(found.join(seen.where(F.col("k") > told * F.col("n")).select("tokens"), "tokens"), "heard")
    larger = heard.select(F.col("tokens").alias("items"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    beaten = _fits(larger, heard, ["v", "c"]).where((F.size("tokens") < F.size("items")) & (F.col("verdict") == F.col("v")) & (F.col("confidence") >= F.col("c")))
    kept = heard.join(beaten.select(F.col("items").alias("tokens"), "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.size("tokens"), "tokens", "verdict"))
    return run.keep(kept.select((rank - 1).alias("rule_id"), "tokens", "verdict", "confidence", "support", "rarest"), "kept")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(u, verdict, rule_id) of urls (u, items) that a mined rule holds for."""
    rank = F.struct("confidence", "support", F.size("tokens").alias("n"), (F.col("verdict") == "block").alias("b"), "rule_id")
    return _fits(urls, rules, ["u"]).groupBy("u").agg(F.max_by(F.struct("verdict", "rule_id"), rank).alias("x")).select("u", "x.*")


def judge(spark: SparkSession, pages: DataFrame, rules: tuple[HostRule, ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "page_id") -> DataFrame:
    """id_col, host, path, rule, verdict, mined (rule_id of the mined rule that decided, or null); distinct URLs are
    matched once."""
    url = F.col("url")
    base = pages.select(id_col, "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("l", listed(F.col("host"), F.col("path"), rules))
    run = Scratch(spark, "urls")
    sets = run.keep(base.where("host <> ''").select("url", tokens(url).alias("items"), F.col("l.verdict").alias("verdict")), "sets")
    if sets.isEmpty():
        return base.select(id_col, "host", "path", F.col("l.rule").alias("rule"), F.coalesce("l.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("int").alias("mined"))
    mined = mine(spark, sets, support, confidence)
    open_ = sets.where("verdict IS NULL").select(F.col("url").alias("u"), "items").distinct()
    out = base.join(match(open_, mined).withColumnRenamed("verdict", "m"), F.col("url") == F.col("u"), "left")
    free = F.col("l").isNull()
    return out.select(id_col, "host", "path", F.col("l.rule").alias("rule"), F.coalesce("l.verdict", "m", F.lit("allow")).alias("verdict"), F.when(free, F.col("rule_id")).alias("mined"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages").select("page_id", "url"))
