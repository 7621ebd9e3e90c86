from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.llm import url_rules as U


def plain(url):
    """(host, path, rule, verdict or None), written out."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


URLS = [None, "", "no scheme", "http://a.COM/x", "http://example.com/en/1", "https://www.example.com/en/2?x#y", "http://m.example.com/en/", "http://notexample.com/en/", "http://x.net/es/a", "http://x.net/fr", "http://x.net", "http://com", "a://b://c.com/d", "http://É.com/é\n/x", "http://h.org/EN/1?k=v&w=2#f", "http://x.com?u=/y", "http://x.com#a/b"]


def test_hosts_paths_and_listed_rules(spark):
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, items int")
    for r in U.judge(spark, df).collect():
        host, path, rule, verdict = plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
        assert verdict is None or r["verdict"] == verdict


def test_mined_rules_generalise_where_nearly_all_is_labelled(spark):
    urls = [f"http://s{i % 7}.example.com/en/{i}?ad=1" for i in range(60)] + [f"http://s.good.org/en/{i}" for i in range(60)] + ["http://other.org/x?ad=1"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r["page_id"]: r for r in U.judge(spark, df).collect()}
    assert out[0]["verdict"] == "block" and out[0]["mined"] is None
    assert out[61]["verdict"] == "allow" and out[61]["mined"] is None
    assert out[120]["verdict"] == "block" and out[120]["mined"] is not None


def test_index_finds_what_subset_tests_find(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sets = pages.select(F.col("url").alias("u"), U.tokens(F.col("url")).alias("items"), U.listed(U.host_of(F.col("url")), U.path_of(F.col("url")))["verdict"].alias("verdict"))
    rules = U.mine(spark, sets, 0.02, 0.9)
    kept = rules.collect()
    got = {r["u"]: r["rule_id"] for r in U.match(sets.select("u", "items"), rules).collect()}
    for r in sets.collect():
        fits = [k for k in kept if set(k["tokens"]) <= set(r["items"])]
        best = max(fits, key=lambda k: (k["confidence"], k["support"], len(k["tokens"]), k["verdict"] == "block", k["rule_id"]), default=None)
        assert got.get(r["u"]) == (best["rule_id"] if best else None)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/1"), (1, "http://a.net/es/1")], "page_id long, url string")
    assert [r["verdict"] for r in U.judge(spark, df).collect()] == ["block", "block"]
    assert U.judge(spark, df.limit(0)).count() == 0
    assert [r["verdict"] for r in U.judge(spark, spark.createDataFrame([(1, None)], "page_id long, url string")).collect()] == ["allow"]
