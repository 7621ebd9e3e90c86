from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import functions as F

from plumbline.llm import secret_ledger as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text or "") if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m.group()) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


TEXTS = [
    None, "", "no secrets", "é😀 password=abcdef1", "PASSWORD: 'token=abcdef' api_key = abc", 'token" : "abcde" : abcdefgh', "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 15,
    "0" * 23 + "g" + "f" * 24, "secret=" + "ab" * 20, ("token=abcdef123 " * 3000), "apikey=abcdef\npasswd:=abcdefg", "password=abcdef1", "a" * 300_000,
]


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumn("blob_id", F.lit("clash")).withColumn("hits", F.lit(1)) if extra else df


def found(spark, df, path):
    out = S.join_back(df, S.update(spark, df, path))
    spans = F.array_join(F.transform("hits", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return {r[0]: r[1] for r in out.select("doc_id", spans).collect()}


def test_matches_brute_force_with_clashing_columns(spark, tmp_path):
    got = found(spark, docs(spark, TEXTS, True), f"file://{tmp_path}/a")
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    first, second = docs(spark, TEXTS[:6]), docs(spark, TEXTS)
    found(spark, first, path)
    ledger = spark.read.parquet(f"{path}/scanned")
    left = S.unseen_blobs(second, ledger).collect()
    seen = {t or "" for t in TEXTS[:6]}
    assert {r["text"] for r in left} == {t or "" for t in TEXTS} - seen
    newer = (S.Rule("assign", S.ASSIGN, version="2", group=2, least=6), *S.RULES[1:])
    again = {r["text"]: r["todo"] for r in S.unseen_blobs(first, ledger, newer).collect()}
    assert again == {t: ["assign@2"] for t in seen}
    assert found(spark, second, path) == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert spark.read.parquet(f"{path}/scanned").count() == len({t or "" for t in TEXTS})


def test_copies_share_findings_and_repeated_rows_stay(spark, tmp_path):
    df = docs(spark, ["token=abcdef"] * 50).unionByName(docs(spark, ["token=abcdef"]))
    out = S.join_back(df, S.update(spark, df, f"file://{tmp_path}/c")).collect()
    assert len(out) == 51 and all(len(r["hits"]) == 1 for r in out)


def test_empty_table(spark, tmp_path):
    assert found(spark, docs(spark, TEXTS).limit(0), f"file://{tmp_path}/e") == {}


def test_digest_columns(spark, sf):
    rows = S.op1_secret_ledger(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["spans"] == brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
