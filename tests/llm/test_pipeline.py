"""run() against the stages written out: DuckDB for line dedup, near-duplicates and decontamination, the library for
ids, and the fitted scorer called outside Spark."""

from __future__ import annotations

import hashlib

import duckdb
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline as C
from plumbline.llm import bpe, decontaminate, line_templates, quality_model, shingle_forest


def test_equals_the_stages_by_other_means(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:] for r in C.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_model.fit(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score(quality_model.features(r["text"] or "")[0]) >= quality_model.THRESHOLD]
    assert 0 < len(rows) < docs.count()
    con = duckdb.connect()
    con.register("kept", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.execute(f"CREATE TABLE lines AS WITH {line_templates.rows_sql('kept')} SELECT doc_id, text FROM deduped WHERE n_dropped = 0 OR regexp_matches(text, '\\S')")
    con.execute(f"CREATE TABLE one AS WITH RECURSIVE {shingle_forest.rows_sql('lines')} SELECT * FROM lines WHERE doc_id IN (SELECT doc_id FROM near WHERE doc_id = class_id)")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    con.execute("ALTER TABLE one RENAME TO documents")
    clean = con.execute(f"SELECT documents.doc_id, text FROM documents JOIN ({decontaminate.ORACLE}) r USING (doc_id) WHERE NOT contaminated").fetchall()
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    want = {}
    for d, text in clean:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_stages_keep_the_columns_and_take_nulls_and_empty_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, k1 int"
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, "some words that are fine and clean here", "en", "s", 39, 1), (3, "some words that are fine and clean here", "en", "s", 39, 1), (4, "x y z " * 2000, "en", "s", 12_000, 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in C.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), "doc_id long, text string, lang string, source string, n_chars long")
            assert docs.columns == list(C.COLUMNS)
        C.tokens(spark, docs, sf).collect()


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    kept = {r["doc_id"] for r in C.quality(spark, docs, sf).collect()}
    assert len(labels & kept) >= 0.97 * len(labels)
