"""Native operators run no Python on executors; no plan has a cross join; broadcasts are of counted tables."""

from __future__ import annotations

import re

import pytest

from plumbline.llm import chat_format, decontaminate, line_templates, secret_ledger


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [secret_ledger.op1_secret_ledger, line_templates.op2_line_templates, chat_format.op4_chat_format, decontaminate.op6_decontaminate], ids=lambda f: f.__name__)
def test_native(spark, sf, query):
    text = plan(query(spark, sf))
    assert not re.search("Python|Pandas|Arrow", text)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)


def test_native_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    its = decontaminate.items(bench)
    pre = decontaminate.prefixes(its, docs)
    for df in (secret_ledger.scan(secret_ledger.unseen_blobs(docs, None)), line_templates.recurring(line_templates.parse(docs)), pre, decontaminate.placements(docs, pre)):
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan(df))


def test_small_tables_only_are_broadcast(spark, monkeypatch):
    from plumbline.llm import shared

    df = spark.range(50)
    assert "broadcast" in shared.small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in shared.small(df, 49)._jdf.queryExecution().logical().toString().lower()
