"""Every library query against its SQL on the smallest tables, and the entry point without the corpus operators."""

from __future__ import annotations

import math
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import checks, daily, evaluation, minute, studies

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (daily, evaluation, minute, checks, studies)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v if v is None or isinstance(v, (bool, str)) else float(v) if hasattr(v, "as_tuple") else str(v)[:26]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    out = con.execute(SQL[name])
    cols = [d[0] for d in out.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    at = [cols.index(c) for c in order]
    want = sorted(repr([norm(r[i]) for i in at]) for r in out.fetchall())
    assert sorted(repr([norm(r[c]) for c in order]) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("plumbline.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {sys.path[0]!r})
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") and q[2].isdigit()] and "momentum_topn" in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True)
