from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import pipeline as P
from plumbline.sources.stores import demo_panel

#: Published results of the demo study; fixed values.
ANCHOR = {
    "ic_mean_momentum_20": 0.9600438863169586, "ic_ir_momentum_20": 7.617904227971471, "annual_return": 0.8407986461861146, "sharpe": 10.304260918159038,
    "volatility": 0.060904296602865324, "max_drawdown": 0.0, "avg_turnover": 0.2121212121212121, "cost_drag": 0.002333333333333333,
}


@pytest.fixture(scope="module")
def demo(spark):
    return demo_panel(spark)


def test_demo_anchor(demo):
    r = P.run_study(demo)
    for k, v in ANCHOR.items():
        assert r.summary[k] == pytest.approx(v, rel=1e-9, abs=1e-12), k
    assert json.loads(r.to_json())["config"]["top_n"] == 3 and "annual_return" in r.to_markdown()


def test_ic_weighted_study_runs(demo):
    r = P.run_study(demo, P.StudyConfig(factors=("momentum_20", "volatility_20"), alpha="ic_weight"))
    assert r.summary["n_rebalances"] == 11


def test_config_is_strict():
    with pytest.raises(ValueError):
        P.StudyConfig.load({"top": 3})
    with pytest.raises(ValueError):
        P.StudyConfig(top_n=0)
    assert P.StudyConfig.load({"factors": ["momentum_5"]}).factors == ("momentum_5",)


def test_feasibility_by_raw_limits(spark):
    df = spark.createDataFrame([(10.0, 10.0, 8.0), (8.0, 10.0, 8.0), (9.0, 10.0, 8.0), (None, 10.0, 8.0), (9.0, None, None)], "p double, u double, d double")
    buy, sell = P.execution_feasibility(F.col("p"), F.col("u"), F.col("d"))
    assert [tuple(r) for r in df.select(buy, sell).collect()] == [(False, True), (True, False), (True, True), (False, False), (True, True)]


def test_straddling_holdings_are_in_neither_part(spark):
    df = spark.createDataFrame([("2024-01-31", "2024-02-29"), ("2024-02-29", "2024-03-29"), ("2024-03-29", "2024-04-30")], "entry string, exit string").select(F.to_date("entry").alias("entry"), F.to_date("exit").alias("exit"))
    assert [r["part"] for r in P.split_holdings(df, "2024-03-15").orderBy("entry").collect()] == ["train", None, "test"]


def test_matrix_verdict():
    assert [P.matrix_verdict(c) for c in ([True, True], [True, False], [False, False, True], [None, None, True], [False, None], [])] == ["SUPPORTED", "PARTIAL", "PARTIAL", "PARTIAL", "NOT SUPPORTED", "NO-HYPOTHESES"]
    assert P.matrix_verdict([True], settled=11) == "INSUFFICIENT-DATA" and P.matrix_verdict([True], settled=12) == "SUPPORTED"
    assert [P.hypothesis_holds(*h) for h in ((1, 0.1, 0.2), (1, 0.1, -0.2), (-1, -0.1, -0.2), (1, 0.0, 0.2), (1, None, 0.2), (1, 0.1, float("nan")))] == [True, False, True, False, False, False]
