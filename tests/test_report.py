from __future__ import annotations

import datetime as dt

from plumbline.operators import evaluation as ev

D = [dt.date(2020, 1, d) for d in (1, 8, 15, 22)]


def test_report_splits_by_the_date_of_realisation(spark):
    sign = {D[0]: 1, D[1]: -1, D[2]: -1, D[3]: -1}
    rows = [(d, f"s{i}", float(i), float(s * i), dt.date(2020, 1, 20)) for d, s in sign.items() for i in range(12)]
    df = spark.createDataFrame(rows, "date date, symbol string, f double, fwd double, realized_date date")
    # the return of the 8th is realised on the 15th, behind the split
    oos = ev.evaluate(df.drop("realized_date"), "f", 1, split="2020-01-10", capacity={"adv": 1})
    assert oos["oos_generalization"] == {"train": 1.0, "test": -1.0} and oos["inputs"]["oos_sign_ok"] is False
    assert oos["execution_capacity"] == {"adv": 1}
    assert ev.evaluate(df, "f", 1, split="2020-01-10")["oos_generalization"]["train"] is None
