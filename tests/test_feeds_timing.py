"""When rows of an endpoint may be read."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.sources import feeds


def test_every_endpoint_has_its_timing():
    assert set(feeds.TIMING) == set(feeds.ENDPOINTS)
    for name, (raw, _) in feeds.TIMING.items():
        assert raw in {r for _, r, _ in feeds.ENDPOINTS[name].columns.values()}, name


def test_days_end_before_they_are_read(spark):
    rows = [(dt.date(2024, 1, k) if k else None, dt.date(2024, 1, 2)) for k in (1, 2, 3, 0)]
    df = spark.createDataFrame(rows, "dated date, decided date")
    read = lambda name, **k: [r[0] for r in df.select(feeds.known_at(name, F.col("dated"), F.col("decided"), **k)).collect()]
    assert read("market_daily") == [True, False, False, False] and read("market_daily", after_close=True) == [True, True, False, False]
    assert read("daily_basic") == read("fina_indicator") == read("index_weight") == [True, True, False, False]
    with pytest.raises(ValueError, match="minute"):
        read("stk_mins_1min")
    with pytest.raises(KeyError):
        read("nothing")
