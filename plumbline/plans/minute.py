"""Queries over intraday bars, and the same results as SQL. The harness has few bars a day, so least counts are
small here; the functions' defaults are those of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import factors_minute as fm
from ..functions.scalar import round6
from ..operators import bars as B
from ..operators import pit
from ..sources import harness
from ..sources.harness import oracle
from .daily import R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CUT = 14 * 60 + 50


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def visible(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    return pit.visible_bars(harness.bars(spark, sf, 60 if wide else 15, wide), CUT)


VIS = "SELECT * FROM {t} WHERE available_time <= trade_date + INTERVAL 890 MINUTE"
V = {"v": VIS.format(t="bars")}
VW = {"v": VIS.format(t="wide")}
D = "(PARTITION BY symbol, trade_date ORDER BY bar_end)"


def out(df: DataFrame) -> DataFrame:
    return df.select("trade_date", "symbol", round6(F.col("value")).alias("value"))


@query("bars_15m", oracle(f"SELECT trade_date, symbol, slot, bar_end, {R('open', 'open')}, {R('high', 'high')}, {R('low', 'low')}, {R('close', 'close')}, volume, amount FROM bars", "bars"))
def bars_15m(spark: SparkSession, sf: str) -> DataFrame:
    b = harness.bars(spark, sf)
    return b.select("trade_date", "symbol", "slot", "bar_end", *[round6(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume", "amount")


@query("bars_resample", oracle(f"""SELECT trade_date, symbol, max(bar_end) AS bar_end, max(available_time) AS available_time, {R('first(open ORDER BY bar_end)', 'open')}, {R('max(high)', 'high')}, {R('min(low)', 'low')}, {R('last(close ORDER BY bar_end)', 'close')}, sum(volume) AS volume, {R('sum(amount)', 'amount')}, epoch_us(max(bar_end)) = e * 1000000 AS complete
  FROM (SELECT *, CAST(ceil(epoch_us(bar_end) / 1e6 / 3600) AS BIGINT) * 3600 AS e FROM bars) GROUP BY trade_date, symbol, e""", "bars"))
def bars_resample(spark: SparkSession, sf: str) -> DataFrame:
    b = B.resample(harness.bars(spark, sf), 60)
    return b.select("trade_date", "symbol", "bar_end", "available_time", *[round6(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume", round6(F.col("amount")).alias("amount"), "complete")


@query("asof_daily_features", oracle(f"""SELECT trade_date, symbol, {R('last(close ORDER BY bar_end) / first(open ORDER BY bar_end) - 1', 'ret')}, CASE WHEN count(*) >= 2 AND min(close) > 0 THEN {R('sqrt(sum(g * g))')} END AS realized_vol, CASE WHEN sum(volume) > 0 THEN {R('sum(amount) / sum(volume)')} END AS vwap,
  {R('last(close ORDER BY bar_end) / (max(struct_pack(a := bar_end, c := close)) FILTER (bar_end <= l - INTERVAL 30 MINUTE)).c - 1', 'last_ret')} FROM (SELECT *, ln(close / lag(close) OVER {D}) AS g, max(bar_end) OVER (PARTITION BY symbol, trade_date) AS l FROM v) GROUP BY trade_date, symbol""", "bars", **V))
def asof_daily_features(spark: SparkSession, sf: str) -> DataFrame:
    f = B.asof_features(visible(spark, sf))
    return f.select("trade_date", "symbol", *[round6(F.col(c)).alias(c) for c in ("ret", "realized_vol", "vwap", "last_ret")])


CLS = f"""SELECT *, er AND coalesce(epoch_us(bar_end) - lag(epoch_us(bar_end)) OVER w = {{us}} AND lag(mi) OVER w, false) AND coalesce(lead(epoch_us(bar_end)) OVER w - epoch_us(bar_end) = {{us}} AND lead(mi) OVER w, false) AS pk FROM
  (SELECT *, cl AND coalesce(volume > m + 1.0 * s, false) AS er, cl AND NOT coalesce(volume > m + 1.0 * s, false) AS mi FROM (SELECT *, n >= 5 AND s IS NOT NULL AND volume IS NOT NULL AS cl FROM
  (SELECT *, count(volume) OVER b AS n, avg(volume) OVER b AS m, stddev_samp(volume) OVER b AS s FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY trade_date) AS k FROM v) WINDOW b AS (PARTITION BY symbol, slot ORDER BY k RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)))) WINDOW w AS {D}"""
CL = {"cls": CLS.format(us=900_000_000)}
CLW = {"cls": CLS.format(us=3_600_000_000)}
FITS = {"bar_seconds": 900, "least": 5}


@query("bar_taxonomy_counts", oracle("SELECT trade_date, symbol, count(*) FILTER (cl) AS n_class, count(*) FILTER (mi) AS n_mild, count(*) FILTER (pk) AS n_peak, count(*) FILTER (er AND NOT pk) AS n_ridge FROM cls GROUP BY trade_date, symbol", "bars", **V, **CL))
def bar_taxonomy_counts(spark: SparkSession, sf: str) -> DataFrame:
    b = B.classify(visible(spark, sf), 900, 10, 5)
    n = lambda c: F.count(F.when(F.col(c), 1))
    return b.groupBy("trade_date", "symbol").agg(n("classifiable").alias("n_class"), n("mild").alias("n_mild"), n("peak").alias("n_peak"), n("ridge").alias("n_ridge"))


DAYS = f"""SELECT symbol, trade_date, count(*) FILTER (cl) AS n_class, count(*) FILTER (pk) AS n_peak, count(*) FILTER (mi AND ok) AS k_valley, sum(amount) FILTER (mi AND ok) AS a_valley, sum(volume) FILTER (mi AND ok) AS v_valley,
  count(*) FILTER (rg AND ok) AS k_ridge, sum(amount) FILTER (rg AND ok) AS a_ridge, sum(volume) FILTER (rg AND ok) AS v_ridge, count(*) FILTER (pk AND ok) AS k_peak, sum(amount) FILTER (pk AND ok) AS a_peak, sum(amount) FILTER (ok) AS a_day, sum(volume) FILTER (ok) AS v_day,
  sum(p) FILTER (rg) AS r_ridge, count(p) FILTER (rg) AS k_rr, max(high) AS hi, min(low) AS lo, last(close ORDER BY bar_end) AS last_close FROM (SELECT *, er AND NOT pk AS rg, volume > 0 AND amount > 0 AS ok, close / lag(close) OVER {D} - 1 AS p FROM cls) GROUP BY symbol, trade_date"""


def rolled(value: str, valid: str, n: int = 10, least: int = 3, src: str = "days", name: str = "value") -> str:
    return f"SELECT symbol, trade_date, CASE WHEN count(*) OVER f >= {least} THEN {value} END AS {name} FROM {src} WHERE {valid} WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def day_query(name: str, build, value: str, valid: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return out(build(fm.class_days(visible(spark, sf), 900, 10, 5)))

    QUERIES[name] = run
    ORACLE[name] = oracle(f"SELECT symbol, trade_date, {R('value', 'value')} FROM r", "bars", **V, **CL, days=DAYS, r=rolled(value, valid))


S = {"window": 10, "least_days": 3}
day_query("volume_peak_count", lambda d: fm.volume_peak_count(d, classifiable=5, **S), "CAST(sum(n_peak) OVER f AS DOUBLE)", "n_class >= 5")
day_query("valley_relative_vwap", lambda d: fm.valley_relative_vwap(d, valley=4, **S), "avg((a_valley / v_valley) / (a_day / v_day)) OVER f", "k_valley >= 4")
day_query("valley_ridge_vwap_ratio", lambda d: fm.valley_ridge_vwap_ratio(d, valley=3, ridge=1, **S), "avg((a_valley / v_valley) / (a_ridge / v_ridge)) OVER f", "k_valley >= 3 AND k_ridge >= 1")
day_query("ridge_minute_return", lambda d: fm.ridge_minute_return(d, ridge=1, **S), "sum(r_ridge) OVER f", "k_rr >= 1")
day_query("peak_ridge_amount_ratio", lambda d: fm.peak_ridge_amount_ratio(d, peak=1, ridge=1, window=10, least_days=1), "sum(a_peak) OVER f / sum(a_ridge) OVER f", "k_peak >= 1 AND k_ridge >= 1")
ORACLE["peak_ridge_amount_ratio"] = ORACLE["peak_ridge_amount_ratio"].replace("OVER f >= 3", "OVER f >= 1")


@query("valley_price_quantile", oracle(f"SELECT symbol, trade_date, CASE WHEN count(*) OVER d >= 5 AND var_samp(x) OVER d > 0 THEN {R('y - avg(y) OVER d - covar_samp(y, x) OVER d / var_samp(x) OVER d * (x - avg(x) OVER d)')} END AS value FROM j WINDOW d AS (PARTITION BY trade_date)", "wide", **VW, **CLW, days=DAYS,
    q="SELECT *, (a_valley / v_valley - least(lo, coalesce(c, lo))) / (greatest(hi, coalesce(c, hi)) - least(lo, coalesce(c, lo))) AS q FROM (SELECT *, lag(last_close) OVER (PARTITION BY symbol ORDER BY trade_date) AS c FROM days)",
    r=rolled("avg(q) OVER f", "k_valley >= 2 AND q IS NOT NULL", 5, 2, "q"), rev="SELECT symbol, trade_date, -(last_close / lag(last_close, 2) OVER (PARTITION BY symbol ORDER BY trade_date) - 1) AS x FROM days",
    j="SELECT r.symbol, r.trade_date, value AS y, x FROM r JOIN rev USING (symbol, trade_date) WHERE value IS NOT NULL AND x IS NOT NULL"))
def valley_price_quantile(spark: SparkSession, sf: str) -> DataFrame:
    days = fm.class_days(visible(spark, sf, True), 3600, 10, 5)
    w = Window.partitionBy("symbol").orderBy("trade_date")
    rev = days.select("symbol", "trade_date", (-(F.try_divide("last_close", F.lag("last_close", 2).over(w)) - 1)).alias("reversal"))
    return out(fm.valley_price_quantile(days, rev, window=5, valley=2, least_days=2, least_names=5))


@query("peak_interval_kurtosis", oracle(f"SELECT symbol, trade_date, CASE WHEN days >= 3 AND n >= 4 AND m2 > 1e-12 THEN {R('(n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6)')} END AS value FROM m", "bars", **V, cls=CL["cls"].replace("1.0 * s", "0.1 * s"),
    g=f"SELECT symbol, trade_date, cl, CASE WHEN pk THEN i - last_value(CASE WHEN pk THEN i END IGNORE NULLS) OVER (PARTITION BY symbol, trade_date ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS x FROM (SELECT *, row_number() OVER {D} AS i FROM cls)",
    d="SELECT symbol, trade_date, count(x) AS k, coalesce(sum(x), 0)::DOUBLE AS s1, coalesce(sum(x * x), 0)::DOUBLE AS s2, coalesce(sum(x * x * x), 0)::DOUBLE AS s3, coalesce(sum(x * x * x * x), 0)::DOUBLE AS s4 FROM g GROUP BY symbol, trade_date HAVING count(*) FILTER (cl) >= 5",
    s="SELECT symbol, trade_date, count(*) OVER f AS days, (sum(k) OVER f)::DOUBLE AS n, sum(s1) OVER f AS s1, sum(s2) OVER f AS s2, sum(s3) OVER f AS s3, sum(s4) OVER f AS s4 FROM d WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    m="SELECT *, s2 / nullif(n, 0) - (s1 / nullif(n, 0)) ** 2 AS m2, s4 / nullif(n, 0) - 4 * s1 / nullif(n, 0) * s3 / nullif(n, 0) + 6 * (s1 / nullif(n, 0)) ** 2 * s2 / nullif(n, 0) - 3 * (s1 / nullif(n, 0)) ** 4 AS m4 FROM s"))
def peak_interval_kurtosis(spark: SparkSession, sf: str) -> DataFrame:
    return out(fm.peak_interval_kurtosis(visible(spark, sf), 20, 900, 10, 5, classifiable=5, least_days=3, least_gaps=4, k=0.1))


@query("jump_amount_corr", oracle(f"SELECT symbol, trade_date, CASE WHEN n >= 5 AND sx > 0 AND sy > 0 THEN {R('greatest(-1, least(1, (n * xy - x * y) / sqrt(sx * sy)))')} END AS value FROM (SELECT *, n * xx - x * x AS sx, n * yy - y * y AS sy FROM r)", "bars", **V,
    p=f"SELECT *, lead(amount) OVER {D} AS nx, lead(epoch_us(bar_end)) OVER {D} - epoch_us(bar_end) AS gap, (amp - avg(amp) OVER (PARTITION BY symbol, trade_date)) / nullif(stddev_samp(amp) OVER (PARTITION BY symbol, trade_date), 0) AS z FROM (SELECT *, high / low - 1 AS amp FROM v WHERE low > 0 AND high >= low)",
    d="SELECT symbol, trade_date, count(*) FILTER (t) AS n, coalesce(sum(amount) FILTER (t), 0) AS x, coalesce(sum(nx) FILTER (t), 0) AS y, coalesce(sum(amount * amount) FILTER (t), 0) AS xx, coalesce(sum(nx * nx) FILTER (t), 0) AS yy, coalesce(sum(amount * nx) FILTER (t), 0) AS xy FROM (SELECT *, coalesce(z > 1 AND gap = 900000000 AND nx IS NOT NULL, false) AS t FROM p) GROUP BY symbol, trade_date",
    r="SELECT symbol, trade_date, " + ", ".join(f"sum({c}) OVER f AS {c}" for c in ("n", "x", "y", "xx", "yy", "xy")) + " FROM d WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def jump_amount_corr(spark: SparkSession, sf: str) -> DataFrame:
    return out(fm.jump_amount_corr(visible(spark, sf), 20, 900, 1.0, 5))


POOL = "SELECT b.*, c.trade_date AS pd FROM b JOIN (SELECT DISTINCT symbol, k, trade_date FROM b) c ON b.symbol = c.symbol AND b.k BETWEEN c.k - {n} AND c.k"
AMP = "SELECT *, high / low - 1 AS amp, dense_rank() OVER (PARTITION BY symbol ORDER BY trade_date) AS k FROM v WHERE low > 0 AND high >= low"


@query("minute_ideal_amp", oracle(f"SELECT symbol, pd AS trade_date, CASE WHEN any_value(n) >= 50 THEN {R('avg(amp) FILTER (h <= floor(n * 0.25)) - avg(amp) FILTER (l <= floor(n * 0.25))')} END AS value FROM (SELECT *, count(*) OVER (PARTITION BY symbol, pd) AS n, row_number() OVER (PARTITION BY symbol, pd ORDER BY close, bar_end) AS l, row_number() OVER (PARTITION BY symbol, pd ORDER BY close DESC, bar_end DESC) AS h FROM p) GROUP BY symbol, pd", "bars", **V, b=AMP, p=POOL.format(n=9)))
def minute_ideal_amp(spark: SparkSession, sf: str) -> DataFrame:
    return out(fm.minute_ideal_amp(visible(spark, sf), 10, 0.25, 50))


@query("amp_marginal_anomaly_vol", oracle(f"SELECT symbol, pd AS trade_date, CASE WHEN count(d) >= 30 AND count(*) FILTER (d > t) >= 3 THEN {R('stddev_samp(r) FILTER (d > t)')} END AS value FROM (SELECT *, avg(d) OVER (PARTITION BY symbol, pd) + stddev_samp(d) OVER (PARTITION BY symbol, pd) AS t FROM p) GROUP BY symbol, pd", "bars", **V, a=AMP,
    b=f"SELECT *, abs(amp - lag(amp) OVER {D}) AS d, close / lag(close) OVER {D} - 1 AS r FROM a", p=POOL.format(n=9)))
def amp_marginal_anomaly_vol(spark: SparkSession, sf: str) -> DataFrame:
    return out(fm.amp_marginal_anomaly_vol(visible(spark, sf), 10, 30, 3))


@query("intraday_amp_cut", oracle(f"SELECT symbol, trade_date, CASE WHEN count(*) OVER d >= 5 THEN {R('((m - avg(m) OVER d) / nullif(stddev_samp(m) OVER d, 0) + (s - avg(s) OVER d) / nullif(stddev_samp(s) OVER d, 0)) / 2')} END AS value FROM st WHERE m IS NOT NULL AND s IS NOT NULL WINDOW d AS (PARTITION BY trade_date)", "wide", **VW,
    b=f"SELECT * FROM (SELECT *, high / low - 1 AS amp, close / lag(close) OVER {D} - 1 AS r FROM v WHERE low > 0 AND high >= low) WHERE r IS NOT NULL",
    c="SELECT *, count(*) OVER (PARTITION BY symbol, trade_date) AS n, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY r, bar_end) AS l, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY r DESC, bar_end DESC) AS h FROM b",
    e="SELECT symbol, trade_date, avg(amp) FILTER (h <= floor(n * 0.2)) - avg(amp) FILTER (l <= floor(n * 0.2)) AS v FROM c WHERE n >= 5 GROUP BY symbol, trade_date",
    st="SELECT symbol, trade_date, CASE WHEN count(v) OVER f >= 3 THEN avg(v) OVER f END AS m, CASE WHEN count(v) OVER f >= 3 THEN stddev_samp(v) OVER f END AS s FROM e WHERE v IS NOT NULL WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def intraday_amp_cut(spark: SparkSession, sf: str) -> DataFrame:
    return out(fm.intraday_amp_cut(visible(spark, sf, True), 10, 0.2, 5, 3, 5))


@query("mmp_ew", oracle(f"""SELECT symbol, trade_date, {R('avg(t)', 'value')} FROM (SELECT symbol, trade_date, CASE WHEN cv >= 5 AND md > 0 AND high + low > 0 THEN (close - (high + low) / 2) / ((high + low) / 2) * sqrt(volume / md) * (abs(close - open) / (high - low + 0.01::DOUBLE)) * ((high - low) / (mr + 0.01::DOUBLE)) END AS t FROM
  (SELECT *, count(volume) OVER p AS cv, quantile_cont(volume, 0.5) OVER p AS md, avg(high - low) OVER p AS mr FROM v WINDOW p AS (PARTITION BY symbol, trade_date ORDER BY bar_end ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))) GROUP BY symbol, trade_date""", "bars", **V))
def mmp_ew(spark: SparkSession, sf: str) -> DataFrame:
    return out(fm.mmp_ew(visible(spark, sf), 5, 0.01))


@query("session_ret", oracle(f"SELECT symbol, trade_date, {R('last(close ORDER BY bar_end) / first(open ORDER BY bar_end) - 1', 'value')} FROM v GROUP BY symbol, trade_date", "bars", **V))
def session_ret(spark: SparkSession, sf: str) -> DataFrame:
    return out(fm.intraday_ret(visible(spark, sf)))


def _exec(spark: SparkSession, sf: str) -> DataFrame:
    b = harness.bars(spark, sf)
    prices = B.execution_price(b, 870, 890)
    panel = b.select("trade_date", "symbol").distinct().withColumn("adj_factor", F.when(F.dayofmonth("trade_date") != 20, 1 + F.dayofmonth("trade_date") / 100.0))
    return B.exec_forward_returns(panel, prices, 1)


PRICE = "SELECT trade_date, symbol, amount, CASE WHEN volume > 0 AND amount / volume > 0 THEN amount / volume END AS price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY bar_end) AS i FROM bars WHERE slot BETWEEN 870 AND 890) WHERE i = 1"
EXEC = """SELECT *, lead(status) OVER w AS exit_status, lead(adjusted) OVER w / adjusted - 1 AS fwd FROM (SELECT *, CASE WHEN status = 'ok' THEN price * adj END AS adjusted FROM (SELECT d.trade_date, d.symbol, adj, price, amount,
  CASE WHEN p.symbol IS NULL THEN 'no_bar' WHEN price IS NULL THEN 'bad_vwap' WHEN adj IS NULL THEN 'bad_adj_factor' ELSE 'ok' END AS status FROM (SELECT DISTINCT trade_date, symbol, CASE WHEN day(trade_date) <> 20 THEN 1 + day(trade_date) / 100.0::DOUBLE END AS adj FROM bars) d LEFT JOIN price p ON d.trade_date = p.trade_date AND d.symbol = p.symbol)) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)"""


@query("exec_price_status", oracle("SELECT status, count(*) AS n FROM x GROUP BY status", "bars", price=PRICE, x=EXEC))
def exec_price_status(spark: SparkSession, sf: str) -> DataFrame:
    return _exec(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("exec_forward_returns", oracle(f"SELECT trade_date, symbol, status, {R('fwd', 'fwd')} FROM x", "bars", price=PRICE, x=EXEC))
def exec_forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    return _exec(spark, sf).select("trade_date", "symbol", "status", round6(F.col("fwd")).alias("fwd"))


@query("coverage_loss", oracle("SELECT CASE WHEN status <> 'ok' THEN status ELSE exit_status END AS cause, count(*) AS n FROM x WHERE exit_status IS NOT NULL GROUP BY 1", "bars", price=PRICE, x=EXEC))
def coverage_loss(spark: SparkSession, sf: str) -> DataFrame:
    return B.coverage_loss(_exec(spark, sf))


@query("liquidity_capacity", oracle(f"SELECT direction, count(*) AS n, {R('min(r)', 'least')}, {R('quantile_cont(r, 0.1)', 'p10')}, {R('quantile_cont(r, 0.5)', 'median')}, {R('quantile_cont(r, 0.9)', 'p90')} FROM (SELECT CASE WHEN d > 0 THEN 'buy' WHEN d < 0 THEN 'sell' ELSE 'hold' END AS direction, CASE WHEN abs(d) > 0 THEN coalesce(amount, 0) * 0.1::DOUBLE / (abs(d) * 10000.0::DOUBLE) END AS r FROM (SELECT *, (day(trade_date) % 3 - 1) * 0.2::DOUBLE AS d FROM x)) GROUP BY direction", "bars", price=PRICE, x=EXEC))
def liquidity_capacity(spark: SparkSession, sf: str) -> DataFrame:
    t = B.liquidity(_exec(spark, sf).withColumn("delta", (F.dayofmonth("trade_date") % 3 - 1) * 0.2), 10000.0)
    q = F.percentile("ratio", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    s = t.groupBy("direction").agg(F.count("*").alias("n"), F.min("ratio").alias("least"), q.alias("q"))
    return s.select("direction", "n", round6(F.col("least")).alias("least"), *[round6(F.col("q")[i]).alias(c) for i, c in enumerate(("p10", "median", "p90"))])


# the factors with the least counts of production, over whole sessions of one-minute bars


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return pit.visible_bars(harness.dense_bars(spark, sf), CUT)


PCLS = CLS.format(us=60_000_000).replace("n >= 5", "n >= 10").replace("BETWEEN 10 PRECEDING", "BETWEEN 20 PRECEDING")
PV = {"v": VIS.format(t="dense"), "cls": PCLS, "days": DAYS}


def production(name: str, build, *swaps: tuple[str, str]) -> None:
    """A query of the factor with its defaults; its SQL is that of the query above with other counts and bars."""
    sql = ORACLE[name]
    for t in ("bars", "wide"):
        sql = sql.replace(harness.CTES[t], harness.CTES["dense"])
    for old, new in swaps:
        if old not in sql:
            raise ValueError(f"{name}: the SQL lacks {old!r}")
        sql = sql.replace(old, new)
    QUERIES[f"{name}_1min"] = lambda spark, sf: out(build(dense(spark, sf)))
    ORACLE[f"{name}_1min"] = sql


for _name, _f, _value, _valid in (
    ("volume_peak_count", fm.volume_peak_count, "CAST(sum(n_peak) OVER f AS DOUBLE)", "n_class >= 100"),
    ("valley_relative_vwap", fm.valley_relative_vwap, "avg((a_valley / v_valley) / (a_day / v_day)) OVER f", "k_valley >= 20"),
    ("valley_ridge_vwap_ratio", fm.valley_ridge_vwap_ratio, "avg((a_valley / v_valley) / (a_ridge / v_ridge)) OVER f", "k_valley >= 20 AND k_ridge >= 10"),
    ("ridge_minute_return", fm.ridge_minute_return, "sum(r_ridge) OVER f", "k_rr >= 10"),
    ("peak_ridge_amount_ratio", fm.peak_ridge_amount_ratio, "sum(a_peak) OVER f / sum(a_ridge) OVER f", "k_peak >= 5 AND k_ridge >= 10"),
):
    QUERIES[f"{_name}_1min"] = lambda spark, sf, f=_f: out(f(fm.class_days(dense(spark, sf))))
    ORACLE[f"{_name}_1min"] = oracle(f"SELECT symbol, trade_date, {R('value', 'value')} FROM r", "dense", **PV, r=rolled(_value, _valid, 20, 10))

_CLASSES = (("= 900000000", "= 60000000"), ("n >= 5 AND s", "n >= 10 AND s"), ("BETWEEN 10 PRECEDING", "BETWEEN 20 PRECEDING"))
production("jump_amount_corr", fm.jump_amount_corr, ("n >= 5 AND sx", "n >= 10 AND sx"), ("gap = 900000000", "gap = 60000000"))
production("minute_ideal_amp", fm.minute_ideal_amp, (">= 50 THEN", ">= 1150 THEN"))
production("amp_marginal_anomaly_vol", fm.amp_marginal_anomaly_vol, (">= 30 AND", ">= 460 AND"), (">= 3 THEN", ">= 20 THEN"), ("c.k - 9 AND", "c.k - 19 AND"))
production("intraday_amp_cut", fm.intraday_amp_cut, ("OVER d >= 5", "OVER d >= 10"), ("n >= 5 GROUP", "n >= 100 GROUP"), ("OVER f >= 3", "OVER f >= 6"))
production("mmp_ew", fm.mmp_ew, ("cv >= 5", "cv >= 20"), ("BETWEEN 5 PRECEDING", "BETWEEN 20 PRECEDING"), ("0.01::DOUBLE", "1e-12::DOUBLE"))
production("session_ret", fm.intraday_ret)
production("peak_interval_kurtosis", fm.peak_interval_kurtosis, *_CLASSES, ("0.1 * s", "1.0 * s"), ("FILTER (cl) >= 5", "FILTER (cl) >= 100"), ("days >= 3 AND n >= 4", "days >= 10 AND n >= 20"))


def _quantile_1min(bars: DataFrame) -> DataFrame:
    days = fm.class_days(bars)
    w = Window.partitionBy("symbol").orderBy("trade_date")
    return fm.valley_price_quantile(days, days.select("symbol", "trade_date", (-(F.try_divide("last_close", F.lag("last_close", 20).over(w)) - 1)).alias("reversal")))


production("valley_price_quantile", _quantile_1min, ("= 3600000000", "= 60000000"), *_CLASSES[1:], ("k_valley >= 2", "k_valley >= 20"), ("BETWEEN 4 PRECEDING", "BETWEEN 19 PRECEDING"), ("OVER f >= 2", "OVER f >= 10"), ("OVER d >= 5", "OVER d >= 10"), ("lag(last_close, 2)", "lag(last_close, 20)"))
