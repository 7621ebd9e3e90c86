"""Queries over the daily panel, and the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import factors_daily as fd  # noqa: F401  registers the factors
from ..functions.registry import compute
from ..functions.scalar import round6
from ..operators import pit, portfolio, xsection
from ..sources import harness
from ..sources.harness import oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def R(x: str, name: str | None = None) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6" + (f" AS {name}" if name else "")


W = "WINDOW s AS (PARTITION BY symbol ORDER BY date)"


def win(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


MOM = "SELECT *, CASE WHEN lag(close, 20) OVER s <> 0 THEN close / lag(close, 20) OVER s - 1 END AS mom FROM panel " + W
Z = "SELECT *, CASE WHEN sd > 0 THEN (mom - m) / sd ELSE mom - m END AS z FROM (SELECT *, avg(mom) OVER (PARTITION BY date) AS m, stddev_pop(mom) OVER (PARTITION BY date) AS sd FROM mom WHERE mom IS NOT NULL)"


@query("momentum_topn", oracle(f"SELECT date, symbol, CAST(rank AS INTEGER) AS rank, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight, {R('z', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY floor(z * 1e6 + 0.5) / 1e6 DESC, symbol) AS rank FROM z) WHERE rank <= 5", "panel", mom=MOM, z=Z))
def momentum_topn(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: 20-day momentum, standardised by date, the five best of each day at equal weight."""
    panel = compute(harness.panel_daily(spark, sf), ["momentum_20"])
    scored = xsection.process(panel, ["momentum_20"]).withColumn("score", round6(F.col("momentum_20")))
    return portfolio.top_n(scored, 5).select("date", "symbol", "rank", "weight", "score")


def _factor(name: str, sql: str, source=lambda p: p):
    short = name.rsplit("_", 1)[0] if name[-1].isdigit() else name

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = compute(source(harness.panel_daily(spark, sf)), [name])
        return out.select("date", "symbol", round6(F.col(name)).alias("value"))

    QUERIES[f"factor_{short}"] = run
    ORACLE[f"factor_{short}"] = sql


_factor("momentum_20", oracle(f"SELECT date, symbol, {R('mom', 'value')} FROM mom", "panel", mom=MOM))
_factor("reversal_20", oracle(f"SELECT date, symbol, {R('-mom', 'value')} FROM mom", "panel", mom=MOM))
RET = "SELECT *, CASE WHEN lag(close) OVER s <> 0 THEN close / lag(close) OVER s - 1 END AS ret FROM panel " + W
_factor("volatility_20", oracle(f"SELECT date, symbol, CASE WHEN count(ret) OVER w >= 20 THEN {R('stddev_samp(ret) OVER w')} END AS value FROM ret WINDOW w AS {win(20)}", "panel", ret=RET))
_factor("liquidity_20", oracle(f"SELECT date, symbol, CASE WHEN count(amount) OVER w >= 20 THEN {R('ln(avg(amount) OVER w)')} END AS value FROM panel WINDOW w AS {win(20)}", "panel"))
_factor("overnight_mom_20", oracle(f"SELECT date, symbol, CASE WHEN count(gap) OVER w >= 20 THEN {R('sum(gap) OVER w')} END AS value FROM gap WINDOW w AS {win(20)}", "panel", gap="SELECT *, CASE WHEN lag(close) OVER s <> 0 AND open / lag(close) OVER s > 0 THEN ln(open / lag(close) OVER s) END AS gap FROM panel " + W))
_factor("value_ep", oracle(f"SELECT date, symbol, CASE WHEN pe > 0 THEN {R('1 / pe')} END AS value FROM cov", "panel", "cov"), harness.covariates)
_factor("value_bp", oracle(f"SELECT date, symbol, CASE WHEN pb > 0 THEN {R('1 / pb')} END AS value FROM cov", "panel", "cov"), harness.covariates)


@query("panel_daily", oracle(f"SELECT date, symbol, {R('open', 'open')}, {R('high', 'high')}, {R('low', 'low')}, {R('close', 'close')}, volume, amount, {R('adj_factor', 'adj_factor')} FROM panel", "panel"))
def panel_daily(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf)
    return p.withColumns({c: round6(F.col(c)) for c in ("open", "high", "low", "close", "adj_factor")})


@query("front_adjusted_close", oracle(f"SELECT date, symbol, {R('close * (adj_factor / last_value(adj_factor) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))', 'close')} FROM panel", "panel"))
def front_adjusted_close(spark: SparkSession, sf: str) -> DataFrame:
    return pit.front_adjust(harness.panel_daily(spark, sf)).select("date", "symbol", round6(F.col("close")).alias("close"))


@query("ex_date_flags", oracle(f"SELECT date, symbol, coalesce(adj_factor <> lag(adj_factor) OVER s, false) AS is_ex FROM panel {W}", "panel"))
def ex_date_flags(spark: SparkSession, sf: str) -> DataFrame:
    return harness.panel_daily(spark, sf).select("date", "symbol", pit.ex_date().alias("is_ex"))


@query("decision_lag", oracle(f"SELECT date, symbol, {R('open', 'open')}, {R('lag(close) OVER s', 'close')}, lag(volume) OVER s AS volume FROM panel {W}", "panel"))
def decision_lag(spark: SparkSession, sf: str) -> DataFrame:
    out = pit.decision_lag(harness.panel_daily(spark, sf))
    return out.select("date", "symbol", round6(F.col("open")).alias("open"), round6(F.col("close")).alias("close"), "volume")


@query("fina_asof", oracle("SELECT p.date, p.symbol, f.value, f.end_date FROM panel p ASOF LEFT JOIN f ON p.symbol = f.symbol AND p.date >= f.ann_date", "panel", "fina", f="SELECT * FROM fina QUALIFY row_number() OVER (PARTITION BY symbol, ann_date ORDER BY end_date DESC) = 1"))
def fina_asof(spark: SparkSession, sf: str) -> DataFrame:
    keys = harness.panel_daily(spark, sf).select("date", "symbol")
    return pit.asof_backward(keys, harness.fina(spark, sf), "symbol", "date", "ann_date", ["end_date", "value"], tie=["end_date"]).select("date", "symbol", "value", "end_date")


@query("membership_asof", oracle("SELECT d.date, s.symbol FROM (SELECT date, max(snap) AS snap FROM (SELECT DISTINCT date FROM panel), (SELECT DISTINCT snap FROM snaps) WHERE snap <= date GROUP BY date) d JOIN snaps s ON d.snap = s.snap", "panel", "snaps"))
def membership_asof(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf)
    return pit.members_asof(p, harness.snapshots(p))


def _spans(spark: SparkSession) -> DataFrame:
    """Industry intervals of every brand: half-open, overlapping, one open at the end."""
    n = spark.range(25).select(F.concat(F.lit("Brand#"), F.col("id") + 1).alias("symbol"), "id")
    day = lambda y, k: F.date_add(F.to_date(F.lit(f"{y}-01-01")), (F.col("id") * k).cast("int"))
    span = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("valid_from"), b.alias("valid_to"))
    open_ = F.lit(None).cast("date")
    rows = F.array(span("L1", open_, day(1997, 3)), span("L2", day(1996, 5), day(1999, 11)), span("L3", day(1999, 7), open_))
    return n.select("symbol", F.inline(rows))


SPANS = "SELECT 'Brand#' || (i + 1) AS symbol, name, a AS valid_from, b AS valid_to FROM (SELECT CAST(i AS INT) AS i FROM range(25) t(i)), LATERAL (SELECT 'L1' AS name, NULL::DATE AS a, DATE '1997-01-01' + i * 3 AS b UNION ALL SELECT 'L2', DATE '1996-01-01' + i * 5, DATE '1999-01-01' + i * 11 UNION ALL SELECT 'L3', DATE '1999-01-01' + i * 7, NULL)"


@query("industry_interval", oracle("SELECT date, symbol, name AS industry FROM (SELECT p.date, p.symbol, name, row_number() OVER (PARTITION BY p.date, p.symbol ORDER BY valid_from DESC NULLS LAST) AS i FROM panel p LEFT JOIN spans s ON p.symbol = s.symbol AND (valid_from IS NULL OR valid_from <= date) AND (valid_to IS NULL OR date < valid_to)) WHERE i = 1", "panel", spans=SPANS))
def industry_interval(spark: SparkSession, sf: str) -> DataFrame:
    keys = harness.panel_daily(spark, sf).select("date", "symbol")
    return pit.interval_join(keys, _spans(spark), ["name"]).withColumnRenamed("name", "industry")


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf)
    w = Window.partitionBy("symbol").orderBy("date")
    prev = p.withColumn("prev", F.lag("close").over(w))
    limits = prev.where("prev IS NOT NULL").select("date", "symbol", (F.col("prev") * 1.1).alias("up_limit"), (F.col("prev") * 0.9).alias("down_limit"))
    st = _spans(spark).where("name = 'L2'").select("symbol", F.lit(True).alias("is_st"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"))
    return pit.tradability(p, p.where("volume < 10").select("date", "symbol"), limits, st)


FLAGS = f"""SELECT p.*, volume >= 10 AS trade_status, EXISTS (SELECT 1 FROM spans s WHERE s.name = 'L2' AND s.symbol = p.symbol AND p.date BETWEEN valid_from AND valid_to) AS is_st,
  coalesce(close >= prev * 1.1::DOUBLE - 1e-6, false) AS limit_up, coalesce(close <= prev * 0.9::DOUBLE + 1e-6, false) AS limit_down FROM (SELECT *, lag(close) OVER s AS prev FROM panel {W}) p"""


@query("tradability_flags", oracle("SELECT date, symbol, trade_status, is_st, limit_up, limit_down FROM flags", "panel", spans=SPANS, flags=FLAGS))
def tradability_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf).select("date", "symbol", "trade_status", "is_st", "limit_up", "limit_down")


@query("tradable_universe", oracle("SELECT date, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM flags WHERE trade_status AND NOT is_st AND NOT limit_up AND NOT limit_down GROUP BY date", "panel", spans=SPANS, flags=FLAGS))
def tradable_universe(spark: SparkSession, sf: str) -> DataFrame:
    return pit.tradable(_flags(spark, sf)).groupBy("date").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"))


@query("tradability_hits", oracle("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT trade_status THEN 'suspended' WHEN is_st THEN 'st' WHEN limit_up OR limit_down THEN 'limit' ELSE 'tradable' END AS reason FROM flags) GROUP BY reason", "panel", spans=SPANS, flags=FLAGS))
def tradability_hits(spark: SparkSession, sf: str) -> DataFrame:
    """How many cells each filter hits, the first one that does counting."""
    why = F.when(~F.col("trade_status"), "suspended").when(F.col("is_st"), "st").when(F.col("limit_up") | F.col("limit_down"), "limit").otherwise("tradable")
    return _flags(spark, sf).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("unserved_keys", oracle("SELECT date, symbol FROM panel WHERE volume < 20", "panel"))
def unserved_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf)
    return pit.unserved(p, p.where("volume >= 20"), ["date", "symbol"])


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    """Covered intervals by customer: from each order's date for its key's days modulo 9."""
    o = harness.read(spark, sf, "orders")
    start = F.to_date("o_orderdate")
    return o.select(F.col("o_custkey").alias("key"), start.alias("start"), F.date_add(start, (F.col("o_orderkey") % 90).cast("int")).alias("end"))


COVERED = "SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS b FROM orders"
ISLES = 'SELECT key, min(a) AS a, max(b) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS n FROM covered)) GROUP BY key, g'


@query("coverage_merge", oracle('SELECT key, a AS start, b AS "end" FROM isles', covered=COVERED, isles=ISLES))
def coverage_merge(spark: SparkSession, sf: str) -> DataFrame:
    return pit.merge_intervals(_covered(spark, sf), ["key"])


@query("coverage_gaps", oracle("""SELECT key, min(d) AS start, max(d) AS "end" FROM (SELECT key, d, d - CAST(row_number() OVER (PARTITION BY key ORDER BY d) AS INT) AS g FROM
  (SELECT key, CAST(unnest(range(DATE '1996-01-01', DATE '1998-01-01', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT key FROM covered)) x WHERE NOT EXISTS (SELECT 1 FROM isles i WHERE i.key = x.key AND x.d BETWEEN i.a AND i.b)) GROUP BY key, g""", covered=COVERED, isles=ISLES))
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    cov = _covered(spark, sf)
    asked = cov.select("key").distinct().select("key", F.to_date(F.lit("1996-01-01")).alias("start"), F.to_date(F.lit("1997-12-31")).alias("end"))
    return pit.subtract_intervals(asked, cov, ["key"])


@query("neutralized_factor", oracle(f"SELECT date, symbol, {R('CASE WHEN n >= 3 AND n > 1 + g THEN dy - CASE WHEN sxx > 1e-18 THEN sxy / sxx ELSE 0 END * dx END', 'value')} FROM c", "panel", "cov",
    mom=MOM.replace("FROM panel", "FROM cov"), b="SELECT date, symbol, mom - avg(mom) OVER i AS dy, ln(market_cap) - avg(ln(market_cap)) OVER i AS dx, industry FROM mom WHERE mom IS NOT NULL WINDOW i AS (PARTITION BY date, industry)",
    g="SELECT date, count(*) AS n, count(DISTINCT industry) AS g, sum(dx * dy) AS sxy, sum(dx * dx) AS sxx FROM b GROUP BY date", c="SELECT b.*, n, g, sxy, sxx FROM b JOIN g USING (date)"))
def neutralized_factor(spark: SparkSession, sf: str) -> DataFrame:
    p = compute(harness.covariates(harness.panel_daily(spark, sf)), ["momentum_20"]).where("momentum_20 IS NOT NULL")
    return xsection.neutralize(p, "momentum_20", "market_cap", "industry").select("date", "symbol", round6(F.col("neutral")).alias("value"))


@query("residual_on_anchor", oracle(f"SELECT date, symbol, {R('CASE WHEN n >= 3 AND sxx > 0 THEN (y - my) - sxy / sxx * (x - mx) END', 'value')} FROM (SELECT *, count(*) OVER d AS n, avg(y) OVER d AS my, avg(x) OVER d AS mx, covar_samp(y, x) OVER d AS sxy, var_samp(x) OVER d AS sxx FROM b WINDOW d AS (PARTITION BY date))",
    "panel", mom=MOM, b="SELECT date, symbol, mom AS y, ln(amount) AS x FROM mom WHERE mom IS NOT NULL AND amount > 0"))
def residual_on_anchor(spark: SparkSession, sf: str) -> DataFrame:
    p = compute(harness.panel_daily(spark, sf), ["momentum_20"]).withColumn("x", F.when(F.col("amount") > 0, F.log("amount"))).where("momentum_20 IS NOT NULL AND x IS NOT NULL")
    return p.select("date", "symbol", round6(xsection.residual(F.col("momentum_20"), F.col("x"), ["date"])).alias("value"))


@query("capped_weights", oracle(f"SELECT date, symbol, {R('least(greatest(w, 0), 0.08::DOUBLE) / sum(least(greatest(w, 0), 0.08::DOUBLE)) OVER (PARTITION BY date)', 'weight')} FROM (SELECT date, symbol, amount / sum(amount) OVER (PARTITION BY date) AS w FROM panel)", "panel"))
def capped_weights(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf)
    w = p.withColumn("weight", F.col("amount") / F.sum("amount").over(Window.partitionBy("date")))
    return portfolio.cap_weights(w, 0.08).select("date", "symbol", round6(F.col("weight")).alias("weight"))


@query("monthly_anchors", oracle("SELECT entry, exit FROM (SELECT entry, coalesce(lead(entry) OVER (ORDER BY entry), (SELECT max(date) FROM panel)) AS exit FROM (SELECT max(date) AS entry FROM panel GROUP BY date_trunc('month', date))) WHERE exit > entry", "panel"))
def monthly_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return portfolio.monthly_anchors(harness.panel_daily(spark, sf).select("date").distinct())


@query("universe_churn", oracle("""SELECT date, count(*) FILTER (now AND was) AS kept, count(*) FILTER (now AND NOT was) AS entered, count(*) FILTER (was AND NOT now) AS left_out FROM (
  SELECT coalesce(a.snap, b.nxt) AS date, a.symbol IS NOT NULL AS now, b.symbol IS NOT NULL AS was FROM snaps a FULL JOIN
  (SELECT s.symbol, c.nxt FROM snaps s JOIN (SELECT snap, lead(snap) OVER (ORDER BY snap) AS nxt FROM (SELECT DISTINCT snap FROM snaps)) c USING (snap) WHERE nxt IS NOT NULL) b ON a.snap = b.nxt AND a.symbol = b.symbol) GROUP BY date""", "panel", "snaps"))
def universe_churn(spark: SparkSession, sf: str) -> DataFrame:
    """Members kept, entered and gone between consecutive snapshots."""
    s = harness.snapshots(harness.panel_daily(spark, sf))
    nxt = s.select("snap").distinct().withColumn("n", F.lead("snap").over(Window.partitionBy(F.lit(0)).orderBy("snap")))
    was = s.join(nxt, "snap").where("n IS NOT NULL").select(F.col("n").alias("snap"), "symbol", F.lit(True).alias("was"))
    both = s.withColumn("now", F.lit(True)).join(was, ["snap", "symbol"], "full").fillna(False, ["now", "was"])
    n = lambda c: F.count(F.when(c, 1))
    return both.groupBy(F.col("snap").alias("date")).agg(n(F.col("now") & F.col("was")).alias("kept"), n(F.col("now") & ~F.col("was")).alias("entered"), n(F.col("was") & ~F.col("now")).alias("left_out"))
