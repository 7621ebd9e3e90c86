"""Queries of study composites, and the same results as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import factors_minute as fm
from ..functions.scalar import round6
from ..operators import bars as B
from ..operators import pit, portfolio, xsection
from ..operators import studies as st
from ..operators.evaluation import information_coefficient
from ..sources import harness, stores
from ..sources.harness import oracle
from ..session import work_dir
from . import pipeline
from .daily import MOM, R, W
from .evaluation import BOTH, IC, PAIRS, QB, TURN, pairs
from .minute import CL, DAYS, PV, V, dense, visible

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


QW = "SELECT bucket, date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY date, bucket) AS w, fwd FROM qb"
GB = {"mom": MOM, "pairs": PAIRS, "both_": BOTH, "qb": QB, "qw": QW, "turn": TURN,
      "g": "SELECT bucket, date, gross, turnover, gross - 1000.0::DOUBLE * turnover AS net FROM (SELECT bucket, date, avg(CAST(round(fwd * 1e6) AS BIGINT)) AS gross FROM qw GROUP BY bucket, date) JOIN turn USING (bucket, date)"}


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    """Returns in millionths, as integers: their means are the same in every engine and order."""
    b = xsection.buckets(pairs(spark, sf).where("factor IS NOT NULL AND fwd IS NOT NULL"), "factor", 5)
    return st.group_backtest(b.withColumn("fwd", F.round(F.col("fwd") * 1e6).cast("bigint")), "bucket", 1000.0)


@query("group_backtest", oracle(f"SELECT bucket, date, floor(gross + 0.5) / 1e6 AS gross, {R('turnover', 'turnover')} FROM g", "panel", **GB))
def group_backtest(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).select("bucket", "date", (F.floor(F.col("gross") + 0.5) / 1e6).alias("gross"), round6(F.col("turnover")).alias("turnover"))


@query("group_spread", oracle(f"SELECT count(*) AS n, {R('avg(s) / 1e6', 'mean')}, {R('sum(s) / 1e6', 'total')} FROM (SELECT date, max(net) FILTER (bucket = 5) - max(net) FILTER (bucket = 1) AS s FROM g GROUP BY date) WHERE s IS NOT NULL", "panel", **GB))
def group_spread(spark: SparkSession, sf: str) -> DataFrame:
    s = st.spread(_groups(spark, sf), "bucket", 5, 1)
    return s.agg(F.count("*").alias("n"), round6(F.avg("spread") / 1e6).alias("mean"), round6(F.max_by("cum", "date") / 1e6).alias("total"))


@query("factor_disclosure", oracle(f"""SELECT count(*) AS rows, count(*) FILTER (ok) AS valid, {R('count(*) FILTER (ok) / count(*)', 'rate')}, count(*) FILTER (NOT coalesce(k_valley >= 6, false)) AS failed_valley, count(*) FILTER (NOT coalesce(n_class >= 10, false)) AS failed_classifiable,
  {R('quantile_cont(q, 0.0) FILTER (ok)', 'p0')}, {R('quantile_cont(q, 0.5) FILTER (ok)', 'p50')}, {R('quantile_cont(q, 1.0) FILTER (ok)', 'p100')} FROM (SELECT *, coalesce(k_valley >= 6, false) AND coalesce(n_class >= 10, false) AS ok, a_valley / v_valley / (a_day / v_day) AS q FROM days)""", "bars", **V, **CL, days=DAYS))
def factor_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    """How many days pass each gate of a bar-class factor, and the spread of its daily value."""
    d = fm.class_days(visible(spark, sf), 900, 10, 5)
    d = d.withColumn("q", F.try_divide(F.try_divide("a_valley", "v_valley"), F.try_divide("a_day", "v_day")))
    s = st.disclosure(d, "q", {"valley": F.col("k_valley") >= 6, "classifiable": F.col("n_class") >= 10})
    return s.select("rows", "valid", round6(F.col("rate")).alias("rate"), "failed_valley", "failed_classifiable", *[round6(F.col(c)).alias(c) for c in ("p0", "p50", "p100")])


@query("mmp_valid_minutes", oracle(f"SELECT symbol, trade_date, count(*) FILTER (cv >= 5 AND md > 0) AS n FROM (SELECT *, count(volume) OVER p AS cv, quantile_cont(volume, 0.5) OVER p AS md FROM v WINDOW p AS (PARTITION BY symbol, trade_date ORDER BY bar_end ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) GROUP BY symbol, trade_date", "bars", **V))
def mmp_valid_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of a day whose baseline of five bars before is known and positive."""
    w = Window.partitionBy(*B.DAY).orderBy("bar_end").rowsBetween(-5, -1)
    b = visible(spark, sf).withColumn("_n", F.count("volume").over(w)).withColumn("_m", F.percentile("volume", 0.5).over(w))
    return b.groupBy(*B.DAY).agg(F.count(F.when((F.col("_n") >= 5) & (F.col("_m") > 0), 1)).alias("n"))


@query("fina_coverage", oracle("SELECT entry AS date, count(*) AS n, count(value) AS covered FROM (SELECT p.date AS entry, p.symbol, f.value FROM panel p JOIN a ON p.date = a.entry ASOF LEFT JOIN f ON p.symbol = f.symbol AND p.date >= f.ann_date) GROUP BY entry", "panel", "fina",
    a="SELECT max(date) AS entry FROM panel GROUP BY date_trunc('month', date)", f="SELECT * FROM fina QUALIFY row_number() OVER (PARTITION BY symbol, ann_date ORDER BY end_date DESC) = 1"))
def fina_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a disclosed value at each month's last trading day."""
    p = harness.panel_daily(spark, sf).select("date", "symbol")
    ends = p.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("date"))
    at = p.join(F.broadcast(ends.select("date")), "date")
    j = pit.asof_backward(at, harness.fina(spark, sf), "symbol", "date", "ann_date", ["end_date", "value"], tie=["end_date"])
    return j.groupBy("date").agg(F.count("*").alias("n"), F.count("value").alias("covered"))


BASES = f"SELECT date, symbol, {R('lead(close) OVER s / close - 1', 'x')}, {R('lead(vw) OVER s / vw - 1', 'y')} FROM (SELECT *, amount / volume AS vw FROM panel) {W}"


@query("basis_agreement", oracle(f"SELECT count(ic) AS n, {R('quantile_cont(ic, 0.1)', 'p10')}, {R('quantile_cont(ic, 0.5)', 'median')}, {R('quantile_cont(ic, 0.9)', 'p90')} FROM ic", "panel", b0=BASES, b="SELECT * FROM b0 WHERE x IS NOT NULL AND y IS NOT NULL", ic=IC.format(src="b")))
def basis_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How close returns from vwap to vwap come to those from close to close."""
    p, w = harness.panel_daily(spark, sf).withColumn("vw", F.try_divide("amount", "volume")), Window.partitionBy("symbol").orderBy("date")
    b = p.select("date", "symbol", round6(F.lead("close").over(w) / F.col("close") - 1).alias("x"), round6(F.lead("vw").over(w) / F.col("vw") - 1).alias("y"))
    s = st.basis_agreement(b, "x", "y")
    return s.select("n", *[round6(F.col(c)).alias(c) for c in ("p10", "median", "p90")])


@query("tail_rebalance", oracle(f"""SELECT entry, {R('coalesce(sum(w * (b.p / a.p - 1)), 0)', 'gross')}, count(b.p / a.p) AS n, count(*) FILTER (b.p / a.p IS NULL) AS omitted FROM h LEFT JOIN pr a ON h.entry = a.date AND h.symbol = a.symbol LEFT JOIN pr b ON h.exit = b.date AND h.symbol = b.symbol GROUP BY entry""", "panel", mom=MOM, pairs=PAIRS,
    an="SELECT entry, coalesce(lead(entry) OVER (ORDER BY entry), (SELECT max(date) FROM panel)) AS exit FROM (SELECT max(date) AS entry FROM panel GROUP BY date_trunc('month', date))",
    h="SELECT entry, exit, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY entry) AS w FROM (SELECT an.entry, an.exit, symbol, row_number() OVER (PARTITION BY date ORDER BY factor DESC, symbol) AS i FROM pairs JOIN an ON date = an.entry WHERE factor IS NOT NULL AND an.exit > an.entry) WHERE i <= 5",
    pr="SELECT date, symbol, CASE WHEN amount / volume > 0 THEN amount / volume END AS p FROM panel"))
def tail_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly top five by momentum, earning from execution price to execution price."""
    p = pairs(spark, sf)
    anchors = portfolio.monthly_anchors(p.select("date").distinct())
    top = portfolio.top_n(p.join(F.broadcast(anchors), F.col("date") == F.col("entry")), 5, "factor").select("entry", "exit", "symbol", "weight")
    prices = harness.panel_daily(spark, sf).select("date", "symbol", F.try_divide("amount", "volume").alias("price"))
    return st.tail_rebalance(top, prices).select("entry", round6(F.col("gross")).alias("gross"), "n", "omitted")


@query("stale_ic_decay", oracle(" UNION ALL ".join(f"SELECT {k} AS lag, {R('avg(ic)', 'mean')}, count(ic) AS n FROM ic{k}" for k in (1, 2)), "panel", mom=MOM, pairs=PAIRS, **{n: s for k in (1, 2) for n, s in {
    f"s{k}": f"SELECT date, symbol, lag(factor, {k}) OVER s AS factor, fwd FROM pairs {W}", f"b{k}": f"SELECT * FROM s{k} WHERE factor IS NOT NULL AND fwd IS NOT NULL",
    f"r{k}": f"SELECT date, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS y FROM b{k}",
    f"ic{k}": IC.format(src=f"r{k}")}.items()}))
def stale_ic_decay(spark: SparkSession, sf: str) -> DataFrame:
    """Mean IC of the factor as it was one and two rows before."""
    p, w = pairs(spark, sf), Window.partitionBy("symbol").orderBy("date")
    out = None
    for k in (1, 2):
        ic = information_coefficient(p.withColumn("_f", F.lag("factor", k).over(w)), "_f")
        one = ic.agg(round6(F.avg("ic")).alias("mean"), F.count("ic").alias("n")).select(F.lit(k).alias("lag"), "mean", "n")
        out = one if out is None else out.unionByName(one)
    return out


ANCHORS = "SELECT * FROM (SELECT entry, coalesce(lead(entry) OVER (ORDER BY entry), (SELECT max(date) FROM panel)) AS exit FROM (SELECT max(date) AS entry FROM panel GROUP BY date_trunc('month', date))) WHERE exit > entry"
EVENTS = """SELECT an.entry AS date, s.symbol, NOT coalesce(a.price > 0, false) AS gone, coalesce(a.price > 0 AND a.price >= a.high - 1e-6, false) AS up, coalesce(a.price > 0 AND a.price <= a.low + 1e-6, false) AS down,
  CASE WHEN a.symbol IS NOT NULL THEN CASE WHEN a.adj IS NOT NULL AND b.adj IS NOT NULL AND a.adj <> 0 THEN b.adj / a.adj - 1 ELSE 0 END END AS ret FROM an CROSS JOIN (SELECT DISTINCT symbol FROM panel) s
  LEFT JOIN px a ON a.date = an.entry AND a.symbol = s.symbol LEFT JOIN px b ON b.date = an.exit AND b.symbol = s.symbol"""
PX = "SELECT date, symbol, high, low, amount, amount / nullif(volume, 0) AS price, amount / nullif(volume, 0) * adj_factor AS adj FROM panel"
EV = {"an": ANCHORS, "px": PX, "ev": EVENTS}


def _tail(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(events, panel): trading at the month's last day's average price, with the day's extremes as its limits."""
    panel = harness.panel_daily(spark, sf).withColumn("price", F.try_divide("amount", "volume"))
    anchors = portfolio.monthly_anchors(panel.select("date").distinct())
    limits = panel.select("date", "symbol", F.col("high").alias("up_limit"), F.col("low").alias("down_limit"))
    return pipeline.tail_events(anchors, panel, panel.select("date", "symbol", "price", "adj_factor"), limits), panel


@query("tail_event_counts", oracle(f"SELECT date, count(*) AS names, count(*) FILTER (gone) AS no_bar, count(*) FILTER (up) AS up_blocked, count(*) FILTER (down) AS down_blocked, count(*) FILTER (NOT gone AND NOT up AND NOT down) AS both_ways, {R('avg(ret)', 'mean_ret')} FROM ev GROUP BY date", "panel", **EV))
def tail_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    e, _ = _tail(spark, sf)
    return pipeline.event_counts(e).join(e.groupBy("date").agg(round6(F.avg("ret")).alias("mean_ret")), "date")


PLANS = "SELECT *, CASE WHEN d > 0 THEN up ELSE down END OR gone AS blocked FROM (SELECT ev.*, px.amount, (month(ev.date) + substr(ev.symbol, 7)::INT) % 4 * 0.1::DOUBLE - substr(ev.symbol, 7)::INT % 3 * 0.1::DOUBLE AS d FROM ev LEFT JOIN px ON px.date = ev.date AND px.symbol = ev.symbol) WHERE abs(d) > 1e-12"
RATIO = "SELECT *, NOT blocked AND NOT coalesce(amount > 0, false) AS missing, CASE WHEN NOT blocked AND amount > 0 THEN amount * 0.1::DOUBLE / (abs(d) * 1000000.0::DOUBLE) END AS ratio FROM plans"


def _diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    e, panel = _tail(spark, sf)
    k = F.substring("symbol", 7, 9).cast("int")
    plan = e.select("date", "symbol", "can_buy", "can_sell", (k % 3 * 0.1).alias("current"), ((F.month("date") + k) % 4 * 0.1).alias("target"))
    return B.liquidity_diagnostics(plan.join(panel.select("date", "symbol", "amount"), ["date", "symbol"], "left"), 1_000_000.0)


@query("liquidity_summary", oracle(f"SELECT count(*) AS trades, count(*) FILTER (blocked) AS blocked, count(*) FILTER (missing) AS missing, count(ratio) AS inspected, count(*) FILTER (ratio < 1) AS below, {R('min(ratio)', 'least')}, {R('quantile_cont(ratio, 0.1)', 'p10')}, {R('quantile_cont(ratio, 0.5)', 'median')}, {R('quantile_cont(ratio, 0.9)', 'p90')} FROM ratios", "panel", **EV, plans=PLANS, ratios=RATIO))
def liquidity_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = B.liquidity_summary(_diagnosed(spark, sf))
    return s.select("trades", "blocked", "missing", "inspected", "below", *[round6(F.col(c)).alias(c) for c in ("least", "p10", "median", "p90")])


@query("most_constrained", oracle(f"SELECT date, symbol, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS direction, {R('ratio', 'ratio')} FROM (SELECT * FROM ratios WHERE ratio IS NOT NULL ORDER BY ratio, date, symbol LIMIT 20)", "panel", **EV, plans=PLANS, ratios=RATIO))
def most_constrained(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the twenty trades that their bar's volume holds back most."""
    return B.most_constrained(_diagnosed(spark, sf), 20).select("date", "symbol", "direction", round6(F.col("ratio")).alias("ratio"))


@query("upsert_partitions", oracle("SELECT symbol, freq, bar_end, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bar_end ORDER BY k DESC) AS i FROM (SELECT symbol, '15min' AS freq, bar_end, round(close * 100) / 100 AS close, 0 AS k FROM bars UNION ALL SELECT symbol, '15min', bar_end, 0.0, 1 FROM bars WHERE day(trade_date) = 5)) WHERE i = 1", "bars"))
def upsert_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Bars stored by month, then a revision of one day of a month upserted; what a range over all of it reads."""
    bars = harness.bars(spark, sf).select("symbol", F.lit("15min").alias("freq"), "bar_end", F.round("close", 2).alias("close"), "trade_date")
    store = stores.IntradayStore(spark, f"{work_dir(spark)}/bars-{uuid.uuid4().hex}")
    store.upsert(bars.drop("trade_date"))
    store.upsert(bars.where(F.dayofmonth("trade_date") == 5).withColumn("close", F.lit(0.0)).drop("trade_date"))
    days = bars.agg(F.to_date(F.min("bar_end")), F.to_date(F.max("bar_end"))).first()
    names = [r[0] for r in bars.select("symbol").distinct().collect()]
    return store.read_range(names, str(days[0]), str(days[1]), "15min").select("symbol", "freq", "bar_end", "close")


SANE = "SELECT date, symbol, price, adj_factor AS f, lead(date) OVER s AS ed, lead(price) OVER s AS ep, lead(adj_factor) OVER s AS ef, lead(price * adj_factor) OVER s / nullif(price * adj_factor, 0) - 1 AS fwd FROM (SELECT *, amount / nullif(volume, 0) AS price FROM panel) WINDOW s AS (PARTITION BY symbol ORDER BY date)"


def _pairs_of_execution(spark: SparkSession, sf: str) -> DataFrame:
    p = harness.panel_daily(spark, sf).select("date", "symbol", F.try_divide("amount", "volume").alias("price"), "adj_factor")
    w = Window.partitionBy("symbol").orderBy("date")
    paid = F.col("price") * F.col("adj_factor")
    return st.execution_pairs(p.withColumn("fwd", F.try_divide(F.lead(paid).over(w), paid) - 1))


@query("execution_moments", oracle(f"SELECT 'fwd' AS series, count(fwd) AS n, {R('avg(fwd)', 'mean')}, {R('stddev_samp(fwd)', 'std')}, {R('min(fwd)', 'least')}, {R('quantile_cont(fwd, 0.5)', 'median')}, {R('max(fwd)', 'most')} FROM sane", "panel", sane=SANE))
def execution_moments(spark: SparkSession, sf: str) -> DataFrame:
    return st.moments(_pairs_of_execution(spark, sf), ["fwd"]).select("series", "n", *[round6(F.col(c)).alias(c) for c in ("mean", "std", "least", "median", "most")])


@query("ex_date_pairs", oracle(f"SELECT date, symbol, ed AS exit_date, {R('f', 'adj_factor')}, {R('ef', 'exit_adj')}, {R('fwd', 'fwd')}, {R('ep / price - 1', 'unadjusted')} FROM sane WHERE fwd IS NOT NULL AND f <> ef", "panel", sane=SANE))
def ex_date_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return st.ex_date_pairs(_pairs_of_execution(spark, sf)).select("date", "symbol", "exit_date", *[round6(F.col(c)).alias(c) for c in ("adj_factor", "exit_adj", "fwd", "unadjusted")])


@query("ridge_coverage", oracle(f"""SELECT count(*) AS rows, count(*) FILTER (k_ridge >= 10 AND k_valley >= 20 AND n_class >= 100) AS valid, count(*) FILTER (n_class >= 100) AS classifiable, count(*) FILTER (k_ridge < 10) AS failed_ridge, count(*) FILTER (k_valley < 20) AS failed_valley, count(*) FILTER (n_class < 100) AS failed_classifiable,
  count(*) FILTER (k_ridge >= 20 AND k_valley >= 20 AND n_class >= 100) AS valid_at_valley_gate, {R('quantile_cont(k_valley, 0.5)', 'valley_median')}, {R('quantile_cont(k_ridge, 0.5) FILTER (k_ridge >= 10 AND k_valley >= 20 AND n_class >= 100)', 'p50')}, {R('count(*) FILTER (k_ridge >= 10 AND k_valley >= 20 AND n_class >= 100) / count(*) FILTER (n_class >= 100)', 'rate_of_classifiable')} FROM days""", "dense", **PV))
def ridge_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = st.ridge_coverage(fm.class_days(dense(spark, sf)))
    return c.select("rows", "valid", "classifiable", "failed_ridge", "failed_valley", "failed_classifiable", "valid_at_valley_gate", *[round6(F.col(k)).alias(k) for k in ("valley_median", "p50", "rate_of_classifiable")])


@query("peak_coverage", oracle(f"SELECT count(*) AS rows, count(*) FILTER (k_peak >= 5 AND k_ridge >= 10 AND n_class >= 100) AS valid, count(*) FILTER (k_peak < 5) AS failed_peak, {R('quantile_cont(k_peak, 0.5) FILTER (k_peak >= 5 AND k_ridge >= 10 AND n_class >= 100)', 'p50')} FROM days", "dense", **PV))
def peak_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return st.peak_coverage(fm.class_days(dense(spark, sf))).select("rows", "valid", "failed_peak", round6(F.col("p50")).alias("p50"))
