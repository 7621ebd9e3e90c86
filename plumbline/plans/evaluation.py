"""Queries that judge signals, and the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.registry import compute
from ..functions.scalar import round6
from ..operators import evaluation as ev
from ..operators import portfolio, xsection
from ..sources import harness
from ..sources.harness import oracle
from .daily import MOM, RET, R, W, win
from .report import EvalConfig, EvalContext, evaluate_factor

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, factor, vol, fwd): momentum, volatility and the next row's return, at six decimals."""
    p = compute(harness.panel_daily(spark, sf), ["momentum_20", "volatility_20"])
    p = ev.forward_returns(p)
    return p.select("date", "symbol", round6(F.col("momentum_20")).alias("factor"), round6(F.col("volatility_20")).alias("vol"), round6(F.col("fwd")).alias("fwd"))


PAIRS = f"SELECT date, symbol, {R('mom', 'factor')}, {R('lead(close) OVER s / close - 1', 'fwd')} FROM mom {W}"
BOTH = "SELECT *, count(*) OVER (PARTITION BY date) AS n FROM pairs WHERE factor IS NOT NULL AND fwd IS NOT NULL"
RANKS = "SELECT date, symbol, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS y FROM both_"
IC = "SELECT d.date, ic, coalesce(n, 0) AS n FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN (SELECT date, CASE WHEN count(*) >= 2 AND min(x) < max(x) AND min(y) < max(y) THEN corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)) END AS ic, count(*) AS n FROM {src} GROUP BY date) i USING (date)"
CHAIN = {"mom": MOM, "pairs": PAIRS, "both_": BOTH}
SPEAR = CHAIN | {"ranks": RANKS, "ic": IC.format(src="ranks")}


@query("forward_returns", oracle("SELECT date, symbol, fwd FROM pairs", "panel", mom=MOM, pairs=PAIRS))
def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    return ev.forward_returns(harness.panel_daily(spark, sf)).select("date", "symbol", round6(F.col("fwd")).alias("fwd"))


@query("ic_spearman", oracle(f"SELECT date, {R('ic', 'ic')}, n FROM ic", "panel", **SPEAR))
def ic_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return ev.information_coefficient(pairs(spark, sf)).select("date", round6(F.col("ic")).alias("ic"), "n")


@query("ic_pearson", oracle(f"SELECT date, {R('ic', 'ic')}, n FROM ic", "panel", **CHAIN, x="SELECT date, factor AS x, fwd AS y FROM both_", ic=IC.format(src="x")))
def ic_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return ev.information_coefficient(pairs(spark, sf), method="pearson").select("date", round6(F.col("ic")).alias("ic"), "n")


@query("ic_summary", oracle(f"SELECT {R('avg(ic)', 'mean')}, {R('stddev_samp(ic)', 'std')}, {R('avg(ic) / stddev_samp(ic)', 'ir')}, count(ic) AS n FROM ic", "panel", **SPEAR))
def ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.ic_summary(ev.information_coefficient(pairs(spark, sf)))
    return s.select(*[round6(F.col(c)).alias(c) for c in ("mean", "std", "ir")], "n")


QB = "SELECT *, CAST(ntile(5) OVER (PARTITION BY date ORDER BY factor, symbol) AS INTEGER) AS bucket FROM both_"
QRET = "SELECT date, bucket, avg(fwd) AS ret, count(*) AS n FROM qb GROUP BY date, bucket"


@query("quantile_returns", oracle(f"SELECT date, bucket, {R('ret', 'ret')}, n FROM qret", "panel", **CHAIN, qb=QB, qret=QRET))
def quantile_returns(spark: SparkSession, sf: str) -> DataFrame:
    return ev.quantile_returns(pairs(spark, sf), 5).select("date", "bucket", round6(F.col("ret")).alias("ret"), "n")


TURN = """SELECT bucket, date, sum(abs(w - b)) AS turnover FROM (SELECT bucket, date, symbol, sum(w) AS w, sum(b) AS b FROM (
  SELECT bucket, date, symbol, w, 0.0::DOUBLE AS b FROM qw UNION ALL SELECT bucket, nxt, symbol, 0.0, w FROM qw JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM qw)) USING (date) WHERE nxt IS NOT NULL) GROUP BY ALL) GROUP BY bucket, date"""
QW = "SELECT bucket, date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY date, bucket) AS w FROM qb"


@query("quantile_turnover", oracle(f"SELECT bucket, date, {R('turnover', 'turnover')} FROM turn", "panel", **CHAIN, qb=QB.replace("both_", "(SELECT * FROM pairs WHERE factor IS NOT NULL)"), qw=QW, turn=TURN))
def quantile_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return ev.quantile_turnover(pairs(spark, sf), 5).select("bucket", "date", round6(F.col("turnover")).alias("turnover"))


@query("long_short_cost", oracle(f"""SELECT date, {R('gross', 'gross')}, {R('cost', 'cost')}, {R('gross - cost', 'aligned')} FROM
  (SELECT date, max(ret) FILTER (bucket = 5) - max(ret) FILTER (bucket = 1) AS gross FROM qret GROUP BY date) JOIN (SELECT date, sum(turnover) * 0.001::DOUBLE AS cost FROM turn WHERE bucket IN (1, 5) GROUP BY date) USING (date)""", "panel", **CHAIN, qb=QB, qret=QRET, qw=QW, turn=TURN))
def long_short_cost(spark: SparkSession, sf: str) -> DataFrame:
    return ev.long_short(pairs(spark, sf), 5, 0.001).select("date", *[round6(F.col(c)).alias(c) for c in ("gross", "cost", "aligned")])


@query("bucket_monotonicity", oracle(f"SELECT date, CASE WHEN count(*) >= 3 AND min(ret) < max(ret) THEN {R('corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE))')} END AS ic, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY bucket) AS x, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS y FROM qret) GROUP BY date", "panel", **CHAIN, qb=QB, qret=QRET))
def bucket_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    return ev.monotonicity(ev.quantile_returns(pairs(spark, sf), 5)).select("date", round6(F.col("ic")).alias("ic"), "n")


@query("rank_autocorrelation", oracle(f"SELECT date, {R('ic', 'ic')}, n FROM ic", "panel", mom=MOM, pairs=PAIRS, was=f"SELECT *, lag(factor) OVER s AS w FROM pairs {W}", both_="SELECT date, symbol, factor, w AS fwd FROM was WHERE factor IS NOT NULL AND w IS NOT NULL", ranks=RANKS, ic=IC.format(src="ranks")))
def rank_autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return ev.rank_autocorrelation(pairs(spark, sf), 1).select("date", round6(F.col("ic")).alias("ic"), "n")


@query("newey_west", oracle("""SELECT floor(t * 1e6 + 0.5) / 1e6 AS t, n FROM (SELECT m / sqrt((sum(d * d) + 2 * (1 - 1 / 5.0) * sum(d * l1) + 2 * (1 - 2 / 5.0) * sum(d * l2) + 2 * (1 - 3 / 5.0) * sum(d * l3) + 2 * (1 - 4 / 5.0) * sum(d * l4)) / n / n) AS t, n FROM
  (SELECT *, lag(d, 1) OVER o AS l1, lag(d, 2) OVER o AS l2, lag(d, 3) OVER o AS l3, lag(d, 4) OVER o AS l4 FROM (SELECT date, coalesce(ic - m, 0) AS d, m, n FROM ic0, (SELECT avg(ic) AS m, count(ic) AS n FROM ic0)) WINDOW o AS (ORDER BY date)) GROUP BY m, n)""", "panel", **SPEAR, ic0=f"SELECT date, {R('ic', 'ic')} FROM ic"))
def newey_west(spark: SparkSession, sf: str) -> DataFrame:
    ic = ev.information_coefficient(pairs(spark, sf)).select("date", round6(F.col("ic")).alias("ic"))
    return ev.newey_west_frame(ic, "ic", 4).select(round6(F.col("t")).alias("t"), "n")


@query("effective_samples", oracle("""SELECT floor(CASE WHEN 1 + 2 * s <= 0 THEN n ELSE least(n, greatest(1, n / (1 + 2 * s))) END * 1e6 + 0.5) / 1e6 AS n_eff, n FROM
  (SELECT any_value(n) AS n, coalesce(sum(r) FILTER (k < cut), 0) AS s FROM (SELECT *, coalesce(min(k) FILTER (r <= 0 AND k > floor(4 * (n / 100.0) ** (2 / 9.0))) OVER (), 1000000) AS cut FROM
    (SELECT a.i - b.i AS k, sum(a.d * b.d) / any_value(a.v) AS r, any_value(a.n) AS n FROM x a JOIN x b ON a.i > b.i AND a.i - b.i < a.n GROUP BY 1)))""", "panel", **SPEAR, x=f"SELECT row_number() OVER (ORDER BY date) AS i, coalesce(ic - m, 0) AS d, n, sum(coalesce(ic - m, 0) ** 2) OVER () AS v FROM (SELECT date, {R('ic', 'ic')} FROM ic), (SELECT avg(ic) AS m, count(ic) AS n FROM (SELECT {R('ic', 'ic')} FROM ic))"))
def effective_samples(spark: SparkSession, sf: str) -> DataFrame:
    values = ev.series(ev.information_coefficient(pairs(spark, sf)).select("date", round6(F.col("ic")).alias("ic")), "ic")
    n = sum(v is not None for v in values)
    return spark.createDataFrame([(float(ev.effective_sample_size(values)), n)], "n_eff double, n long").select(round6(F.col("n_eff")).alias("n_eff"), "n")


SCORED = f"SELECT p.date, p.symbol, p.factor AS a, v.v AS b, p.fwd FROM pairs p JOIN (SELECT date, symbol, CASE WHEN count(ret) OVER w >= 20 THEN {R('stddev_samp(ret) OVER w')} END AS v FROM ret WINDOW w AS {win(20)}) v USING (date, symbol)"


@query("equal_weight_score", oracle(f"SELECT date, symbol, {R('(coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0)', 'score')} FROM scored", "panel", mom=MOM, pairs=PAIRS, ret=RET, scored=SCORED))
def equal_weight_score(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("date", "symbol", round6(portfolio.equal_weight_score(["factor", "vol"])).alias("score"))


def _sided(c: str) -> str:
    return f"SELECT date, CASE WHEN count(*) >= 2 AND min({c}) < max({c}) AND min(fwd) < max(fwd) THEN {R(f'corr({c}, fwd)')} END AS ic FROM scored WHERE {c} IS NOT NULL AND fwd IS NOT NULL GROUP BY date"


@query("ic_weighted_score", oracle(f"SELECT s.date, s.symbol, {R('s.a * wa + s.b * wb', 'score')} FROM scored s JOIN w USING (date)", "panel", mom=MOM, pairs=PAIRS, ret=RET, scored=SCORED, ia=_sided("a"), ib=_sided("b"),
    m="SELECT date, avg(ia.ic) OVER o AS ma, avg(ib.ic) OVER o AS mb, count(ia.ic) OVER o AS na, count(ib.ic) OVER o AS nb FROM (SELECT DISTINCT date FROM panel) LEFT JOIN ia USING (date) LEFT JOIN ib USING (date) WINDOW o AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)",
    w="SELECT date, CASE WHEN least(na, nb) >= 20 AND abs(ma) + abs(mb) > 0 THEN ma / (abs(ma) + abs(mb)) ELSE 0.5 END AS wa, CASE WHEN least(na, nb) >= 20 AND abs(ma) + abs(mb) > 0 THEN mb / (abs(ma) + abs(mb)) ELSE 0.5 END AS wb FROM m"))
def ic_weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    ic = lambda c: ev.information_coefficient(p, c, method="pearson").select("date", round6(F.col("ic")).alias(c))
    w = portfolio.ic_weights(ic("factor").join(ic("vol"), "date"), ["factor", "vol"], horizon=1, window=60)
    return portfolio.weighted_score(p, w, ["factor", "vol"]).select("date", "symbol", round6(F.col("score")).alias("score"))


TOP = "SELECT date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS w, fwd FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC, symbol) AS r FROM pairs WHERE factor IS NOT NULL) WHERE r <= 5"
BT = """SELECT date, sum(w * coalesce(fwd, 0)) AS gross FROM top_ GROUP BY date"""
TURN1 = TURN.replace("bucket, ", "").replace("qw", "top_").replace("GROUP BY date", "GROUP BY date")
NET = "SELECT date, gross, turnover, gross - turnover * 0.001::DOUBLE AS net FROM bt JOIN turn USING (date)"
BCH = {"mom": MOM, "pairs": PAIRS, "top_": TOP, "bt": BT, "turn": TURN1, "net": NET}


def _backtest(spark: SparkSession, sf: str) -> DataFrame:
    top = portfolio.top_n(pairs(spark, sf), 5, "factor")
    gross = top.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("gross_return"))
    turn = portfolio.turnover(top.select("date", "symbol", "weight"), top)
    return gross.join(turn, "date").withColumn("net_return", F.col("gross_return") - F.col("turnover") * 0.001)


@query("backtest_relational", oracle(f"SELECT date, {R('gross', 'gross_return')}, {R('turnover', 'turnover')}, {R('net', 'net_return')}, {R('sum(ln(1 + net)) OVER (ORDER BY date)', 'log_nav')} FROM net", "panel", **BCH))
def backtest_relational(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    b = _backtest(spark, sf).withColumn("log_nav", F.sum(F.log(1 + F.col("net_return"))).over(w))
    return b.select("date", *[round6(F.col(c)).alias(c) for c in ("gross_return", "turnover", "net_return", "log_nav")])


@query("drawdown", oracle(f"SELECT date, {R('g - greatest(0.0, max(g) OVER (ORDER BY date))', 'log_drawdown')} FROM (SELECT date, sum(ln(1 + net)) OVER (ORDER BY date) AS g FROM net)", "panel", **BCH))
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    b = _backtest(spark, sf).withColumn("log_nav", F.sum(F.log(1 + F.col("net_return"))).over(w))
    return b.select("date", round6(ev.log_drawdown("log_nav", w)).alias("log_drawdown"))


@query("perf_summary", oracle(f"""SELECT count(*) AS n, {R('sum(ln(1 + net))', 'log_growth')}, {R('stddev_samp(net) * sqrt(252)', 'volatility')}, {R('avg(net) / stddev_samp(net) * sqrt(252)', 'sharpe')}, {R('min(dd)', 'max_drawdown')}
  FROM (SELECT *, exp(g - greatest(0.0, max(g) OVER (ORDER BY date))) - 1 AS dd FROM (SELECT date, net, sum(ln(1 + net)) OVER (ORDER BY date) AS g FROM net))""", "panel", **BCH))
def perf_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.performance(_backtest(spark, sf))
    return out.select("n", *[round6(F.col(c)).alias(c) for c in ("log_growth", "volatility", "sharpe", "max_drawdown")])


FLAGS = "substr(symbol, 7)::INT"
#: Rebalances as lists over all symbols in order, so that the state is one row a strategy; step by step as simulate() does.
STATE = """SELECT strategy, 0 AS i, NULL::DATE AS date, z AS held, 0.0::DOUBLE AS gross_return, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS log_nav, 0 AS n_held FROM (SELECT DISTINCT strategy FROM reb), (SELECT list_transform(range(count(DISTINCT symbol)), lambda x: 0.0::DOUBLE) AS z FROM panel)
  UNION ALL SELECT strategy, i, date, held, gross, moved, log_nav + ln(1 + gross - moved * 0.001::DOUBLE), len(list_filter(held, lambda x: x > 0)) FROM (
    SELECT *, coalesce(list_sum([a * b for a, b in list_zip(held, r)]), 0) AS gross FROM (
      SELECT *, list_sum([abs(x[1] - x[2]) for x in list_zip(held, was)]) AS moved FROM (
        SELECT *, [CASE WHEN x[1] + x[2] * scale > 1e-9 THEN x[1] + x[2] * scale ELSE 0 END for x in list_zip(sold, want)] AS held FROM (
          SELECT *, CASE WHEN list_sum(want) > 1e-9 THEN least(1, greatest(0, 1 - list_sum(sold)) / list_sum(want)) ELSE 0 END AS scale FROM (
            SELECT *, [CASE WHEN x[2] - x[1] > 1e-9 AND x[3] > 0 THEN x[2] - x[1] ELSE 0 END for x in list_zip(sold, t, cb)] AS want FROM (
              SELECT st.strategy, reb.i, reb.date, st.log_nav, st.held AS was, t, cb, r, [CASE WHEN x[2] < x[1] - 1e-9 AND x[3] > 0 THEN x[2] ELSE x[1] END for x in list_zip(st.held, t, cs)] AS sold
              FROM st JOIN reb ON st.strategy = reb.strategy AND reb.i = st.i + 1))))))"""


def _constrained_sql() -> str:
    import re

    three = lambda s: re.sub(r"\[a \* b for a, b in list_zip\(held, r\)\]", "[x[1] * x[2] for x in list_zip(held, r)]", s)
    more = {
        "mom": MOM, "pairs": PAIRS, "ends": "SELECT entry AS date FROM (SELECT entry, coalesce(lead(entry) OVER (ORDER BY entry), (SELECT max(date) FROM pairs)) AS x FROM (SELECT max(date) AS entry FROM pairs GROUP BY date_trunc('month', date))) WHERE x > entry",
        "own": "SELECT date, symbol, fwd, bucket, 1.0::DOUBLE / count(*) OVER (PARTITION BY date, bucket) AS target FROM (SELECT *, ntile(5) OVER (PARTITION BY date ORDER BY factor, symbol) AS bucket FROM pairs JOIN ends USING (date) WHERE factor IS NOT NULL)",
        "reb": f"""SELECT strategy, date, dense_rank() OVER (ORDER BY date) AS i, list(t ORDER BY symbol) AS t, list(cb ORDER BY symbol) AS cb, list(cs ORDER BY symbol) AS cs, list(r ORDER BY symbol) AS r FROM (
          SELECT strategy, d.date, s.symbol, CASE WHEN bucket = strategy THEN target ELSE 0 END::DOUBLE AS t, CASE WHEN o.symbol IS NOT NULL AND ({FLAGS.replace('symbol', 's.symbol')} * 7 + day(d.date) * 3 + month(d.date)) % 10 <> 0 THEN 1 ELSE 0 END::DOUBLE AS cb,
            CASE WHEN o.symbol IS NOT NULL AND ({FLAGS.replace('symbol', 's.symbol')} * 5 + day(d.date) + month(d.date) * 2) % 11 <> 0 THEN 1 ELSE 0 END::DOUBLE AS cs, coalesce(fwd, 0)::DOUBLE AS r
          FROM (SELECT DISTINCT date FROM own) d, (SELECT DISTINCT symbol FROM panel) s, (SELECT unnest(range(1, 6)) AS strategy) LEFT JOIN own o ON o.date = d.date AND o.symbol = s.symbol) GROUP BY strategy, date""",
        "st": three(STATE),
    }
    final = f"SELECT CAST(strategy AS INTEGER) AS strategy, date, {R('gross_return + 2e-8', 'gross_return')}, {R('turnover + 2e-8', 'turnover')}, {R('log_nav', 'log_nav')}, CAST(n_held AS BIGINT) AS n_held FROM st WHERE i > 0"
    return oracle(final, "panel", **more).replace("WITH ", "WITH RECURSIVE ", 1)


@query("backtest_constrained", _constrained_sql())
def backtest_constrained(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly rebalances of five strategies (one for each score bucket) with blocked sells and cash-scaled buys."""
    p = pairs(spark, sf)
    ends = portfolio.monthly_anchors(p.select("date").distinct()).select(F.col("entry").alias("date"))
    b = xsection.buckets(p.join(F.broadcast(ends), "date"), "factor", 5).withColumn("target", 1.0 / F.count("*").over(Window.partitionBy("date", "bucket")))
    k, day, month = F.substring("symbol", 7, 9).cast("int"), F.dayofmonth("date"), F.month("date")
    rows = b.withColumn("strategy", F.explode(F.sequence(F.lit(1), F.lit(5))))
    rows = rows.select("strategy", "date", "symbol", F.when(F.col("bucket") == F.col("strategy"), F.col("target")).otherwise(0.0).alias("target"), ((k * 7 + day * 3 + month) % 10 != 0).alias("can_buy"), ((k * 5 + day + month * 2) % 11 != 0).alias("can_sell"), F.col("fwd").alias("ret"))
    out = portfolio.simulate(rows)
    # quarters of six-digit returns lie on the edge of rounding, so both sides are moved off it
    return out.select("strategy", "date", *[round6(c).alias(n) for c, n in ((F.col("gross_return") + 2e-8, "gross_return"), (F.col("turnover") + 2e-8, "turnover"), (F.log("nav"), "log_nav"))], "n_held")


def _report(spark: SparkSession, sf: str):
    """The whole report of momentum against a one-factor book, split by date of realisation."""
    cfg = EvalConfig("all", True, "1992-01-01", "1999-12-31", False, False, oos_split="1996-01-01", n_factors_screened=4)
    return evaluate_factor(pairs(spark, sf), "factor", 1, cfg, EvalContext(known_factors=("vol",), universe_symbols=("P0", "none"), min_history_bars=21))


def _row(spark: SparkSession, row: dict) -> DataFrame:
    """One row of driver figures, numbers to six decimals; unknown ones are numbers."""
    kind = lambda v: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double"
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(v)}" for k, v in row.items()))
    return df.select(*[round6(F.col(k)).alias(k) if kind(v) == "double" else F.col(k) for k, v in row.items()])


LAGGED = f"SELECT *, lag(factor, 1) OVER s AS f1, lag(factor, 2) OVER s AS f2, lag(factor, 3) OVER s AS f3, lag(factor, 5) OVER s AS f5 FROM pairs {W}"


def _rank_corr(a: str, b: str, src: str = "lagged", ranked: bool = True) -> str:
    """SQL of the per-date correlations `c` of columns a and b of src."""
    x = lambda c: f"rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0" if ranked else c
    return f"SELECT date, CASE WHEN count(*) >= 2 AND min(x) < max(x) AND min(y) < max(y) THEN corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)) END AS c FROM (SELECT date, {x(a)} AS x, {x(b)} AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY date"


BUCKET = "SELECT *, CAST(ntile(5) OVER (PARTITION BY date ORDER BY factor, symbol) AS INTEGER) AS bucket FROM pairs WHERE factor IS NOT NULL"
LEGS = "SELECT date, coalesce(max(turnover) FILTER (bucket = 5), 0) + coalesce(max(turnover) FILTER (bucket = 1), 0) AS t FROM turn GROUP BY date"
RCH = {"mom": MOM, "pairs": PAIRS, "lagged": LAGGED, "icr": _rank_corr("factor", "fwd"), "qb": BUCKET, "qret": "SELECT date, bucket, avg(fwd) AS ret FROM qb GROUP BY date, bucket", "qw": QW, "turn": TURN, "legs": LEGS}
SPREAD = "SELECT date, g, t FROM (SELECT date, max(ret) FILTER (bucket = 5) - max(ret) FILTER (bucket = 1) AS g FROM qret GROUP BY date) JOIN legs USING (date) WHERE g IS NOT NULL"


def _avg(sql: str) -> str:
    return f"(SELECT {R('avg(c)')} FROM ({sql}))"


@query("report_predictive", oracle(f"""SELECT {R('avg(c)', 'ic_mean')}, {R('stddev_samp(c)', 'ic_std')}, {R('avg(c) / stddev_samp(c)', 'ic_ir')}, {R('avg(CAST(round(c, 9) > 0 AS INT))', 'win_rate')}, count(c) AS periods, count(*) - count(c) AS periods_without,
  {_avg(_rank_corr('factor', 'fwd', ranked=False))} AS pearson_mean, {', '.join(f"{_avg(_rank_corr(f'f{k}', 'fwd'))} AS stale_{k}" for k in (1, 2, 3, 5))} FROM (SELECT DISTINCT date FROM pairs) LEFT JOIN icr USING (date)""", "panel", **RCH))
def report_predictive(spark: SparkSession, sf: str) -> DataFrame:
    p = _report(spark, sf).sections["predictive_power"]
    return _row(spark, {k: p[k] for k in ("ic_mean", "ic_std", "ic_ir", "win_rate", "periods", "periods_without", "pearson_mean")} | {f"stale_{k}": v for k, v in p["stale"].items()})


MONO = "SELECT date, CASE WHEN count(*) >= 3 AND min(ret) < max(ret) THEN corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)) END AS c FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY bucket) AS x, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS y FROM qret WHERE ret IS NOT NULL) GROUP BY date"


@query("report_return_risk", oracle(f"""SELECT {R('avg(g)', 'gross')}, {', '.join(R(f'avg(g - {c} * 0.001::DOUBLE * t)', f'net_{c}') for c in (1, 2, 4))}, {R('avg(g - 0.001::DOUBLE * t)', 'aligned')},
  (SELECT {R('avg(c)')} FROM mono) AS monotonicity, (SELECT count(c) FROM mono) AS monotonicity_dates, {', '.join(f"(SELECT {R('avg(ret)')} FROM qret WHERE bucket = {k}) AS mean_{k}" for k in range(1, 6))} FROM spread""", "panel", **RCH, spread=SPREAD,
    mono=MONO))
def report_return_risk(spark: SparkSession, sf: str) -> DataFrame:
    r = _report(spark, sf).sections["return_risk"]
    net = {f"net_{c:g}": v for c, v in r["net_by_cost"].items()}
    return _row(spark, {"gross": r["gross"], **net, "aligned": r["aligned"], "monotonicity": r["monotonicity"], "monotonicity_dates": r["monotonicity_dates"]} | {f"mean_{q}": v for q, v in r["bucket_mean"].items()})


@query("report_stability", oracle(f"""SELECT {', '.join(f"{_avg(_rank_corr('factor', f'f{k}'))} AS rho_{k}" for k in (1, 2, 3, 5))}, (SELECT CASE WHEN avg(c) > 0 AND avg(c) < 1 THEN {R('ln(0.5) / ln(avg(c))')} END FROM ({_rank_corr('factor', 'f1')})) AS half_life, {R('avg(t)', 'legs_turnover')},
  {', '.join(R(f'{c} * 0.001::DOUBLE * avg(t) * 252', f'cost_{c}') for c in (1, 2, 4))} FROM (SELECT date, coalesce(t, 0) AS t FROM (SELECT DISTINCT date FROM pairs) LEFT JOIN legs USING (date))""", "panel", **RCH))
def report_stability(spark: SparkSession, sf: str) -> DataFrame:
    r = _report(spark, sf).sections["stability_cost"]
    return _row(spark, {f"rho_{k}": v for k, v in r["rank_autocorrelation"].items()} | {"half_life": r["half_life"], "legs_turnover": r["legs_turnover"]} | {f"cost_{c:g}": v for c, v in r["cost_a_year"].items()})


PURE = {"both_": f"SELECT p.date, p.symbol, p.factor, v.v AS vol, p.fwd FROM pairs p JOIN (SELECT date, symbol, CASE WHEN count(ret) OVER w >= 20 THEN {R('stddev_samp(ret) OVER w')} END AS v FROM ret WINDOW w AS {win(20)}) v USING (date, symbol)", "resid": "SELECT b.date, b.symbol, fwd, CASE WHEN n >= 3 AND sxx > 0 THEN floor((factor - my - sxy / sxx * (vol - mx)) * 1e12 + 0.5) / 1e12 END AS res FROM both_ b JOIN (SELECT date, count(*) AS n, avg(factor) AS my, avg(vol) AS mx, covar_pop(factor, vol) AS sxy, var_pop(vol) AS sxx FROM both_ WHERE factor IS NOT NULL AND vol IS NOT NULL GROUP BY date) s USING (date) WHERE factor IS NOT NULL AND vol IS NOT NULL"}


@query("report_purity", oracle(f"""SELECT {_avg(_rank_corr('factor', 'vol', 'both_'))} AS correlation, {R('avg(c)', 'ic_beside')}, {R('avg(c) / stddev_samp(c)', 'incremental_ir')} FROM ({_rank_corr('res', 'fwd', 'resid')})""", "panel", mom=MOM, pairs=PAIRS, ret=RET, **PURE))
def report_purity(spark: SparkSession, sf: str) -> DataFrame:
    r = _report(spark, sf).sections["purity"]
    return _row(spark, {"correlation": r["correlation"]["vol"], "ic_beside": r["ic_beside"]["vol"], "incremental_ir": r["incremental_ir"]})


_LATE = "r >= DATE '1996-01-01'"
_OOS = ", ".join(R(f"avg(c) FILTER ({when})", name) for name, when in (("train", f"NOT {_LATE}"), ("test", _LATE), ("half_1", f"{_LATE} AND h <= m"), ("half_2", f"{_LATE} AND h > m")))


@query("report_oos", oracle(f"""SELECT {_OOS}, count(c) FILTER (NOT {_LATE}) AS train_periods, count(c) FILTER ({_LATE}) AS test_periods, count(*) FILTER (r IS NULL) AS never_realised FROM
  (SELECT *, row_number() OVER (PARTITION BY {_LATE} ORDER BY date) AS h, count(*) FILTER ({_LATE}) OVER () // 2 AS m FROM (SELECT date, c, lead(date) OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM pairs) LEFT JOIN icr USING (date)))""", "panel", **RCH))
def report_oos(spark: SparkSession, sf: str) -> DataFrame:
    r = _report(spark, sf).sections["oos_generalization"]
    return _row(spark, {k: r[k] for k in ("train", "test", "train_periods", "test_periods", "never_realised")} | {"half_1": r["halves"][0], "half_2": r["halves"][1]})


@query("report_coverage", oracle(f"""SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, {R('1 - count(factor) / count(*)', 'factor_missing')}, count(*) FILTER (i <= 21) AS warm_up_rows, {R('1 - count(factor) FILTER (i > 21) / count(*) FILTER (i > 21)', 'factor_missing_after_warm_up')}, {R('1 - count(fwd) / count(*)', 'return_missing')},
  (SELECT count(c) FROM icr) AS rebalances, (SELECT {R('avg(n)')} FROM sizes) AS size_mean, (SELECT min(n) FROM sizes) AS size_min, (SELECT max(n) FROM sizes) AS size_max, (SELECT {R('median(n)')} FROM sizes) AS size_median, (SELECT date_diff('day', min(date), max(date)) FROM icr WHERE c IS NOT NULL) AS span_days, CAST(2 - count(DISTINCT symbol) FILTER (symbol IN ('P0', 'none')) AS INTEGER) AS dropped
  FROM (SELECT *, row_number() OVER s AS i FROM pairs {W})""", "panel", **RCH, sizes="SELECT date, count(*) FILTER (factor IS NOT NULL AND fwd IS NOT NULL) AS n FROM pairs GROUP BY date"))
def report_coverage(spark: SparkSession, sf: str) -> DataFrame:
    r = _report(spark, sf).sections["data_coverage"]
    keep = ("rows", "symbols", "factor_missing", "warm_up_rows", "factor_missing_after_warm_up", "return_missing", "rebalances", "size_mean", "size_min", "size_max", "size_median", "span_days", "dropped")
    return _row(spark, {k: float(r[k]) if k == "size_median" else r[k] for k in keep}).withColumn("dropped", F.col("dropped").cast("int"))


def _lag_sums(src: str) -> str:
    """SQL of (k, r, n, v): lagged products of deviations of the series (i, c), gaps as zero, over their own square sum."""
    return f"""SELECT a.i - b.i AS k, sum(a.d * b.d) AS r, any_value(a.n) AS n, any_value(a.v) AS v FROM (SELECT *, sum(d * d) OVER () AS v FROM (SELECT row_number() OVER (ORDER BY i) AS i, coalesce(c - m, 0) AS d, n FROM {src}, (SELECT avg(c) AS m, count(c) AS n FROM {src}))) a
      JOIN (SELECT row_number() OVER (ORDER BY i) AS i, coalesce(c - m, 0) AS d FROM {src}, (SELECT avg(c) AS m FROM {src})) b ON a.i > b.i AND a.i - b.i < a.n GROUP BY 1"""


def _n_eff(src: str) -> str:
    return f"""(SELECT CASE WHEN 1 + 2 * s <= 0 THEN n ELSE least(n, greatest(1, n / (1 + 2 * s))) END FROM (SELECT any_value(n) AS n, coalesce(sum(r / v) FILTER (k < cut), 0) AS s FROM
      (SELECT *, coalesce(min(k) FILTER (r <= 0 AND k > floor(4 * (n / 100.0) ** (2 / 9.0))) OVER (), 1000000) AS cut FROM ({_lag_sums(src)}))))"""


def _nw_t(src: str) -> str:
    return f"""(SELECT m / sqrt((v + 2 * s) / n / n) FROM (SELECT any_value(n) AS n, any_value(v) AS v, sum((1 - k / (floor(4 * (n / 100.0) ** (2 / 9.0)) + 1)) * r) AS s FROM ({_lag_sums(src)}) WHERE k <= floor(4 * (n / 100.0) ** (2 / 9.0))), (SELECT avg(c) AS m FROM {src}))"""


_Z = "1.959963984540054::DOUBLE"
_FACTS = f"""SELECT (SELECT avg(c) / stddev_samp(c) FROM icd) AS ir, (SELECT count(c) FROM icd) AS n, {_n_eff('icd')} AS ne, {_n_eff('ick')} AS nk, {_nw_t('icd')} AS t, (SELECT avg(CAST(round(c, 9) > 0 AS INT)) FROM ick) AS win, (SELECT date_diff('day', min(i), max(i)) FROM ick) AS span,
  (SELECT avg(c) FROM mono) AS mm, (SELECT stddev_samp(c) FROM mono) / sqrt({_n_eff('mono')}) AS ms, (SELECT avg(c) / stddev_samp(c) FROM pure) AS pr, {_n_eff('pure')} AS pn, o.* FROM
  (SELECT avg(c) FILTER (NOT {_LATE}) AS train, avg(c) FILTER ({_LATE}) AS test, avg(c) FILTER ({_LATE} AND h <= m) AS h1, avg(c) FILTER ({_LATE} AND h > m) AS h2 FROM (SELECT *, row_number() OVER (PARTITION BY {_LATE} ORDER BY i) AS h, count(*) FILTER ({_LATE}) OVER () // 2 AS m FROM (SELECT i, c, lead(i) OVER (ORDER BY i) AS r FROM icd))) o"""
_AXES = f"""SELECT *, train IS NOT NULL AND test IS NOT NULL AS there, n < 12 OR ne < 24 OR span < 365 AS thin, ir - {_Z} * sqrt((1 + 0.5 * ir * ir) / nk) AS low, pr - {_Z} * sqrt((1 + 0.5 * pr * pr) / pn) AS plow FROM facts"""
_STATES = f"""SELECT *, CASE WHEN there AND test < 0 THEN 'FAIL' WHEN thin OR NOT there THEN 'INSUFFICIENT_DATA' WHEN NOT coalesce(h1 > 0 AND h2 > 0 AND abs(ir) > 0.3 AND abs(t) > 2 AND win > 0.55, false) OR mm + {_Z} * ms < 0 THEN 'FAIL' WHEN NOT mm - {_Z} * ms > 0 THEN 'INSUFFICIENT_DATA' WHEN low > 0.3 THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS predictive,
  CASE WHEN thin OR pr IS NULL THEN 'INSUFFICIENT_DATA' WHEN NOT pr > 0.15 THEN 'FAIL' WHEN plow > 0.15 THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS incremental FROM axes"""


@query("eval_report_row", oracle(f"""SELECT {R('t', 't')}, {R('ne', 'n_eff')}, {R('low', 'icir_low')}, predictive, incremental, 'NOT_ASSESSED' AS tradable,
  CASE WHEN 'FAIL' IN (predictive, incremental) THEN 'Reject' WHEN 'PASS' IN (predictive, incremental) THEN 'Watch' ELSE 'INSUFFICIENT-DATA' END AS decision FROM states""", "panel", **RCH, ret=RET, **PURE,
    icd="SELECT date AS i, c FROM (SELECT DISTINCT date FROM pairs) LEFT JOIN icr USING (date)", ick="SELECT * FROM icd WHERE c IS NOT NULL", mono=f"SELECT date AS i, c FROM ({MONO}) WHERE c IS NOT NULL", pure=f"SELECT date AS i, c FROM ({_rank_corr('res', 'fwd', 'resid')}) WHERE c IS NOT NULL",
    facts=_FACTS, axes=_AXES, states=_STATES))
def eval_report_row(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict, and what it is reached from; its parts have queries with SQL of their own."""
    r = _report(spark, sf)
    return _row(spark, {"t": r.inputs.t, "n_eff": r.inputs.n_eff, "icir_low": r.inputs.icir_ci[0] if r.inputs.icir_ci else None, **{k: r.verdict[k] for k in ("predictive", "incremental", "tradable", "decision")}})


@query("oos_split", oracle(f"SELECT part, {R('avg(ic)', 'mean')}, {R('avg(ic) / stddev_samp(ic)', 'ir')}, count(ic) AS n FROM (SELECT CASE WHEN realized < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS part, ic FROM (SELECT ic, lead(date) OVER (ORDER BY date) AS realized FROM ic) WHERE realized IS NOT NULL) GROUP BY part", "panel", **SPEAR))
def oos_split(spark: SparkSession, sf: str) -> DataFrame:
    """ICs before and after a date, by when they are realised."""
    ic = ev.information_coefficient(pairs(spark, sf))
    ic = ic.withColumn("realized_date", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))).where("realized_date IS NOT NULL")
    s = ev.split_oos(ic, "1999-01-01").groupBy("part").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), F.count("ic").alias("n"))
    return s.select("part", round6(F.col("mean")).alias("mean"), round6(F.try_divide("mean", "sd")).alias("ir"), "n")
