"""Market inputs derived from the driver tables, and the panel / feature queries.

Tickers are part brands. A brand's price is its running revenue over running quantity, kept in integer cents until the
last step so that partial sums are exact whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import features as ft
from strandline.operators import panel
from strandline.plans.registry import ctes, query, rounded, sql_rnd, sql_rounded, stable, staged, table
from strandline.session import spread

INDEX = "ALL"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(index_name, ticker, date, qty, cents, foreign_flow, organ_flow): the one pass over the lines. A line without a part has no
    ticker and counts for the index alone."""
    def build() -> DataFrame:
        lines = table(spark, sf, "lineitem").select(
            "l_partkey", F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("long").alias("qty"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_returnflag")
        parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
        signed = F.when(F.col("l_returnflag") == "R", F.col("qty")).when(F.col("l_returnflag") == "N", -F.col("qty"))
        return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("ticker", "date")
                .agg(F.sum("qty").alias("qty"), F.sum("cents").alias("cents"), F.sum(signed).cast("double").alias("foreign_flow"),
                     F.sum(F.when(F.col("l_returnflag") == "A", F.col("qty"))).cast("double").alias("organ_flow"))
                .select(F.lit(INDEX).alias("index_name"), "*"))

    return staged(spark, sf, "daily_lines", build)


def running_bars(rows: DataFrame, key: str, *others: str) -> DataFrame:
    """Bars from daily (qty, cents): close is the running average price. Other columns named are kept."""
    run = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(key).orderBy("date")
    priced = (rows.withColumn("close", stable(F.sum("cents").over(run) / F.sum("qty").over(run) / 100, 4))
              .withColumn("open", F.lag("close").over(order)))
    return priced.select(key, "date", "open", F.greatest("open", "close").alias("high"),
                         F.least("open", "close").alias("low"), "close", F.col("qty").cast("double").alias("volume"), *others)


def listed(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).where("ticker IS NOT NULL")


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    return running_bars(listed(spark, sf), "ticker", "index_name")


def index_bars(spark: SparkSession, sf: str) -> DataFrame:
    total = daily(spark, sf).groupBy("index_name", "date").agg(F.sum("qty").alias("qty"), F.sum("cents").alias("cents"))
    return running_bars(total, "index_name").select("index_name", "date", "close")


def fx_bars(spark: SparkSession, sf: str) -> DataFrame:
    total = (table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
             .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("qty"))
             .withColumn("index_name", F.lit(INDEX)))
    run = Window.partitionBy("index_name").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return total.select("index_name", "date", stable(F.sum("cents").over(run) / F.sum("qty").over(run) / 100, 4).alias("close"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return listed(spark, sf).select("ticker", "date", F.col("foreign_flow").alias("foreign"), F.col("organ_flow").alias("organ"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return panel.adjust_corporate_actions(raw_bars(spark, sf))


def ready_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Adjusted bars with index, FX, flows and returns attached. The calendar is met first; all that follows runs by ticker under
    one shuffle and one sort."""
    market = panel.align_calendar(listed(spark, sf), [(index_bars(spark, sf), "idx", False), (fx_bars(spark, sf), "fx", True)])
    priced = running_bars(spread(market, "ticker"), "ticker", "index_name", "idx", "fx", "foreign_flow", "organ_flow")
    return panel.log_returns(panel.adjust_corporate_actions(priced))


# ---- the same inputs in SQL --------------------------------------------------------------------------------------

SQL_RAW = f"""
daily AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) WHEN l_returnflag = 'N' THEN -CAST(l_quantity AS BIGINT) END) AS DOUBLE) AS foreign_flow,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) AS organ_flow
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
closes AS (SELECT *, {sql_rnd("CAST(sum(cents) OVER r AS DOUBLE) / CAST(sum(qty) OVER r AS DOUBLE) / 100", 4)} AS close
  FROM daily WINDOW r AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)),
opened AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS open FROM closes),
raw_bars AS (SELECT ticker, date, open, greatest(open, close) AS high, least(open, close) AS low, close,
  CAST(qty AS DOUBLE) AS volume, foreign_flow, organ_flow FROM opened)
"""
_NEAR = " OR ".join(f"abs(size / {f} - 1) <= {panel.SPLIT_TOLERANCE}" for f in panel.SPLIT_FACTORS)
SQL_BARS = SQL_RAW.strip() + f""",
ratios AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) AS ratio FROM raw_bars),
sized AS (SELECT *, CASE WHEN ratio < 1 THEN 1 / ratio ELSE ratio END AS size FROM ratios),
kinds AS (SELECT *, CASE WHEN ratio > {panel.JUMP_UP} OR ratio < {panel.JUMP_DOWN} THEN CASE WHEN {_NEAR} THEN 'split' ELSE 'reset' END END AS kind FROM sized),
cut AS (SELECT *, max(CASE WHEN kind = 'reset' THEN date END) OVER (PARTITION BY ticker) AS truncated_before FROM kinds),
kept AS (SELECT *, CASE WHEN kind = 'split' THEN ratio END AS split_ratio FROM cut WHERE truncated_before IS NULL OR date >= truncated_before),
factored AS (SELECT *, coalesce(product(coalesce(split_ratio, 1.0)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS factor FROM kept),
bars AS (SELECT ticker, date, open * factor AS open, high * factor AS high, low * factor AS low, close * factor AS close,
  volume / factor AS volume, foreign_flow, organ_flow, split_ratio, truncated_before FROM factored)
"""
SQL_INDEX = f"""
index_daily AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(CAST(l_quantity AS BIGINT)) AS qty,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1),
index_bars AS (SELECT date, {sql_rnd("CAST(sum(cents) OVER r AS DOUBLE) / CAST(sum(qty) OVER r AS DOUBLE) / 100", 4)} AS close
  FROM index_daily WINDOW r AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
fx_daily AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS qty FROM orders GROUP BY 1),
fx_bars AS (SELECT date, {sql_rnd("CAST(sum(cents) OVER r AS DOUBLE) / CAST(sum(qty) OVER r AS DOUBLE) / 100", 4)} AS close
  FROM fx_daily WINDOW r AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
"""
SQL_READY = SQL_BARS.strip() + "," + SQL_INDEX + """,
with_idx AS (SELECT b.*, i.close AS idx FROM bars b ASOF LEFT JOIN index_bars i ON b.date >= i.date),
with_fx AS (SELECT b.*, f.close AS fx FROM with_idx b ASOF LEFT JOIN fx_bars f ON b.date > f.date),
ready AS (SELECT *, ln(close / lag(close) OVER o) AS ret,
  CASE WHEN idx > 0 AND lag(idx) OVER o > 0 THEN ln(idx / lag(idx) OVER o) END AS idx_ret
  FROM with_fx WINDOW o AS (PARTITION BY ticker ORDER BY date))
"""


def _w(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _back(c: str, n: int) -> str:
    lag = f"lag({c}, {n}) OVER (PARTITION BY ticker ORDER BY date)"
    return f"CASE WHEN {c} > 0 AND {lag} > 0 THEN ln({c} / {lag}) END"


_PAIR_Y = "CASE WHEN ret IS NOT NULL AND idx_ret IS NOT NULL THEN ret END"
_PAIR_X = "CASE WHEN ret IS NOT NULL AND idx_ret IS NOT NULL THEN idx_ret END"
_SQL_FEATURES = {
    **{f"ret{n}": _back("close", n) for n in (1, 2, 3, 5, 10, 20, 60)},
    **{f"ma{n}Gap": f"CASE WHEN row >= {n} THEN close / avg(close) {_w(n)} - 1 END" for n in (5, 20, 60)},
    **{f"idxRet{n}": _back("idx", n) for n in (1, 5, 20, 60)},
    **{f"fxRet{n}": _back("fx", n) for n in (1, 5, 20)},
    "rsi14": "CASE WHEN row >= 15 THEN coalesce(gain / nullif(gain + loss, 0) - 0.5, 0.0) END",
    "range1": "(high - low) / close",
    "closeLoc": "CASE WHEN high > low THEN (2 * close - low - high) / (high - low) END",
    "gap1": "ln(open / lag(close) OVER (PARTITION BY ticker ORDER BY date))",
    "volume1": "CASE WHEN volume > 0 THEN ln(volume / avgvol) END",
    "volume5": "ln(avgvol5 / avgvol)",
    "high120Gap": "ln(close / hi)",
    "low120Gap": "ln(close / lo)",
    "downStreak": "CAST(least(row - last_not_down, 10) AS DOUBLE)",
    "upStreak": "CAST(least(row - last_not_up, 10) AS DOUBLE)",
    "idxMa60Gap": f"CASE WHEN row >= 60 AND idx > 0 AND count(CASE WHEN idx > 0 THEN idx END) {_w(60)} >= 50 THEN idx / avg(CASE WHEN idx > 0 THEN idx END) {_w(60)} - 1 END",
    **{f"{who}{n}": f"CASE WHEN count({who}_flow) {_w(n)} = {n} THEN sum({who}_flow) {_w(n)} END / (avgvol * {n})"
       for who in ("foreign", "organ") for n in (1, 5)},
}
SQL_FEATURES = SQL_READY.strip() + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS row FROM ready),
stats AS (SELECT *,
  stddev_samp(ret) {_w(5)} AS vol5, stddev_samp(ret) {_w(20)} AS vol20, stddev_samp(idx_ret) {_w(20)} AS "idxVol20",
  CASE WHEN count(CASE WHEN volume > 0 THEN volume END) {_w(20)} >= 10 THEN avg(CASE WHEN volume > 0 THEN volume END) {_w(20)} END AS avgvol,
  CASE WHEN count(CASE WHEN volume > 0 THEN volume END) {_w(5)} >= 3 THEN avg(CASE WHEN volume > 0 THEN volume END) {_w(5)} END AS avgvol5,
  sum(greatest(ret, 0.0)) {_w(14)} AS gain, sum(greatest(-ret, 0.0)) {_w(14)} AS loss,
  CASE WHEN regr_count({_PAIR_Y}, {_PAIR_X}) {_w(60)} >= 30 THEN regr_slope({_PAIR_Y}, {_PAIR_X}) {_w(60)} END AS beta60,
  max(coalesce(high, close)) {_w(120)} AS hi, min(coalesce(low, close)) {_w(120)} AS lo,
  max(CASE WHEN NOT coalesce(ret < 0, false) THEN row END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS last_not_down,
  max(CASE WHEN NOT coalesce(ret > 0, false) THEN row END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS last_not_up
  FROM numbered),
feat1 AS (SELECT *, {", ".join(f'{e} AS "{n}"' for n, e in _SQL_FEATURES.items())} FROM stats),
features AS (SELECT *, vol5 / nullif(vol20, 0) AS "volRatio", ret1 / nullif(vol20, 0) AS z1, ret5 / nullif(vol20 * sqrt(5.0), 0) AS z5,
  ret1 - coalesce(beta60, 1.0) * "idxRet1" AS excess1, ret5 - coalesce(beta60, 1.0) * "idxRet5" AS excess5 FROM feat1)
"""
_LEAD = "OVER (PARTITION BY ticker ORDER BY date)"
SQL_SAMPLES = SQL_FEATURES.strip() + f""",
labelled AS (SELECT *, {", ".join(f"ln(lead(close, {h}) {_LEAD} / close) AS fwd{h}, lead(date, {h}) {_LEAD} AS end{h}" for h in ft.HORIZONS)} FROM features),
sample_rows AS (SELECT * FROM labelled WHERE row >= {panel.MIN_HISTORY}),
peers AS (SELECT date, avg(ret1) AS "peerRet1", avg(ret5) AS "peerRet5", avg(CASE WHEN ret1 > 0 THEN 1.0 ELSE 0.0 END) AS "peerUpShare", count(*) AS n_peers
  FROM sample_rows WHERE ret1 IS NOT NULL AND ret5 IS NOT NULL GROUP BY date HAVING count(*) >= 3),
samples AS (SELECT s.*, p."peerRet1", p."peerRet5", p."peerUpShare", s.ret1 - p."peerRet1" AS "relRet1", s.ret5 - p."peerRet5" AS "relRet5",
  CASE WHEN dayofweek(s.date) = 1 THEN 1.0 ELSE 0.0 END AS monday, CASE WHEN dayofweek(s.date) = 5 THEN 1.0 ELSE 0.0 END AS friday,
  CASE WHEN day(s.date) >= 26 THEN 1.0 ELSE 0.0 END AS "monthEnd", CASE WHEN day(s.date) <= 3 THEN 1.0 ELSE 0.0 END AS "monthStart"
  FROM sample_rows s LEFT JOIN peers p ON s.date = p.date)
"""


# ---- queries -----------------------------------------------------------------------------------------------------

_BAR_VALUES = ["open", "high", "low", "close", "volume"]


@query("bars_source", ctes(SQL_RAW) + sql_rounded(["ticker", "date"], _BAR_VALUES, "raw_bars", 4))
def bars_source(spark, sf):
    return rounded(raw_bars(spark, sf), ["ticker", "date"], _BAR_VALUES, 4)


@query("index_fx_source", ctes(SQL_INDEX) + f"SELECT 'index' AS series, date, {sql_rnd('close', 4)} AS close FROM index_bars UNION ALL SELECT 'fx', date, {sql_rnd('close', 4)} FROM fx_bars")
def index_fx_source(spark, sf):
    both = (index_bars(spark, sf).select(F.lit("index").alias("series"), "date", "close")
            .unionByName(fx_bars(spark, sf).select(F.lit("fx").alias("series"), "date", "close")))
    return rounded(both, ["series", "date"], ["close"], 4)


@query("flows_source", ctes(SQL_RAW) + 'SELECT ticker, date, foreign_flow AS "foreign", organ_flow AS organ FROM raw_bars')
def flows_source(spark, sf):
    return flows(spark, sf)


@query("last_arrival_bars", f"""
WITH a AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {sql_rnd("l_extendedprice / l_quantity", 4)} AS close FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM a)
SELECT ticker, date, close, l_orderkey FROM n WHERE rn = 1""")
def last_arrival_bars(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                "l_extendedprice", "l_quantity", "l_shipdate")
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    ticks = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "ticker", F.to_date("l_shipdate").alias("date"), "l_orderkey",
        stable(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("close"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ingest_seq"))
    return panel.last_arrival(ticks).select("ticker", "date", "close", "l_orderkey")


@query("unfinished_session", ctes(SQL_RAW) + f"""
, last_day AS (SELECT max(date) AS d FROM raw_bars)
SELECT ticker, date, {sql_rnd("close", 4)} AS close FROM raw_bars, last_day WHERE NOT date = d""")
def unfinished_session(spark, sf):
    """'Now' is 15:39 in Korea on the last day of the data: that day's bars are not final."""
    data = raw_bars(spark, sf)
    last = table(spark, sf, "lineitem").agg(F.to_date(F.max("l_shipdate"))).first()[0]
    now = F.to_utc_timestamp(F.lit(f"{last} 15:39:00").cast("timestamp"), "Asia/Seoul")
    return rounded(panel.drop_unfinished_session(data, now), ["ticker", "date"], ["close"], 4)


@query("corporate_actions", ctes(SQL_BARS) + sql_rounded(["ticker", "date", "truncated_before"], _BAR_VALUES + ["split_ratio"], "bars", 4))
def corporate_actions(spark, sf):
    return rounded(bars(spark, sf), ["ticker", "date", "truncated_before"], _BAR_VALUES + ["split_ratio"], 4)


@query("asof_alignment", ctes(SQL_READY) + sql_rounded(["ticker", "date"], ["idx", "fx", "foreign_flow", "organ_flow", "ret", "idx_ret"], "ready", 8))
def asof_alignment(spark, sf):
    return rounded(ready_bars(spark, sf), ["ticker", "date"], ["idx", "fx", "foreign_flow", "organ_flow", "ret", "idx_ret"], 8)


@query("panel_features", ctes(SQL_FEATURES) + sql_rounded(["ticker", "date", "row"], list(ft.FEATURES), "features"))
def panel_features(spark, sf):
    return rounded(ft.features(ready_bars(spark, sf)), ["ticker", "date", F.col("row").cast("long").alias("row")], list(ft.FEATURES))


_SAMPLE_VALUES = [*ft.CROSS_FEATURES, "fwd1", "fwd2", "fwd3", "vol20", "ret1", "beta60"]


@query("samples", ctes(SQL_SAMPLES) + sql_rounded(["ticker", "date", "end1", "end2", "end3"], _SAMPLE_VALUES, "samples"))
def samples_query(spark, sf):
    return rounded(ft.samples(ready_bars(spark, sf)), ["ticker", "date", "end1", "end2", "end3"], _SAMPLE_VALUES)


@query("peer_statistics", ctes(SQL_SAMPLES) + "SELECT date, n_peers, " + ", ".join(f'{sql_rnd(chr(34) + c + chr(34), 8)} AS "{c}"' for c in ("peerRet1", "peerRet5", "peerUpShare")) + " FROM peers")
def peer_statistics(spark, sf):
    rows = ft.features(ready_bars(spark, sf)).where(F.col("row") >= panel.MIN_HISTORY)
    return rounded(ft.peer_statistics(rows), ["date", "n_peers"], ["peerRet1", "peerRet5", "peerUpShare"], 8)


@query("volatility_scale", ctes(SQL_SAMPLES) + ", hz AS (SELECT unnest([1, 2, 3]) AS horizon) SELECT ticker, date, horizon, "
       + sql_rnd("coalesce(CASE WHEN vol20 IS NOT NULL THEN greatest(vol20, 0.003) END, 0.02) * sqrt(horizon)", 8) + " AS scale FROM samples, hz")
def volatility_scale(spark, sf):
    rows = ft.samples(ready_bars(spark, sf)).select("ticker", "date", "vol20",
                                                    F.explode(F.array(*[F.lit(h) for h in ft.HORIZONS])).alias("horizon"))
    return rows.select("ticker", "date", "horizon", stable(ft.volatility_scale(F.col("horizon")), 8).alias("scale"))


@query("history_gate", ctes(SQL_BARS) + f"SELECT ticker, count(*) AS sessions, count(*) > {panel.MIN_HISTORY} AS enough FROM bars GROUP BY ticker")
def history_gate(spark, sf):
    return panel.enough_history(bars(spark, sf))


@query("fill_profile", ctes(SQL_BARS) + """SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(open) AS n_open,
  count(high) AS n_high, count(low) AS n_low, count(volume) AS n_volume, count(foreign_flow) AS n_foreign_flow, count(organ_flow) AS n_organ_flow FROM bars GROUP BY ticker""")
def fill_profile(spark, sf):
    return panel.fill_profile(panel.join_flows(bars(spark, sf), flows(spark, sf)))


@query("peer_pool", """
WITH u AS (SELECT c_custkey AS ticker, c_mktsegment AS exchange, c_acctbal AS market_cap FROM customer),
t AS (SELECT exchange, ticker AS peer, market_cap, row_number() OVER (PARTITION BY exchange ORDER BY market_cap DESC, ticker) AS r FROM u),
p AS (SELECT u.ticker, u.exchange, t.peer, t.market_cap, row_number() OVER (PARTITION BY u.ticker ORDER BY t.r) AS peer_rank
  FROM u JOIN t ON u.exchange = t.exchange AND t.peer <> u.ticker WHERE t.r <= 21)
SELECT * FROM p WHERE peer_rank <= 20""")
def peer_pool(spark, sf):
    universe = table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("exchange"),
                                                   F.col("c_acctbal").alias("market_cap"))
    return panel.peer_pool(universe, universe, 20).withColumn("peer_rank", F.col("peer_rank").cast("long"))


def momentum_rows(spark, sf) -> DataFrame:
    """Long (ticker, date, horizon) rows with the past and the realised move."""
    order = Window.partitionBy("ticker").orderBy("date")
    data = ft.labels(bars(spark, sf).withColumns({
        f"ret{h}": F.ln(F.col("close") / F.lag("close", h).over(order)) for h in ft.HORIZONS}))
    return data.select("ticker", "date", F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"ret{h}").alias("past"), F.col(f"fwd{h}").alias("actual"))
        for h in ft.HORIZONS])).alias("m")).select("ticker", "date", "m.*").where(F.col("actual").isNotNull())


@query("momentum_baseline", ctes(SQL_SAMPLES) + ", m AS (" + " UNION ALL ".join(
    f"SELECT ticker, date, {h} AS horizon, ret{h} AS past, fwd{h} AS actual FROM labelled WHERE fwd{h} IS NOT NULL" for h in ft.HORIZONS) + f""")
SELECT horizon, coalesce(ticker, 'ALL') AS ticker, count(*) AS n, {sql_rnd("avg(CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END)")} AS always_up,
  {sql_rnd("avg(CASE WHEN past <> 0 THEN CASE WHEN (past > 0) = (actual > 0) THEN 1.0 ELSE 0.0 END END)")} AS momentum
FROM m GROUP BY GROUPING SETS ((horizon), (horizon, ticker))""")
def momentum_baseline(spark, sf):
    """How often the last h-session direction continues, per ticker and overall."""
    up = F.when(F.col("actual") > 0, 1.0).otherwise(0.0)
    hit = F.when(F.col("past") != 0, F.when((F.col("past") > 0) == (F.col("actual") > 0), 1.0).otherwise(0.0))
    return (momentum_rows(spark, sf)
            .groupingSets([["horizon"], ["horizon", "ticker"]], "horizon", "ticker")
            .agg(F.count("*").alias("n"), stable(F.avg(up)).alias("always_up"), stable(F.avg(hit)).alias("momentum"))
            .select("horizon", F.coalesce("ticker", F.lit("ALL")).alias("ticker"), "n", "always_up", "momentum"))
