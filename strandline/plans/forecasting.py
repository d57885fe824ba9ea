"""Walk-forward, backtest, forecast and log-scoring queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import clamp, floor_quantile
from strandline.operators import backtest as bt
from strandline.operators import features as ft
from strandline.operators import folds as fd
from strandline.operators import forecast as fc
from strandline.operators import panel
from strandline.plans import market as mk
from strandline.plans.registry import ctes, query, rounded, sql_rnd, stable, staged, table
from strandline.session import stage, stage_dir
from strandline.sources import publish as pb

def sample_rows(spark, sf) -> DataFrame:
    return staged(spark, sf, "samples", lambda: fd.long_samples(ft.samples(mk.ready_bars(spark, sf))))


def first_stage(spark, sf) -> DataFrame:
    return staged(spark, sf, "oos", lambda: fd.walk_forward(sample_rows(spark, sf)))


def second_stage(spark, sf) -> DataFrame:
    return staged(spark, sf, "stacked", lambda: fd.stack(first_stage(spark, sf)))


# ---- folds -------------------------------------------------------------------------------------------------------

SQL_LONG = mk.SQL_SAMPLES.strip() + ", long_rows AS (" + " UNION ALL ".join(
    f"SELECT ticker, date, {h} AS horizon, fwd{h} AS fwd, end{h} AS end_date, ret{h} AS past, ret1, close, vol20, "
    f"coalesce(CASE WHEN vol20 IS NOT NULL THEN greatest(vol20, 0.003) END, 0.02) * sqrt({h}.0) AS scale FROM samples"
    for h in ft.HORIZONS) + ")"


def sql_schedule(source: str, min_known: int, strict: bool, name: str, step: int = 20) -> str:
    op = "<" if strict else "<="
    return f"""
{name}_dates AS (SELECT DISTINCT horizon, date FROM {source}),
{name}_ends AS (SELECT horizon, end_date, count(*) AS n FROM {source} WHERE end_date IS NOT NULL GROUP BY 1, 2),
{name}_known AS (SELECT d.horizon, d.date, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS known, row_number() OVER (PARTITION BY d.horizon ORDER BY d.date) AS i
  FROM {name}_dates d LEFT JOIN {name}_ends e ON e.horizon = d.horizon AND e.end_date {op} d.date GROUP BY d.horizon, d.date),
{name}_first AS (SELECT horizon, min(i) AS i0 FROM {name}_known WHERE known >= {min_known} GROUP BY horizon),
{name} AS (SELECT k.horizon, k.date, k.known, CAST(floor((i - i0) / {step}.0) AS INTEGER) AS fold,
  min(date) OVER (PARTITION BY k.horizon, floor((i - i0) / {step}.0)) AS fold_date FROM {name}_known k JOIN {name}_first f ON k.horizon = f.horizon WHERE i >= i0),
{name}_folds AS (SELECT * FROM {name} WHERE date = fold_date)
"""


SQL_FOLDS = SQL_LONG + "," + sql_schedule("long_rows", 250, False, "sched")


@query("fold_schedule", ctes(SQL_FOLDS) + "SELECT * FROM sched")
def fold_schedule(spark, sf):
    return fd.fold_schedule(sample_rows(spark, sf), 250, 20)


SQL_WINDOWS = SQL_FOLDS.strip() + """,
ranked AS (SELECT l.*, f.fold, f.fold_date, row_number() OVER (PARTITION BY l.horizon, f.fold ORDER BY l.date DESC, l.ticker DESC) AS rk
  FROM long_rows l JOIN sched_folds f ON l.horizon = f.horizon AND l.end_date <= f.fold_date),
windows AS (SELECT * FROM ranked WHERE rk <= 6000 AND fwd <> 0),
aged AS (SELECT *, dense_rank() OVER (PARTITION BY horizon, fold ORDER BY date DESC) - 1 AS age FROM windows),
spread AS (SELECT *, count(*) OVER (PARTITION BY horizon, fold) AS m, 1 + max(age) OVER (PARTITION BY horizon, fold) AS nd FROM aged),
raws AS (SELECT *, pow(0.5, age / greatest(120.0, 1500.0 / (2.885 * m / nd))) AS raw FROM spread),
weighted AS (SELECT *, raw / avg(raw) OVER (PARTITION BY horizon, fold) AS weight FROM raws)
"""


@query("training_windows", ctes(SQL_WINDOWS) + f"""SELECT horizon, fold, count(*) AS n, min(date) AS first_date, max(date) AS last_date, max(end_date) AS last_end,
  {sql_rnd("min(weight)")} AS min_weight, {sql_rnd("max(weight)")} AS max_weight, {sql_rnd("sum(weight * past)", 4)} AS weighted_past FROM weighted GROUP BY 1, 2""")
def training_windows(spark, sf):
    rows = sample_rows(spark, sf)
    folds = fd.fold_table(fd.fold_schedule(rows, 250, 20))
    windows = fd.recency_weights(fd.training_windows(rows, folds, 6000).where(F.col("fwd") != 0), 120.0)
    return windows.groupBy("horizon", "fold").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max("end_date").alias("last_end"), stable(F.min("weight")).alias("min_weight"), stable(F.max("weight")).alias("max_weight"),
        stable(F.sum(F.col("weight") * F.col("past")), 4).alias("weighted_past"))


@query("robust_scaler", ctes(SQL_WINDOWS) + f""", v AS (SELECT horizon, fold, list_sort(list(past) FILTER (WHERE past IS NOT NULL)) AS xs, stddev_samp(past) AS sd,
  quantile_cont(fwd / scale, 0.01) AS lo, quantile_cont(fwd / scale, 0.99) AS hi FROM windows GROUP BY 1, 2),
q AS (SELECT *, xs[CAST(floor(0.5 * (len(xs) - 1)) AS INTEGER) + 1] AS med, (xs[CAST(floor(0.75 * (len(xs) - 1)) AS INTEGER) + 1] - xs[CAST(floor(0.25 * (len(xs) - 1)) AS INTEGER) + 1]) / 1.349 AS iqr FROM v)
SELECT horizon, fold, {sql_rnd("med", 9)} AS center, {sql_rnd("CASE WHEN iqr > 1e-12 THEN iqr WHEN sd > 1e-12 THEN sd ELSE 1.0 END", 9)} AS spread, {sql_rnd("lo")} AS target_lo, {sql_rnd("hi")} AS target_hi FROM q""")
def robust_scaler(spark, sf):
    """Scaler of one feature and the winsorising limits of the target, per training window (at most 6000 rows each)."""
    rows = sample_rows(spark, sf)
    folds = fd.fold_table(fd.fold_schedule(rows, 250, 20))
    windows = fd.training_windows(rows, folds, 6000).where(F.col("fwd") != 0)
    unit = F.col("fwd") / F.col("scale")
    agg = windows.groupBy("horizon", "fold").agg(
        floor_quantile("past", 0.5).alias("med"), ((floor_quantile("past", 0.75) - floor_quantile("past", 0.25)) / 1.349).alias("iqr"),
        F.stddev_samp("past").alias("sd"), F.percentile(unit, F.lit(0.01)).alias("lo"), F.percentile(unit, F.lit(0.99)).alias("hi"))
    spread = F.when(F.col("iqr") > 1e-12, F.col("iqr")).when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    return agg.select("horizon", "fold", stable("med", 9).alias("center"), stable(spread, 9).alias("spread"),
                      stable("lo").alias("target_lo"), stable("hi").alias("target_hi"))


_OOS_VALUES = ["p", "pg", "r", "base_rate", "actual", "past", "scale"]


@query("walk_forward")
def walk_forward(spark, sf):
    return rounded(first_stage(spark, sf), ["horizon", "ticker", "date", "end_date"], _OOS_VALUES)


@query("stacked_walk_forward")
def stacked_walk_forward(spark, sf):
    return rounded(second_stage(spark, sf), ["horizon", "ticker", "date", "end_date"], _OOS_VALUES)


@query("model_backtest")
def model_backtest(spark, sf):
    stats = bt.backtest_stats(second_stage(spark, sf))
    return stats.join(bt.range_coverage(second_stage(spark, sf)), ["horizon", "ticker"], "left")


@query("platt_calibration")
def platt_calibration(spark, sf):
    return bt.platt(second_stage(spark, sf))


def forecasts(spark, sf) -> DataFrame:
    def build():
        stacked = second_stage(spark, sf)
        return fc.forecast_rows(sample_rows(spark, sf), first_stage(spark, sf), stacked, bt.range_coverage(stacked),
                                bt.backtest_stats(stacked))
    return staged(spark, sf, "forecasts", build)


@query("forecast_ranking")
def forecast_ranking(spark, sf):
    return fc.ranking(forecasts(spark, sf), 1)


@query("forecast_log")
def forecast_log(spark, sf):
    return fc.log_records(forecasts(spark, sf), "2024-01-01 00:00:00")


@query("single_target_forecast")
def single_target_forecast(spark, sf):
    """One ticker with an explicit peer pool: the same pipeline on the pool's rows, forecasts of the target only."""
    target, pool = "Brand#11", ["Brand#11", "Brand#12", "Brand#13", "Brand#14"]
    rows = stage(fd.long_samples(ft.samples(mk.ready_bars(spark, sf).where(F.col("ticker").isin(pool)))), "pool")
    first = stage(fd.walk_forward(rows), "pool-oos")
    stacked = stage(fd.stack(first), "pool-stacked")
    wanted = rows.where(F.col("ticker") == target).select("ticker").distinct()
    return fc.forecast_rows(rows, first, stacked, bt.range_coverage(stacked), bt.backtest_stats(stacked), wanted)


# ---- statistics on a rule-based prediction table (exact in SQL) ------------------------------------------------------


def rule_predictions(spark, sf) -> DataFrame:
    """The last h-session move, in volatility units, as the prediction."""
    def build():
        rows = sample_rows(spark, sf).where(F.col("fwd").isNotNull() & F.col("past").isNotNull())
        z = F.col("past") / F.col("scale")
        return rows.select("horizon", "ticker", "date", "end_date", "scale", F.col("fwd").alias("actual"), "past", "ret1",
                           (0.5 + clamp(z, -4, 4) / 10).alias("p"), (0.5 + clamp(z, -4, 4) / 10).alias("pg"),
                           (F.col("past") * 0.2).alias("r"), F.lit(0.5).alias("base_rate"))
    return staged(spark, sf, "rule", build)


SQL_RULE = SQL_LONG + """, oos AS (SELECT horizon, ticker, date, end_date, scale, fwd AS actual, past, ret1,
  0.5 + least(4.0, greatest(-4.0, past / scale)) / 10 AS p, past * 0.2 AS r, 0.5 AS base_rate FROM long_rows WHERE fwd IS NOT NULL AND past IS NOT NULL)"""

_UP = "CASE WHEN actual > 0 THEN 1.0 ELSE 0.0 END"
_PCT_A, _PCT_R = "(exp(actual) - 1) * 100", "(exp(r) - 1) * 100"


def _sql_p(hits: str, n: str, p0: str) -> str:
    z = f"((({hits}) - {n} * {p0}) / sqrt({n} * {p0} * (1 - {p0})) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * abs({z})))"
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z})"
    return f"0.5 * (CASE WHEN {z} >= 0 THEN {poly} ELSE 2 - {poly} END)"


SQL_STATS = f"""
agg AS (SELECT horizon, coalesce(ticker, 'ALL') AS ticker, count(*) AS n, min(date) AS from_date, max(date) AS to_date,
  avg(CASE WHEN (p > 0.5) = (actual > 0) THEN 1.0 ELSE 0.0 END) AS accuracy, avg({_UP}) AS always_up_accuracy,
  avg(CASE WHEN past <> 0 THEN CASE WHEN (past > 0) = (actual > 0) THEN 1.0 ELSE 0.0 END END) AS momentum_accuracy,
  avg(pow(p - {_UP}, 2)) AS brier, avg(pow(base_rate - {_UP}, 2)) AS brier_base_rate, avg(abs({_PCT_R} - {_PCT_A})) AS mean_abs_error_pct,
  avg(abs({_PCT_A})) AS zero_forecast_mae_pct, avg(CASE WHEN p > 0.5 THEN {_PCT_A} END) - avg(CASE WHEN p <= 0.5 THEN {_PCT_A} END) AS up_down_spread_pct
  FROM oos GROUP BY GROUPING SETS ((horizon), (horizon, ticker))),
eff AS (SELECT *, greatest(1.0, floor(n / horizon)) AS n_eff, greatest(0.5, always_up_accuracy, 1 - always_up_accuracy) AS climate FROM agg),
pv AS (SELECT *, {_sql_p("accuracy * n_eff", "n_eff", "0.5")} AS p_value_vs_coin, {_sql_p("accuracy * n_eff", "n_eff", "climate")} AS p_value_vs_climatology,
  {_sql_p("accuracy * n_eff", "n_eff", "greatest(climate, coalesce(momentum_accuracy, 0.0))")} AS p_value_vs_best_baseline FROM eff),
duo AS (SELECT *, ticker AS grp FROM oos UNION ALL SELECT *, 'ALL' FROM oos),
conf_r AS (SELECT *, row_number() OVER (PARTITION BY horizon, grp ORDER BY abs(p - 0.5) DESC, date, ticker) AS rn, count(*) OVER (PARTITION BY horizon, grp) AS m FROM duo),
conf AS (SELECT horizon, grp AS ticker, count(*) AS confident_n, avg(CASE WHEN (p > 0.5) = (actual > 0) THEN 1.0 ELSE 0.0 END) AS confident_accuracy FROM conf_r WHERE rn <= greatest(1, floor(m * 0.3)) GROUP BY 1, 2)
"""
_STAT_VALUES = ["accuracy", "always_up_accuracy", "momentum_accuracy", "brier", "brier_base_rate", "mean_abs_error_pct",
                "zero_forecast_mae_pct", "up_down_spread_pct", "p_value_vs_coin", "p_value_vs_climatology",
                "p_value_vs_best_baseline", "confident_accuracy"]


@query("backtest_statistics", ctes(SQL_RULE, SQL_STATS) + f"""SELECT horizon, ticker, n, from_date, to_date, confident_n,
  CASE WHEN n_eff >= 100 AND p_value_vs_climatology < 0.05 AND brier < brier_base_rate THEN 'detected' ELSE 'none' END AS edge,
  {", ".join(f"{sql_rnd(c)} AS {c}" for c in _STAT_VALUES)} FROM pv JOIN conf USING (horizon, ticker)""")
def backtest_statistics(spark, sf):
    stats = bt.backtest_stats(rule_predictions(spark, sf))
    return rounded(stats, ["horizon", "ticker", "n", "from_date", "to_date", "confident_n", "edge"], _STAT_VALUES)


@query("reliability_table", ctes(SQL_RULE) + f"""SELECT horizon, coalesce(ticker, 'ALL') AS ticker, bin, count(*) AS n, {sql_rnd("avg(p)")} AS mean_predicted, {sql_rnd(f"avg({_UP})")} AS actual_up_rate
FROM (SELECT *, CASE WHEN p < 0.45 THEN 0 WHEN p < 0.5 THEN 1 WHEN p < 0.55 THEN 2 ELSE 3 END AS bin FROM oos) GROUP BY GROUPING SETS ((horizon, bin), (horizon, ticker, bin))""")
def reliability_table(spark, sf):
    return rounded(bt.reliability(rule_predictions(spark, sf)), ["horizon", "ticker", "bin", "n"], ["mean_predicted", "actual_up_rate"])


def sql_calibration(rows: str, keys: str, name: str) -> str:
    return f"""
{name}_line AS (SELECT {keys}, count(*) AS n, least(1.0, greatest(0.0, coalesce(regr_slope(actual / scale, r / scale), 0.0))) AS slope, avg(r / scale) AS mx, avg(actual / scale) AS my FROM {rows} GROUP BY {keys} HAVING count(*) >= 100),
{name} AS (SELECT {keys}, any_value(l.n) AS n, any_value(slope) AS slope, any_value(my - slope * mx) AS icpt,
  quantile_cont(actual / scale - (my - slope * mx + slope * (r / scale)), 0.1) AS q_lo, quantile_cont(actual / scale - (my - slope * mx + slope * (r / scale)), 0.9) AS q_hi
  FROM {rows} JOIN {name}_line l USING ({keys}) GROUP BY {keys})"""


@query("return_calibration", ctes(SQL_RULE, sql_calibration("oos", "horizon", "cal")) + "SELECT horizon, n, " + ", ".join(f"{sql_rnd(c)} AS {c}" for c in ("slope", "icpt", "q_lo", "q_hi")) + " FROM cal")
def return_calibration(spark, sf):
    return rounded(bt.calibrate_returns(rule_predictions(spark, sf), ["horizon"]), ["horizon", "n"], ["slope", "icpt", "q_lo", "q_hi"])


@query("range_coverage", ctes(SQL_RULE, sql_schedule("oos", 100, True, "cs"),
                              "known AS (SELECT o.*, f.fold FROM oos o JOIN cs_folds f ON o.horizon = f.horizon AND o.end_date < f.fold_date)",
                              sql_calibration("known", "horizon, fold", "band")) + f"""
SELECT horizon, coalesce(ticker, 'ALL') AS ticker, count(*) AS coverage_n, {sql_rnd("avg(CASE WHEN actual / scale BETWEEN icpt + slope * (r / scale) + q_lo AND icpt + slope * (r / scale) + q_hi THEN 1.0 ELSE 0.0 END)")} AS range80_coverage
FROM (SELECT o.horizon, o.ticker, o.actual, o.scale, o.r, b.icpt, b.slope, b.q_lo, b.q_hi FROM oos o JOIN cs s ON o.horizon = s.horizon AND o.date = s.date JOIN band b ON b.horizon = s.horizon AND b.fold = s.fold)
GROUP BY GROUPING SETS ((horizon), (horizon, ticker))""")
def range_coverage(spark, sf):
    return rounded(bt.range_coverage(rule_predictions(spark, sf)), ["horizon", "ticker", "coverage_n"], ["range80_coverage"])


# ---- log ---------------------------------------------------------------------------------------------------------


def rule_log(spark, sf) -> DataFrame:
    """Forecast records made by the last-move rule at every session; each is logged twice, the second one counts."""
    data = mk.bars(spark, sf).select("ticker", "date", "close")
    order = Window.partitionBy("ticker").orderBy("date")
    moved = data.withColumn("move", F.coalesce(F.col("close") / F.lag("close").over(order) - 1, F.lit(0.0)) * 100)
    up = F.col("move") > 0
    entries = F.array(*[F.struct(
        F.lit(h).alias("horizon"), F.when(up, 0.5 + 0.05 * h).otherwise(0.5 - 0.05 * h).alias("probability_up"),
        F.when(up, "up").otherwise("down").alias("direction"),
        F.when(F.abs("move") > 0.1, "high").when(F.abs("move") > 0.02, "medium").otherwise("low").alias("confidence"),
        (F.col("move") * h).alias("expected_return_pct"), (F.col("move") * h - 0.1).alias("range_lo"),
        (F.col("move") * h + 0.1).alias("range_hi")) for h in ft.HORIZONS])
    good = moved.select(F.lit(2).alias("seq"), "ticker", F.col("date").alias("as_of_date"), entries.alias("horizons"))
    stale = good.withColumn("seq", F.lit(1)).withColumn("horizons", F.slice("horizons", 1, 1))
    return good.unionByName(stale)


SQL_LOG = mk.SQL_BARS.strip() + """,
moved AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 0.0) * 100 AS move FROM bars),
hz AS (SELECT unnest([1, 2, 3]) AS horizon),
ahead AS (SELECT *, lead(close, 1) OVER o AS c1, lead(close, 2) OVER o AS c2, lead(close, 3) OVER o AS c3, lead(date, 1) OVER o AS d1, lead(date, 2) OVER o AS d2, lead(date, 3) OVER o AS d3 FROM moved WINDOW o AS (PARTITION BY ticker ORDER BY date)),
entries AS (SELECT ticker, date AS as_of_date, horizon, CASE WHEN move > 0 THEN 0.5 + 0.05 * horizon ELSE 0.5 - 0.05 * horizon END AS probability_up,
  CASE WHEN abs(move) > 0.1 THEN 'high' WHEN abs(move) > 0.02 THEN 'medium' ELSE 'low' END AS confidence, move * horizon AS predicted_return_pct, move * horizon - 0.1 AS lo, move * horizon + 0.1 AS hi,
  (CASE horizon WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END / close - 1) * 100 AS actual_return_pct, CASE horizon WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS target_date FROM ahead, hz),
scores AS (SELECT ticker, as_of_date, horizon, CASE WHEN actual_return_pct IS NULL THEN 'pending' ELSE 'scored' END AS status, target_date, actual_return_pct, predicted_return_pct, probability_up, confidence,
  CASE WHEN actual_return_pct <> 0 THEN (probability_up >= 0.5) = (actual_return_pct > 0) END AS direction_hit, actual_return_pct >= lo AND actual_return_pct <= hi AS within_range80 FROM entries)
"""


@query("forecast_log_scores", ctes(SQL_LOG) + f"SELECT ticker, as_of_date, horizon, status, target_date, confidence, direction_hit, within_range80, {sql_rnd('actual_return_pct')} AS actual_return_pct, {sql_rnd('predicted_return_pct')} AS predicted_return_pct, {sql_rnd('probability_up')} AS probability_up FROM scores")
def forecast_log_scores(spark, sf):
    scores = fc.score_log(fc.dedupe_log(rule_log(spark, sf)), mk.bars(spark, sf))
    return rounded(scores, ["ticker", "as_of_date", "horizon", "status", "target_date", "confidence", "direction_hit", "within_range80"],
                      ["actual_return_pct", "predicted_return_pct", "probability_up"])


_SUM_VALUES = ["direction_accuracy", "mean_abs_error_pct", "range80_coverage", "brier"]


@query("forecast_score_summary", ctes(SQL_LOG) + f"""SELECT horizon, confidence, CAST(grouping(horizon, confidence) AS BIGINT) AS level, count(CASE WHEN status = 'scored' THEN 1 END) AS n, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, CAST(0 AS BIGINT) AS unavailable,
  {sql_rnd("avg(CASE WHEN status = 'scored' AND direction_hit THEN 1.0 WHEN status = 'scored' AND NOT direction_hit THEN 0.0 END)")} AS direction_accuracy,
  {sql_rnd("avg(CASE WHEN status = 'scored' THEN abs(predicted_return_pct - actual_return_pct) END)")} AS mean_abs_error_pct,
  {sql_rnd("avg(CASE WHEN status = 'scored' AND within_range80 THEN 1.0 WHEN status = 'scored' AND NOT within_range80 THEN 0.0 END)")} AS range80_coverage,
  {sql_rnd("avg(CASE WHEN status = 'scored' THEN pow(probability_up - CASE WHEN actual_return_pct > 0 THEN 1.0 ELSE 0.0 END, 2) END)")} AS brier
FROM scores GROUP BY GROUPING SETS ((), (horizon), (confidence))""")
def forecast_score_summary(spark, sf):
    scores = fc.score_log(fc.dedupe_log(rule_log(spark, sf)), mk.bars(spark, sf))
    return rounded(fc.score_summary(scores), ["horizon", "confidence", "level", "n", "pending", "unavailable"], _SUM_VALUES)


@query("history_failures", ctes(mk.SQL_BARS) + """, wanted AS (SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT n_name FROM nation)
SELECT w.ticker, coalesce(s.sessions, 0) AS sessions, CASE WHEN s.sessions IS NULL THEN 'not_loaded' ELSE 'too_short' END AS reason
FROM wanted w LEFT JOIN (SELECT ticker, count(*) AS sessions FROM bars GROUP BY ticker) s ON w.ticker = s.ticker WHERE coalesce(s.sessions, 0) <= 61""")
def history_failures(spark, sf):
    wanted = (table(spark, sf, "part").select(F.col("p_brand").alias("ticker"))
              .unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("ticker"))))
    return fc.failures(wanted, mk.bars(spark, sf))


# ---- daily job -----------------------------------------------------------------------------------------------------


def daily(spark, sf) -> str:
    """Folder of a daily job over the last session of each ticker, run, broken off, and run again for the same day."""
    def entries(log):
        return log.select("ticker", "as_of_date", F.explode("horizons").alias("h")).select("ticker", "as_of_date", "h.*")

    log, bars = rule_log(spark, sf), mk.bars(spark, sf).select("ticker", "date", "close")
    last = entries(log.where("seq = 2").groupBy("ticker").agg(F.max_by(F.struct("as_of_date", "horizons"), "as_of_date").alias("x")).select("ticker", "x.*"))
    forecasts = staged(spark, sf, "daily_forecasts", lambda: last.join(bars.withColumnsRenamed({"date": "as_of_date", "close": "last_close"}), ["ticker", "as_of_date"])
                       .withColumnsRenamed({"range_lo": "range80_lo_pct", "range_hi": "range80_hi_pct"}))
    names = bars.select("ticker").distinct().withColumn("exchange", F.when(F.substring("ticker", -1, 1).cast("int") % 2 == 0, "KOSPI").otherwise("KOSDAQ"))
    path = f"{stage_dir(spark).rstrip('/')}/daily-{uuid.uuid4().hex}"
    past = log.where("seq = 2").select("seq", "ticker", "as_of_date", "horizons")
    pb.daily_job(forecasts.where("horizon = 1 AND probability_up > 2"), names, past, bars, path, "2002-01-01")
    pb.daily_job(forecasts, names, past, bars, path, "2002-01-01")
    pb.write_run({"ranking": forecasts.limit(1)}, path)
    return path


@query("daily_ranking", ctes(SQL_LOG) + f""", t AS (SELECT ticker, max(date) AS d FROM bars GROUP BY 1)
SELECT CASE WHEN CAST(right(e.ticker, 1) AS INTEGER) % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS exchange, e.ticker, {sql_rnd('probability_up')} AS probability_up,
  CAST(row_number() OVER (PARTITION BY CAST(right(e.ticker, 1) AS INTEGER) % 2 ORDER BY probability_up DESC, predicted_return_pct DESC, e.ticker) AS INTEGER) AS rank FROM entries e JOIN t ON t.ticker = e.ticker AND t.d = as_of_date WHERE horizon = 1""")
def daily_ranking(spark, sf):
    return pb.published(spark, daily(spark, sf), "ranking").select("exchange", "ticker", stable("probability_up").alias("probability_up"), "rank")


@query("daily_summary", ctes(SQL_LOG) + """, t AS (SELECT DISTINCT ticker FROM bars)
SELECT 'ranked' AS section, CASE WHEN CAST(right(ticker, 1) AS INTEGER) % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS name, count(*) AS n FROM t GROUP BY 2
UNION ALL SELECT 'scores', status, count(*) FROM scores GROUP BY 2""")
def daily_summary(spark, sf):
    return pb.published(spark, daily(spark, sf), "summary")
