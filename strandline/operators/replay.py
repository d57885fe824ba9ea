"""Replay accounting for many cohorts at once (key `run_id`): entry at the first open, exit at the last close.

selection(run_id, ticker, weight, sector_key), sessions(run_id, idx, open_at, close_at),
prices(run_id, label, idx, open, close) with labels = tickers and the two benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.rules import union_all
from strandline.operators.screen import ScreenConfig

MARKET, SECTOR = "MARKET_BENCHMARK", "SECTOR_BENCHMARK"


def _problem(df: DataFrame, subject, reason: str) -> DataFrame:
    subject = F.lit(subject) if isinstance(subject, str) else subject
    return df.select("run_id", subject.alias("subject"), F.lit(reason).alias("reason"))


def incomplete(runs: DataFrame, selection: DataFrame, sessions: DataFrame, prices: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """(run_id, subject, reason) of everything that makes a run unusable.

    runs: run_id, decision_at, selection_decision_at, evaluated_at, experiment_mode, config_digest, selection_digest,
    outcome_known_at. A run with any reason reports no performance."""
    calendar = sessions.groupBy("run_id").agg(F.count("*").alias("n"), F.min("open_at").alias("first_open"),
                                              F.max("close_at").alias("final_close"))
    r = runs.join(calendar, "run_id", "left")
    real = F.col("experiment_mode") != "synthetic"
    weights = selection.groupBy("run_id").agg(F.sum("weight").alias("total"), F.max("weight").alias("top"), F.min("weight").alias("low"),
                                              F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"))
    sector = selection.groupBy("run_id", "sector_key").agg(F.sum("weight").alias("w"))
    wanted = (selection.select("run_id", F.col("ticker").alias("label"))
              .unionByName(runs.select("run_id", F.explode(F.array(F.lit(MARKET), F.lit(SECTOR))).alias("label"))))
    needed = wanted.join(sessions.select("run_id", "idx"), "run_id").join(prices, ["run_id", "label", "idx"], "left")
    holes = needed.where(F.col("open").isNull() | F.col("close").isNull()).select("run_id", "label").distinct()
    return union_all([
        _problem(selection.where(F.col("sector_key").isNull()), F.col("ticker"), "no sector input"),
        _problem(weights.where((F.col("rows") != F.col("tickers")) | (F.col("low") <= 0) | (F.col("top") > cfg.max_weight)
                               | (F.col("total") > 1 + 1e-12)), "selection", "weights violate limits"),
        _problem(sector.where(F.col("w") > cfg.risk.max_sector_weight + 1e-12).select("run_id").distinct(), "selection", "sector weight violates limit"),
        _problem(r.where(real & (F.col("final_close") > F.col("evaluated_at"))), "outcomes", "holding window not complete"),
        _problem(r.where(real & ((F.col("outcome_known_at") < F.col("final_close")) | (F.col("outcome_known_at") > F.col("evaluated_at")))),
                 "outcomes", "outcome not known between final session and evaluation"),
        _problem(r.where(F.coalesce("n", F.lit(0)) != cfg.hold_sessions), "calendar", "session count differs from config"),
        _problem(r.where(F.col("decision_at") >= F.col("first_open")), "decision_at", "not before the first open"),
        _problem(r.where(F.col("config_digest") != F.col("selection_digest")), "selection", "config digest differs"),
        _problem(r.where(F.col("decision_at") != F.col("selection_decision_at")), "selection", "decision time differs"),
        _problem(holes, F.col("label"), "missing price"),
    ])


def positions(selection: DataFrame, prices: DataFrame, last_idx: DataFrame, cfg: ScreenConfig) -> DataFrame:
    fee, slip, tax = cfg.fee_bps / 1e4, cfg.slippage_bps / 1e4, cfg.sell_tax_bps / 1e4
    edges = prices.join(last_idx, "run_id").groupBy("run_id", F.col("label").alias("ticker")).agg(
        F.max(F.when(F.col("idx") == 0, F.col("open"))).alias("entry_open"),
        F.max(F.when(F.col("idx") == F.col("last_idx"), F.col("close"))).alias("exit_close"))
    after_slip = F.col("exit_close") * (1 - slip)
    return (selection.join(edges, ["run_id", "ticker"])
            .withColumn("entry_cost", F.col("entry_open") * (1 + slip) * (1 + fee))
            .withColumn("budget", F.lit(cfg.initial_capital) * F.col("weight"))
            .withColumn("units", F.col("budget") / F.col("entry_cost"))
            .withColumn("exit_proceeds", after_slip * (1 - fee - tax))
            .withColumn("gross_exit_value", F.col("units") * F.col("exit_close"))
            .withColumn("net_exit_value", F.col("units") * F.col("exit_proceeds"))
            .withColumn("entry_slippage", F.col("units") * F.col("entry_open") * slip)
            .withColumn("entry_fee", F.col("units") * F.col("entry_open") * (1 + slip) * fee)
            .withColumn("exit_slippage", F.col("units") * F.col("exit_close") * slip)
            .withColumn("exit_fee", F.col("units") * after_slip * fee)
            .withColumn("exit_tax", F.col("units") * after_slip * tax))


def equity_curve(runs: DataFrame, held: DataFrame, sessions: DataFrame, prices: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """(run_id, point, equity): capital before entry, marks at each close, net exit at the last."""
    totals = held.groupBy("run_id").agg(F.sum("budget").alias("invested"), F.sum("net_exit_value").alias("exit_value"))
    marks = (held.select("run_id", F.col("ticker").alias("label"), "units").join(prices, ["run_id", "label"])
             .groupBy("run_id", "idx").agg(F.sum(F.col("units") * F.col("close")).alias("mark")))
    last = F.max("idx").over(Window.partitionBy("run_id"))
    calendar = sessions.select("run_id", "idx").withColumn("last_idx", last)
    zero = F.lit(0.0)
    value = F.when(F.col("idx") == F.col("last_idx"), F.coalesce("exit_value", zero)).otherwise(F.coalesce("mark", zero))
    path = (calendar.join(runs.select("run_id"), "run_id", "left_semi").join(totals, "run_id", "left")
            .join(marks, ["run_id", "idx"], "left")
            .select("run_id", (F.col("idx") + 1).alias("point"),
                    (F.lit(cfg.initial_capital) - F.coalesce("invested", zero) + value).alias("equity")))
    return path.unionByName(runs.select("run_id", F.lit(0).alias("point"), F.lit(cfg.initial_capital).alias("equity")))


def max_drawdown(curve: DataFrame) -> DataFrame:
    peak = F.max("equity").over(Window.partitionBy("run_id").orderBy("point").rowsBetween(Window.unboundedPreceding, 0))
    return (curve.withColumn("_dd", (peak - F.col("equity")) / peak)
            .groupBy("run_id").agg((F.greatest(F.max("_dd"), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
                                   F.max_by("equity", "point").alias("final_equity")))


def run_summary(runs: DataFrame, held: DataFrame, curve: DataFrame, prices: DataFrame, last_idx: DataFrame,
                cfg: ScreenConfig) -> DataFrame:
    """Costs, returns, benchmarks, turnover and drawdown per complete run; a run without positions is all cash."""
    slip, capital, zero = cfg.slippage_bps / 1e4, cfg.initial_capital, F.lit(0.0)
    parts = ("entry_slippage", "entry_fee", "exit_slippage", "exit_fee", "exit_tax")
    totals = held.groupBy("run_id").agg(
        F.count("*").alias("_n"), F.sum("budget").alias("invested"), *[F.sum(p).alias(p) for p in parts],
        F.sum(F.col("budget") / F.col("entry_open") * F.col("exit_close")).alias("_gross"),
        F.sum(F.col("units") * F.col("entry_open") * (1 + slip)).alias("buy_notional"),
        F.sum(F.col("units") * F.col("exit_close") * (1 - slip)).alias("sell_notional"))
    bench = (prices.where(F.col("label").isin(MARKET, SECTOR)).join(last_idx, "run_id").groupBy("run_id", "label")
             .agg((F.max(F.when(F.col("idx") == F.col("last_idx"), F.col("close")))
                   / F.max(F.when(F.col("idx") == 0, F.col("open"))) - 1).alias("ret"))
             .groupBy("run_id").agg((F.max(F.when(F.col("label") == MARKET, F.col("ret"))) * 100).alias("market_return_pct"),
                                    (F.max(F.when(F.col("label") == SECTOR, F.col("ret"))) * 100).alias("sector_return_pct")))
    out = (runs.select("run_id").join(totals, "run_id", "left").join(max_drawdown(curve), "run_id", "left")
           .join(bench, "run_id", "left")
           .na.fill(0.0, ["invested", *parts, "_gross", "buy_notional", "sell_notional"]))
    net = (F.col("final_equity") / capital - 1) * 100
    cash_sector = F.col("invested") / capital * F.col("sector_return_pct")
    return out.withColumns({
        "status": F.when(F.col("_n").isNull(), "no_trade").otherwise("completed"),
        "idle_cash": F.lit(capital) - F.col("invested"),
        "total_cost": sum((F.col(p) for p in parts), zero),
        "gross_return_pct": ((F.lit(capital) - F.col("invested") + F.col("_gross")) / capital - 1) * 100,
        "net_return_pct": net, "excess_vs_market_pct": net - F.col("market_return_pct"),
        "excess_vs_sector_pct": net - F.col("sector_return_pct"), "cash_weighted_sector_pct": cash_sector,
        "excess_vs_cash_weighted_sector_pct": net - cash_sector,
        "turnover": (F.col("buy_notional") + F.col("sell_notional")) / capital}).drop("_n", "_gross")


def forecast_accuracy(selected: DataFrame, forecast_quarters: DataFrame, realised: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Forecast against realised EPS where every forecast quarter has been reported."""
    joined = (selected.select("run_id", "ticker", "ntm_eps").join(forecast_quarters, ["run_id", "ticker"])
              .join(realised.select("ticker", "q", F.col("eps").alias("realised_eps")), ["ticker", "q"], "left"))
    whole = (joined.groupBy("run_id", "ticker", "ntm_eps")
             .agg(F.sum("realised_eps").alias("realised_ntm_eps"), F.count("*").alias("n"), F.count("realised_eps").alias("k"))
             .where(F.col("n") == F.col("k")))
    error = F.col("ntm_eps") - F.col("realised_ntm_eps")
    fine = F.abs("realised_ntm_eps") >= cfg.min_consensus_eps
    return whole.select("run_id", "ticker", "ntm_eps", "realised_ntm_eps", error.alias("error"),
                        F.when(fine, error / F.abs("realised_ntm_eps") * 100).alias("error_pct"),
                        F.when(~fine, F.lit("REALIZED_EPS_NEAR_ZERO")).alias("reason"))
