"""Candidate gates, ranking and capped allocation for many decision cohorts at once (key `run_id`)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import instant_days, kst_date, quarter_end, quarter_index
from strandline.operators.earnings import RiskPolicy
from strandline.operators.rules import broken_rules


@dataclass(frozen=True)
class ScreenConfig:
    """The proposed hypothesis thresholds; costs and capital have no defaults."""
    fee_bps: float
    slippage_bps: float
    sell_tax_bps: float
    initial_capital: float
    gap_threshold: float = 0.1
    min_revision: float = 0.0
    max_consensus_age_days: int = 30
    min_prior_lag_days: int = 20
    max_prior_lag_days: int = 40
    catalyst_min_days: int = 1
    catalyst_max_days: int = 60
    max_holdings: int = 5
    max_weight: float = 0.2
    hold_sessions: int = 20
    min_consensus_eps: float = 1.0
    risk: RiskPolicy = RiskPolicy()


# Exchanges and security type a candidate must declare.
EXCHANGES, SECURITY_TYPE = ("KOSPI", "KOSDAQ"), "common_stock"


def _after(a, b):
    return F.unix_millis(a) > F.unix_millis(b)


def gate_reasons(c: DataFrame, cfg: ScreenConfig, single_quarter: bool = False) -> DataFrame:
    """(run_id, ticker, code) of every failed gate.

    `c` has one row per candidate: declared identities, horizons as quarter arrays, instants, consensus EPS, liquidity,
    risk summaries and the latest knowledge time of the forecast's sources."""
    decision = F.col("decision_at")
    decision_q = quarter_index(kst_date("decision_at"))
    first_q = F.element_at("forecast_quarters", 1)
    if single_quarter:
        horizon = [("FORECAST_HORIZON_NOT_SINGLE_QUARTER", (F.size("forecast_quarters") != 1) | ~first_q.isin(decision_q, decision_q - 1))]
    else:
        horizon = [("FORECAST_HORIZON_NOT_NEXT_FOUR", first_q != decision_q + 1),
                   ("FORECAST_QUARTER_NOT_FUTURE", F.exists("forecast_quarters", lambda q: quarter_end(q) <= kst_date("decision_at")))]
    observed = [(k, s) for k, s in (("current_known_at", "current_source_at"), ("prior_known_at", "prior_source_at"),
                                    ("catalyst_known_at", "catalyst_source_at"))]
    time_mismatch = F.lit(False)
    for known, source in observed:
        time_mismatch = time_mismatch | _after(source, known) | _after(known, decision)
    eps_rules = []
    for who in ("current", "prior"):
        value = F.col(f"{who}_eps")
        eps_rules += [(f"NONPOSITIVE_{who.upper()}_CONSENSUS_EPS", value <= 0),
                      (f"NEAR_ZERO_{who.upper()}_CONSENSUS_EPS", (value > 0) & (value < cfg.min_consensus_eps))]
    lag = instant_days("prior_known_at", "current_known_at")
    not_before = ~_after("current_known_at", "prior_known_at")
    ahead = instant_days("decision_at", "event_at")
    usable = ((F.col("current_eps") >= cfg.min_consensus_eps) & (F.col("current_eps") > 0)
              & (F.col("prior_eps") >= cfg.min_consensus_eps) & (F.col("prior_eps") > 0) & ~not_before)
    has_risk = F.col("has_funding") & F.col("schedule_code").isNull()
    coverage_floor = F.lit(cfg.risk.min_interest_coverage).cast("double")
    rules = [
        ("TICKER_MISMATCH", (F.col("forecast_ticker") != F.col("ticker")) | (F.col("consensus_ticker") != F.col("ticker"))
         | (F.col("catalyst_ticker") != F.col("ticker"))),
        ("COMPANY_SCOPE_MISSING", F.col("company_name").isNull() | ~F.coalesce(F.col("scope") == "consolidated", F.lit(False))),
        ("NOT_KOSPI_COMMON", F.col("company_name").isNotNull() & (F.col("scope") == "consolidated")
         & (~F.col("exchange").isin(*EXCHANGES) | (F.col("security_type") != SECURITY_TYPE) | F.col("not_common"))),
        ("HORIZON_MISMATCH", F.col("current_horizon") != F.col("forecast_quarters")),
        ("ROLLING_HORIZON_CHANGED", F.col("prior_horizon") != F.col("forecast_quarters")),
        *horizon,
        ("FORECAST_GENERATED_AFTER_DECISION", _after("generated_at", "decision_at")),
        ("SOURCE_KNOWN_AFTER_GENERATION", _after("last_source_at", "generated_at")),
        ("FORECAST_PROVENANCE_MISSING", F.col("provenance_missing")),
        ("SOURCE_TIME_MISMATCH", time_mismatch),
        ("LIQUIDITY_DATA_MISSING", F.col("adtv").isNull() & F.lit(cfg.risk.require_liquidity)),
        ("LIQUIDITY_TIME_MISMATCH", F.col("adtv").isNotNull() & (
            _after("liquidity_as_of", "liquidity_known_at") | _after("liquidity_source_at", "liquidity_known_at")
            | _after("liquidity_known_at", "generated_at")
            | _after("liquidity_known_at", "decision_at"))),
        ("LIQUIDITY_STALE", F.col("adtv").isNotNull()
         & (instant_days("liquidity_as_of", "decision_at") > cfg.risk.max_liquidity_age_days)),
        ("RISK_DATA_MISSING", ~F.col("has_funding") & F.lit(cfg.risk.require_funding_data)),
        ("INVALID_DEBT_SCHEDULE", F.col("schedule_code") == "INVALID_DEBT_SCHEDULE"),
        ("FUNDING_HORIZON_MISMATCH", F.col("schedule_code") == "FUNDING_HORIZON_MISMATCH"),
        ("BASE_FUNDING_GAP", has_risk & (F.col("base_peak_funding") > 0)),
        ("STRESS_FUNDING_GAP", has_risk & F.lit(cfg.risk.exclude_stress_funding_gap) & (F.col("stress_peak_funding") > 0)),
        ("LOW_INTEREST_COVERAGE", has_risk & (F.col("base_min_coverage") < coverage_floor)),
        *eps_rules,
        ("CURRENT_CONSENSUS_FUTURE", _after("current_known_at", "decision_at")),
        ("CURRENT_CONSENSUS_STALE", ~_after("current_known_at", "decision_at")
         & (instant_days("current_known_at", "decision_at") > cfg.max_consensus_age_days)),
        ("PRIOR_CONSENSUS_FUTURE", _after("prior_known_at", "decision_at")),
        ("PRIOR_CONSENSUS_NOT_BEFORE_CURRENT", not_before),
        ("PRIOR_CONSENSUS_LAG_OUT_OF_RANGE", ~not_before & ~lag.between(cfg.min_prior_lag_days, cfg.max_prior_lag_days)),
        ("CATALYST_SOURCE_FUTURE", _after("catalyst_known_at", "decision_at")),
        ("CATALYST_NOT_FUTURE", ~_after("event_at", "decision_at")),
        ("CATALYST_WINDOW_VIOLATION", _after("event_at", "decision_at") & ~ahead.between(cfg.catalyst_min_days, cfg.catalyst_max_days)),
        ("NO_POSITIVE_REVISION", usable & (F.col("revision") <= cfg.min_revision)),
        ("GAP_BELOW_THRESHOLD", usable & (F.col("gap") < cfg.gap_threshold)),
    ]
    return broken_rules(c, ["run_id", "ticker"], rules)


def duplicate_candidates(c: DataFrame) -> DataFrame:
    """Runs naming a ticker more than once; such a run is rejected whole."""
    return (c.groupBy("run_id", "ticker").agg(F.count("*").alias("n")).where(F.col("n") > 1)
            .select("run_id", "ticker", F.lit("DUPLICATE_CANDIDATE").alias("code")))


def eligible(c: DataFrame, reasons: DataFrame, duplicates: DataFrame) -> DataFrame:
    return (c.join(reasons.select("run_id", "ticker").distinct(), ["run_id", "ticker"], "left_anti")
            .join(duplicates.select("run_id").distinct(), "run_id", "left_anti"))


def allocate(ok: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Rank by gap, keep the best `max_holdings`, weight by the tightest of position, equal, sector and liquidity caps."""
    order = Window.partitionBy("run_id").orderBy(F.desc("gap"), "ticker")
    chosen = ok.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.max_holdings)
    run, sector = Window.partitionBy("run_id"), Window.partitionBy("run_id", "sector_key")
    equal = F.least(F.lit(cfg.max_weight), F.lit(1.0) / F.count("*").over(run))
    limit = F.least(equal, F.lit(cfg.risk.max_sector_weight) / F.count("*").over(sector))
    capacity = F.coalesce(F.col("adtv") * cfg.risk.max_participation_rate / cfg.initial_capital, equal)
    return (chosen.withColumn("allocation_limit", limit).withColumn("weight", F.least("allocation_limit", capacity))
            .withColumn("budget", F.col("weight") * cfg.initial_capital)
            .withColumn("participation_rate", F.col("budget") / F.col("adtv"))
            .withColumn("liquidity_limited", F.col("weight") < F.col("allocation_limit")))


def portfolio(runs: DataFrame, selected: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Totals per run; a run without a selection stays in cash."""
    sectors = (selected.groupBy("run_id", "sector_key").agg(F.sum("weight").alias("sector_weight"))
               .groupBy("run_id").agg(F.max("sector_weight").alias("largest_sector_weight")))
    covered = F.sum(F.when(F.col("stress_loss").isNotNull(), F.col("weight")).otherwise(F.lit(0.0)))
    totals = selected.groupBy("run_id").agg(
        F.sum("weight").alias("invested_weight"), F.max("weight").alias("largest_position_weight"),
        F.count("*").alias("holdings"), covered.alias("stress_coverage_weight"),
        F.sum(F.col("weight") * F.col("stress_loss")).alias("_loss"))
    zero = F.lit(0.0)
    joined = runs.select("run_id").distinct().join(totals, "run_id", "left").join(sectors, "run_id", "left")
    invested, cover = F.coalesce("invested_weight", zero), F.coalesce("stress_coverage_weight", zero)
    return joined.select(
        "run_id", invested.alias("invested_weight"), (invested * cfg.initial_capital).alias("invested"),
        ((1 - invested) * cfg.initial_capital).alias("idle_cash"), F.coalesce("holdings", F.lit(0)).alias("holdings"),
        F.coalesce("largest_position_weight", zero).alias("largest_position_weight"),
        F.coalesce("largest_sector_weight", zero).alias("largest_sector_weight"),
        F.when(F.abs(cover - invested) < 1e-12, F.coalesce("_loss", zero)).alias("stress_loss"),
        cover.alias("stress_coverage_weight"), F.col("holdings").isNull().alias("no_trade"))


def run_mode(c: DataFrame) -> DataFrame:
    """A run with any synthetic candidate is synthetic, else retrospective research."""
    return c.groupBy("run_id").agg(F.when(F.max(F.col("evidence_mode") == "synthetic"), "synthetic")
                                   .otherwise("retrospective_research").alias("experiment_mode"))
