"""Single-quarter estimates: assumption flattening, identity and time checks, optional blocks, input domain checks, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import kst_date, quarter_index
from strandline.operators.rules import broken_rules, union_all
from strandline.operators.screen import EXCHANGES, SECURITY_TYPE

# Source kinds a strategy input may cite, bounds of its numbers and its declared constants.
SOURCE_KINDS = ("filing", "guidance", "press_release", "exchange_notice", "analyst_report", "market_data_vendor", "manual_assumption", "archive")
CONSTANTS = {"scope": "consolidated", "basis": "common_diluted", "unit": "KRW_per_share", "currency": "KRW"}
MAX_TAX_RATE, MAX_VOLUME, MAX_PRICE, MAX_MONEY = 0.6, 1e15, 1e12, 1e18


def assumptions(quarters: DataFrame, segments: DataFrame, funding: DataFrame, funding_from_filings: bool = False) -> DataFrame:
    """(id, path, rationale, source, is_model_estimate) of every stated assumption, numbered by position."""
    keep = ["id", "path", "rationale", "source", "is_model_estimate"]
    bridge = quarters.withColumn("path", F.format_string("forecast.quarters[%d].bridgeAssumptions", "pos"))
    seg = segments.withColumn("path", F.format_string("forecast.quarters[%d].segments[%d].assumptions", "pos", "seg_pos"))
    fund = funding.withColumn("path", F.format_string("forecast.funding.quarters[%d].assumptions", "pos"))
    flag = lambda df, model: df.where(F.col("rationale").isNotNull()).withColumn("is_model_estimate", F.lit(model)).select(*keep)
    return union_all([flag(bridge, True), flag(seg, True), flag(fund, not funding_from_filings)])


def identity_reasons(c: DataFrame) -> DataFrame:
    """(id, code) of forecasts that may not be used at all: wrong company or scope, wrong quarter, known too late."""
    q = quarter_index(kst_date("decision_at"))
    after = lambda a, b: F.unix_millis(a) > F.unix_millis(b)
    return broken_rules(c, ["id"], [
        ("FORECAST_TICKER_MISMATCH", F.col("forecast_ticker") != F.col("ticker")),
        ("FORECAST_COMPANY_SCOPE_MISSING", F.col("company_name").isNull() | ~F.coalesce(F.col("scope") == CONSTANTS["scope"], F.lit(False))),
        ("FORECAST_NOT_KOSPI_COMMON", F.col("company_name").isNotNull() & (F.col("scope") == CONSTANTS["scope"])
         & (~F.col("exchange").isin(*EXCHANGES) | (F.col("security_type") != SECURITY_TYPE) | F.col("not_common"))),
        ("FORECAST_HORIZON_NOT_SINGLE_QUARTER", (F.size("forecast_quarters") != 1) | ~F.get("forecast_quarters", F.lit(0)).isin(q, q - 1)),
        ("FORECAST_GENERATED_AFTER_DECISION", after("generated_at", "decision_at")),
        ("FORECAST_SOURCE_AFTER_GENERATION", after("last_source_at", "generated_at"))])


def late_blocks(c: DataFrame) -> DataFrame:
    """(id, code) of optional liquidity or funding blocks whose facts were not known in time; each falls alone."""
    after = lambda a, b: F.unix_millis(a) > F.unix_millis(b)
    return broken_rules(c, ["id"], [
        ("LIQUIDITY_TIME_MISMATCH", F.col("adtv").isNotNull() & (
            after("liquidity_as_of", "liquidity_known_at") | after("liquidity_source_at", "liquidity_known_at")
            | after("liquidity_known_at", "generated_at") | after("liquidity_known_at", "decision_at"))),
        ("FUNDING_TIME_MISMATCH", F.col("has_funding") & (after("funding_source_at", "generated_at") | after("funding_source_at", "decision_at")))])


def drop_late_blocks(c: DataFrame, late: DataFrame) -> DataFrame:
    codes = late.groupBy("id").agg(F.collect_set("code").alias("_late"))
    joined = c.join(codes, "id", "left")
    has = lambda code: F.coalesce(F.array_contains("_late", code), F.lit(False))
    return joined.withColumns({"adtv": F.when(~has("LIQUIDITY_TIME_MISMATCH"), F.col("adtv")),
                               "has_funding": F.col("has_funding") & ~has("FUNDING_TIME_MISMATCH")}).drop("_late")


def status(c: DataFrame, identity: DataFrame, gates: DataFrame, complete: Column) -> DataFrame:
    """eligible / ineligible when consensus and catalyst are there (`complete`), else estimate_only; a forecast failing
    identity leaves insufficient_data."""
    bad = identity.select("id").distinct().withColumn("_bad", F.lit(True))
    failed = gates.select("id").distinct().withColumn("_failed", F.lit(True))
    joined = c.select("id", complete.alias("_complete")).join(bad, "id", "left").join(failed, "id", "left")
    return joined.select("id", F.when(F.col("_bad"), "insufficient_data").when(~F.col("_complete"), "estimate_only")
                         .when(F.col("_failed"), "ineligible").otherwise("eligible").alias("status"))


def input_faults(segments: DataFrame, quarters: DataFrame, consensus: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, code) of inputs outside their domain: quarters not consecutive, numbers out of bounds, kinds, constants."""
    step = F.col("q") - F.lag("q").over(Window.partitionBy("id").orderBy("pos"))
    gaps = quarters.withColumn("_s", step).where(F.col("_s") != 1).select("id", F.lit("QUARTERS_NOT_CONSECUTIVE").alias("code"))
    constants = F.lit(False)
    for column, value in CONSTANTS.items():
        constants = constants | (F.col(column) != value)
    return union_all([
        gaps,
        broken_rules(quarters, ["id"], [("TAX_RATE_OUT_OF_RANGE", ~F.col("tax_rate").between(0, MAX_TAX_RATE)), ("SHARES_NOT_POSITIVE", F.col("diluted_shares") <= 0),
                                        ("NONCONTROLLING_OUT_OF_RANGE", ~F.col("noncontrolling_share").between(0, 1))]),
        broken_rules(segments, ["id"], [("VOLUME_OUT_OF_RANGE", ~F.col("volume").between(0, MAX_VOLUME)), ("PRICE_NOT_POSITIVE", ~((F.col("unit_price") > 0) & (F.col("unit_price") <= MAX_PRICE))),
                                        ("COST_OUT_OF_RANGE", ~F.col("fixed_cost").between(0, MAX_MONEY))]),
        broken_rules(consensus, ["id"], [("CONSENSUS_CONSTANTS", constants)]),
        broken_rules(sources, ["id"], [("SOURCE_KIND_NOT_ALLOWED", ~F.col("kind").isin(*SOURCE_KINDS)), ("SOURCE_WITHOUT_REFERENCE", F.col("url").isNull() & F.col("manual_reference").isNull())])]).distinct()
