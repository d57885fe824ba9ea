"""Checks of a finished valuation against market data, and scoring of logged predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import tdiv

# Largest tolerated consensus gap; an actual nearer zero than this gives no ratio.
MAX_CONSENSUS_GAP_PCT, NEAR_ZERO = 30, 1e-9


def pe_band(assumed: DataFrame, observed: DataFrame) -> DataFrame:
    """Scenario multiples outside the range the share traded at. assumed(ticker, bear, base, bull)."""
    rows = assumed.join(observed.select("ticker", "min_per", "median_per", "max_per"), "ticker")
    out = ((F.col("base") < F.col("min_per")) | (F.col("base") > F.col("max_per"))
           | (F.col("bear") > F.col("max_per")) | (F.col("bull") < F.col("min_per")))
    return rows.where(out).withColumn("code", F.lit("PE_OUTSIDE_OBSERVED_RANGE"))


def consensus_gap(values: DataFrame, consensus: DataFrame, limit: float = MAX_CONSENSUS_GAP_PCT) -> DataFrame:
    """Base-case revenue or operating profit too far from the consensus of the same quarter."""
    rows = values.join(consensus, ["ticker", "q"])

    def gap(mine, theirs):
        return F.when(F.col(theirs) > 0, tdiv(F.col(mine) - F.col(theirs), F.col(theirs)) * 100)

    marked = rows.withColumns({"revenue_gap_pct": gap("revenue", "consensus_revenue"), "op_gap_pct": gap("operating_profit", "consensus_op")})
    far = F.coalesce(F.abs("revenue_gap_pct") > limit, F.lit(False)) | F.coalesce(F.abs("op_gap_pct") > limit, F.lit(False))
    return marked.where(far).withColumn("code", F.lit("CONSENSUS_GAP_LARGE"))


def quality_tier(rows: DataFrame) -> DataFrame:
    """Tier and reasons from grade, cross_checked, grounding and the warning codes."""
    verified, warned = F.col("grade") == "verified", lambda w: F.array_contains("warnings", w)
    reasons = F.array_compact(F.array(
        F.when(~verified, "provisional valuation"), F.when(~F.col("cross_checked"), "single model"),
        F.when(F.coalesce(F.col("grounding") != "high", F.lit(True)), F.concat(F.lit("data grounding "), F.coalesce("grounding", F.lit("unknown")))),
        *[F.when(warned(w), w) for w in ("PE_OUTSIDE_OBSERVED_RANGE", "CONSENSUS_GAP_LARGE")]))
    severe = (F.coalesce(F.col("grounding") == "low", F.lit(False)) | (~verified & F.coalesce(F.col("grounding") != "high", F.lit(True)))
              | warned("PE_OUTSIDE_OBSERVED_RANGE"))
    tier = F.when(F.col("grade").isNull(), None).when(F.size(reasons) == 0, "high").when(severe, "low").otherwise("medium")
    return rows.withColumns({"tier": tier, "reasons": F.when(F.col("grade").isNull(), F.array(F.lit("no valuation"))).otherwise(reasons)})


def prediction_records(valuation: DataFrame, estimate: DataFrame, consensus: DataFrame) -> DataFrame:
    """One record per (job_id, ticker) holding whatever can be scored later; nothing scorable gives no record."""
    scen = F.sort_array(F.collect_list(F.struct("scenario", "quarter_eps", "upside_pct")))
    v = valuation.groupBy("job_id", "ticker").agg(F.first("target_q").alias("target_q"), scen.alias("scenarios"), F.first("price").alias("price"), F.first("as_of").alias("quote_as_of"))
    e = estimate.select("job_id", "ticker", F.col("q").alias("estimate_q"), F.col("eps").alias("estimate_eps"))
    both = v.join(e, ["job_id", "ticker"], "full")
    c = consensus.groupBy("ticker").agg(F.collect_list(F.struct("q", "eps")).alias("_c"))
    joined = both.join(c, "ticker", "left")
    wanted = F.filter(F.coalesce("_c", F.array().cast("array<struct<q:int,eps:double>>")), lambda x: (x.q == F.col("target_q")) | (x.q == F.col("estimate_q")))
    return joined.withColumn("consensus", wanted).drop("_c")


def score_predictions(records: DataFrame, actuals: DataFrame, closes: DataFrame) -> DataFrame:
    """One row per record and distinct quarter: errors, hit in the scenario range, consensus comparison, direction."""
    quarters = F.array_distinct(F.array_compact(F.array("target_q", "estimate_q")))
    rows = records.withColumn("q", F.explode(quarters)).join(actuals.select("ticker", "q", F.col("eps").alias("actual")), ["ticker", "q"], "left")
    newest = closes.groupBy("ticker").agg(F.max("date").alias("to_date"), F.max_by("close", "date").alias("to_close"))
    eps = F.array_compact(F.transform("scenarios", lambda s: s.quarter_eps))
    mine = F.coalesce(F.col("q") == F.col("target_q"), F.lit(False)) & F.col("_base.quarter_eps").isNotNull()

    def error(p):
        return F.when(F.abs("actual") >= NEAR_ZERO, (p - F.col("actual")) / F.abs("actual") * 100)

    joined = rows.join(newest, "ticker", "left").withColumns({"_base": F.try_element_at(F.filter("scenarios", lambda s: s.scenario == "base"), F.lit(1)), "_eps": eps,
                                                              "_cons": F.try_element_at(F.filter("consensus", lambda c: c.q == F.col("q")), F.lit(1))})
    change = F.when(F.col("to_date") > F.col("quote_as_of"), (F.col("to_close") / F.col("price") - 1) * 100)
    out = joined.withColumns({
        "valuation_error_pct": F.when(mine, error(F.col("_base.quarter_eps"))),
        "within_range": F.when(mine, F.col("actual").between(F.array_min("_eps"), F.array_max("_eps"))),
        "estimate_error_pct": F.when(F.col("q") == F.col("estimate_q"), error(F.col("estimate_eps"))),
        "consensus_error_pct": F.when(F.col("q") == F.col("estimate_q"), error(F.col("_cons.eps"))),
        "change_pct": change, "base_upside_pct": F.when(mine, F.col("_base.upside_pct"))})
    return out.select(
        "job_id", "ticker", "q", F.when(F.col("actual").isNull(), "pending").otherwise("scored").alias("status"), "actual", "valuation_error_pct",
        "within_range", "estimate_error_pct", "consensus_error_pct", (F.abs("estimate_error_pct") < F.abs("consensus_error_pct")).alias("beat_consensus"),
        "change_pct", F.when(F.col("base_upside_pct") != 0, F.signum("change_pct") == F.signum("base_upside_pct")).alias("direction_hit"))


def prediction_summary(scores: DataFrame) -> DataFrame:
    done = F.col("status") == "scored"

    def rate(c, only=True):
        flag = F.when(F.col(c), 1.0).when(~F.col(c), 0.0)
        return F.avg(F.when(done, flag) if only else flag)

    return scores.agg(
        F.count("*").alias("n_rows"), F.count(F.when(done, 1)).alias("scored"), F.count(F.when(~done, 1)).alias("pending"),
        F.avg(F.when(done, F.abs("valuation_error_pct"))).alias("valuation_error_pct"), rate("within_range").alias("within_range"),
        F.avg(F.when(done, F.abs("estimate_error_pct"))).alias("estimate_error_pct"), F.avg(F.when(done, F.abs("consensus_error_pct"))).alias("consensus_error_pct"),
        rate("beat_consensus").alias("beat_consensus"), rate("direction_hit", only=False).alias("direction_hit"))


def valuation_grade(rows: DataFrame, hard: DataFrame, soft: DataFrame, warnings: DataFrame) -> DataFrame:
    """Status and grade per dataset: a hard issue blocks the price, a soft issue or warning makes it provisional."""
    n = lambda df, name: df.groupBy("ds_id").agg(F.count("*").alias(name), F.sort_array(F.collect_set("code")).alias(f"{name}_codes"))
    joined = rows.select("ds_id").distinct()
    for df, name in ((hard, "hard"), (soft, "soft"), (warnings, "warned")):
        joined = joined.join(n(df, name), "ds_id", "left")
    joined = joined.na.fill(0, ["hard", "soft", "warned"])
    status = F.when(F.col("hard") > 0, "unavailable").otherwise("available")
    grade = F.when(F.col("hard") > 0, None).when(F.col("soft") + F.col("warned") > 0, "provisional").otherwise("verified")
    return joined.withColumns({"status": status, "grade": grade, "partial_reasons": F.array_distinct(F.concat(
        *[F.coalesce(f"{c}_codes", F.array().cast("array<string>")) for c in ("hard", "soft", "warned")]))}).select(
        "ds_id", "hard", "soft", "warned", "status", "grade", "partial_reasons")


