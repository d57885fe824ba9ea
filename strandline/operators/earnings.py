"""Earnings bridge, sensitivities, stress and funding roll-forward for many companies and cohorts at once.

segments: keys, q, segment, volume, unit_price, variable_cost, fixed_cost
quarters: keys, q, net_interest, tax_rate, noncontrolling_share, preferred_claims, diluted_shares
plan:     keys, q, depreciation, capex, delta_working_capital, cash_taxes, cash_interest, other_cash_flow,
          principal_due, committed_draw, payouts, opening_cash, opening_debt (the last two repeat per quarter)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import quarter_end, quarter_start, rnd, tdiv


@dataclass(frozen=True)
class RiskPolicy:
    """The default downside scenario and the funding and sizing limits."""
    require_funding_data: bool = True
    exclude_stress_funding_gap: bool = True
    minimum_cash_buffer: float = 0.0
    min_interest_coverage: float | None = 1.0
    volume_decline: float = 0.1
    price_decline: float = 0.05
    variable_cost_increase: float = 0.05
    annual_interest_shock_bps: float = 200.0
    max_sector_weight: float = 0.6
    require_liquidity: bool = True
    max_participation_rate: float = 0.01
    max_liquidity_age_days: int = 10


def segment_contribution(segments: DataFrame) -> DataFrame:
    unit = F.col("unit_price") - F.col("variable_cost")
    return segments.withColumns({
        "revenue": F.col("volume") * F.col("unit_price"), "contribution": F.col("volume") * unit - F.col("fixed_cost"),
        "break_even_volume": F.when(unit > 0, tdiv("fixed_cost", unit))})


def quarter_bridge(segments: DataFrame, quarters: DataFrame, keys: list[str]) -> DataFrame:
    """Revenue to EPS per quarter. A pretax loss earns no tax credit."""
    sums = segment_contribution(segments).groupBy(*keys, "q").agg(
        F.sum("revenue").alias("revenue"), F.sum("contribution").alias("operating_profit"))
    pretax = F.col("operating_profit") + F.col("net_interest")
    return (sums.join(quarters, [*keys, "q"])
            .withColumn("pretax", pretax)
            .withColumn("tax", F.greatest("pretax", F.lit(0.0)) * F.col("tax_rate"))
            .withColumn("net_income", F.col("pretax") - F.col("tax"))
            .withColumn("noncontrolling", F.col("net_income") * F.col("noncontrolling_share"))
            .withColumn("common_earnings", F.col("net_income") - F.col("noncontrolling") - F.col("preferred_claims"))
            .withColumn("eps", F.col("common_earnings") / F.col("diluted_shares")))


def ntm_eps(bridge: DataFrame, keys: list[str]) -> DataFrame:
    return bridge.groupBy(*keys).agg(F.sum("eps").alias("ntm_eps"), F.count("*").alias("n_quarters"),
                                     F.sort_array(F.collect_list("q")).alias("forecast_quarters"),
                                     F.sum("operating_profit").alias("total_operating_profit"))


# The one-percent perturbations reported beside a forecast.
SHOCKS = (("base", 1.0, 1.0, 1.0), ("price_up", 1.01, 1.0, 1.0), ("volume_up", 1.0, 1.01, 1.0), ("variable_cost_up", 1.0, 1.0, 1.01))


def shocked(segments: DataFrame, shocks=SHOCKS) -> DataFrame:
    """One copy of the segments per shock (name, price, volume and variable-cost factor)."""
    table = F.array(*[F.struct(F.lit(n).alias("shock"), F.lit(p).alias("fp"), F.lit(v).alias("fv"), F.lit(c).alias("fc"))
                      for n, p, v, c in shocks])
    return (segments.withColumn("_s", F.explode(table))
            .withColumns({"shock": F.col("_s.shock"), "unit_price": F.col("unit_price") * F.col("_s.fp"),
                          "volume": F.col("volume") * F.col("_s.fv"),
                          "variable_cost": F.col("variable_cost") * F.col("_s.fc")}).drop("_s"))


def sensitivity(segments: DataFrame, quarters: DataFrame, keys: list[str]) -> DataFrame:
    """NTM EPS of each one-percent shock and its difference from the base."""
    copies = quarters.withColumn("shock", F.explode(F.array(*[F.lit(s[0]) for s in SHOCKS])))
    eps = ntm_eps(quarter_bridge(shocked(segments), copies, [*keys, "shock"]), [*keys, "shock"])
    base = F.max(F.when(F.col("shock") == "base", F.col("ntm_eps"))).over(Window.partitionBy(*keys))
    return eps.select(*keys, "shock", "ntm_eps", (F.col("ntm_eps") - base).alias("delta_eps"))


def opening_debt(plan: DataFrame, keys: list[str]) -> DataFrame:
    """Debt at the start of each quarter: the schedule is fixed, so it is a running sum of draws less principal."""
    before = Window.partitionBy(*keys).orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    change = F.coalesce(F.sum(F.col("committed_draw") - F.col("principal_due")).over(before), F.lit(0.0))
    return plan.withColumn("quarter_opening_debt", F.col("opening_debt") + change)


def scenario_bridge(segments: DataFrame, quarters: DataFrame, plan: DataFrame | None, keys: list[str],
                    policy: RiskPolicy) -> DataFrame:
    """Base and stress bridges, scenario as a column. Rate stress reprices the whole opening debt of each quarter."""
    shocks = (("base", 1.0, 1.0, 1.0),
              ("stress", 1 - policy.price_decline, 1 - policy.volume_decline, 1 + policy.variable_cost_increase))
    copies = shocked(segments, shocks).withColumnRenamed("shock", "scenario")
    debt = opening_debt(plan, keys).select(*keys, "q", "quarter_opening_debt")
    extra = F.when(F.col("scenario") == "stress",
                   F.col("quarter_opening_debt") * policy.annual_interest_shock_bps / 10000 / 4).otherwise(F.lit(0.0))
    stressed = (quarters.join(debt, [*keys, "q"])
                .withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit("stress"))))
                .withColumn("incremental_interest", extra)
                .withColumn("net_interest", F.col("net_interest") - F.col("incremental_interest")))
    return quarter_bridge(copies, stressed, [*keys, "scenario"])


def funding_rollforward(bridge: DataFrame, plan: DataFrame, keys: list[str], policy: RiskPolicy) -> DataFrame:
    """Quarter-by-quarter cash and debt of each scenario, from running sums of the flows."""
    group = [*keys, "scenario"]
    upto = Window.partitionBy(*group).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    rows = (bridge.select(*group, "q", "revenue", "operating_profit", "incremental_interest", "quarter_opening_debt")
            .join(plan, [*keys, "q"])
            .withColumn("cash_interest_paid", F.col("cash_interest") + F.col("incremental_interest"))
            .withColumn("operating_cash", F.col("operating_profit") + F.col("depreciation") - F.col("cash_taxes")
                        - F.col("cash_interest_paid") + F.col("other_cash_flow") - F.col("delta_working_capital"))
            .withColumn("free_cash_flow", F.col("operating_cash") - F.col("capex"))
            .withColumn("_flow", F.col("free_cash_flow") - F.col("principal_due") + F.col("committed_draw") - F.col("payouts"))
            .withColumn("ending_cash", F.col("opening_cash") + F.sum("_flow").over(upto))
            .withColumn("quarter_opening_cash", F.col("ending_cash") - F.col("_flow"))
            .withColumn("ending_debt", F.col("quarter_opening_debt") + F.col("committed_draw") - F.col("principal_due")))
    return rows.withColumns({
        "net_debt": F.col("ending_debt") - F.col("ending_cash"),
        "additional_funding": F.greatest(F.lit(0.0), F.lit(policy.minimum_cash_buffer) - F.col("ending_cash")),
        "capex_to_revenue": F.when(F.col("revenue") > 0, tdiv("capex", "revenue")),
        "interest_coverage": F.when(F.col("cash_interest_paid") > 0, tdiv("operating_profit", "cash_interest_paid")),
    }).drop("_flow")


def funding_summary(rollforward: DataFrame, keys: list[str], policy: RiskPolicy) -> DataFrame:
    low = F.least(F.min("ending_cash"), F.min("opening_cash"))
    return rollforward.groupBy(*keys, "scenario").agg(
        low.alias("minimum_cash"), F.greatest(F.lit(0.0), F.lit(policy.minimum_cash_buffer) - low).alias("peak_funding"),
        F.sum("capex").alias("total_capex"), F.sum("delta_working_capital").alias("total_working_capital"),
        F.sum("free_cash_flow").alias("total_free_cash_flow"), F.sum("principal_due").alias("total_repayment"),
        F.sum("committed_draw").alias("total_draw"), F.max_by("ending_debt", "q").alias("final_debt"),
        F.max_by("ending_cash", "q").alias("final_cash"), F.min("interest_coverage").alias("min_coverage"))


def invalid_schedules(plan: DataFrame, quarters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code): principal beyond debt plus draws, or a plan not covering the exact forecast quarters."""
    overdue = (opening_debt(plan, keys)
               .where(F.col("principal_due") > F.col("quarter_opening_debt") + F.col("committed_draw"))
               .select(*keys, F.lit("INVALID_DEBT_SCHEDULE").alias("code")))
    planned = plan.select(*keys, "q", F.lit(1).alias("_p"))
    wanted = quarters.join(plan.select(*keys).distinct(), keys, "left_semi").select(*keys, "q", F.lit(1).alias("_w"))
    mismatch = (planned.join(wanted, [*keys, "q"], "full").where(F.col("_p").isNull() | F.col("_w").isNull())
                .select(*keys, F.lit("FUNDING_HORIZON_MISMATCH").alias("code")))
    return overdue.unionByName(mismatch).distinct()


def gap_and_revision(df: DataFrame) -> DataFrame:
    """Forecast against current consensus, current against prior."""
    return df.withColumns({"gap": tdiv("ntm_eps", "current_eps") - 1, "revision": tdiv("current_eps", "prior_eps") - 1})


def valuation_diagnostic(df: DataFrame) -> DataFrame:
    """Fixed-multiple value of the forecast and the loss a stressed EPS implies (negative earnings are worth zero)."""
    return df.withColumns({
        "implied_eps": tdiv("price", "reference_pe"), "forecast_value": F.col("ntm_eps") * F.col("reference_pe"),
        "earnings_only_upside": tdiv(F.col("ntm_eps") * F.col("reference_pe"), F.col("price")) - 1,
        "stress_loss": F.greatest(F.lit(0.0), 1 - tdiv(F.greatest(F.lit(0.0), F.col("stress_eps") * F.col("reference_pe")),
                                                       F.col("price")))})


def no_refinancing_bound(df: DataFrame, policy: RiskPolicy) -> DataFrame:
    """All current debt due in the forecast quarter instead of the assumed part of it."""
    extra = F.col("current_debt") - F.col("assumed_principal")
    out = df
    for scenario in ("base", "stress"):
        out = (out.withColumn(f"{scenario}_bound_cash", F.col(f"{scenario}_ending_cash") - extra)
               .withColumn(f"{scenario}_bound_funding", F.greatest(
                   F.lit(0.0), F.lit(policy.minimum_cash_buffer) - F.col(f"{scenario}_bound_cash"))))
    return out


def same_quarter_consensus(consensus: DataFrame, bridge: DataFrame, decision_at) -> DataFrame:
    """Provider figures observed within 24 hours before the decision beside the own estimate of the same quarter."""
    cutoff = F.unix_millis(decision_at)
    seen = F.unix_millis("observed_at")
    fresh = consensus.where((seen <= cutoff) & (cutoff - seen <= 24 * 3600 * 1000))
    own = bridge.select("ticker", "q", F.col("revenue").alias("own_revenue"), F.col("operating_profit").alias("own_op"))
    joined = fresh.join(own, ["ticker", "q"], "left")

    def gap(mine, theirs):
        return F.when(F.col(theirs) > 0, tdiv(F.col(mine) - F.col(theirs), F.col(theirs)) * 100)

    return joined.withColumns({
        "status": F.when(F.col("own_revenue").isNotNull(), "same_quarter_reference").otherwise("consensus_only"),
        "revenue_difference": F.col("own_revenue") - F.col("consensus_revenue"),
        "revenue_difference_pct": gap("own_revenue", "consensus_revenue"),
        "op_difference": F.col("own_op") - F.col("consensus_op"), "op_difference_pct": gap("own_op", "consensus_op")})


# Sessions a base quarter needs and how near its edges the first and last must be.
MIN_BASE_SESSIONS, EDGE_TOLERANCE_DAYS = 40, 10


def per_hold_price(forecast: DataFrame, closes: DataFrame, actuals: DataFrame) -> DataFrame:
    """Next-quarter price at the multiple the market paid in the base quarter.

    forecast(ticker, q, eps), closes(ticker, date, close), actuals(ticker, q, eps)."""
    base = forecast.select("ticker", "q", F.col("eps").alias("forecast_eps"), (F.col("q") - 1).alias("base_q"))
    sessions = (base.join(closes.withColumn("base_q", (F.year("date") * 4 + F.quarter("date") - 1).cast("int")), ["ticker", "base_q"])
                .groupBy("ticker", "q").agg(F.count("*").alias("sessions"), F.min("date").alias("first_date"),
                                            F.max("date").alias("last_date"), F.avg("close").alias("avg_close")))
    latest = closes.groupBy("ticker").agg(F.max_by("close", "date").alias("latest_close"), F.max("date").alias("latest_date"))
    needed = (base.select("ticker", "q", "base_q", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
              .join(actuals.select("ticker", F.col("q").alias("aq"), F.col("eps").alias("actual_eps")).withColumnRenamed("ticker", "t2"),
                    (F.col("ticker") == F.col("t2")) & (F.col("base_q") - F.col("k") == F.col("aq")))
              .groupBy("ticker", "q").agg(F.count("*").alias("n_actual"), F.sum("actual_eps").alias("base_ttm"),
                                          F.sum(F.when(F.col("k") < 3, F.col("actual_eps"))).alias("_recent")))
    joined = base.join(sessions, ["ticker", "q"], "left").join(needed, ["ticker", "q"], "left").join(latest, "ticker", "left")
    complete = F.coalesce((F.col("sessions") >= MIN_BASE_SESSIONS)
                          & (F.datediff("first_date", quarter_start("base_q")) <= EDGE_TOLERANCE_DAYS)
                          & (F.datediff(quarter_end("base_q"), "last_date") <= EDGE_TOLERANCE_DAYS), F.lit(False))
    has_eps = F.coalesce(F.col("n_actual") == 4, F.lit(False))
    ready = complete & has_eps
    average = rnd("avg_close", 2)
    target = F.col("_recent") + F.col("forecast_eps")
    priced = ready & (F.col("base_ttm") > 0) & (target > 0)
    per = tdiv(average, F.col("base_ttm"))
    fair = per * target
    reasons = F.array_compact(F.array(
        F.when(~complete, F.lit("BASE_PRICES_INCOMPLETE")), F.when(~has_eps, F.lit("ACTUAL_EPS_MISSING")),
        F.when(ready & (F.col("base_ttm") <= 0), F.lit("NON_POSITIVE_BASE_EPS")),
        F.when(ready & (F.col("base_ttm") > 0) & (target <= 0), F.lit("NON_POSITIVE_TARGET_EPS"))))
    return joined.select(
        "ticker", "q", F.when(priced, "available").otherwise("unavailable").alias("status"), "sessions",
        F.when(complete, average).alias("average_close"), F.when(ready, rnd("base_ttm", 2)).alias("base_ttm_eps"),
        F.when(ready, rnd(target, 2)).alias("target_ttm_eps"), F.when(priced, rnd(per, 2)).alias("implied_per"),
        F.when(priced, rnd(fair, 0)).alias("fair_price"),
        F.when(priced, rnd((fair / average - 1) * 100, 2)).alias("change_vs_base_pct"),
        F.when(priced, rnd((fair / F.col("latest_close") - 1) * 100, 2)).alias("latest_to_fair_pct"), "latest_date",
        F.array_join(reasons, ",").alias("reasons"))
