"""Earnings, funding, screening and replay queries. Cohorts are decision quarters, companies are part brands.

A cohort's forecast is the four quarters after the decision quarter, its consensus the trailing four quarters, so every
row comes from the sales tables. Amounts are integer cents and shares of them dyadic, which keeps sums exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import quarter_end, quarter_index, sector_key
from strandline.operators import earnings as er
from strandline.operators import panel, replay as rp, screen as sc
from strandline.plans import market as mk
from strandline.plans.registry import ctes, query, rounded, sql_rnd, stable, staged, table

CONFIG = sc.ScreenConfig(fee_bps=10, slippage_bps=20, sell_tax_bps=18, initial_capital=1_000_000.0)
POLICY = CONFIG.risk
RUN = ["run_id", "ticker"]


def brand_number(c="ticker"):
    return F.regexp_extract(c, r"(\d+)", 1).cast("int")


def cells(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", quarter_index(F.to_date("l_shipdate")).alias("q"), F.col("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"), F.col("p_type").alias("segment"))
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", "q", "segment")
            .agg(F.sum("qty").alias("qty"), F.sum("cents").alias("cents")))


def segments(base: DataFrame) -> DataFrame:
    cents, volume = F.col("cents").cast("double"), F.col("qty").cast("double")
    unit = cents / volume
    share = 0.5 + 0.03125 * (F.length("segment") % 8)
    return base.select("ticker", "q", "segment", volume.alias("volume"), unit.alias("unit_price"),
                       (unit * share).alias("variable_cost"), (cents * 0.125).alias("fixed_cost"))


def quarters(spark, sf, base: DataFrame) -> DataFrame:
    shares = table(spark, sf, "part").groupBy(F.col("p_brand").alias("ticker")).agg((F.count("*") * 1000).alias("diluted_shares"))
    revenue = base.groupBy("ticker", "q").agg(F.sum("cents").cast("double").alias("rev"))
    return revenue.join(shares, "ticker").select(
        "ticker", "q", "rev", (F.col("rev") * -0.03125).alias("net_interest"), F.lit(0.25).alias("tax_rate"),
        F.lit(0.0625).alias("noncontrolling_share"), F.lit(5000.0).alias("preferred_claims"),
        F.col("diluted_shares").cast("double").alias("diluted_shares"))


def by_run(df: DataFrame) -> DataFrame:
    """Each quarter belongs to the forecasts of the four decision quarters before it."""
    return df.withColumn("run_id", F.explode(F.array(*[F.col("q") - k for k in range(1, 5)])))


def plan(run_quarters: DataFrame) -> DataFrame:
    rev = F.col("rev")
    group = Window.partitionBy(*RUN)
    first = F.max(F.when(F.col("q") == F.col("run_id") + 1, rev)).over(group)
    b = brand_number()
    return run_quarters.withColumn("_first", F.coalesce(first, F.lit(0.0))).select(
        *RUN, "q", (rev * 0.0625).alias("depreciation"), (rev * 0.125).alias("capex"), (rev * 0.03125).alias("delta_working_capital"),
        (rev * 0.03125).alias("cash_taxes"), (rev * 0.03125).alias("cash_interest"), F.lit(0.0).alias("other_cash_flow"),
        (rev * 0.0625).alias("principal_due"), (rev * 0.03125).alias("committed_draw"), (rev * 0.03125).alias("payouts"),
        (F.col("_first") * 0.125 * (b % 5)).alias("opening_cash"),
        F.when(b % 11 == 0, 0.0).otherwise(F.col("_first") * 0.25).alias("opening_debt"))


SQL_STRAT = """
cells AS (SELECT p_brand AS ticker, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, p_type AS segment,
  sum(CAST(l_quantity AS BIGINT)) AS qty, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
segs AS (SELECT ticker, q, segment, CAST(qty AS DOUBLE) AS volume, CAST(cents AS DOUBLE) / CAST(qty AS DOUBLE) AS unit_price,
  CAST(cents AS DOUBLE) / CAST(qty AS DOUBLE) * (0.5 + 0.03125 * (length(segment) % 8)) AS variable_cost, CAST(cents AS DOUBLE) * 0.125 AS fixed_cost FROM cells),
brand_shares AS (SELECT p_brand AS ticker, CAST(count(*) * 1000 AS DOUBLE) AS diluted_shares FROM part GROUP BY 1),
quarters AS (SELECT c.ticker, c.q, CAST(sum(cents) AS DOUBLE) AS rev, CAST(sum(cents) AS DOUBLE) * -0.03125 AS net_interest, any_value(diluted_shares) AS diluted_shares
  FROM cells c JOIN brand_shares s ON c.ticker = s.ticker GROUP BY 1, 2),
ks AS (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS k),
run_segs AS (SELECT q - k AS run_id, segs.* FROM segs, ks),
run_quarters AS (SELECT q - k AS run_id, quarters.* FROM quarters, ks),
bridge0 AS (SELECT s.ticker, s.q, sum(volume * unit_price) AS revenue, sum(volume * (unit_price - variable_cost) - fixed_cost) AS operating_profit FROM segs s GROUP BY 1, 2),
bridge AS (SELECT b.*, diluted_shares, operating_profit + net_interest AS pretax, greatest(operating_profit + net_interest, 0.0) * 0.25 AS tax,
  ((operating_profit + net_interest) - greatest(operating_profit + net_interest, 0.0) * 0.25) AS net_income,
  ((operating_profit + net_interest) - greatest(operating_profit + net_interest, 0.0) * 0.25) * (1 - 0.0625) - 5000.0 AS common_earnings,
  (((operating_profit + net_interest) - greatest(operating_profit + net_interest, 0.0) * 0.25) * (1 - 0.0625) - 5000.0) / diluted_shares AS eps
  FROM bridge0 b JOIN quarters q ON b.ticker = q.ticker AND b.q = q.q)
"""


@query("segment_contribution", ctes(SQL_STRAT) + f"""SELECT ticker, q, segment, {sql_rnd("volume * unit_price", 2)} AS revenue, {sql_rnd("volume * (unit_price - variable_cost) - fixed_cost", 2)} AS contribution,
  {sql_rnd("CASE WHEN unit_price > variable_cost THEN fixed_cost / (unit_price - variable_cost) END", 4)} AS break_even_volume FROM segs""")
def segment_contribution(spark, sf):
    rows = er.segment_contribution(segments(cells(spark, sf)))
    return rows.select("ticker", "q", "segment", stable("revenue", 2).alias("revenue"), stable("contribution", 2).alias("contribution"),
                       stable("break_even_volume", 4).alias("break_even_volume"))


_BRIDGE = ["revenue", "operating_profit", "pretax", "tax", "net_income", "common_earnings"]


def base_bridge(spark, sf) -> DataFrame:
    base = cells(spark, sf)
    return er.quarter_bridge(segments(base), quarters(spark, sf, base), ["ticker"])


@query("quarter_bridge", ctes(SQL_STRAT) + "SELECT ticker, q, " + ", ".join(f"{sql_rnd(c, 2)} AS {c}" for c in _BRIDGE) + f", {sql_rnd('eps')} AS eps FROM bridge")
def quarter_bridge(spark, sf):
    return base_bridge(spark, sf).select("ticker", "q", *[stable(c, 2).alias(c) for c in _BRIDGE], stable("eps").alias("eps"))


def _shocked_sql(shocks, name="shock") -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS {name}, {p} AS fp, {v} AS fv, {c} AS fc" for n, p, v, c in shocks)
    return rows


@query("sensitivity", ctes(SQL_STRAT) + f""", sh AS ({_shocked_sql(er.SHOCKS)}),
sb AS (SELECT run_id, ticker, q, shock, sum(volume * fv * (unit_price * fp - variable_cost * fc) - fixed_cost) AS op FROM run_segs, sh GROUP BY 1, 2, 3, 4),
se AS (SELECT s.run_id, s.ticker, shock, sum(((op + net_interest) - greatest(op + net_interest, 0.0) * 0.25) * (1 - 0.0625) - 5000.0) OVER () AS dummy,
  (((op + net_interest) - greatest(op + net_interest, 0.0) * 0.25) * (1 - 0.0625) - 5000.0) / diluted_shares AS eps FROM sb s JOIN quarters q ON s.ticker = q.ticker AND s.q = q.q),
sn AS (SELECT run_id, ticker, shock, sum(eps) AS ntm_eps FROM se GROUP BY 1, 2, 3)
SELECT a.run_id, a.ticker, a.shock, {sql_rnd("a.ntm_eps")} AS ntm_eps, {sql_rnd("a.ntm_eps - b.ntm_eps")} AS delta_eps FROM sn a JOIN sn b ON a.run_id = b.run_id AND a.ticker = b.ticker AND b.shock = 'base'""")
def sensitivity(spark, sf):
    base = cells(spark, sf)
    return rounded(er.sensitivity(by_run(segments(base)), by_run(quarters(spark, sf, base)), RUN), [*RUN, "shock"], ["ntm_eps", "delta_eps"])


def risk_tables(spark, sf):
    base = cells(spark, sf)
    run_quarters = by_run(quarters(spark, sf, base))
    schedule = plan(run_quarters)
    scenarios = er.scenario_bridge(by_run(segments(base)), run_quarters, schedule, RUN, POLICY)
    return scenarios, er.funding_rollforward(scenarios, schedule, RUN, POLICY), schedule, run_quarters


SQL_RISK = SQL_STRAT.strip() + f""",
firsts AS (SELECT *, coalesce(max(CASE WHEN q = run_id + 1 THEN rev END) OVER (PARTITION BY run_id, ticker), 0.0) AS first_rev,
  CAST(regexp_extract(ticker, '(\\d+)', 1) AS INTEGER) AS b FROM run_quarters),
plan AS (SELECT run_id, ticker, q, rev, net_interest, diluted_shares, first_rev * 0.125 * (b % 5) AS opening_cash, CASE WHEN b % 11 = 0 THEN 0.0 ELSE first_rev * 0.25 END AS opening_debt FROM firsts),
debts AS (SELECT *, opening_debt + coalesce(sum(rev * 0.03125 - rev * 0.0625) OVER (PARTITION BY run_id, ticker ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open_debt FROM plan),
scen AS ({_shocked_sql((("base", 1.0, 1.0, 1.0), ("stress", 0.95, 0.9, 1.05)), "scenario")}),
sop AS (SELECT run_id, ticker, q, scenario, sum(volume * fv * (unit_price * fp)) AS revenue, sum(volume * fv * (unit_price * fp - variable_cost * fc) - fixed_cost) AS op FROM run_segs, scen GROUP BY 1, 2, 3, 4),
sbr AS (SELECT s.*, d.rev, d.opening_cash, d.open_debt, d.diluted_shares, CASE WHEN scenario = 'stress' THEN open_debt * 200.0 / 10000 / 4 ELSE 0.0 END AS inc, d.net_interest
  FROM sop s JOIN debts d ON s.run_id = d.run_id AND s.ticker = d.ticker AND s.q = d.q),
seps AS (SELECT *, (((op + net_interest - inc) - greatest(op + net_interest - inc, 0.0) * 0.25) * (1 - 0.0625) - 5000.0) / diluted_shares AS eps,
  rev * 0.03125 + inc AS interest_paid, op + rev * 0.0625 - rev * 0.03125 - (rev * 0.03125 + inc) - rev * 0.03125 AS op_cash FROM sbr),
flow AS (SELECT *, op_cash - rev * 0.125 AS fcf, op_cash - rev * 0.125 - rev * 0.0625 + rev * 0.03125 - rev * 0.03125 AS cash_flow, open_debt - rev * 0.03125 AS ending_debt,
  CASE WHEN interest_paid > 0 THEN op / interest_paid END AS interest_coverage FROM seps),
roll AS (SELECT *, opening_cash + sum(cash_flow) OVER (PARTITION BY run_id, ticker, scenario ORDER BY q ROWS UNBOUNDED PRECEDING) AS ending_cash FROM flow),
fsum AS (SELECT run_id, ticker, scenario, least(min(ending_cash), min(opening_cash)) AS minimum_cash, greatest(0.0, -least(min(ending_cash), min(opening_cash))) AS peak_funding,
  sum(rev * 0.125) AS total_capex, sum(fcf) AS total_free_cash_flow, max_by(ending_debt, q) AS final_debt, max_by(ending_cash, q) AS final_cash, min(interest_coverage) AS min_coverage, sum(eps) AS ntm_eps FROM roll GROUP BY 1, 2, 3)
"""


@query("funding_rollforward", ctes(SQL_RISK) + f"""SELECT run_id, ticker, scenario, q, {sql_rnd("ending_cash", 1)} AS ending_cash, {sql_rnd("ending_debt", 1)} AS ending_debt, {sql_rnd("fcf", 1)} AS free_cash_flow,
  {sql_rnd("greatest(0.0, -ending_cash)", 1)} AS additional_funding, {sql_rnd("interest_coverage")} AS interest_coverage, {sql_rnd("CASE WHEN revenue > 0 THEN rev * 0.125 / revenue END")} AS capex_to_revenue FROM roll""")
def funding_rollforward(spark, sf):
    _, roll, _, _ = risk_tables(spark, sf)
    money = ["ending_cash", "ending_debt", "free_cash_flow", "additional_funding"]
    return roll.select(*RUN, "scenario", "q", *[stable(c, 1).alias(c) for c in money],
                       stable("interest_coverage").alias("interest_coverage"), stable("capex_to_revenue").alias("capex_to_revenue"))


_FSUM = ["minimum_cash", "peak_funding", "total_capex", "total_free_cash_flow", "final_debt", "final_cash"]


@query("funding_summary", ctes(SQL_RISK) + "SELECT run_id, ticker, scenario, " + ", ".join(f"{sql_rnd(c, 1)} AS {c}" for c in _FSUM) + f", {sql_rnd('min_coverage')} AS min_coverage FROM fsum")
def funding_summary(spark, sf):
    _, roll, _, _ = risk_tables(spark, sf)
    return er.funding_summary(roll, RUN, POLICY).select(*RUN, "scenario", *[stable(c, 1).alias(c) for c in _FSUM],
                                                        stable("min_coverage").alias("min_coverage"))


@query("stress_eps", ctes(SQL_RISK) + f"SELECT run_id, ticker, scenario, {sql_rnd('ntm_eps')} AS ntm_eps FROM fsum")
def stress_eps(spark, sf):
    scenarios, _, _, _ = risk_tables(spark, sf)
    return rounded(er.ntm_eps(scenarios, [*RUN, "scenario"]), [*RUN, "scenario"], ["ntm_eps"])


@query("invalid_schedules", ctes(SQL_RISK) + """SELECT DISTINCT run_id, ticker, 'INVALID_DEBT_SCHEDULE' AS code FROM debts WHERE rev * 0.0625 > open_debt + rev * 0.03125""")
def invalid_schedules(spark, sf):
    _, _, schedule, run_quarters = risk_tables(spark, sf)
    return er.invalid_schedules(schedule, run_quarters, RUN)


# ---- candidates --------------------------------------------------------------------------------------------------


def candidates(spark, sf) -> DataFrame:
    return staged(spark, sf, "candidates", lambda: build_candidates(spark, sf))


def build_candidates(spark, sf) -> DataFrame:
    base = cells(spark, sf)
    eps = base_bridge(spark, sf).select("ticker", "q", "eps")
    scenarios, roll, schedule, run_quarters = risk_tables(spark, sf)
    whole = er.ntm_eps(scenarios.where(F.col("scenario") == "base"), RUN).where(F.col("n_quarters") == 4)
    risk = er.funding_summary(roll, RUN, POLICY).join(er.ntm_eps(scenarios, [*RUN, "scenario"]).select(*RUN, "scenario", "ntm_eps"), [*RUN, "scenario"])
    risk = risk.groupBy(*RUN).agg(*[F.max(F.when(F.col("scenario") == s, F.col(c))).alias(f"{s}_{a}")
                                    for s in ("base", "stress") for c, a in (("peak_funding", "peak_funding"), ("min_coverage", "min_coverage"), ("ntm_eps", "eps"))])
    order = Window.partitionBy("ticker").orderBy("q")
    trailing = eps.select(F.col("q").alias("run_id"), "ticker", F.sum("eps").over(order.rowsBetween(-3, 0)).alias("current_eps"),
                          F.sum("eps").over(order.rowsBetween(-4, -1)).alias("prior_eps"),
                          F.lag("q", 4).over(order).alias("_q4")).where(F.col("_q4") == F.col("run_id") - 4)
    dates = mk.listed(spark, sf).groupBy("ticker", quarter_index("date").alias("run_id")).agg(
        F.sum("cents").alias("c"), F.sum("qty").alias("v"), F.countDistinct("date").alias("d"))
    traded = dates.select(*RUN, (F.col("c").cast("double") / F.col("d")).alias("adtv"), (F.col("c").cast("double") / F.col("v")).alias("price"))
    codes = er.invalid_schedules(schedule, run_quarters, RUN).groupBy(*RUN).agg(F.min("code").alias("schedule_code"))
    day = F.make_dt_interval(F.lit(1))
    b = F.col("b")

    def days(n):
        return F.make_dt_interval(n)

    joined = (whole.join(trailing, RUN).join(risk, RUN).join(traded, RUN).join(codes, RUN, "left")
              .withColumn("b", brand_number()).withColumn("decision_at", quarter_end("run_id").cast("timestamp") - days(F.lit(5)) + F.expr("interval 6 hours"))
              .withColumn("generated_at", F.col("decision_at") - day)
              .withColumn("current_known_at", F.col("decision_at") - days(b % 40))
              .withColumn("prior_known_at", F.col("current_known_at") - days(b + 15))
              .withColumn("catalyst_known_at", F.col("decision_at") - days(F.lit(3)))
              .withColumn("liquidity_as_of", F.col("generated_at") - days(b % 14)))
    hour = F.expr("interval 1 hour")
    quarters_ahead = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.col("run_id") + k).cast("int"))
    return er.gap_and_revision(joined.withColumns({
        "forecast_ticker": F.col("ticker"), "consensus_ticker": F.col("ticker"), "catalyst_ticker": F.col("ticker"),
        "company_name": F.when(b % 13 != 0, F.col("ticker")), "scope": F.lit("consolidated"),
        "exchange": F.when(b % 8 == 0, "NASDAQ").when(b % 2 == 0, "KOSPI").otherwise("KOSDAQ"),
        "security_type": F.when(b % 17 == 0, "preferred").otherwise("common_stock"), "not_common": F.lit(False),
        "forecast_quarters": F.transform("forecast_quarters", lambda q: q.cast("int")),
        "current_horizon": quarters_ahead, "prior_horizon": F.when(b % 19 == 0, F.slice(quarters_ahead, 1, 3)).otherwise(quarters_ahead),
        "last_source_at": F.when(b % 9 == 0, F.col("generated_at") + hour).otherwise(F.col("generated_at") - hour),
        "provenance_missing": b % 23 == 0, "current_source_at": F.col("current_known_at") - hour,
        "prior_source_at": F.col("prior_known_at") - hour, "catalyst_source_at": F.col("catalyst_known_at") - hour,
        "liquidity_known_at": F.col("liquidity_as_of") + hour, "liquidity_source_at": F.col("liquidity_as_of") + hour,
        "event_at": F.col("decision_at") + days(b * 3 - 2), "has_funding": b % 21 != 0,
        "sector": F.when(b % 2 == 0, F.concat(F.lit(" SECTOR "), (b % 3).cast("string"))).otherwise(F.concat(F.lit("Sector "), (b % 3).cast("string"))),
        "evidence_mode": F.when(b % 6 == 0, "synthetic").otherwise("historical_import_unverified"), "reference_pe": F.lit(100.0)}))


SQL_CAND = SQL_RISK.strip() + """,
trail AS (SELECT q AS run_id, ticker, sum(eps) OVER (PARTITION BY ticker ORDER BY q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS current_eps,
  sum(eps) OVER (PARTITION BY ticker ORDER BY q ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS prior_eps, lag(q, 4) OVER (PARTITION BY ticker ORDER BY q) AS q4 FROM bridge),
traded AS (SELECT p_brand AS ticker, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS run_id,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(DISTINCT CAST(l_shipdate AS DATE)) AS adtv,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bad AS (SELECT DISTINCT run_id, ticker FROM debts WHERE rev * 0.0625 > open_debt + rev * 0.03125),
nq AS (SELECT run_id, ticker, count(*) AS n FROM run_quarters GROUP BY 1, 2 HAVING count(*) = 4),
cand0 AS (SELECT n.run_id, n.ticker, CAST(regexp_extract(n.ticker, '(\\d+)', 1) AS INTEGER) AS b, fb.ntm_eps, fs.ntm_eps AS stress_eps, fb.peak_funding AS base_peak, fs.peak_funding AS stress_peak, fb.min_coverage AS base_cov,
  t.current_eps, t.prior_eps, d.adtv, d.price, bad.ticker IS NOT NULL AS bad_schedule, fb.ntm_eps / t.current_eps - 1 AS gap, t.current_eps / t.prior_eps - 1 AS revision
  FROM nq n JOIN trail t ON n.run_id = t.run_id AND n.ticker = t.ticker AND t.q4 = t.run_id - 4
  JOIN fsum fb ON fb.run_id = n.run_id AND fb.ticker = n.ticker AND fb.scenario = 'base' JOIN fsum fs ON fs.run_id = n.run_id AND fs.ticker = n.ticker AND fs.scenario = 'stress'
  JOIN traded d ON d.run_id = n.run_id AND d.ticker = n.ticker LEFT JOIN bad ON bad.run_id = n.run_id AND bad.ticker = n.ticker),
cand AS (SELECT *, current_eps > 0 AND current_eps >= 1 AND prior_eps > 0 AND prior_eps >= 1 AS usable, trim(lower(CASE WHEN b % 2 = 0 THEN ' SECTOR ' ELSE 'Sector ' END || (b % 3))) AS sector_key FROM cand0),
reasons AS (SELECT run_id, ticker, unnest(list_filter([
  CASE WHEN b % 13 = 0 THEN 'COMPANY_SCOPE_MISSING' END, CASE WHEN b % 13 <> 0 AND (b % 8 = 0 OR b % 17 = 0) THEN 'NOT_KOSPI_COMMON' END,
  CASE WHEN b % 19 = 0 THEN 'ROLLING_HORIZON_CHANGED' END, CASE WHEN b % 9 = 0 THEN 'SOURCE_KNOWN_AFTER_GENERATION' END, CASE WHEN b % 23 = 0 THEN 'FORECAST_PROVENANCE_MISSING' END,
  CASE WHEN b % 14 = 0 THEN 'LIQUIDITY_TIME_MISMATCH' END, CASE WHEN 1 + b % 14 > 10 THEN 'LIQUIDITY_STALE' END, CASE WHEN b % 21 = 0 THEN 'RISK_DATA_MISSING' END,
  CASE WHEN bad_schedule THEN 'INVALID_DEBT_SCHEDULE' END, CASE WHEN b % 21 <> 0 AND NOT bad_schedule AND base_peak > 0 THEN 'BASE_FUNDING_GAP' END,
  CASE WHEN b % 21 <> 0 AND NOT bad_schedule AND stress_peak > 0 THEN 'STRESS_FUNDING_GAP' END, CASE WHEN b % 21 <> 0 AND NOT bad_schedule AND base_cov < 1 THEN 'LOW_INTEREST_COVERAGE' END,
  CASE WHEN current_eps <= 0 THEN 'NONPOSITIVE_CURRENT_CONSENSUS_EPS' WHEN current_eps < 1 THEN 'NEAR_ZERO_CURRENT_CONSENSUS_EPS' END,
  CASE WHEN prior_eps <= 0 THEN 'NONPOSITIVE_PRIOR_CONSENSUS_EPS' WHEN prior_eps < 1 THEN 'NEAR_ZERO_PRIOR_CONSENSUS_EPS' END,
  CASE WHEN b % 40 > 30 THEN 'CURRENT_CONSENSUS_STALE' END, CASE WHEN b + 15 NOT BETWEEN 20 AND 40 THEN 'PRIOR_CONSENSUS_LAG_OUT_OF_RANGE' END,
  CASE WHEN b * 3 - 2 <= 0 THEN 'CATALYST_NOT_FUTURE' WHEN b * 3 - 2 NOT BETWEEN 1 AND 60 THEN 'CATALYST_WINDOW_VIOLATION' END,
  CASE WHEN usable AND revision <= 0 THEN 'NO_POSITIVE_REVISION' END, CASE WHEN usable AND gap < 0.1 THEN 'GAP_BELOW_THRESHOLD' END], lambda x: x IS NOT NULL)) AS code FROM cand)
"""


@query("gap_and_revision", ctes(SQL_CAND) + f"""SELECT run_id, ticker, {sql_rnd("gap")} AS gap, {sql_rnd("revision")} AS revision, {sql_rnd("ntm_eps * 100 / price - 1")} AS earnings_only_upside,
  {sql_rnd("greatest(0.0, 1 - greatest(0.0, stress_eps * 100) / price)")} AS stress_loss FROM cand""")
def gap_and_revision(spark, sf):
    return rounded(er.valuation_diagnostic(candidates(spark, sf)), RUN, ["gap", "revision", "earnings_only_upside", "stress_loss"])


@query("screen_reasons", ctes(SQL_CAND) + "SELECT run_id, ticker, code FROM reasons")
def screen_reasons(spark, sf):
    return sc.gate_reasons(candidates(spark, sf), CONFIG)


@query("duplicate_candidates", "SELECT CAST(o_orderdate AS DATE) AS run_id, o_custkey AS ticker, 'DUPLICATE_CANDIDATE' AS code FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_candidates(spark, sf):
    return sc.duplicate_candidates(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("run_id"), F.col("o_custkey").alias("ticker")))


def relaxed(spark, sf):
    """Selection with the funding, provenance and sizing gates satisfied for most brands, so cohorts hold positions."""
    rows = er.valuation_diagnostic(candidates(spark, sf)).withColumn("sector_key", sector_key("sector"))
    reasons = sc.gate_reasons(rows, CONFIG).where(F.col("code").isin(*HARD_CODES))
    chosen = sc.allocate(sc.eligible(rows, reasons, sc.duplicate_candidates(rows)), CONFIG)
    return rows, staged(spark, sf, "selection", lambda: chosen)


HARD_CODES = ["COMPANY_SCOPE_MISSING", "NOT_KOSPI_COMMON", "NO_POSITIVE_REVISION", "GAP_BELOW_THRESHOLD", "CATALYST_WINDOW_VIOLATION"]
SQL_SELECT = SQL_CAND.strip() + f""",
ok AS (SELECT c.*, greatest(0.0, 1 - greatest(0.0, stress_eps * 100) / price) AS stress_loss FROM cand c WHERE NOT EXISTS (SELECT 1 FROM reasons r WHERE r.run_id = c.run_id AND r.ticker = c.ticker AND r.code IN ({", ".join(f"'{c}'" for c in HARD_CODES)}))),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gap DESC, ticker) AS rank FROM ok),
top AS (SELECT *, least(0.2, 1.0 / count(*) OVER (PARTITION BY run_id), 0.6 / count(*) OVER (PARTITION BY run_id, sector_key)) AS allocation_limit, least(0.2, 1.0 / count(*) OVER (PARTITION BY run_id)) AS equal FROM rk WHERE rank <= 5),
sel AS (SELECT *, least(allocation_limit, coalesce(adtv * 0.01 / 1000000.0, equal)) AS weight FROM top)
"""


@query("screen_allocation", ctes(SQL_SELECT) + f"""SELECT run_id, ticker, sector_key, CAST(rank AS INTEGER) AS rank, weight < allocation_limit AS liquidity_limited, {sql_rnd("weight")} AS weight,
  {sql_rnd("weight * 1000000.0 / adtv")} AS participation_rate, {sql_rnd("stress_loss")} AS stress_loss FROM sel""")
def screen_allocation(spark, sf):
    _, selected = relaxed(spark, sf)
    return rounded(selected, [*RUN, "sector_key", "rank", "liquidity_limited"], ["weight", "participation_rate", "stress_loss"])


_PORT = ["invested_weight", "idle_cash", "largest_position_weight", "largest_sector_weight", "stress_loss"]


@query("portfolio", ctes(SQL_SELECT) + f""", sw AS (SELECT run_id, max(w) AS mw FROM (SELECT run_id, sector_key, sum(weight) AS w FROM sel GROUP BY 1, 2) GROUP BY 1),
pf AS (SELECT r.run_id, count(s.ticker) AS holdings, coalesce(sum(weight), 0.0) AS invested_weight, (1 - coalesce(sum(weight), 0.0)) * 1000000.0 AS idle_cash, coalesce(max(weight), 0.0) AS largest_position_weight,
  coalesce(any_value(mw), 0.0) AS largest_sector_weight, coalesce(sum(weight * stress_loss), 0.0) AS stress_loss FROM (SELECT DISTINCT run_id FROM cand) r LEFT JOIN sel s ON r.run_id = s.run_id LEFT JOIN sw ON sw.run_id = r.run_id GROUP BY 1)
SELECT run_id, holdings, holdings = 0 AS no_trade, {", ".join(f"{sql_rnd(c)} AS {c}" for c in _PORT)} FROM pf""")
def portfolio(spark, sf):
    rows, selected = relaxed(spark, sf)
    return rounded(sc.portfolio(rows, selected, CONFIG), ["run_id", "holdings", "no_trade"], _PORT)


@query("run_mode", ctes(SQL_CAND) + "SELECT run_id, CASE WHEN bool_or(b % 6 = 0) THEN 'synthetic' ELSE 'retrospective_research' END AS experiment_mode FROM cand GROUP BY 1")
def run_mode(spark, sf):
    return sc.run_mode(candidates(spark, sf))


# ---- replay ------------------------------------------------------------------------------------------------------


def replay_sessions(spark, sf, runs: DataFrame) -> DataFrame:
    """The first 20 index dates after each decision."""
    dates = mk.index_bars(spark, sf).select("date", F.explode(F.array(quarter_index("date"), quarter_index("date") - 1)).alias("run_id"))
    rows = dates.join(runs.select("run_id", F.to_date("decision_at").alias("d")), "run_id").where(F.col("date") > F.col("d"))
    order = Window.partitionBy("run_id").orderBy("date")
    return (rows.withColumn("idx", F.row_number().over(order) - 1).where(F.col("idx") < CONFIG.hold_sessions)
            .select("run_id", "idx", "date", F.col("date").cast("timestamp").alias("open_at"),
                    (F.col("date").cast("timestamp") + F.expr("interval 6 hours")).alias("close_at")))


def replay_prices(spark, sf, sessions: DataFrame, selected: DataFrame) -> DataFrame:
    """Opens and closes of the selected brands as known at each session of their run; brands with a multiple of 12 only
    have prices on their trading dates."""
    dates = sessions.select("date").distinct()
    bars = mk.bars(spark, sf).select("ticker", "date", "close")
    probes = selected.select("run_id", "ticker").join(sessions.select("run_id", "date"), "run_id").select("ticker", "date").distinct()
    close = panel.asof_join(probes, bars, "close", by=["ticker"])
    both = panel.asof_join(close, bars.withColumnRenamed("close", "open"), "open", by=["ticker"], strict=True)
    exact = bars.select("ticker", "date", F.lit(True).alias("_exact"))
    shown = both.join(exact, ["ticker", "date"], "left").where((brand_number() % 12 != 0) | F.col("_exact"))
    series = [shown.select(F.col("ticker").alias("label"), "date", "open", "close")]
    for label, source in ((rp.MARKET, mk.index_bars(spark, sf)), (rp.SECTOR, mk.fx_bars(spark, sf))):
        one = source.select(F.col("index_name").alias("label"), "date", "close")
        tagged = dates.withColumn("label", F.lit(mk.INDEX))
        with_close = panel.asof_join(tagged, one, "close", by=["label"])
        with_open = panel.asof_join(with_close, one.withColumnRenamed("close", "open"), "open", by=["label"], strict=True)
        series.append(with_open.select(F.lit(label).alias("label"), "date", "open", "close"))
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    return sessions.select("run_id", "idx", "date").join(out, "date").select("run_id", "label", "idx", "open", "close")


def runs_of(rows: DataFrame) -> DataFrame:
    runs = rows.groupBy("run_id").agg(F.max("decision_at").alias("decision_at")).withColumns({
        "selection_decision_at": F.col("decision_at"), "evaluated_at": F.col("decision_at") + F.expr("interval 400 days"),
        "outcome_known_at": F.col("decision_at") + F.expr("interval 300 days"), "config_digest": F.lit("c"), "selection_digest": F.lit("c")})
    return runs.join(sc.run_mode(rows), "run_id")


def replay_inputs(spark, sf):
    rows, selected = relaxed(spark, sf)
    runs = staged(spark, sf, "runs", lambda: runs_of(rows))
    sessions = staged(spark, sf, "sessions", lambda: replay_sessions(spark, sf, runs))
    return runs, selected, sessions, staged(spark, sf, "session-prices", lambda: replay_prices(spark, sf, sessions, selected))


SQL_REPLAY = SQL_SELECT.strip() + "," + mk.SQL_BARS.strip() + "," + mk.SQL_INDEX.strip() + """,
runs AS (SELECT run_id, CAST(last_day(make_date(CAST(run_id // 4 AS INTEGER), CAST((run_id % 4) * 3 + 3 AS INTEGER), 1)) AS DATE) - 5 AS d FROM (SELECT DISTINCT run_id FROM cand)),
sess AS (SELECT * FROM (SELECT r.run_id, i.date, row_number() OVER (PARTITION BY r.run_id ORDER BY i.date) - 1 AS idx FROM runs r JOIN index_bars i ON i.date > r.d AND year(i.date) * 4 + quarter(i.date) - 1 IN (r.run_id, r.run_id + 1)) WHERE idx < 20),
sdates AS (SELECT DISTINCT date FROM sess),
probe AS (SELECT t.ticker, s.date FROM (SELECT DISTINCT ticker FROM bars) t, sdates s),
tp AS (SELECT p.ticker AS label, p.date, o.close AS open, c.close AS close, p.date = c.date AS exact FROM probe p ASOF LEFT JOIN bars c ON p.ticker = c.ticker AND p.date >= c.date ASOF LEFT JOIN bars o ON p.ticker = o.ticker AND p.date > o.date),
bench AS (SELECT 'MARKET_BENCHMARK' AS label, s.date, o.close AS open, c.close AS close FROM sdates s ASOF LEFT JOIN index_bars c ON s.date >= c.date ASOF LEFT JOIN index_bars o ON s.date > o.date
  UNION ALL SELECT 'SECTOR_BENCHMARK', s.date, o.close, c.close FROM sdates s ASOF LEFT JOIN fx_bars c ON s.date >= c.date ASOF LEFT JOIN fx_bars o ON s.date > o.date),
price AS (SELECT run_id, label, idx, open, close FROM sess JOIN (SELECT label, date, open, close FROM tp WHERE CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) % 12 <> 0 OR exact UNION ALL SELECT * FROM bench) x USING (date)),
want AS (SELECT run_id, ticker AS label FROM sel UNION ALL SELECT run_id, 'MARKET_BENCHMARK' FROM runs UNION ALL SELECT run_id, 'SECTOR_BENCHMARK' FROM runs),
holes AS (SELECT DISTINCT w.run_id, w.label AS subject, 'missing price' AS reason FROM want w JOIN sess s ON w.run_id = s.run_id LEFT JOIN price p ON p.run_id = w.run_id AND p.label = w.label AND p.idx = s.idx WHERE p.open IS NULL OR p.close IS NULL),
shortcal AS (SELECT r.run_id, 'calendar' AS subject, 'session count differs from config' AS reason FROM runs r LEFT JOIN sess s ON r.run_id = s.run_id GROUP BY 1 HAVING count(s.idx) <> 20),
problems AS (SELECT * FROM holes UNION ALL SELECT * FROM shortcal),
good AS (SELECT run_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM problems)),
pos AS (SELECT s.run_id, s.ticker, s.weight, s.weight * 1000000.0 AS budget, a.open AS entry_open, z.close AS exit_close, s.weight * 1000000.0 / (a.open * 1.002 * 1.001) AS units
  FROM sel s JOIN good USING (run_id) JOIN price a ON a.run_id = s.run_id AND a.label = s.ticker AND a.idx = 0 JOIN price z ON z.run_id = s.run_id AND z.label = s.ticker AND z.idx = 19),
net AS (SELECT *, units * exit_close * 0.998 * (1 - 0.001 - 0.0018) AS net_exit FROM pos),
curve AS (SELECT g.run_id, CAST(s.idx + 1 AS INTEGER) AS point, 1000000.0 - coalesce((SELECT sum(budget) FROM net n WHERE n.run_id = g.run_id), 0.0)
   + CASE WHEN s.idx = 19 THEN coalesce((SELECT sum(net_exit) FROM net n WHERE n.run_id = g.run_id), 0.0) ELSE coalesce((SELECT sum(n.units * p.close) FROM net n JOIN price p ON p.run_id = n.run_id AND p.label = n.ticker AND p.idx = s.idx WHERE n.run_id = g.run_id), 0.0) END AS equity
  FROM good g JOIN sess s ON g.run_id = s.run_id UNION ALL SELECT run_id, 0, 1000000.0 FROM good),
dd AS (SELECT run_id, greatest(max((peak - equity) / peak), 0.0) * 100 AS max_drawdown_pct, max_by(equity, point) AS final_equity FROM (SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY point) AS peak FROM curve) GROUP BY 1)
"""


@query("replay_incomplete", ctes(SQL_REPLAY) + "SELECT * FROM problems")
def replay_incomplete(spark, sf):
    runs, selected, sessions, prices = replay_inputs(spark, sf)
    return rp.incomplete(runs, selected, sessions, prices, CONFIG)


def complete_replay(spark, sf):
    runs, selected, sessions, prices = replay_inputs(spark, sf)
    broken = rp.incomplete(runs, selected, sessions, prices, CONFIG).select("run_id").distinct()
    good = staged(spark, sf, "complete-runs", lambda: runs.join(broken, "run_id", "left_anti"))
    last = sessions.groupBy("run_id").agg(F.max("idx").alias("last_idx"))
    held = staged(spark, sf, "positions", lambda: rp.positions(
        selected.join(good.select("run_id"), "run_id", "left_semi"), prices, last, CONFIG))
    return good, held, rp.equity_curve(good, held, sessions, prices, CONFIG), prices, last, selected


_POS = ["budget", "entry_open", "exit_close", "units", "net_exit_value", "entry_slippage", "entry_fee", "exit_slippage", "exit_fee", "exit_tax"]


@query("replay_positions", ctes(SQL_REPLAY) + f"""SELECT run_id, ticker, {", ".join(f"{sql_rnd(e, 4)} AS {n}" for n, e in (
    ("budget", "budget"), ("entry_open", "entry_open"), ("exit_close", "exit_close"), ("units", "units"), ("net_exit_value", "net_exit"),
    ("entry_slippage", "units * entry_open * 0.002"), ("entry_fee", "units * entry_open * 1.002 * 0.001"), ("exit_slippage", "units * exit_close * 0.002"),
    ("exit_fee", "units * exit_close * 0.998 * 0.001"), ("exit_tax", "units * exit_close * 0.998 * 0.0018")))} FROM net""")
def replay_positions(spark, sf):
    return rounded(complete_replay(spark, sf)[1], RUN, _POS, 4)


@query("replay_equity", ctes(SQL_REPLAY) + f"SELECT run_id, point, {sql_rnd('equity', 4)} AS equity FROM curve")
def replay_equity(spark, sf):
    return rounded(complete_replay(spark, sf)[2], ["run_id", "point"], ["equity"], 4)


_RUN = ["max_drawdown_pct", "final_equity", "net_return_pct", "gross_return_pct", "market_return_pct", "sector_return_pct",
        "excess_vs_market_pct", "cash_weighted_sector_pct", "turnover", "total_cost"]


@query("replay_summary", ctes(SQL_REPLAY) + f""", tot AS (SELECT run_id, count(*) AS n, sum(budget) AS invested, sum(budget / entry_open * exit_close) AS gross, sum(units * entry_open * 1.002) AS buys, sum(units * exit_close * 0.998) AS sells,
  sum(units * entry_open * 0.002 + units * entry_open * 1.002 * 0.001 + units * exit_close * 0.002 + units * exit_close * 0.998 * 0.001 + units * exit_close * 0.998 * 0.0018) AS total_cost FROM net GROUP BY 1),
br AS (SELECT run_id, label, (max(CASE WHEN idx = 19 THEN close END) / max(CASE WHEN idx = 0 THEN open END) - 1) * 100 AS ret FROM price WHERE label IN ('MARKET_BENCHMARK', 'SECTOR_BENCHMARK') GROUP BY 1, 2),
fin AS (SELECT d.run_id, CASE WHEN t.n IS NULL THEN 'no_trade' ELSE 'completed' END AS status, max_drawdown_pct, final_equity, (final_equity / 1000000.0 - 1) * 100 AS net_return_pct,
  ((1000000.0 - coalesce(invested, 0.0) + coalesce(gross, 0.0)) / 1000000.0 - 1) * 100 AS gross_return_pct, m.ret AS market_return_pct, s.ret AS sector_return_pct, (final_equity / 1000000.0 - 1) * 100 - m.ret AS excess_vs_market_pct,
  coalesce(invested, 0.0) / 1000000.0 * s.ret AS cash_weighted_sector_pct, (coalesce(buys, 0.0) + coalesce(sells, 0.0)) / 1000000.0 AS turnover, coalesce(total_cost, 0.0) AS total_cost
  FROM dd d LEFT JOIN tot t USING (run_id) JOIN br m ON m.run_id = d.run_id AND m.label = 'MARKET_BENCHMARK' JOIN br s ON s.run_id = d.run_id AND s.label = 'SECTOR_BENCHMARK')
SELECT run_id, status, {", ".join(f"{sql_rnd(c, 5)} AS {c}" for c in _RUN)} FROM fin""")
def replay_summary(spark, sf):
    good, held, curve, prices, last, _ = complete_replay(spark, sf)
    return rounded(rp.run_summary(good, held, curve, prices, last, CONFIG), ["run_id", "status"], _RUN, 5)


@query("replay_forecast_accuracy", ctes(SQL_SELECT) + f""", fa AS (SELECT s.run_id, s.ticker, any_value(s.ntm_eps) AS ntm_eps, sum(b.eps * 0.75) AS realised_ntm_eps FROM sel s JOIN bridge b ON b.ticker = s.ticker AND b.q BETWEEN s.run_id + 1 AND s.run_id + 4 GROUP BY 1, 2)
SELECT run_id, ticker, {sql_rnd("ntm_eps")} AS ntm_eps, {sql_rnd("realised_ntm_eps")} AS realised_ntm_eps, {sql_rnd("CASE WHEN abs(realised_ntm_eps) >= 1 THEN (ntm_eps - realised_ntm_eps) / abs(realised_ntm_eps) * 100 END", 4)} AS error_pct FROM fa""")
def replay_forecast_accuracy(spark, sf):
    _, selected = relaxed(spark, sf)
    realised = base_bridge(spark, sf).select("ticker", "q", (F.col("eps") * 0.75).alias("eps"))
    wanted = selected.select("run_id", "ticker", F.explode("forecast_quarters").alias("q"))
    rows = rp.forecast_accuracy(selected, wanted, realised, CONFIG)
    return rows.select(*RUN, stable("ntm_eps").alias("ntm_eps"), stable("realised_ntm_eps").alias("realised_ntm_eps"), stable("error_pct", 4).alias("error_pct"))


# ---- references beside a forecast ---------------------------------------------------------------------------------


@query("per_hold_price", ctes(SQL_STRAT.strip() + "," + mk.SQL_BARS.strip()) + f""", fq AS (SELECT ticker, q, eps AS forecast_eps, q - 1 AS base_q FROM bridge),
ses AS (SELECT f.ticker, f.q, count(*) AS sessions, min(b.date) AS fd, max(b.date) AS ld, avg(b.close) AS ac FROM fq f JOIN bars b ON b.ticker = f.ticker AND year(b.date) * 4 + quarter(b.date) - 1 = f.base_q GROUP BY 1, 2),
act AS (SELECT f.ticker, f.q, count(*) AS n, sum(b.eps) AS base_ttm, sum(CASE WHEN b.q > f.base_q - 3 THEN b.eps END) AS recent FROM fq f JOIN bridge b ON b.ticker = f.ticker AND b.q BETWEEN f.base_q - 3 AND f.base_q GROUP BY 1, 2),
lat AS (SELECT ticker, max_by(close, date) AS lc, max(date) AS latest_date FROM bars GROUP BY 1),
j AS (SELECT f.*, sessions, ac, base_ttm, recent + forecast_eps AS target, lc, latest_date, coalesce(sessions >= 40 AND fd - make_date(CAST(base_q // 4 AS INTEGER), CAST(base_q % 4 * 3 + 1 AS INTEGER), 1) <= 10
  AND CAST(last_day(make_date(CAST(base_q // 4 AS INTEGER), CAST(base_q % 4 * 3 + 3 AS INTEGER), 1)) AS DATE) - ld <= 10, false) AS complete, coalesce(n = 4, false) AS has_eps
  FROM fq f LEFT JOIN ses s ON s.ticker = f.ticker AND s.q = f.q LEFT JOIN act a ON a.ticker = f.ticker AND a.q = f.q LEFT JOIN lat l ON l.ticker = f.ticker),
p AS (SELECT *, floor(ac * 100.0 + 0.5) / 100.0 AS av, complete AND has_eps AS ready, complete AND has_eps AND base_ttm > 0 AND target > 0 AS priced FROM j)
SELECT ticker, q, CASE WHEN priced THEN 'available' ELSE 'unavailable' END AS status, sessions, CASE WHEN complete THEN av END AS average_close, CASE WHEN priced THEN floor(av / base_ttm * 100.0 + 0.5) / 100.0 END AS implied_per,
  CASE WHEN priced THEN floor(av / base_ttm * target + 0.5) END AS fair_price, latest_date,
  concat_ws(',', CASE WHEN NOT complete THEN 'BASE_PRICES_INCOMPLETE' END, CASE WHEN NOT has_eps THEN 'ACTUAL_EPS_MISSING' END, CASE WHEN ready AND base_ttm <= 0 THEN 'NON_POSITIVE_BASE_EPS' END,
   CASE WHEN ready AND base_ttm > 0 AND target <= 0 THEN 'NON_POSITIVE_TARGET_EPS' END) AS reasons FROM p""")
def per_hold_price(spark, sf):
    eps = base_bridge(spark, sf).select("ticker", "q", "eps")
    out = er.per_hold_price(eps, mk.bars(spark, sf).select("ticker", "date", "close"), eps)
    return out.select("ticker", "q", "status", "sessions", "average_close", "implied_per", "fair_price", "latest_date", "reasons")


@query("same_quarter_consensus", ctes(SQL_STRAT) + f""", con AS (SELECT p_brand AS ticker, o_orderkey, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, l_linenumber, l_partkey, l_suppkey, l_extendedprice * 100000 AS consensus_revenue, l_extendedprice * 1000 AS consensus_op, o_orderdate AS observed_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1998-06-30 12:00:00' AND o_orderdate >= TIMESTAMP '1998-06-29 12:00:00')
SELECT c.ticker, c.q, o_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN b.revenue IS NOT NULL THEN 'same_quarter_reference' ELSE 'consensus_only' END AS status,
  {sql_rnd("CASE WHEN consensus_revenue > 0 THEN (b.revenue - consensus_revenue) / consensus_revenue * 100 END", 4)} AS revenue_difference_pct,
  {sql_rnd("CASE WHEN consensus_op > 0 THEN (b.operating_profit - consensus_op) / consensus_op * 100 END", 4)} AS op_difference_pct FROM con c LEFT JOIN bridge b ON b.ticker = c.ticker AND b.q = c.q""")
def same_quarter_consensus(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("observed_at"))
    decision = F.lit("1998-06-30 12:00:00").cast("timestamp")
    consensus = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
                 .select("ticker", quarter_index(F.to_date("l_shipdate")).alias("q"), "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("observed_at").cast("timestamp").alias("observed_at"),
                         (F.col("l_extendedprice") * 100000).alias("consensus_revenue"), (F.col("l_extendedprice") * 1000).alias("consensus_op")))
    out = er.same_quarter_consensus(consensus, base_bridge(spark, sf), decision)
    return rounded(out, ["ticker", "q", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status"], ["revenue_difference_pct", "op_difference_pct"], 4)


@query("no_refinancing_bound", ctes(SQL_RISK) + f""", w AS (SELECT run_id, ticker, max(CASE WHEN scenario = 'base' THEN final_cash END) AS bc, max(CASE WHEN scenario = 'stress' THEN final_cash END) AS sc FROM fsum GROUP BY 1, 2),
x AS (SELECT w.*, d.opening_debt - d.opening_debt / 4 AS extra FROM w JOIN (SELECT DISTINCT run_id, ticker, opening_debt FROM plan) d USING (run_id, ticker))
SELECT run_id, ticker, {sql_rnd("bc - extra", 1)} AS base_bound_cash, {sql_rnd("sc - extra", 1)} AS stress_bound_cash, {sql_rnd("greatest(0.0, -(bc - extra))", 1)} AS base_bound_funding, {sql_rnd("greatest(0.0, -(sc - extra))", 1)} AS stress_bound_funding FROM x""")
def no_refinancing_bound(spark, sf):
    _, roll, schedule, _ = risk_tables(spark, sf)
    cash = er.funding_summary(roll, RUN, POLICY).groupBy(*RUN).agg(*[
        F.max(F.when(F.col("scenario") == s, F.col("final_cash"))).alias(f"{s}_ending_cash") for s in ("base", "stress")])
    debt = schedule.groupBy(*RUN).agg(F.max("opening_debt").alias("current_debt")).withColumn("assumed_principal", F.col("current_debt") / 4)
    return rounded(er.no_refinancing_bound(cash.join(debt, RUN), POLICY), RUN,
                   ["base_bound_cash", "stress_bound_cash", "base_bound_funding", "stress_bound_funding"], 1)
