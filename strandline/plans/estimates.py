"""Single-quarter estimate queries over the screening candidates, and company profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import candidates as ca
from strandline.operators import filings as fl
from strandline.operators import valuation as va
from strandline.plans import strategy as sg
from strandline.plans import valuing as vl
from strandline.plans.registry import ctes, query, rounded, sql_rnd, table


def single(spark, sf):
    """Screening candidates cut to one forecast quarter: the quarter after, of or before the decision by brand."""
    b = F.col("b")
    return sg.candidates(spark, sf).withColumns({
        "id": F.concat_ws(":", "run_id", "ticker"), "forecast_quarters": F.array((F.col("run_id") + F.when(b % 4 == 0, 1).when(b % 4 == 1, -1).otherwise(0)).cast("int")),
        "funding_source_at": F.when(b % 15 == 0, F.col("decision_at") + F.expr("interval 1 day")).otherwise(F.col("generated_at") - F.expr("interval 1 day"))})


SQL_SINGLE = sg.SQL_CAND.strip() + """,
sq AS (SELECT run_id || ':' || ticker AS id, b FROM cand),
idr AS (SELECT id, unnest(list_filter([CASE WHEN b % 13 = 0 THEN 'FORECAST_COMPANY_SCOPE_MISSING' END, CASE WHEN b % 13 <> 0 AND (b % 8 = 0 OR b % 17 = 0) THEN 'FORECAST_NOT_KOSPI_COMMON' END, CASE WHEN b % 4 = 0 THEN 'FORECAST_HORIZON_NOT_SINGLE_QUARTER' END, CASE WHEN b % 9 = 0 THEN 'FORECAST_SOURCE_AFTER_GENERATION' END], lambda x: x IS NOT NULL)) AS code FROM sq),
lat2 AS (SELECT id, 'LIQUIDITY_TIME_MISMATCH' AS code FROM sq WHERE b % 14 = 0 UNION ALL SELECT id, 'FUNDING_TIME_MISMATCH' FROM sq WHERE b % 15 = 0 AND b % 21 <> 0)
"""


@query("estimate_identity", ctes(SQL_SINGLE) + "SELECT id, code FROM idr")
def estimate_identity(spark, sf):
    return ca.identity_reasons(single(spark, sf))


@query("late_blocks", ctes(SQL_SINGLE) + "SELECT * FROM lat2")
def late_blocks(spark, sf):
    return ca.late_blocks(single(spark, sf))


@query("blocks_kept", ctes(SQL_SINGLE) + "SELECT id, b % 14 <> 0 AS has_liquidity, b % 21 <> 0 AND b % 15 <> 0 AS has_funding FROM sq")
def blocks_kept(spark, sf):
    c = single(spark, sf)
    return ca.drop_late_blocks(c, ca.late_blocks(c)).select("id", F.col("adtv").isNotNull().alias("has_liquidity"), "has_funding")


@query("estimate_status", ctes(SQL_SINGLE) + """SELECT id, CASE WHEN EXISTS (SELECT 1 FROM idr i WHERE i.id = sq.id) THEN 'insufficient_data' WHEN b % 3 = 0 THEN 'estimate_only' WHEN b * 3 - 2 > 60 THEN 'ineligible' ELSE 'eligible' END AS status FROM sq""")
def estimate_status(spark, sf):
    c = single(spark, sf)
    gates = c.where(F.datediff("event_at", "decision_at") > 60).select("id", F.lit("CATALYST_WINDOW_VIOLATION").alias("code"))
    return ca.status(c, ca.identity_reasons(c), gates, F.col("b") % 3 != 0)


@query("assumption_flattening", ctes(sg.SQL_STRAT) + """SELECT ticker AS id, 'forecast.quarters[' || q || '].bridgeAssumptions' AS path, true AS is_model_estimate FROM quarters WHERE q % 2 = 0
UNION ALL SELECT ticker, 'forecast.quarters[' || q || '].segments[' || length(segment) || '].assumptions', true FROM segs UNION ALL SELECT ticker, 'forecast.funding.quarters[' || q || '].assumptions', false FROM quarters""")
def assumption_flattening(spark, sf):
    base = sg.cells(spark, sf)
    q = base.select("ticker", "q").distinct().select(F.col("ticker").alias("id"), F.col("q").alias("pos"), F.when(F.col("q") % 2 == 0, "why").alias("rationale"), F.lit("doc").alias("source"))
    segs = base.select(F.col("ticker").alias("id"), F.col("q").alias("pos"), F.length("segment").alias("seg_pos"), F.lit("why").alias("rationale"), F.lit("doc").alias("source"))
    return ca.assumptions(q, segs, q.withColumn("rationale", F.lit("filing")), True).select("id", "path", "is_model_estimate")


@query("input_faults", ctes(sg.SQL_STRAT) + """SELECT DISTINCT ticker AS id, 'QUARTERS_NOT_CONSECUTIVE' AS code FROM quarters WHERE CAST(regexp_extract(ticker, '(\\d+)', 1) AS INTEGER) % 5 = 0
UNION SELECT ticker, 'TAX_RATE_OUT_OF_RANGE' FROM quarters WHERE CAST(regexp_extract(ticker, '(\\d+)', 1) AS INTEGER) % 7 = 0 UNION SELECT ticker, 'CONSENSUS_CONSTANTS' FROM quarters WHERE CAST(regexp_extract(ticker, '(\\d+)', 1) AS INTEGER) % 4 = 0
UNION SELECT ticker, 'SOURCE_KIND_NOT_ALLOWED' FROM quarters WHERE CAST(regexp_extract(ticker, '(\\d+)', 1) AS INTEGER) % 6 = 0""")
def input_faults(spark, sf):
    base = sg.cells(spark, sf)
    b = sg.brand_number("id")
    quarters = sg.quarters(spark, sf, base).withColumnRenamed("ticker", "id").withColumn("pos", F.col("q"))
    gapped = quarters.where(~((b % 5 == 0) & (F.col("q") == 7990))).withColumn("tax_rate", F.when(b % 7 == 0, 0.7).otherwise(F.col("tax_rate")))
    segs = sg.segments(base).withColumnRenamed("ticker", "id")
    ids = quarters.select("id").distinct()
    consensus = ids.withColumns({k: F.lit(v) for k, v in ca.CONSTANTS.items()}).withColumn("basis", F.when(b % 4 == 0, "basic").otherwise(F.lit(ca.CONSTANTS["basis"])))
    sources = ids.withColumns({"kind": F.when(b % 6 == 0, "model_knowledge").otherwise("filing"), "url": F.lit("https://x.example.com"), "manual_reference": F.lit(None).cast("string")})
    return ca.input_faults(segs, gapped, consensus, sources)


@query("company_profile", ctes(vl.SQL_VAL) + """SELECT e.ds_id, count(DISTINCT e.product_id) AS products, count(DISTINCT e.market_id) AS markets, max(l.latest_q) AS latest_observation, CAST(50000 + 1000 * e.ds_id AS DOUBLE) AS price FROM ent e JOIN lat l ON l.ds_id = e.ds_id AND l.market_id = e.market_id GROUP BY 1""")
def company_profile(spark, sf):
    t = vl.tables(spark, sf)
    latest = va.latest_observation(t)
    return (t.product.join(latest, ["ds_id", "market_id"]).groupBy("ds_id").agg(F.countDistinct("product_id").alias("products"), F.countDistinct("market_id").alias("markets"),
                                                                              F.max("latest_q").alias("latest_observation"))
            .join(t.quote.select("ds_id", "price"), "ds_id"))


@query("half_year_filings", f"""WITH d AS (SELECT o_custkey AS company, CAST(last_day(make_date(CAST(year(o_orderdate) AS INTEGER), CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END, 1)) AS DATE) AS period_end, CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END AS months,
  o_orderstatus = 'F' AS consolidated, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 END AS pr, o_orderkey AS k, round(o_totalprice * 100) AS cents FROM orders)
SELECT company, period_end, months, consolidated, pr AS priority, min(k % 100) AS days FROM (SELECT *, rank() OVER (PARTITION BY company, period_end, months ORDER BY CASE WHEN consolidated THEN 0 ELSE 1 END, pr, -(k % 100)) AS r FROM d WHERE pr IS NOT NULL AND k % 100 <= 90) WHERE r = 1 GROUP BY 1, 2, 3, 4, 5""")
def half_year_filings(spark, sf):
    first = F.month("o_orderdate") <= 6
    end = F.last_day(F.make_date(F.year("o_orderdate"), F.when(first, 6).otherwise(12), F.lit(1)))
    docs = table(spark, sf, "orders").select(F.col("o_custkey").alias("company"), end.alias("period_end"), F.when(first, 6).otherwise(12).alias("months"), (F.col("o_orderstatus") == "F").alias("consolidated"),
                                             F.col("o_orderpriority").alias("element"), F.date_add(end, (F.col("o_orderkey") % 100).cast("int")).alias("filed_date"))
    out = fl.half_year_filings(docs, {"1-URGENT": 0, "2-HIGH": 1}, 90, F.to_date(F.lit("2100-01-01")))
    return out.select("company", "period_end", "months", "consolidated", F.when(F.col("element") == "1-URGENT", 0).otherwise(1).alias("priority"), F.datediff("filed_date", "period_end").cast("long").alias("days"))
