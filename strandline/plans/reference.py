"""Filing, statement, facts, universe, record and quality queries over orders, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import quarter_end, quarter_index, quarter_start
from strandline.operators import filings as fl
from strandline.operators import quality as qu
from strandline.operators import quality_rules as qr
from strandline.operators import records as rc
from strandline.operators import valuation as va
from strandline.plans import market as mk
from strandline.plans import strategy as sg
from strandline.plans import valuing as vl
from strandline.plans.registry import ctes, query, rounded, sql_rnd, stable, staged, table

AS_OF = "2000-06-30"


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))


# ---- filing versions: each order is a filing of its customer for the quarter ended at least 45 days before -----------


def filing_rows(spark, sf) -> DataFrame:
    end_q = quarter_index(F.date_sub("d", 45)) - 1
    end = quarter_end(end_q)
    kind = F.when(F.month(end) == 12, "사업").when(F.month(end) == 6, "반기").otherwise("분기")
    name = F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "[기재정정]").otherwise(""),
                    F.when(F.col("o_orderkey") % 50 == 0, "[첨부추가]").otherwise(""), kind, F.lit("보고서 ("), F.date_format(end, "yyyy.MM"), F.lit(")"))
    return orders(spark, sf).select(
        F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("receipt"), F.col("d").alias("received_date"), name.alias("report_name"),
        F.when(F.col("o_custkey") % 5 == 0, 3).otherwise(12).alias("fye_month"), "o_orderstatus")


SQL_FILINGS = f"""
ends AS (SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(last_day(make_date(CAST((y * 4 + qq - 2) // 4 AS INTEGER), CAST((y * 4 + qq - 2) % 4 * 3 + 3 AS INTEGER), 1)) AS DATE) AS e FROM (SELECT *, year(CAST(o_orderdate AS DATE) - 45) AS y, quarter(CAST(o_orderdate AS DATE) - 45) AS qq FROM orders)),
kinds AS (SELECT o_custkey AS company, o_orderkey AS receipt, d AS received_date, o_orderstatus, CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE 12 END AS fye, e AS period_end, o_orderpriority = '1-URGENT' AS is_correction, (month(e) - CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE 12 END + 12) % 12 AS k FROM ends WHERE o_orderkey % 50 <> 0),
typed AS (SELECT *, CASE WHEN month(period_end) = 12 THEN CASE WHEN k = 0 THEN 'FY' END WHEN month(period_end) = 6 THEN CASE WHEN k = 6 THEN 'H1' END WHEN k = 3 THEN 'Q1' WHEN k = 9 THEN 'Q3' END AS period_type,
  year(period_end) AS y FROM kinds),
filed AS (SELECT *, CASE WHEN period_type = 'FY' OR fye = 12 THEN y ELSE y + CASE WHEN month(period_end) > fye THEN 1 ELSE 0 END END AS fiscal_year FROM typed WHERE period_type IS NOT NULL),
known AS (SELECT * FROM filed WHERE received_date <= DATE '{AS_OF}' AND period_end <= DATE '{AS_OF}')
"""


@query("classify_reports", ctes(SQL_FILINGS) + "SELECT company, receipt, period_type, period_end, fiscal_year, is_correction FROM filed")
def classify_reports(spark, sf):
    out = fl.classify_reports(filing_rows(spark, sf))
    return out.select("company", "receipt", "period_type", "period_end", F.col("fiscal_year").cast("long").alias("fiscal_year"), "is_correction")


def _latest_sql(where: str) -> str:
    return f"""SELECT company, period_type, period_end, receipt, received_date, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY period_end DESC, period_type) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY company, period_type, period_end ORDER BY received_date DESC, receipt DESC) AS v FROM known {where}) WHERE v = 1)"""


@query("latest_versions", ctes(SQL_FILINGS) + _latest_sql(""))
def latest_versions(spark, sf):
    known = fl.filings_as_of(fl.classify_reports(filing_rows(spark, sf)), F.to_date(F.lit(AS_OF)))
    return fl.latest_versions(known).select("company", "period_type", "period_end", "receipt", "received_date", "rank")


@query("versions_with_documents", ctes(SQL_FILINGS) + _latest_sql("WHERE o_orderstatus = 'F'"))
def versions_with_documents(spark, sf):
    known = fl.filings_as_of(fl.classify_reports(filing_rows(spark, sf)), F.to_date(F.lit(AS_OF)))
    documents = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("receipt"))
    return fl.with_documents(known, documents).select("company", "period_type", "period_end", "receipt", "received_date", "rank")


# ---- statements: a customer's orders by quarter, priority as account, order status as basis --------------------------


def statement_rows(spark, sf) -> DataFrame:
    """Quarter amounts, running year-to-date amounts, annual rows; basis from status, accounts from priority."""
    base = orders(spark, sf).select(F.col("o_custkey").alias("company"), F.year("d").alias("fiscal_year"), F.quarter("d").alias("qn"), "o_orderpriority",
                                    F.when(F.col("o_orderstatus") == "F", "CFS").otherwise("OFS").alias("basis"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderkey")
    account = F.when(F.col("o_orderpriority") == "1-URGENT", "ifrs-full_Revenue").otherwise("acc")
    name = F.when(F.col("o_orderpriority") == "2-HIGH", "매출액").when(F.col("o_orderpriority") == "5-LOW", "주당순이익").otherwise(F.col("o_orderpriority"))
    rows = base.select("company", "fiscal_year", "qn", "basis", account.alias("account_id"), name.alias("account_name"), "cents")
    keys = ["company", "fiscal_year", "basis", "account_id", "account_name"]
    by_q = rows.groupBy(*keys, "qn").agg(F.sum("cents").cast("double").alias("this_term"))
    cum = F.sum("this_term").over(Window.partitionBy(*keys).orderBy("qn"))
    interim = by_q.withColumn("this_term_cum", cum).where(F.col("qn") < 4).withColumn("period", F.element_at(F.array(F.lit("Q1"), F.lit("H1"), F.lit("Q3")), F.col("qn")))
    annual = rows.groupBy(*keys).agg(F.sum("cents").cast("double").alias("this_term")).withColumns({"this_term_cum": F.lit(None).cast("double"), "period": F.lit("FY"), "qn": F.lit(4)})
    both = interim.unionByName(annual)
    end = quarter_end(F.col("fiscal_year") * 4 + F.col("qn") - 1)
    return both.select(*keys, "period", "this_term", "this_term_cum", F.lit("IS").alias("statement"), F.lit("KRW").alias("currency"), end.alias("period_end"),
                       F.date_add(end, F.when((F.col("company") % 9 == 0) & (F.col("period") == "Q3"), 300).otherwise(45)).alias("filed_date"),
                       F.concat_ws("-", "company", "fiscal_year", "period", F.when((F.col("company") % 7 == 0) & (F.col("account_id") == "acc"), "x").otherwise("a")).alias("receipt"),
                       (F.col("company") % 11 == 0).alias("is_correction"), F.when(F.col("account_id") == "acc", 1).otherwise(2).alias("pos"))


_NAME = "CASE WHEN o_orderpriority = '2-HIGH' THEN '매출액' WHEN o_orderpriority = '5-LOW' THEN '주당순이익' ELSE o_orderpriority END"
SQL_STATEMENTS = f"""
lines AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(quarter(o_orderdate) AS INTEGER) AS qn, CASE WHEN o_orderstatus = 'F' THEN 'CFS' ELSE 'OFS' END AS basis,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'ifrs-full_Revenue' ELSE 'acc' END AS account_id, {_NAME} AS account_name, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
byq AS (SELECT company, fiscal_year, basis, account_id, account_name, qn, CAST(sum(cents) AS DOUBLE) AS this_term FROM lines GROUP BY ALL),
stm AS (SELECT *, 'Q' AS dummy FROM (SELECT company, fiscal_year, basis, account_id, account_name, qn, this_term, sum(this_term) OVER (PARTITION BY company, fiscal_year, basis, account_id, account_name ORDER BY qn) AS cum FROM byq) WHERE qn < 4
  UNION ALL SELECT company, fiscal_year, basis, account_id, account_name, 4, CAST(sum(cents) AS DOUBLE), NULL, 'Q' FROM lines GROUP BY 1, 2, 3, 4, 5),
rows0 AS (SELECT *, ['Q1', 'H1', 'Q3', 'FY'][qn] AS period, CAST(last_day(make_date(fiscal_year, qn * 3, 1)) AS DATE) AS period_end FROM stm),
srows AS (SELECT *, period_end + CASE WHEN company % 9 = 0 AND period = 'Q3' THEN 300 ELSE 45 END AS filed_date, CASE WHEN company % 7 = 0 AND account_id = 'acc' THEN 'x' ELSE 'a' END AS tag FROM rows0),
sound AS (SELECT company, fiscal_year, period, basis FROM srows GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT tag) = 1 AND max(filed_date) <= DATE '{AS_OF}'),
good AS (SELECT s.* FROM srows s JOIN sound g USING (company, fiscal_year, period, basis)),
pref AS (SELECT * FROM (SELECT *, min(CASE WHEN basis = 'CFS' THEN 0 ELSE 1 END) OVER (PARTITION BY company, fiscal_year, period) AS p FROM good) WHERE CASE WHEN basis = 'CFS' THEN 0 ELSE 1 END = p),
q4 AS (SELECT a.company, a.fiscal_year, a.basis, a.account_id, a.account_name, a.period_end, a.this_term - n.cum AS amount, n.filed_date > a.filed_date OR a.company % 11 = 0 AS withheld
  FROM srows a JOIN srows n ON n.company = a.company AND n.fiscal_year = a.fiscal_year AND n.basis = a.basis AND n.account_id = a.account_id AND n.account_name = a.account_name AND n.period = 'Q3' AND a.period = 'FY' WHERE a.account_name <> '주당순이익')
"""


@query("sound_statements", ctes(SQL_STATEMENTS) + f"SELECT company, fiscal_year, period, basis, account_name, {sql_rnd('this_term', 0)} AS this_term FROM pref")
def sound_statements(spark, sf):
    out = fl.preferred_basis(fl.sound_statements(statement_rows(spark, sf), F.to_date(F.lit(AS_OF))))
    return rounded(out, ["company", "fiscal_year", "period", "basis", "account_name"], ["this_term"], 0)


@query("derived_q4", ctes(SQL_STATEMENTS) + f"SELECT company, fiscal_year, basis, account_name, withheld, {sql_rnd('amount', 0)} AS amount FROM q4")
def derived_q4(spark, sf):
    return rounded(fl.derived_q4(statement_rows(spark, sf)), ["company", "fiscal_year", "basis", "account_name", "withheld"], ["amount"], 0)


@query("statement_revenue", ctes(SQL_STATEMENTS) + f""", rr AS (SELECT company, fiscal_year, basis, period, period_end, this_term, row_number() OVER (PARTITION BY company, fiscal_year, period, basis ORDER BY CASE WHEN account_id = 'ifrs-full_Revenue' THEN 0 ELSE 1 END) AS rn FROM srows WHERE account_id = 'ifrs-full_Revenue' OR account_name = '매출액'),
rq AS (SELECT company, fiscal_year, basis, period_end, amount, row_number() OVER (PARTITION BY company, fiscal_year, basis ORDER BY CASE WHEN account_id = 'ifrs-full_Revenue' THEN 0 ELSE 1 END) AS rn FROM q4 WHERE account_id = 'ifrs-full_Revenue' OR account_name = '매출액')
SELECT company, fiscal_year, CASE WHEN period = 'FY' THEN 12 ELSE 3 END AS months, period_end, 'reported' AS kind, {sql_rnd('this_term', 0)} AS revenue FROM rr WHERE rn = 1
UNION ALL SELECT company, fiscal_year, 3, period_end, 'derived', {sql_rnd('amount', 0)} FROM rq WHERE rn = 1""")
def statement_revenue(spark, sf):
    return rounded(fl.statement_revenue(statement_rows(spark, sf)), ["company", "fiscal_year", "months", "period_end", "kind"], ["revenue"], 0)


@query("share_counts", """WITH r AS (SELECT o_custkey AS company, o_orderstatus AS s, CASE o_orderpriority WHEN '1-URGENT' THEN 'common' WHEN '2-HIGH' THEN 'preferred' ELSE 'other' END AS share_class, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL),
g AS (SELECT company FROM r GROUP BY 1 HAVING count(DISTINCT s) = 1 AND bool_or(share_class = 'common')) SELECT company, share_class, CAST(sum(n) AS BIGINT) AS issued FROM r SEMI JOIN g USING (company) GROUP BY 1, 2""")
def share_counts(spark, sf):
    rows = orders(spark, sf).groupBy(F.col("o_custkey").alias("company"), F.col("o_orderstatus").alias("receipt"),
                                     F.when(F.col("o_orderpriority") == "1-URGENT", "보통주").when(F.col("o_orderpriority") == "2-HIGH", "우선주").otherwise("합계").alias("class_name")).agg(F.count("*").alias("issued"))
    return fl.share_counts(rows)


# ---- company facts: quarterly and annual sales per supplier nation, each filed twice ----------------------------------


def facts(spark, sf) -> DataFrame:
    sold = staged(spark, sf, "sales", lambda: vl.sales(spark, sf)).groupBy("nation", "p_type", "q").agg(F.sum("cents").alias("cents"))
    concept = F.element_at(F.array(*[F.lit(c) for c in fl.REVENUE_CONCEPTS]), (F.length("p_type") % 5 + 1).cast("int"))
    base = sold.select(F.col("nation").alias("company"), concept.alias("concept"), "q", "cents").groupBy("company", "concept", "q").agg(F.sum("cents").alias("val"))
    quarters = base.where((F.col("q") % 4 != 3) | (F.col("company") % 3 == 0)).select("company", "concept", quarter_start("q").alias("start"), quarter_end("q").alias("end"), "val", F.lit("10-Q").alias("form"))
    years = base.groupBy("company", "concept", F.floor(F.col("q") / 4).cast("int").alias("y")).agg(F.sum("val").alias("val"), F.count("*").alias("n")).where("n = 4").select(
        "company", "concept", F.make_date("y", F.lit(1), F.lit(1)).alias("start"), F.make_date("y", F.lit(12), F.lit(31)).alias("end"), "val", F.lit("10-K").alias("form"))
    first = quarters.unionByName(years).withColumn("filed", F.date_add("end", 40)).withColumn("accession", F.lit("a"))
    again = first.withColumns({"filed": F.date_add("end", 400), "val": F.col("val") * 2, "accession": F.lit("b")})
    return first.unionByName(again)


SQL_FACTS = f"""
fs AS (SELECT s_nationkey AS company, CASE length(p_type) % 5 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(fl.REVENUE_CONCEPTS))} END AS concept, length(p_type) % 5 AS pref, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS val
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4),
f0 AS (SELECT company, concept, pref, make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 1 AS INTEGER), 1) AS start, CAST(last_day(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 3 AS INTEGER), 1)) AS DATE) AS "end", val, '10-Q' AS form FROM fs WHERE q % 4 <> 3 OR company % 3 = 0
  UNION ALL SELECT company, concept, pref, make_date(CAST(q // 4 AS INTEGER), 1, 1), make_date(CAST(q // 4 AS INTEGER), 12, 31), sum(val), '10-K' FROM fs GROUP BY company, concept, pref, q // 4 HAVING count(*) = 4),
f1 AS (SELECT *, "end" + 40 AS filed FROM f0 UNION ALL SELECT company, concept, pref, start, "end", val * 2, form, "end" + 400 FROM f0),
fu AS (SELECT * FROM f1 WHERE CAST(filed AS TIMESTAMP) + INTERVAL 27 HOURS <= TIMESTAMP '{AS_OF} 15:00:00'),
fc AS (SELECT company, arg_max(concept, e * 10 - pref) AS concept FROM (SELECT company, concept, pref, max(datediff('day', DATE '1970-01-01', "end")) AS e FROM fu GROUP BY 1, 2, 3) GROUP BY 1),
fe AS (SELECT * FROM (SELECT fu.*, row_number() OVER (PARTITION BY fu.company, start, "end" ORDER BY filed) AS rn FROM fu JOIN fc ON fu.company = fc.company AND fu.concept = fc.concept) WHERE rn = 1),
fq AS (SELECT * FROM fe WHERE "end" - start BETWEEN 80 AND 100), fy AS (SELECT * FROM fe WHERE "end" - start BETWEEN 350 AND 380 AND form LIKE '10-K%'),
fd AS (SELECT y.company, max(q."end") + 1 AS start, y."end", y.val - sum(q.val) AS val FROM fy y JOIN fq q ON q.company = y.company AND q.start >= y.start AND q."end" <= y."end" GROUP BY y.company, y.start, y."end", y.val HAVING count(*) = 3),
fr AS (SELECT company, 3 AS months, start, "end", val, 'reported' AS kind FROM fq UNION ALL SELECT company, 12, start, "end", val, 'reported' FROM fy UNION ALL SELECT company, 3, start, "end", val, 'derived' FROM fd d WHERE NOT EXISTS (SELECT 1 FROM fq q WHERE q.company = d.company AND q."end" = d."end"))
"""


@query("facts_revenue", ctes(SQL_FACTS) + f"""SELECT company, months, start, "end", kind, {sql_rnd('val', 0)} AS revenue, CAST(row_number() OVER (PARTITION BY company, months ORDER BY "end" DESC, start) AS INTEGER) AS rank FROM fr""")
def facts_revenue(spark, sf):
    cutoff = F.lit(f"{AS_OF} 15:00:00").cast("timestamp")
    known = staged(spark, sf, "facts", lambda: fl.earliest_values(fl.chosen_concept(fl.usable_facts(facts(spark, sf), cutoff))))
    out = fl.facts_revenue(known)
    return rounded(out, ["company", "months", "start", "end", "kind", "rank"], ["revenue"], 0)


@query("second_half", ctes(mk.SQL_RAW) + f""", h AS (SELECT ticker, year(date) AS y, sum(cents) AS yr, sum(CASE WHEN month(date) <= 6 THEN cents END) AS h1 FROM daily GROUP BY 1, 2) SELECT ticker AS company, true AS consolidated, make_date(CAST(y AS INTEGER), 12, 31) AS period_end, {sql_rnd('CAST(yr - h1 AS DOUBLE)', 0)} AS revenue FROM h WHERE h1 IS NOT NULL""")
def second_half(spark, sf):
    daily = mk.listed(spark, sf).groupBy(F.col("ticker").alias("company"), F.year("date").alias("y"), F.when(F.month("date") <= 6, 1).otherwise(2).alias("h")).agg(F.sum("cents").alias("c"))
    year = daily.groupBy("company", "y").agg(F.sum("c").alias("revenue")).select("company", F.lit(12).alias("months"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"), F.col("revenue").cast("double").alias("revenue"))
    half = daily.where("h = 1").select("company", F.lit(6).alias("months"), F.make_date("y", F.lit(6), F.lit(30)).alias("period_end"), F.col("c").cast("double").alias("revenue"))
    return rounded(fl.second_half(year.unionByName(half).withColumn("consolidated", F.lit(True))), ["company", "consolidated", "period_end"], ["revenue"], 0)


@query("wide_finance", f"""WITH w AS (SELECT o_custkey AS company, year(o_orderdate) AS y, o_orderpriority AS title, count(*) AS n, max(o_totalprice) AS v, bool_or(o_orderstatus = 'O') AS e FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3)
SELECT company, CAST(y AS VARCHAR) AS "column", bool_or(e) AS is_estimate, {sql_rnd("max(CASE WHEN title = '1-URGENT' THEN v * 1e8 END) / 1e8", 3)} AS revenue, {sql_rnd("max(CASE WHEN title = '2-HIGH' THEN v * 1e8 END) / 1e8", 3)} AS profit FROM w WHERE n = 1 GROUP BY 1, 2""")
def wide_finance(spark, sf):
    rows = orders(spark, sf).select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("title"), F.year("d").cast("string").alias("column"),
                                    (F.col("o_orderstatus") == "O").alias("is_estimate"), F.format_number("o_totalprice", 2).alias("value"))
    out = fl.wide_finance(rows, {"revenue": "1-URGENT", "profit": "2-HIGH"})
    return out.select("company", "column", "is_estimate", stable(F.col("revenue") / 1e8, 3).alias("revenue"), stable(F.col("profit") / 1e8, 3).alias("profit"))


@query("yearly_growth", f"""WITH y AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)
SELECT company, year, {sql_rnd("CASE WHEN lag(year) OVER w = year - 1 AND lag(v) OVER w > 0 THEN (v / lag(v) OVER w - 1) * 100 END", 5)} AS growth_pct FROM y WINDOW w AS (PARTITION BY company ORDER BY year)""")
def yearly_growth(spark, sf):
    rows = orders(spark, sf).groupBy(F.col("o_custkey").alias("company"), F.year("d").alias("year")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("v"))
    return rounded(fl.yearly_growth(rows, "v"), ["company", "year"], ["growth_pct"], 5)


@query("per_reference", ctes(sg.SQL_STRAT.strip() + "," + mk.SQL_BARS.strip()) + f""", l4 AS (SELECT ticker, sum(eps) AS ttm, max(q) - min(q) AS span, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY q DESC) AS r FROM bridge) WHERE r <= 4 GROUP BY 1 HAVING n = 4 AND span = 3 AND ttm > 0),
c AS (SELECT b.ticker, b.date, b.close / (ttm / 100) AS per FROM bars b JOIN l4 USING (ticker) WHERE b.date <= DATE '2001-06-30')
SELECT ticker, count(*) AS sessions, floor(max_by(per, date) * 100 + 0.5) / 100 AS current, floor(min(per) * 100 + 0.5) / 100 AS min_per, floor(max(per) * 100 + 0.5) / 100 AS max_per, floor(quantile_cont(per, 0.5) * 100 + 0.5) / 100 AS median_per FROM c GROUP BY 1""")
def per_reference(spark, sf):
    eps = sg.base_bridge(spark, sf).select("ticker", "q", (F.col("eps") / 100).alias("eps"))
    closes = fl.recent_closes(mk.bars(spark, sf).select("ticker", "date", "close"), F.to_date(F.lit("2001-06-30")))
    return fl.per_reference(closes, eps).select("ticker", "sessions", "current", "min_per", "max_per", "median_per")


@query("cross_rates", """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS currency, avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS rate FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1999-12-30' GROUP BY 1, 2), l AS (SELECT max(date) AS d FROM r)
SELECT currency, date, floor((SELECT rate FROM r, l WHERE date = d AND currency = '1-URGENT') / rate * 10000.0 + 0.5) / 10000.0 AS per_unit FROM r, l WHERE date = d AND currency <> '1-URGENT' AND (SELECT count(*) FROM r, l WHERE date = d AND currency = '1-URGENT') > 0""")
def cross_rates(spark, sf):
    rates = orders(spark, sf).groupBy(F.col("d").alias("date"), F.col("o_orderpriority").alias("currency")).agg(F.avg(F.round(F.col("o_totalprice") * 100).cast("long")).alias("rate"))
    return fl.cross_rates(rates, F.to_date(F.lit("1999-12-31")), base="1-URGENT")


@query("disclosures", """WITH d AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS received_date, o_orderkey AS receipt, CASE o_orderpriority WHEN '1-URGENT' THEN 'earnings_schedule' WHEN '2-HIGH' THEN 'earnings_guidance' WHEN '3-MEDIUM' THEN 'preliminary_earnings' END AS kind FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY company, kind ORDER BY received_date DESC, receipt DESC) AS n FROM d WHERE kind IS NOT NULL)
SELECT company, receipt, kind, CAST(n AS INTEGER) AS kind_rank, CAST(row_number() OVER (PARTITION BY company ORDER BY received_date DESC, receipt DESC) AS INTEGER) AS rank FROM k""")
def disclosures(spark, sf):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "기업설명회 (IR) 개최").when(F.col("o_orderpriority") == "2-HIGH", "영업실적 전망").when(F.col("o_orderpriority") == "3-MEDIUM", "영업(잠정)실적").otherwise("기타")
    rows = orders(spark, sf).select(F.col("o_custkey").alias("company"), F.col("d").alias("received_date"), F.col("o_orderkey").alias("receipt"), name.alias("report_name"))
    return fl.disclosures(rows).select("company", "receipt", "kind", "kind_rank", "rank")


# ---- universe ----------------------------------------------------------------------------------------------------


def listing(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 17 == 0, F.concat("c_name", F.lit(" 리츠"))).when(k % 19 == 0, F.concat("c_name", F.lit(" 스팩"))).when(k % 23 == 0, F.concat("c_name", F.lit(" 우선주"))).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select(F.lpad(k.cast("string"), 6, "0").alias("ticker"), name.alias("name"), F.when(k % 13 == 0, "etf").otherwise("stock").alias("instrument"),
                                               F.when(k % 29 == 0, "64201").alias("industry"), F.when(F.col("c_nationkey") % 2 == 0, "KOSPI").otherwise("KOSDAQ").alias("exchange"), F.col("c_acctbal").alias("market_cap"))


SQL_LISTING = """
ls AS (SELECT *, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS ticker, CASE WHEN c_nationkey % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS exchange, c_custkey AS k FROM customer),
cl AS (SELECT *, list_filter([CASE WHEN k % 13 = 0 THEN 'ETF_ETN' END, CASE WHEN (length(ticker) = 6 AND k % 10 <> 0) OR (k % 23 = 0 AND k % 17 <> 0 AND k % 19 <> 0) THEN 'PREFERRED_STOCK' END, CASE WHEN k % 17 = 0 THEN 'REIT' END,
  CASE WHEN k % 29 = 0 THEN 'INFRA_FUND' END, CASE WHEN k % 19 = 0 AND k % 17 <> 0 THEN 'SPAC' END], lambda x: x IS NOT NULL) AS rejections FROM ls)
"""


@query("classify_securities", ctes(SQL_LISTING) + "SELECT ticker, array_to_string(rejections, ',') AS rejections FROM cl")
def classify_securities(spark, sf):
    return fl.classify_securities(listing(spark, sf)).select("ticker", F.array_join("rejections", ",").alias("rejections"))


@query("screen_names", """SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'ETF_ETN:' ELSE 'NON_STOCK:' END WHEN p_partkey % 11 = 0 THEN 'ETF_ETN:KODEX ' || p_name END,
  CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 3 <> 0 THEN 'PREFERRED_STOCK:' END, CASE WHEN p_partkey % 13 = 0 THEN 'REIT:' || p_brand || ' 리츠' END,
  CASE WHEN p_partkey % 17 = 0 THEN 'INFRA_FUND:' END, CASE WHEN p_partkey % 19 = 0 THEN 'SPAC:' || p_brand || ' 스팩' END], lambda x: x IS NOT NULL), ',') AS rejections FROM part""")
def screen_names(spark, sf):
    """Parts as listings of up to five names, the deciding one never first."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    rows = table(spark, sf, "part").select(
        k.alias("id"), F.lpad((k % 1000000).cast("string"), 6, "0").alias("ticker"), F.when(k % 7 == 0, F.when(k % 2 == 0, "ETF").otherwise("warrant")).when(k % 5 == 0, "Stock").alias("instrument"),
        F.array(F.lit(" "), brand, F.when(k % 11 == 0, F.concat(F.lit(" KODEX "), "p_name")), F.when(k % 13 == 0, F.concat(brand, F.lit(" 리츠"))), F.when(k % 19 == 0, F.concat(brand, F.lit(" 스팩")))).alias("names"),
        F.when(k % 17 == 0, "64201").otherwise("26110").alias("industry"), F.when(k % 3 == 0, False).alias("check_suffix"))
    return fl.screen_names(rows).select("id", F.array_join(F.transform("rejections", lambda r: F.concat(r["code"], F.lit(":"), F.coalesce(r["matched"], F.lit("")))), ",").alias("rejections"))


@query("universe", ctes(SQL_LISTING) + "SELECT ticker, exchange, c_acctbal AS market_cap FROM cl WHERE len(rejections) = 0 ORDER BY exchange, market_cap DESC, ticker")
def universe(spark, sf):
    return fl.universe(listing(spark, sf)).select("ticker", "exchange", "market_cap")


@query("search_universe", ctes(SQL_LISTING) + ", h AS (SELECT * FROM cl WHERE ticker LIKE '12%' OR lower(c_name) LIKE '%12%') SELECT ticker, (SELECT count(*) FROM h) AS total FROM h ORDER BY c_acctbal DESC, ticker LIMIT 20")
def search_universe(spark, sf):
    return fl.search_universe(listing(spark, sf), "12", 20).select("ticker", "total")


@query("industry_peers", """WITH p AS (SELECT o_custkey AS company, l_suppkey AS peer, min(l_orderkey) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 3 <> 0 AND l_suppkey <> o_custkey GROUP BY 1, 2)
SELECT company, peer, CASE WHEN r <= 6 THEN r END AS peer_rank, r <= 6 AS is_competitor FROM (SELECT *, CAST(row_number() OVER (PARTITION BY company ORDER BY pos, peer) AS INTEGER) AS r FROM p)""")
def industry_peers(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    rows = (lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")))
    ex = F.element_at(F.array(F.lit("NYSE"), F.lit("KOSPI"), F.lit("KOSDAQ")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    out = fl.industry_peers(rows.select(F.col("o_custkey").alias("company"), F.col("l_suppkey").alias("peer"), F.col("l_orderkey").alias("pos"), ex.alias("exchange")))
    return out.select("company", "peer", "peer_rank", "is_competitor")


@query("agreed_exchange", """WITH a AS (SELECT c_custkey AS ticker, CASE WHEN c_nationkey % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS x FROM customer WHERE c_custkey % 4 <> 0), b AS (SELECT c_custkey AS ticker, CASE WHEN c_nationkey % 3 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS y FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN a.x IS NOT NULL AND b.y IS NOT NULL AND x <> y THEN NULL ELSE coalesce(x, y) END AS exchange, coalesce(x <> y, false) AS conflict FROM a FULL JOIN b ON a.ticker = b.ticker""")
def agreed_exchange(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), "c_nationkey")
    pick = lambda m: F.when(F.col("c_nationkey") % m == 0, "KOSPI").otherwise("KOSDAQ").alias("exchange")
    return fl.agreed_exchange(c.where("ticker % 4 <> 0").select("ticker", pick(2)), c.where("ticker % 5 <> 0").select("ticker", pick(3)))


@query("valid_quotes", "SELECT event_id, user_id, date_trunc('day', ts + INTERVAL 9 HOURS) = TIMESTAMP '2024-01-15' AS same_day FROM events WHERE value > 0 AND ts <= TIMESTAMP '2024-01-15 06:00:00'")
def valid_quotes(spark, sf):
    quotes = table(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("close"), F.col("ts").cast("timestamp").alias("traded_at"))
    return fl.valid_quotes(quotes, F.lit("2024-01-15 06:00:00").cast("timestamp")).select("event_id", "user_id", "same_day")


@query("required_inputs", """WITH k AS (SELECT user_id AS company, event_type AS input, count(*) AS items FROM events GROUP BY 1, 2), ks AS (SELECT unnest(['click', 'error', 'missing']) AS input)
SELECT u.company, ks.input, coalesce(k.items, 0) AS items, coalesce(k.items, 0) > 0 AS present FROM (SELECT DISTINCT user_id AS company FROM events) u, ks LEFT JOIN k ON k.company = u.company AND k.input = ks.input""")
def required_inputs(spark, sf):
    return fl.required_inputs(table(spark, sf, "events").select(F.col("user_id").alias("company"), F.col("event_type").alias("kind")), ["click", "error", "missing"])


@query("provider_status", """WITH e AS (SELECT user_id AS company, event_type AS provider, CASE WHEN value > 40 THEN 'error' WHEN value > 30 THEN 'warning' ELSE 'info' END AS s, CAST(user_id % 3 AS BIGINT) AS items FROM events),
g AS (SELECT company, coalesce(provider, 'overall') AS provider, count(CASE WHEN s = 'error' THEN 1 END) AS errors, count(CASE WHEN s = 'warning' THEN 1 END) AS warnings, max(items) AS items FROM e GROUP BY GROUPING SETS ((company, provider), (company)))
SELECT *, CASE WHEN errors > 0 AND items = 0 THEN 'failed' WHEN errors + warnings > 0 THEN 'partial' ELSE 'complete' END AS status FROM g""")
def provider_status(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("company"), F.col("event_type").alias("provider"), (F.col("user_id") % 3).alias("items"),
                                          F.when(F.col("value") > 40, "error").when(F.col("value") > 30, "warning").otherwise("info").alias("severity"))
    return fl.provider_status(e)


# ---- records: events as journal records ------------------------------------------------------------------------------


def journal(spark, sf) -> DataFrame:
    k = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        k.cast("string").alias("id"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), "event_type", "value", ts.alias("recorded_at"),
        (ts + F.when(k % 9 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval -1 hour"))).alias("known_at"),
        F.when(k % 3 == 0, "historical_import_unverified").otherwise("forward").alias("mode"), F.when((k % 3 == 0) & (k % 2 == 0), "archive").alias("archive_source"),
        (k % 6 == 0).alias("synthetic"), F.when(k % 7 == 0, (k - F.when(k % 2 == 0, 1).otherwise(1000000)).cast("string")).alias("supersedes"))


SQL_JOURNAL = """
jr AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id AS k, 'T' || user_id AS ticker, ts AS recorded_at, event_id % 9 = 0 AS late, event_id % 3 = 0 AS hist, CASE WHEN event_id % 7 = 0 THEN CAST(event_id - CASE WHEN event_id % 2 = 0 THEN 1 ELSE 1000000 END AS VARCHAR) END AS supersedes FROM events)
"""
PAYLOAD = ["ticker", "event_type", "value"]


@query("record_append", "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 = 0 THEN 'RECORD_ID_CONFLICT' ELSE 'accepted' END AS outcome FROM events WHERE event_id % 4 = 0 OR event_id % 2 = 1 ORDER BY 1")
def record_append(spark, sf):
    """Multiples of four are stored already; they and the odd ids arrive."""
    rows = rc.with_hash(journal(spark, sf), PAYLOAD)
    k = F.col("id").cast("long")
    accepted, rejected = rc.append(rows.where(k % 4 == 0), rows.where((k % 4 == 0) | (k % 2 == 1)))
    return accepted.select("id", F.lit("accepted").alias("outcome")).unionByName(rejected.select("id", F.col("code").alias("outcome")))


@query("record_audit", ctes(SQL_JOURNAL) + """SELECT id, 'HASH_MISMATCH' AS code FROM jr WHERE k % 10 = 3 UNION ALL SELECT id, 'ARCHIVE_SOURCE_MISSING' FROM jr WHERE hist AND k % 2 <> 0""")
def record_audit(spark, sf):
    rows = rc.with_hash(journal(spark, sf), PAYLOAD)
    return rc.audit(rows.withColumn("value", F.when(F.col("id").cast("long") % 10 == 3, F.col("value") + 1).otherwise(F.col("value"))), PAYLOAD)


@query("record_guards", ctes(SQL_JOURNAL) + """SELECT id, 'RECORD_FROM_FUTURE' AS code FROM jr WHERE late AND NOT hist UNION ALL SELECT a.id, CASE WHEN b.id IS NULL THEN 'RECORD_NOT_FOUND' ELSE 'REVISION_TICKER_MISMATCH' END FROM jr a LEFT JOIN jr b ON a.supersedes = b.id WHERE a.supersedes IS NOT NULL AND (b.id IS NULL OR b.ticker <> a.ticker)""")
def record_guards(spark, sf):
    rows = journal(spark, sf)
    return rc.time_guard(rows, ["known_at"]).unionByName(rc.revision_problems(rows))


@query("record_resolution", ctes(SQL_JOURNAL) + """SELECT 'r' || k AS request_id, CASE WHEN NOT hist AND TIMESTAMP '2024-01-16 00:00:00' < recorded_at THEN 'FORWARD_RECORD_NOT_YET_AVAILABLE' END AS code, CASE WHEN k % 6 = 0 THEN 'synthetic' WHEN hist THEN 'historical_import_unverified' ELSE 'forward' END AS evidence_mode FROM jr
UNION ALL SELECT 'x' || k, 'RECORD_NOT_FOUND', NULL FROM jr WHERE k % 5 = 0""")
def record_resolution(spark, sf):
    rows = rc.with_hash(journal(spark, sf), PAYLOAD)
    at = F.lit("2024-01-16 00:00:00").cast("timestamp").alias("decision_at")
    asked = rows.select(F.concat(F.lit("r"), "id").alias("request_id"), "id", at).unionByName(
        rows.where(F.col("id").cast("long") % 5 == 0).select(F.concat(F.lit("x"), "id").alias("request_id"), F.concat(F.lit("no-"), "id").alias("id"), at))
    return rc.resolve(asked, rows).select("request_id", "code", "evidence_mode")


@query("evidence_mode", ctes(SQL_JOURNAL) + """SELECT ticker AS request_id, count(*) AS inputs, CASE WHEN bool_or(k % 6 = 0) THEN 'synthetic' WHEN bool_or(hist) THEN 'historical_import_unverified' ELSE 'forward' END AS evidence_mode FROM jr GROUP BY 1""")
def evidence_mode(spark, sf):
    rows = rc.with_hash(journal(spark, sf), PAYLOAD)
    asked = rows.select(F.col("ticker").alias("request_id"), "id", F.lit("2030-01-01 00:00:00").cast("timestamp").alias("decision_at"))
    return rc.evidence_mode(rc.resolve(asked, rows))


# ---- quality checks and prediction scoring ---------------------------------------------------------------------------


@query("valuation_grade", ctes(vl.SQL_BAD) + """, hs AS (SELECT ds_id, code, CASE WHEN code IN (""" + ", ".join(f"'{c}'" for c in qr.HARD_CODES) + """) OR (code = 'ANNUAL_QUARTERLY_CONFUSION' AND path LIKE '%.basis') OR (code = 'CURRENCY_MISMATCH' AND path NOT LIKE 'competitors%') THEN 1 ELSE 0 END AS h FROM found)
SELECT n.nation AS ds_id, CAST(coalesce(sum(h), 0) AS BIGINT) AS hard, CAST(coalesce(sum(1 - h), 0) AS BIGINT) AS soft, CASE WHEN coalesce(sum(h), 0) > 0 THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN coalesce(sum(h), 0) > 0 THEN NULL WHEN coalesce(sum(1 - h), 0) > 0 THEN 'provisional' ELSE 'verified' END AS grade
FROM nat n LEFT JOIN hs ON hs.ds_id = n.nation GROUP BY 1""")
def valuation_grade(spark, sf):
    t = vl.spoiled_lifted(spark, sf)
    found = qr.classify(qr.static_rules(t))
    none = found.where(F.lit(False))
    out = qu.valuation_grade(t.quote, found.where("severity = 'hard'"), found.where("severity = 'soft'"), none)
    return out.select("ds_id", "hard", "soft", "status", "grade")


def predictions(spark, sf):
    """Records of every cohort and brand: scenario EPS around the trailing quarter, an estimate, a consensus."""
    eps = sg.base_bridge(spark, sf).select("ticker", "q", "eps")
    prior = eps.select(F.concat(F.lit("j"), F.col("q").cast("string")).alias("job_id"), "ticker", (F.col("q") + 1).alias("target_q"), "eps", (F.col("eps") * 100).alias("price"))
    scen = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), (F.col("eps") * m).alias("quarter_eps"), F.lit(u).alias("upside_pct")) for s, m, u in (("bear", 0.9, -5.0), ("base", 1.0, 4.0), ("bull", 1.1, 12.0))])).alias("s")
    valuation = prior.select("job_id", "ticker", "target_q", "price", quarter_end(F.col("target_q") - 1).alias("as_of"), scen).select("job_id", "ticker", "target_q", "price", "as_of", "s.*")
    estimate = prior.where(F.col("target_q") % 2 == 0).select("job_id", "ticker", F.col("target_q").alias("q"), (F.col("eps") * 1.05).alias("eps"))
    consensus = eps.select("ticker", (F.col("q") + 1).cast("int").alias("q"), (F.col("eps") * 0.97).alias("eps"))
    closes = mk.bars(spark, sf).select("ticker", "date", "close")
    return qu.score_predictions(qu.prediction_records(valuation, estimate, consensus), eps, closes)


SQL_PRED = sg.SQL_STRAT.strip() + "," + mk.SQL_BARS.strip() + f""",
lastbar AS (SELECT ticker, max(date) AS d, max_by(close, date) AS c FROM bars GROUP BY 1),
pd AS (SELECT 'j' || b.q AS job_id, b.ticker, b.q + 1 AS q, b.eps AS e, a.eps AS actual, CASE WHEN l.d > CAST(last_day(make_date(CAST(b.q // 4 AS INTEGER), CAST(b.q % 4 * 3 + 3 AS INTEGER), 1)) AS DATE) THEN (l.c / (b.eps * 100) - 1) * 100 END AS change_pct
  FROM bridge b LEFT JOIN bridge a ON a.ticker = b.ticker AND a.q = b.q + 1 JOIN lastbar l ON l.ticker = b.ticker),
sp AS (SELECT *, CASE WHEN actual IS NULL THEN 'pending' ELSE 'scored' END AS status, (e - actual) / abs(actual) * 100 AS valuation_error_pct, actual BETWEEN least(e * 0.9, e * 1.1) AND greatest(e * 0.9, e * 1.1) AS within_range,
  CASE WHEN q % 2 = 0 THEN (e * 1.05 - actual) / abs(actual) * 100 END AS estimate_error_pct, CASE WHEN q % 2 = 0 THEN (e * 0.97 - actual) / abs(actual) * 100 END AS consensus_error_pct, sign(change_pct) = 1 AS direction_hit FROM pd)
"""


@query("prediction_scores", ctes(SQL_PRED) + f"SELECT job_id, ticker, q, status, within_range, direction_hit, abs(estimate_error_pct) < abs(consensus_error_pct) AS beat_consensus, {sql_rnd('valuation_error_pct', 5)} AS valuation_error_pct, {sql_rnd('estimate_error_pct', 5)} AS estimate_error_pct FROM sp")
def prediction_scores(spark, sf):
    return rounded(predictions(spark, sf), ["job_id", "ticker", "q", "status", "within_range", "direction_hit", "beat_consensus"], ["valuation_error_pct", "estimate_error_pct"], 5)


@query("prediction_summary", ctes(SQL_PRED) + f"""SELECT count(*) AS n_rows, count(CASE WHEN status = 'scored' THEN 1 END) AS scored, count(CASE WHEN status <> 'scored' THEN 1 END) AS pending, {sql_rnd("avg(abs(valuation_error_pct))", 5)} AS valuation_error_pct, {sql_rnd("avg(CASE WHEN within_range THEN 1.0 WHEN NOT within_range THEN 0.0 END)", 5)} AS within_range,
  {sql_rnd("avg(CASE WHEN abs(estimate_error_pct) < abs(consensus_error_pct) THEN 1.0 WHEN abs(estimate_error_pct) >= abs(consensus_error_pct) THEN 0.0 END)", 5)} AS beat_consensus, {sql_rnd("avg(CASE WHEN direction_hit THEN 1.0 WHEN NOT direction_hit THEN 0.0 END)", 5)} AS direction_hit FROM sp""")
def prediction_summary(spark, sf):
    return rounded(qu.prediction_summary(predictions(spark, sf)), ["n_rows", "scored", "pending"], ["valuation_error_pct", "within_range", "beat_consensus", "direction_hit"], 5)


@query("consensus_gap", ctes(sg.SQL_STRAT) + f""", p AS (SELECT ticker, q, revenue, operating_profit, lag(revenue) OVER w AS pr, lag(operating_profit) OVER w AS po FROM bridge WINDOW w AS (PARTITION BY ticker ORDER BY q)), g AS (SELECT ticker, q, CASE WHEN pr > 0 THEN (revenue - pr) / pr * 100 END AS rg, CASE WHEN po > 0 THEN (operating_profit - po) / po * 100 END AS og FROM p WHERE pr IS NOT NULL)
SELECT ticker, q, {sql_rnd('rg', 5)} AS revenue_gap_pct, {sql_rnd('og', 5)} AS op_gap_pct, 'CONSENSUS_GAP_LARGE' AS code FROM g WHERE coalesce(abs(rg) > 30, false) OR coalesce(abs(og) > 30, false)""")
def consensus_gap(spark, sf):
    values = sg.base_bridge(spark, sf).select("ticker", "q", "revenue", "operating_profit")
    order = Window.partitionBy("ticker").orderBy("q")
    consensus = values.select("ticker", F.lead("q").over(order).alias("q"), F.col("revenue").alias("consensus_revenue"), F.col("operating_profit").alias("consensus_op")).where(F.col("q").isNotNull())
    return rounded(qu.consensus_gap(values, consensus), ["ticker", "q", "code"], ["revenue_gap_pct", "op_gap_pct"], 5)


@query("pe_band", ctes(sg.SQL_STRAT.strip() + "," + mk.SQL_BARS.strip()) + """, l4 AS (SELECT ticker, sum(eps) AS ttm, max(q) - min(q) AS span, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY q DESC) AS r FROM bridge) WHERE r <= 4 GROUP BY 1 HAVING n = 4 AND span = 3 AND ttm > 0),
c AS (SELECT b.ticker, floor(min(b.close / (ttm / 100)) * 100 + 0.5) / 100 AS lo, floor(max(b.close / (ttm / 100)) * 100 + 0.5) / 100 AS hi FROM bars b JOIN l4 USING (ticker) GROUP BY 1), a AS (SELECT *, CAST(regexp_extract(ticker, '(\\d+)', 1) AS INTEGER) * 10.0 AS base FROM c)
SELECT ticker, 'PE_OUTSIDE_OBSERVED_RANGE' AS code FROM a WHERE base < lo OR base > hi OR base * 0.8 > hi OR base * 1.2 < lo""")
def pe_band(spark, sf):
    eps = sg.base_bridge(spark, sf).select("ticker", "q", (F.col("eps") / 100).alias("eps"))
    observed = fl.per_reference(mk.bars(spark, sf).select("ticker", "date", "close"), eps)
    base = sg.brand_number() * 10.0
    assumed = observed.select("ticker", base.alias("base"), (base * 0.8).alias("bear"), (base * 1.2).alias("bull"))
    return qu.pe_band(assumed, observed).select("ticker", "code")


@query("quality_tier", """WITH t AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'verified' ELSE 'provisional' END AS grade, c_custkey % 3 <> 0 AS x, CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'low' END AS g, c_custkey % 11 = 0 AS pe, c_custkey % 5 = 0 AS cg FROM customer),
r AS (SELECT *, list_filter([CASE WHEN grade <> 'verified' THEN 'provisional valuation' END, CASE WHEN NOT x THEN 'single model' END, CASE WHEN g <> 'high' THEN 'data grounding ' || g END, CASE WHEN pe THEN 'PE_OUTSIDE_OBSERVED_RANGE' END, CASE WHEN cg THEN 'CONSENSUS_GAP_LARGE' END], lambda v: v IS NOT NULL) AS rs FROM t)
SELECT k, CASE WHEN grade IS NULL THEN NULL WHEN len(rs) = 0 THEN 'high' WHEN g = 'low' OR (grade <> 'verified' AND g <> 'high') OR pe THEN 'low' ELSE 'medium' END AS tier, CASE WHEN grade IS NULL THEN 'no valuation' ELSE array_to_string(rs, '|') END AS reasons FROM r""")
def quality_tier(spark, sf):
    k = F.col("k")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).withColumns({
        "grade": F.when(k % 7 == 0, None).when(k % 2 == 0, "verified").otherwise("provisional"), "cross_checked": k % 3 != 0,
        "grounding": F.when(k % 4 == 1, "medium").when(k % 4 == 3, "low").otherwise("high"),
        "warnings": F.array_compact(F.array(F.when(k % 11 == 0, "PE_OUTSIDE_OBSERVED_RANGE"), F.when(k % 5 == 0, "CONSENSUS_GAP_LARGE")))})
    return qu.quality_tier(rows).select("k", "tier", F.array_join("reasons", "|").alias("reasons"))
