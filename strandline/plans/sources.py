"""Queries of the file sources and sinks, scalar rules and the funding plan: tables are rendered as the source's own files in the
shared folder, read back and compared with SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalar as sc
from strandline.operators import filings as fl
from strandline.operators import records as rc
from strandline.plans import reference as rf
from strandline.plans.registry import query, table
from strandline.session import spread, stage_dir
from strandline.sources import readers as rd


def _folder(spark) -> str:
    return f"{stage_dir(spark).rstrip('/')}/source-{uuid.uuid4().hex}"


@query("statement_files", "SELECT CAST(o_custkey AS VARCHAR) AS company, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(o_orderdate AS DATE) AS period_end, CAST(o_orderkey AS VARCHAR) AS receipt, o_totalprice AS this_term FROM orders")
def statement_files(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("company"), F.year("o_orderdate").alias("fiscal_year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period_end"),
        F.col("o_orderkey").cast("string").alias("receipt"), F.lit("CFS").alias("basis"), F.col("o_totalprice").alias("this_term"))
    path = _folder(spark)
    rows.write.json(path)
    return rd.read_statement_rows(spark, path).select("company", "fiscal_year", "period_end", "receipt", "this_term")


@query("finance_tables", "SELECT o_custkey AS company, o_orderpriority AS title, CAST(y AS VARCHAR) AS \"column\", y >= 2000 AS is_estimate, CAST(n AS VARCHAR) AS value FROM (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2, 3)")
def finance_tables(spark, sf):
    cells = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").cast("string").alias("y")).agg(F.count("*").cast("string").alias("n"))
    per_row = cells.groupBy("company", "title").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("values"))
    nested = (per_row.groupBy("company").agg(F.collect_list(F.struct("title", "values")).alias("rows"))
              .join(cells.groupBy("company").agg(F.transform(F.collect_set("y"), lambda y: F.struct(y.alias("key"), (y.cast("int") >= 2000).alias("is_estimate"))).alias("columns")), "company"))
    return rd.parse_finance_tables(nested).select("company", "title", "column", "is_estimate", "value")


@query("forecast_log_files", "SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS as_of_date, o_totalprice AS last_close FROM orders")
def forecast_log_files(spark, sf):
    """Two appends, with a torn line between them that the reader skips."""
    o, path = table(spark, sf, "orders"), _folder(spark)
    rows = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("ticker"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_of_date"), F.col("o_totalprice").alias("last_close"))
    for parity in (0, 1):
        rd.append_log(rows.where(F.col("o_orderkey") % 2 == parity).drop("o_orderkey"), path)
    rows.where(F.col("o_orderkey") % 100 == 1).select(F.concat(F.lit('{"ticker": "'), "ticker", F.lit('", "as_of')).alias("value")).write.mode("append").text(path)
    return rd.read_log(spark, path).select("ticker", "as_of_date", "last_close")


@query("daily_summary_files", """SELECT 'status' AS section, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def daily_summary_files(spark, sf):
    """Written twice: the second summary replaces the first."""
    o, path = table(spark, sf, "orders"), _folder(spark)
    count = lambda c: o.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n"))
    rd.write_summary({"status": count("o_orderpriority"), "old": count("o_orderstatus")}, path)
    rd.write_summary({"status": count("o_orderstatus"), "priority": count("o_orderpriority")}, path)
    got = spark.read.schema("row string, section string").json(path)
    return got.select("section", F.from_json("row", "name string, n long").alias("r")).select("section", "r.*")


@query("code_list_files", "SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code, c_name AS name FROM customer")
def code_list_files(spark, sf):
    """Quoted names; title and header lines are no codes."""
    c, path = table(spark, sf, "customer"), _folder(spark)
    rows = c.select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), F.col("c_name").alias("name"))
    heads = spark.createDataFrame([("Code list", None), ("code", "name")], "code string, name string")
    heads.coalesce(1).write.csv(path, quoteAll=True)
    rows.write.mode("append").csv(path, quoteAll=True)
    return rd.read_code_list(spark, path, "code string, name string", r"^\d{6}$")


@query("as_of_cutoffs", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + 53999999 WHEN 1 THEN epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + 21600000 END AS cutoff_ms FROM orders""")
def as_of_cutoffs(spark, sf):
    """A date, an instant with an offset, and a text that is neither."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 3 == 0, day).when(k % 3 == 1, F.concat(day, F.lit("T15:00:00+09:00"))).otherwise("soon")
    return table(spark, sf, "orders").select(k.alias("id"), F.unix_millis(sc.as_of_cutoff(text)).alias("cutoff_ms"))


@query("competitor_ids", """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'KR' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' END AS country, CASE s_suppkey % 4 WHEN 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') WHEN 1 THEN 'AB' WHEN 2 THEN lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') END AS symbol FROM supplier""")
def competitor_ids(spark, sf):
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, F.concat(F.lit(" kr:"), F.lpad(k.cast("string"), 6, "0"))).when(k % 4 == 1, "us:a b").when(
        k % 4 == 2, F.concat(F.lit("JP:"), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("XX:1")
    return table(spark, sf, "supplier").select(k.alias("id"), sc.parse_competitor_id(text).alias("c")).select("id", "c.country", "c.symbol")


@query("calendar_labels", """WITH q AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders), e AS (SELECT *, CAST(make_date(y, q * 3, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS ended FROM q)
SELECT ended, y || 'Q' || q AS label, true AS exact, 3 AS months FROM e UNION ALL SELECT CAST(ended - INTERVAL 20 DAY AS DATE), y || 'Q' || q, false, 3 FROM e""")
def calendar_labels(spark, sf):
    """Quarter ends, and ends twenty days before."""
    ends = table(spark, sf, "orders").select(F.last_day(F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3, F.lit(1))).alias("ended")).distinct()
    rows = ends.unionByName(ends.select(F.date_sub("ended", 20).alias("ended"))).withColumn("months", F.lit(3))
    label, exact = sc.calendar_label("ended", "months")
    return rows.select("ended", label.alias("label"), exact.alias("exact"), "months")


@query("record_listing", "SELECT CAST(event_id AS VARCHAR) AS id, ts AS recorded_at FROM events")
def record_listing(spark, sf):
    return rc.chronological(rf.journal(spark, sf)).select("id", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))


SQL_FUNDING = "SELECT c_custkey AS company, CAST((abs(CAST(round(c_acctbal * 100) AS BIGINT)) + 1000) * 4 AS DOUBLE) AS b, c_custkey % 3 = 0 AS held, c_custkey % 5 = 0 AS doubled, c_custkey % 7 = 0 AS pledged FROM customer"


def funding_rows(spark, sf) -> DataFrame:
    """One annual statement set per customer, amounts as multiples of a base; some have restricted cash or a debt total beside its parts.

    Customers are dealt by key before each becomes sixteen rows: the file may be one split, whose rows a single task would sort, and
    rows dealt by company need no further exchange for sums, windows and joins by company."""
    k = F.col("c_custkey")
    base = (F.abs(F.round(F.col("c_acctbal") * 100).cast("long")) + 1000) * 4
    accounts = [("BS", "현금및현금성자산", 10, 9), ("BS", "단기차입금", 2, 2), ("BS", "장기차입금", 3, 3), ("BS", "매출채권", 3, 2), ("BS", "재고자산", 2, 2), ("BS", "매입채무", 1, 2),
                ("IS", "영업이익", 4, 4), ("CF", "영업에서 창출된 현금", 6, 6), ("CF", "유형자산의 취득", 2, 2), ("CF", "감가상각비", 1, 1), ("CF", "법인세 납부", 1, 1), ("CF", "이자 지급", 1, 1), ("CF", "배당금 지급", 1, 1),
                ("BS", "사용제한 현금및현금성자산", 1, 1), ("BS", "차입금 합계", 5, 5), ("BS", "사용제한 예금", 1, 1)]
    bases = spread(table(spark, sf, "customer").select(k.alias("company"), base.cast("double").alias("b")), "company")
    rows = bases.select("company", "b", F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(s).alias("statement"), F.lit(n).alias("account_name"), F.lit(float(x)).alias("x"), F.lit(float(p)).alias("p")) for i, (s, n, x, p) in enumerate(accounts)])).alias("a"))
    rows = rows.select("company", "b", "a.*").where(((F.col("pos") != 13) | (F.col("company") % 3 == 0)) & ((F.col("pos") != 14) | (F.col("company") % 5 == 0)) & ((F.col("pos") != 15) | (F.col("company") % 7 == 0)))
    return rows.select("company", F.lit("FY").alias("period"), "pos", "statement", F.concat(F.lit("id"), F.col("pos").cast("string")).alias("account_id"), "account_name", F.lit("KRW").alias("currency"),
                       (F.col("x") * F.col("b")).alias("this_term"), (F.col("x") * F.col("b")).alias("this_term_cum"), (F.col("p") * F.col("b")).alias("prior_term"))


@query("funding_plan", f"""SELECT company, CASE WHEN held THEN 9 ELSE 10 END * b AS opening_cash, 5 * b AS opening_debt, 0.25 * b AS depreciation, 0.5 * b AS capex, 0.5 * b AS delta_working_capital, 0.25 * b AS cash_taxes,
 0.25 * b AS cash_interest, 0.75 * b AS other_cash_flow, 0.5 * b AS principal_due, 0.25 * b AS payouts, CASE WHEN doubled THEN 'FUNDING_DEBT_ROWS_AMBIGUOUS' WHEN pledged THEN 'FUNDING_RESTRICTED_CASH_UNRESOLVED' END AS unavailable_code FROM ({SQL_FUNDING})""")
def funding_plan(spark, sf):
    out = fl.funding_plan(funding_rows(spark, sf), ["company"])
    return out.select("company", "opening_cash", "opening_debt", "depreciation", "capex", "delta_working_capital", "cash_taxes", "cash_interest", "other_cash_flow", "principal_due", "payouts", "unavailable_code")


@query("debt_classes", f"""SELECT company, 2 * b AS current_debt, CASE WHEN doubled THEN NULL ELSE 3 * b END AS noncurrent_debt, CASE WHEN doubled THEN 'total_beside_detail' END AS debt_problem FROM ({SQL_FUNDING})""")
def debt_classes(spark, sf):
    out = fl.debt_classes(funding_rows(spark, sf), ["company"])
    return out.select("company", "current_debt", F.when(F.col("debt_problem").isNull(), F.col("noncurrent_debt")).alias("noncurrent_debt"), "debt_problem")
