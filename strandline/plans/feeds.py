"""Source and stream queries: raw texts are rendered from the tables and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import filings as fl
from strandline.operators import forecast as fc
from strandline.operators import panel
from strandline.plans import market as mk
from strandline.plans import reference as rf
from strandline.plans.registry import ctes, query, rounded, sql_rnd, table
from strandline.session import stage_dir
from strandline.sources import readers as rd
from strandline.streaming import jobs


@query("parse_bars", "SELECT CAST(l_orderkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END AS open, l_extendedprice AS close, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS volume FROM lineitem WHERE l_linenumber <> 5")
def parse_bars(spark, sf):
    n = F.col("l_linenumber")
    price = F.format_number("l_extendedprice", 2)
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("ticker"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T15:30:00")).alias("date"),
        F.when(n % 3 == 0, "0").otherwise(price).alias("open"), price.alias("high"), price.alias("low"), F.when(n == 5, "-").otherwise(price).alias("close"),
        F.when(n == 2, "-5").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("volume"), n.alias("seq"))
    return rd.parse_bars(rows).select("ticker", "date", "open", "close", "volume")


@query("parse_flows", "SELECT CAST(l_orderkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN l_quantity * 1000 WHEN l_returnflag = 'N' THEN -l_quantity END AS \"foreign\", CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS organ FROM lineitem WHERE l_returnflag <> 'A'")
def parse_flows(spark, sf):
    qty = F.col("l_quantity").cast("int")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("ticker"), F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyyMMdd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("+"), F.format_number(qty * 1000, 0))).when(F.col("l_returnflag") == "N", F.concat(F.lit("-"), qty.cast("string"))).otherwise("n/a").alias("foreign"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(qty.cast("string")).alias("organ"), F.col("l_linenumber").alias("seq"))
    return rd.parse_flows(rows).select("ticker", "date", "foreign", "organ")


@query("parse_rate_maps", "SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders GROUP BY 1")
def parse_rate_maps(spark, sf):
    rates = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.year("o_orderdate").alias("y")).agg(F.max("o_totalprice").alias("r"))
    maps = rates.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("d", F.create_map(F.lit("KRW"), "r")))).alias("rates"))
    return rd.parse_rate_maps(maps.withColumn("index_name", F.lit(mk.INDEX))).select("date", "close")


@query("parse_facts", ctes(rf.SQL_FACTS) + "SELECT company, concept, start, \"end\", form, filed, floor(val + 0.5) AS val FROM f1")
def parse_facts(spark, sf):
    """Facts rendered as one JSON document per company and concept, then read back."""
    facts = rf.facts(spark, sf)
    doc = facts.groupBy("company", "concept").agg(F.to_json(F.create_map(F.col("concept"), F.struct(F.create_map(F.lit("USD"), F.collect_list(
        F.struct("start", "end", "val", F.col("accession").alias("accn"), "form", "filed"))).alias("units")))).alias("json"))
    return rd.parse_facts(doc.select("company", "json")).select("company", "concept", "start", "end", "form", "filed", F.floor(F.col("val") + 0.5).cast("double").alias("val"))


@query("parse_news_listing", "SELECT source AS company, CAST(doc_id AS VARCHAR) AS id, TIMESTAMP '2023-12-31 15:00:00' + to_days(CAST(doc_id % 700 AS INTEGER)) AS published_at, lang AS title FROM documents")
def parse_news_listing(spark, sf):
    at = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")), "yyyyMMdd")
    items = table(spark, sf, "documents").select(F.col("source").alias("company"), F.struct(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("<b>"), "lang", F.lit("</b>&nbsp;")).alias("title"),
                                                                                            F.col("text").alias("body"), F.concat(at, F.lit("0000")).alias("datetime")).alias("x"))
    pages = items.groupBy("company", F.floor(F.col("x.id").cast("long") / 100).alias("page")).agg(F.collect_list("x").alias("items"))
    out = rd.parse_news_listing(pages.select("company", F.array(F.struct("items")).alias("groups")))
    return out.select("company", "id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.regexp_replace("title", r"[\s ]+$", "").alias("title"))


@query("company_codes", "SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS ticker, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS corp_code, c_name AS name FROM customer WHERE c_custkey % 10 <> 3")
def company_codes(spark, sf):
    k = F.col("c_custkey").cast("string")
    item = F.concat(F.lit("<list><corp_code>"), F.lpad(k, 8, "0"), F.lit("</corp_code><corp_name>"), "c_name", F.lit("</corp_name><stock_code> "),
                    F.when(F.col("c_custkey") % 10 == 3, "").otherwise(F.lpad(k, 6, "0")), F.lit("</stock_code></list>"))
    return fl.company_codes(table(spark, sf, "customer").select(item.alias("markup")))


@query("reference_metrics", "SELECT o_orderkey AS id, round(o_totalprice * 100) / 100 AS number, CASE WHEN o_orderkey % 2 = 0 THEN '배' ELSE '원' END AS unit, CASE WHEN o_orderkey % 3 = 0 THEN 'consensus' WHEN o_orderkey % 3 = 1 THEN 'valuation' ELSE 'other' END AS role FROM orders")
def reference_metrics(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("id"), F.concat(F.format_number("o_totalprice", 2), F.when(k % 2 == 0, "배").otherwise("원")).alias("text"),
                                             F.when(k % 3 == 0, "cnsEps").when(k % 3 == 1, "per").otherwise("dividend").alias("code"))
    return fl.reference_metrics(rows).select("id", "number", "unit", "role")


# ---- streams -----------------------------------------------------------------------------------------------------


def event_stream(spark, sf) -> DataFrame:
    """The events table read as a stream of bars: event type and day as ticker and session, event id as arrival."""
    raw = table(spark, sf, "events").schema
    rows = spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), (F.col("value") + 1).alias("close"), F.col("event_id").alias("ingest_seq"))


def _folder(spark) -> str:
    return f"{stage_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


SQL_EVENT_BARS = "eb AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, arg_max(value + 1, event_id) AS close FROM events GROUP BY 1, 2)"


@query("stream_bars", ctes(SQL_EVENT_BARS) + "SELECT * FROM eb")
def stream_bars(spark, sf):
    stream, base = event_stream(spark, sf), _folder(spark)
    jobs.ingest_bars(stream, f"{base}/bars", f"{base}/cp", availableNow=True).awaitTermination()
    return jobs.current_bars(spark, f"{base}/bars", stream.schema).select("ticker", "date", "close")


def event_log(bars: DataFrame) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(0.6).alias("probability_up"), F.lit("up").alias("direction"), F.lit("low").alias("confidence"),
                                 F.lit(1.0).alias("expected_return_pct"), F.lit(-50.0).alias("range_lo"), F.lit(50.0).alias("range_hi")) for h in (1, 2, 3)])
    return bars.select("ticker", F.col("date").alias("as_of_date"), entries.alias("horizons"))


@query("stream_scores", ctes(SQL_EVENT_BARS) + f""", a AS (SELECT ticker, date, close, unnest([1, 2, 3]) AS horizon, [lead(close, 1) OVER w, lead(close, 2) OVER w, lead(close, 3) OVER w] AS n FROM eb WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date AS as_of_date, horizon, {sql_rnd('(n[horizon] / close - 1) * 100', 5)} AS actual_return_pct FROM a WHERE n[horizon] IS NOT NULL""")
def stream_scores(spark, sf):
    events = table(spark, sf, "events")
    batch_bars = panel.last_arrival(events.select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), (F.col("value") + 1).alias("close"), F.col("event_id").alias("ingest_seq")))
    log, base = event_log(batch_bars), _folder(spark)
    jobs.score_arrivals(event_stream(spark, sf), log, f"{base}/bars", f"{base}/scores", f"{base}/cp", availableNow=True).awaitTermination()
    out = jobs.current_scores(spark, f"{base}/scores", jobs.score_schema(log))
    return rounded(out, ["ticker", "as_of_date", "horizon"], ["actual_return_pct"], 5)


@query("stream_records", "SELECT CAST(event_id AS VARCHAR) AS id, 'stored' AS outcome FROM events WHERE NOT (event_id % 9 = 0 AND event_id % 3 <> 0) UNION ALL SELECT CAST(event_id AS VARCHAR), 'RECORD_FROM_FUTURE' FROM events WHERE event_id % 9 = 0 AND event_id % 3 <> 0")
def stream_records(spark, sf):
    raw = table(spark, sf, "events").schema
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    stream = spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(sf).select(
        k.cast("string").alias("id"), "event_type", "value", F.when(k % 3 == 0, "historical_import_unverified").otherwise("forward").alias("mode"), ts.alias("recorded_at"),
        (ts + F.when(k % 9 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval -1 hour"))).alias("known_at"))
    base = _folder(spark)
    jobs.ingest_records(stream, ["event_type", "value"], ["known_at"], f"{base}/records", f"{base}/rejects", f"{base}/cp", availableNow=True).awaitTermination()
    read = lambda p, s: spark.read.schema(s).option("recursiveFileLookup", True).parquet(f"{base}/{p}")
    return read("records", "id string").select("id", F.lit("stored").alias("outcome")).unionByName(read("rejects", "id string, code string").select("id", F.col("code").alias("outcome")))
