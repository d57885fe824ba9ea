"""Nested dataset files: the valuation tables are nested and written as one JSON document per company, read back, walked and valued.
Besides them lie a torn file, a file of another company's name and a file that is no dataset."""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import format_quarter
from strandline.operators import filings as fl
from strandline.operators import grounding as gr
from strandline.operators import valuation as va
from strandline.plans import valuing as vl
from strandline.plans.registry import ctes, query, sql_rnd, stable, staged
from strandline.session import stage, stage_dir
from strandline.sources import readers as rd

NAME = r"ticker=(\d{6})/"
HOUSE = "MODEL_ASSUMPTION: house view"
SITE = "https://filings.example.com/"


def _source(title: Column | str, url: Column | str | None, manual: Column | str | None, day: Column | str) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(column(title).alias("title"), column(url).cast("string").alias("url"), column(manual).cast("string").alias("manualReference"),
                    F.date_format(column(day), "yyyy-MM-dd").alias("publishedAt"))


def _view(value: Column) -> Column:
    return F.struct(value.alias("value"), _source("Analyst", None, HOUSE, F.to_date(F.lit("2002-01-31"))).alias("source"), F.lit("as before").alias("rationale"))


def _three(df: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Scenario rows to one struct of bear, base and bull per value."""
    pick = lambda c: F.struct(*[F.max(F.when(F.col("scenario") == s, F.col(c))).alias(s) for s in va.SCENARIOS])
    return df.groupBy(*keys).agg(*[pick(c).alias(out) for c, out in names.items()])


def _series(df: DataFrame, key: str, kind: str, name: str, currency: bool) -> DataFrame:
    url = F.concat(F.lit(SITE), F.col("ds_id").cast("string"), F.lit(f"/{kind}/"), F.date_format("published_at", "yyyy-MM-dd"))
    estimated = F.col("method").isNotNull()
    point = F.struct(
        "j", format_quarter(F.col("q")).alias("quarter"), "revenue", *(["currency"] if currency else []), "basis",
        _source(F.when(estimated, "Estimate").otherwise(f"{kind} report"), F.when(~estimated, url), F.when(estimated, F.concat(F.lit("MODEL_ESTIMATE: "), "method")), F.col("published_at")).alias("source"),
        F.when(estimated, F.struct(F.col("method").alias("method"), F.array(F.lit("quote")).alias("basedOn"), F.lit("inferred").alias("rationale"))).alias("estimate"))
    return df.groupBy("ds_id", key).agg(F.transform(F.array_sort(F.collect_list(point)), lambda x: x.dropFields("j")).alias(name))


def nested_datasets(t: va.Tables) -> DataFrame:
    """The inverse of `readers.normalise_datasets`: one nested row per company."""
    def gathered(df: DataFrame, name: str, *columns: Column | str) -> DataFrame:
        rows = df.groupBy("ds_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*columns).alias("x")))).alias("_l"))
        return rows.select("ds_id", F.transform("_l", lambda e: e["x"]).alias(name))

    day = F.col("published_at")
    market = t.market.join(_series(t.market_obs, "market_id", "market", "observations", False), ["ds_id", "market_id"]).join(
        _three(t.market_tri, ["ds_id", "market_id"], {"annual_growth": "growth", "cyclical": "cycle"}), ["ds_id", "market_id"])
    markets = gathered(market, "markets", F.col("market_id").alias("id"), "name", "scope", "currency", "observations", _view(F.col("growth")).alias("annualGrowth"),
                       _view(F.struct(*[F.col(f"s{i}").alias(f"q{i}") for i in range(1, 5)])).alias("seasonality"), _view(F.col("cycle")).alias("cyclical"))
    product = t.product.join(_series(t.product_rev, "product_id", "product", "revenue", True), ["ds_id", "product_id"]).join(
        _three(t.product_tri, ["ds_id", "product_id"], {"share_delta": "delta", "margin": "margin"}), ["ds_id", "product_id"])
    products = gathered(product, "products", F.col("product_id").alias("id"), "name", F.col("market_id").alias("marketId"), "revenue", _view(F.col("delta")).alias("shareDelta"),
                        F.struct(F.col("share_min").alias("min"), F.col("share_max").alias("max")).alias("shareBounds"), _view(F.col("margin")).alias("operatingMargin"))
    rival = t.competitor.join(_series(t.competitor_rev, "competitor_id", "competitor", "revenue", True), ["ds_id", "competitor_id"], "left").join(
        _three(t.competitor_tri, ["ds_id", "competitor_id"], {"share_delta": "delta"}), ["ds_id", "competitor_id"])
    competitors = gathered(rival, "competitors", F.col("competitor_id").alias("id"), "name", F.col("market_id").alias("marketId"), "revenue", _view(F.col("delta")).alias("shareDelta"))
    fx = gathered(t.fx, "fx", "currency", F.col("krw_per_unit").alias("krwPerUnit"), F.date_format("as_of", "yyyy-MM-dd").alias("asOf"),
                  _source("Rates", SITE + "fx", None, day).alias("source"))
    of = lambda kind: F.concat(F.lit(SITE), F.col("ds_id").cast("string"), F.lit(f"/{kind}"))
    quote = t.quote.select("ds_id", F.struct(F.col("price").alias("priceKRW"), F.date_format("as_of", "yyyy-MM-dd").alias("asOf"), _source("Exchange", of("quote"), None, day).alias("source")).alias("quote"))
    shares = t.shares.select("ds_id", F.struct(F.col("diluted").alias("dilutedCommon"), F.date_format("as_of", "yyyy-MM-dd").alias("asOf"), _source("Annual report", of("annual"), None, day).alias("source")).alias("shares"))
    financials = t.financials.select("ds_id", F.struct(format_quarter(F.col("q")).alias("quarter"), F.col("total_revenue").alias("totalRevenueKRW"), _source("Annual report", of("annual"), None, day).alias("source")).alias("financials"))
    residual = _three(t.residual_tri, ["ds_id"], {"annual_growth": "annualGrowth", "margin": "operatingMargin"}).select("ds_id", _view(F.struct("annualGrowth", "operatingMargin")).alias("residual"))
    bridge = t.bridge.select("ds_id", _view(F.struct(F.col("net_interest").alias("netInterestKRW"), F.col("tax_rate").alias("effectiveTaxRate"), F.col("noncontrolling_share").alias("noncontrollingShare"),
                                                     F.col("preferred_claims").alias("preferredClaimsKRW"))).alias("earningsBridge"))
    multiple = _three(t.pe_tri, ["ds_id"], {"pe": "pe"}).select("ds_id", F.struct(_view(F.col("pe")).alias("peMultiple")).alias("valuation"))
    out = quote
    for part in (shares, financials, markets, products):
        out = out.join(part, "ds_id")
    for part in (fx, competitors, residual, bridge, multiple):
        out = out.join(part, "ds_id", "left")
    ticker = F.lpad(F.col("ds_id").cast("string"), 6, "0")
    company = F.struct(ticker.alias("ticker"), F.concat(F.lit("Company "), ticker).alias("name"), F.lit("KOSPI").alias("exchange"), F.array(_source("Register", SITE + "register", None, F.to_date(F.lit("2001-12-01")))).alias("sources"))
    return out.select(F.lit(1).alias("schemaVersion"), F.lit(True).alias("synthetic"), company.alias("company"), "quote", "shares", "fx", "financials", "markets", "products", "competitors",
                      "residual", "earningsBridge", "valuation", ticker.alias("ticker"))


def dataset_files(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents of all companies as files, and the bad ones beside them, read back; both tables kept for the queries here."""
    def build() -> DataFrame:
        folder = f"{stage_dir(spark).rstrip('/')}/datasets-{uuid.uuid4().hex}"
        nested = nested_datasets(vl.tables(spark, sf))
        documents = stage(nested.select("ticker", F.to_json(F.struct(*[c for c in nested.columns if c != "ticker"])).alias("value")), "dataset-documents")
        cut = lambda n: documents.where(F.col("ticker") == f"{n:06d}")
        torn = cut(0).select(F.lit("900000").alias("ticker"), F.expr("substring(value, 1, 5000)").alias("value"))
        other = cut(0).select(F.lit("900001").alias("ticker"), "value")
        for rows in (documents, torn, other):
            rows.repartition("ticker").write.mode("append").partitionBy("ticker").text(folder)
        cut(1).select("value").write.text(f"{folder}/notes")
        datasets, faults = rd.read_dataset_files(spark, folder, NAME)
        told = faults.select(F.lit(None).cast("string").alias("row"), F.regexp_extract("file", NAME, 1).alias("ticker"), "code")
        return datasets.select(F.to_json(F.struct(*[c for c in datasets.columns if c != "file"])).alias("row"), F.col("company.ticker").alias("ticker"), F.lit(None).cast("string").alias("code")).unionByName(told)

    both = staged(spark, sf, "dataset_files", build)
    rows = both.where("code IS NULL").select(F.from_json("row", rd.DATASET).alias("d")).select("d.*")
    return rows, both.where("code IS NOT NULL").select("ticker", "code")


@query("dataset_faults", "SELECT '900000' AS ticker, 'CORRUPT' AS code FROM nation WHERE n_nationkey = 0 UNION ALL SELECT '900001', 'TICKER_MISMATCH' FROM nation WHERE n_nationkey = 0 UNION ALL SELECT '', 'NOT_A_DATASET' FROM nation WHERE n_nationkey = 1")
def dataset_faults(spark, sf):
    return dataset_files(spark, sf)[1]


@query("dataset_valuation", ctes(vl.SQL_VAL) + f"SELECT ds_id, scenario, target_q, CASE WHEN ok THEN 'available' ELSE 'unavailable' END AS status, {sql_rnd('CASE WHEN ok THEN annual_eps * pe END', 3)} AS target_price FROM val")
def dataset_valuation(spark, sf):
    """The read documents valued: the same target prices as from the tables they were made of."""
    t = rd.normalise_datasets(dataset_files(spark, sf)[0])
    t = va.lift_markets(va.Tables(**{f.name: getattr(t, f.name).withColumn("ds_id", F.col("ds_id").cast("int")) for f in fields(va.Tables)}))
    v = va.valuation(t, vl.as_of(), vl.reported_eps(t))
    return v.select("ds_id", "scenario", "target_q", "status", stable("target_price", 3).alias("target_price"))


def walked(spark, sf) -> DataFrame:
    return staged(spark, sf, "dataset_sources", lambda: rd.resolvable_sources(dataset_files(spark, sf)[0]))


def _sql_series(kind: str, rows: str, key: str, section: str, field: str, order: int) -> str:
    at = f"dense_rank() OVER (PARTITION BY ds_id ORDER BY {key}) - 1"
    return f"""SELECT ds_id, '{section}[' || i || '].{field}[' || j || '].source' AS path, CASE WHEN method IS NULL THEN '{kind} report' ELSE 'Estimate' END AS title,
  CASE WHEN method IS NULL THEN '{SITE}' || ds_id || '/{kind}/' || day ELSE 'MODEL_ESTIMATE: ' || method END AS reference, day, {order} * 1000000000000 + i * 10000 + j AS ord
  FROM (SELECT ds_id, method, {at} AS i, row_number() OVER (PARTITION BY ds_id, {key} ORDER BY q) - 1 AS j, CAST(last_day(make_date(CAST(q // 4 AS INTEGER), CAST(q % 4 * 3 + 3 AS INTEGER), 1)) AS DATE) + 20 AS day FROM {rows})"""


def _sql_views(rows: str, key: str, section: str, names: tuple[str, ...], order: int) -> str:
    at = f"dense_rank() OVER (PARTITION BY ds_id ORDER BY {key}) - 1"
    return " UNION ALL ".join(f"""SELECT ds_id, '{section}[' || i || '].{name}.source', 'Analyst', '{HOUSE}', DATE '2002-01-31', {order} * 1000000000000 + i * 10000 + {9000 + n}
  FROM (SELECT DISTINCT ds_id, {at} AS i FROM {rows})""" for n, name in enumerate(names))


def _sql_one(path: str, title: str, reference: str, day: str, order: int, where: str = "true") -> str:
    return f"SELECT nation, '{path}', '{title}', {reference}, DATE '{day}', {order} * 1000000000000 FROM nat JOIN fin ON fin.ds_id = nation WHERE {where}"


SQL_WALK = ctes(vl.SQL_VAL) + ", rv AS (SELECT r.ds_id, r.pos, r.rival, c.q, c.method FROM riv r LEFT JOIN crev c ON c.ds_id = r.ds_id AND c.competitor_id = r.competitor_id), src(ds_id, path, title, reference, day, ord) AS (" + " UNION ALL ".join([
    _sql_series("market", "obs0", "pos", "markets", "observations", 5), _sql_one("company.sources[0]", "Register", f"'{SITE}register'", "2001-12-01", 0),
    _sql_one("quote.source", "Exchange", f"'{SITE}' || nation || '/quote'", "2002-05-12", 1), _sql_one("shares.source", "Annual report", f"'{SITE}' || nation || '/annual'", "2002-02-10", 2),
    _sql_one("fx[0].source", "Rates", f"'{SITE}fx'", "2002-05-01", 3), _sql_one("financials.source", "Annual report", f"'{SITE}' || nation || '/annual'", "2002-02-10", 4),
    _sql_views("obs0", "pos", "markets", ("annualGrowth", "seasonality", "cyclical"), 5),
    _sql_series("product", "own", "pos", "products", "revenue", 6), _sql_views("own", "pos", "products", ("shareDelta", "operatingMargin"), 6),
    "SELECT * FROM (" + _sql_series("competitor", "rv", "pos * 100 + rival", "competitors", "revenue", 7).replace("FROM rv)", "FROM rv WHERE true)") + ") WHERE day IS NOT NULL",
    _sql_views("rv", "pos * 100 + rival", "competitors", ("shareDelta",), 7), _sql_one("residual.source", "Analyst", f"'{HOUSE}'", "2002-01-31", 8, "nation % 3 <> 0"),
    _sql_one("earningsBridge.source", "Analyst", f"'{HOUSE}'", "2002-01-31", 9), _sql_one("valuation.peMultiple.source", "Analyst", f"'{HOUSE}'", "2002-01-31", 10)]) + ")"


@query("dataset_sources", SQL_WALK + " SELECT ds_id, path, title, reference, day AS published_at FROM src")
def dataset_sources(spark, sf):
    return walked(spark, sf).select(F.col("ds_id").cast("int").alias("ds_id"), "path", "title", "reference", "published_at")


@query("dataset_provenance", SQL_WALK + """ SELECT ds_id, title, reference, day AS published_at, arg_min(path, ord) AS first_path, count(*) AS n, CAST(row_number() OVER (PARTITION BY ds_id ORDER BY min(ord)) AS INTEGER) AS rank FROM src GROUP BY ds_id, title, reference, day""")
def dataset_provenance(spark, sf):
    return rd.dataset_provenance(walked(spark, sf)).withColumn("ds_id", F.col("ds_id").cast("int"))


@query("dataset_source_rules", SQL_WALK + f"""  SELECT ds_id, 'UNKNOWN_SOURCE_URL' AS code, path FROM src WHERE reference LIKE '%/fx'
  UNION ALL SELECT ds_id, 'FUTURE_SOURCE', path FROM src WHERE day > DATE '{vl.AS_OF}'""")
def dataset_source_rules(spark, sf):
    """The source rules on the documents as read; all urls but that of the rates are supplied documents."""
    sources = walked(spark, sf)
    supplied = sources.where("url IS NOT NULL AND url NOT LIKE '%/fx'").select("url", "published_at").distinct()
    found = gr.resolve_sources(sources, supplied, vl.as_of())
    return found.select(F.col("ds_id").cast("int").alias("ds_id"), "code", "path")


@query("dataset_companies", "SELECT lpad(CAST(s AS VARCHAR), 6, '0') AS ticker, 'Company ' || lpad(CAST(s AS VARCHAR), 6, '0') AS name, 'KOSPI' AS exchange FROM (SELECT DISTINCT s_nationkey AS s FROM supplier) WHERE lpad(CAST(s AS VARCHAR), 6, '0') LIKE '%01%'")
def dataset_companies(spark, sf):
    """Companies whose name holds the term; no ticker begins with it."""
    return fl.list_companies(dataset_files(spark, sf)[0], " 01 ").select("ticker", "name", "exchange")


@query("dataset_profiles", ctes(vl.SQL_VAL) + """, m AS (SELECT ds_id, market_id, max(q) AS q FROM obs0 GROUP BY 1, 2), p AS (SELECT ds_id, count(DISTINCT product_id) AS products, min(product_id) AS first_product FROM own GROUP BY 1)
SELECT m.ds_id, m.market_id, (q // 4) || 'Q' || (q % 4 + 1) AS latest_observation, p.products, p.first_product, '2001Q4' AS financials_quarter, CAST(50000 + 1000 * m.ds_id AS DOUBLE) AS price FROM m JOIN p ON p.ds_id = m.ds_id""")
def dataset_profiles(spark, sf):
    rows = fl.company_profiles(dataset_files(spark, sf)[0])
    each = rows.select(F.col("ticker").cast("int").alias("ds_id"), F.explode("markets").alias("m"), F.size("products").cast("long").alias("products"),
                       F.array_min(F.transform("products", lambda p: p["id"])).alias("first_product"), "financials_quarter", F.col("quote.priceKRW").alias("price"))
    return each.select("ds_id", F.col("m.id").alias("market_id"), F.col("m.latest_observation").alias("latest_observation"), "products", "first_product", "financials_quarter", "price")
