"""Sources and sinks. Every read has an explicit schema; malformed rows fail or are dropped as each source demands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions import nested
from strandline.functions.scalar import parse_amount, parse_quarter, signed_amount, strip_tags, valid_date
from strandline.operators import valuation as va
from strandline.operators.rules import union_all

# ---- prices ------------------------------------------------------------------------------------------------------


def parse_bars(rows: DataFrame) -> DataFrame:
    """Raw price rows (ticker, date text, price texts, seq) to bars: a valid date and a positive close are required,
    non-positive open/high/low and negative volume become NULL."""
    def positive(c):
        amount = parse_amount(c)
        return F.when(amount > 0, amount)

    volume, day = parse_amount("volume"), F.substring("date", 1, 10)
    out = rows.select("ticker", F.when(valid_date(day), F.try_to_date(day, "yyyy-MM-dd")).alias("date"), *[positive(c).alias(c) for c in ("open", "high", "low", "close")],
                      F.when(volume >= 0, volume).alias("volume"), F.col("seq").alias("ingest_seq"))
    return out.where(F.col("date").isNotNull() & F.col("close").isNotNull())


def parse_rate_maps(rows: DataFrame, currency: str = "KRW") -> DataFrame:
    """{date: {currency: rate}} maps (column `rates`) to close-only series rows."""
    return (rows.select("index_name", F.explode("rates").alias("date", "r"))
            .select("index_name", F.try_to_date("date", "yyyy-MM-dd").alias("date"), F.try_element_at("r", F.lit(currency)).alias("close"))
            .where(F.col("date").isNotNull() & (F.col("close") > 0)))


def parse_flows(rows: DataFrame) -> DataFrame:
    """Investor rows with dates as yyyymmdd or ISO and signed texts; rows without either side are dropped."""
    text = F.col("date")
    day = F.coalesce(F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    out = rows.select("ticker", day.alias("date"), signed_amount("foreign").alias("foreign"), signed_amount("organ").alias("organ"), F.col("seq").alias("ingest_seq"))
    return out.where(F.col("date").isNotNull() & (F.col("foreign").isNotNull() | F.col("organ").isNotNull()))


def session_prices(replays: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested replay inputs to (sessions, prices, problems): ascending disjoint sessions, one price per session, unique labels."""
    sessions = replays.select("run_id", F.posexplode("sessions").alias("idx", "s")).select("run_id", "idx", "s.open_at", "s.close_at")
    series = replays.select("run_id", F.explode("series").alias("x")).select("run_id", "x.label", "x.prices")
    prices = series.select("run_id", "label", F.posexplode("prices").alias("idx", "p")).select("run_id", "label", "idx", "p.open", "p.close")
    previous = F.lag("close_at").over(Window.partitionBy("run_id").orderBy("idx"))
    n = replays.select("run_id", F.size("sessions").alias("n"))
    problems = union_all([
        sessions.withColumn("_p", previous).where((F.col("open_at") >= F.col("close_at")) | (F.col("_p") >= F.col("open_at"))).select("run_id", F.lit("SESSIONS_NOT_ASCENDING").alias("code")),
        series.join(n, "run_id").where(F.size("prices") != F.col("n")).select("run_id", F.lit("PRICE_COUNT_DIFFERS").alias("code")),
        series.groupBy("run_id", "label").count().where("count > 1").select("run_id", F.lit("DUPLICATE_LABEL").alias("code"))]).distinct()
    return sessions, prices, problems


# ---- nested valuation datasets -----------------------------------------------------------------------------------

SOURCE = "struct<title:string,url:string,manualReference:string,publishedAt:date>"
ESTIMATE = "struct<method:string,basedOn:array<string>,rationale:string>"
TRI = "struct<bear:double,base:double,bull:double>"


def _assumed(value: str) -> str:
    return f"struct<value:{value},source:{SOURCE},rationale:string>"


DATASET = f"""schemaVersion int, synthetic boolean,
company struct<ticker:string,name:string,exchange:string,sector:string,description:string,sources:array<{SOURCE}>>,
quote struct<priceKRW:double,asOf:date,source:{SOURCE}>, shares struct<dilutedCommon:double,asOf:date,source:{SOURCE}>,
fx array<struct<currency:string,krwPerUnit:double,asOf:date,source:{SOURCE}>>, financials struct<quarter:string,totalRevenueKRW:double,source:{SOURCE}>,
markets array<struct<id:string,name:string,scope:string,currency:string,observations:array<struct<quarter:string,revenue:double,basis:string,source:{SOURCE},estimate:{ESTIMATE}>>,
  annualGrowth:{_assumed(TRI)},seasonality:{_assumed('struct<q1:double,q2:double,q3:double,q4:double>')},cyclical:{_assumed(TRI)}>>,
products array<struct<id:string,name:string,marketId:string,revenue:array<struct<quarter:string,revenue:double,currency:string,basis:string,source:{SOURCE},estimate:{ESTIMATE}>>,
  shareDelta:{_assumed(TRI)},shareBounds:struct<min:double,max:double>,operatingMargin:{_assumed(TRI)}>>,
competitors array<struct<id:string,name:string,marketId:string,revenue:array<struct<quarter:string,revenue:double,currency:string,basis:string,source:{SOURCE},estimate:{ESTIMATE}>>,shareDelta:{_assumed(TRI)}>>,
residual {_assumed(f'struct<annualGrowth:{TRI},operatingMargin:{TRI}>')},
earningsBridge {_assumed('struct<netInterestKRW:double,effectiveTaxRate:double,noncontrollingShare:double,preferredClaimsKRW:double>')},
valuation struct<peMultiple:{_assumed(TRI)}>"""


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """One nested JSON document per file; a corrupt file is an error."""
    return spark.read.schema(DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_dataset_files(spark: SparkSession, path: str, name: str = r"(\d{6})\.json$") -> tuple[DataFrame, DataFrame]:
    """(datasets with `file`, faults (file, code)): one nested JSON document per file, named by its ticker; `name` finds the ticker
    in the path. A bad file is a fault by itself and does not stop the others: CORRUPT (no JSON of the schema), TICKER_MISMATCH
    (another company's, or none), NOT_A_DATASET (the name holds no ticker; such a file is left out)."""
    rows = (spark.read.schema(DATASET + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path")))
    expected = F.regexp_extract("file", name, 1)
    fault = (F.when(expected == "", "NOT_A_DATASET").when(F.col("_bad").isNotNull() | F.col("company").isNull(), "CORRUPT")
             .when(~F.coalesce(F.col("company.ticker") == expected, F.lit(False)), "TICKER_MISMATCH"))
    judged = rows.withColumn("_fault", fault)
    return (judged.where(F.col("_fault").isNull()).drop("_bad", "_fault"),
            judged.where(F.col("_fault").isNotNull()).select("file", F.col("_fault").alias("code")).distinct())


def walk_sources(datasets: DataFrame) -> DataFrame:
    """(ds_id, pos, path, title, url, reference, published_at): every source of a dataset in the order of the document, wherever the
    schema has one. `reference` is the url or, without one, the manual reference."""
    kind = datasets.select(*[c for c in datasets.columns if c != "file"]).schema
    found = nested.nodes(F.struct(*[F.col(f.name) for f in kind.fields]), kind, nested.structs_with("title", "publishedAt"))
    rows = datasets.select(F.col("company.ticker").alias("ds_id"), F.posexplode(found).alias("pos", "n"))
    return rows.select("ds_id", "pos", "n.path", "n.value.title", "n.value.url", F.col("n.value.manualReference").alias("manual_reference"),
                       F.coalesce("n.value.url", "n.value.manualReference").alias("reference"), F.col("n.value.publishedAt").alias("published_at"))


def dataset_provenance(sources: DataFrame) -> DataFrame:
    """Distinct sources (title, reference, date) of each dataset in order of first appearance, with the path they first appear at
    and how often they appear."""
    distinct = sources.groupBy("ds_id", "title", "reference", "published_at").agg(
        F.min("pos").alias("_first"), F.min_by("path", "pos").alias("first_path"), F.count("*").alias("n"))
    order = Window.partitionBy("ds_id").orderBy("_first")
    return distinct.withColumn("rank", F.row_number().over(order)).drop("_first")


def resolvable_sources(datasets: DataFrame) -> DataFrame:
    """`walk_sources` with what stands beside each source: its rationale, and whether an estimate does; as the source rules
    (`grounding.resolve_sources`) take them."""
    kind = datasets.select(*[c for c in datasets.columns if c != "file"]).schema
    texts = nested.nodes(F.struct(*[F.col(f.name) for f in kind.fields]), kind, lambda t: isinstance(t, StringType))
    beside = datasets.select(F.col("company.ticker").alias("ds_id"), F.explode(texts).alias("n")).select(
        "ds_id", F.regexp_extract("n.path", r"^(.*)\.(?:rationale|estimate\.method)$", 1).alias("_parent"),
        F.when(F.col("n.path").endswith(".rationale"), F.col("n.value")).alias("rationale"), F.col("n.path").endswith(".estimate.method").alias("_estimate"))
    beside = beside.where("_parent <> ''").groupBy("ds_id", "_parent").agg(F.max("rationale").alias("rationale"), F.max("_estimate").alias("_estimate"))
    sources = walk_sources(datasets).withColumn("_parent", F.regexp_replace("path", r"\.source$", ""))
    return (sources.join(beside, ["ds_id", "_parent"], "left").withColumn("has_estimate", F.coalesce("_estimate", F.lit(False))).drop("_parent", "_estimate"))


def _tri(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), *[F.col(f"{path}.{s}").alias(name) for name, path in values.items()]) for s in va.SCENARIOS]))
    return df.select(*keys, rows.alias("_s")).select(*keys, "_s.*")


def normalise_datasets(datasets: DataFrame) -> va.Tables:
    """Nested datasets to the valuation normal form; array positions are kept for issue paths."""
    d = datasets.withColumn("ds_id", F.col("company.ticker"))
    exploded = lambda c: d.where(F.col(c).isNotNull()).select("ds_id", F.posexplode(c).alias("pos", "x"))
    m, p, c = exploded("markets"), exploded("products"), exploded("competitors")

    def series(df, key, field, currency):
        rows = df.select("ds_id", F.col("x.id").alias(key), F.posexplode(f"x.{field}").alias("j", "o"))
        extra = [F.col("o.currency").alias("currency")] if currency else []
        return rows.select("ds_id", key, "j", parse_quarter("o.quarter").alias("q"), F.col("o.revenue").alias("revenue"), *extra,
                           F.col("o.basis").alias("basis"), F.col("o.estimate.method").alias("method"), F.col("o.source.publishedAt").alias("published_at"))

    return va.Tables(
        quote=d.select("ds_id", F.col("quote.priceKRW").alias("price"), F.col("quote.asOf").alias("as_of"), F.col("quote.source.publishedAt").alias("published_at")),
        shares=d.select("ds_id", F.col("shares.dilutedCommon").alias("diluted"), F.col("shares.asOf").alias("as_of"), F.col("shares.source.publishedAt").alias("published_at")),
        fx=exploded("fx").select("ds_id", "pos", "x.currency", F.col("x.krwPerUnit").alias("krw_per_unit"), F.col("x.asOf").alias("as_of"), F.col("x.source.publishedAt").alias("published_at")),
        financials=d.select("ds_id", parse_quarter("financials.quarter").alias("q"), F.col("financials.totalRevenueKRW").alias("total_revenue"), F.col("financials.source.publishedAt").alias("published_at")),
        market=m.select("ds_id", "pos", F.col("x.id").alias("market_id"), "x.name", "x.scope", "x.currency", *[F.col(f"x.seasonality.value.q{i}").alias(f"s{i}") for i in range(1, 5)]),
        market_obs=series(m, "market_id", "observations", False),
        market_tri=_tri(m.withColumn("market_id", F.col("x.id")), ["ds_id", "market_id"], {"annual_growth": "x.annualGrowth.value", "cyclical": "x.cyclical.value"}),
        product=p.select("ds_id", "pos", F.col("x.id").alias("product_id"), "x.name", F.col("x.marketId").alias("market_id"), F.col("x.shareBounds.min").alias("share_min"), F.col("x.shareBounds.max").alias("share_max")),
        product_rev=series(p, "product_id", "revenue", True),
        product_tri=_tri(p.withColumn("product_id", F.col("x.id")), ["ds_id", "product_id"], {"share_delta": "x.shareDelta.value", "margin": "x.operatingMargin.value"}),
        competitor=c.select("ds_id", "pos", F.col("x.id").alias("competitor_id"), "x.name", F.col("x.marketId").alias("market_id")),
        competitor_rev=series(c, "competitor_id", "revenue", True),
        competitor_tri=_tri(c.where(F.col("x.shareDelta").isNotNull()).withColumn("competitor_id", F.col("x.id")), ["ds_id", "competitor_id"], {"share_delta": "x.shareDelta.value"}),
        residual_tri=_tri(d.where(F.col("residual").isNotNull()), ["ds_id"], {"annual_growth": "residual.value.annualGrowth", "margin": "residual.value.operatingMargin"}),
        bridge=d.select("ds_id", F.col("earningsBridge.value.netInterestKRW").alias("net_interest"), F.col("earningsBridge.value.effectiveTaxRate").alias("tax_rate"),
                        F.col("earningsBridge.value.noncontrollingShare").alias("noncontrolling_share"), F.col("earningsBridge.value.preferredClaimsKRW").alias("preferred_claims")),
        pe_tri=_tri(d, ["ds_id"], {"pe": "valuation.peMultiple.value"}))


# ---- filings, facts, listings ------------------------------------------------------------------------------------

STATEMENT_ROW = """company string, fiscal_year int, period string, period_end date, basis string, receipt string, filed_date date, is_correction boolean, pos int, statement string,
account_id string, account_name string, currency string, this_term double, this_term_cum double, prior_term double, prior_quarter double, prior_cum double"""
FACTS = "map<string,struct<units:map<string,array<struct<start:date,end:date,val:double,accn:string,fy:int,fp:string,form:string,filed:date>>>>>"


def read_statement_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATEMENT_ROW).option("mode", "FAILFAST").json(path)


def parse_facts(rows: DataFrame, unit: str = "USD") -> DataFrame:
    """(company, json of concept -> units -> facts) to one row per fact."""
    concepts = rows.select("company", F.explode(F.from_json("json", FACTS)).alias("concept", "c"))
    facts = concepts.select("company", "concept", F.explode(F.try_element_at("c.units", F.lit(unit))).alias("f"))
    return facts.select("company", "concept", "f.start", "f.end", "f.val", F.col("f.accn").alias("accession"), "f.form", "f.filed").where(
        F.col("val").isNotNull() & F.col("end").isNotNull() & F.col("filed").isNotNull())


def parse_finance_tables(rows: DataFrame) -> DataFrame:
    """Nested finance tables (columns, rows of column -> value) to (company, title, column, is_estimate, value)."""
    columns = rows.select("company", F.explode("columns").alias("c")).select("company", F.col("c.key").alias("column"), F.col("c.is_estimate").alias("is_estimate"))
    cells = rows.select("company", F.explode("rows").alias("r")).select("company", F.col("r.title").alias("title"), F.explode("r.values").alias("column", "value"))
    return cells.join(columns, ["company", "column"])


def read_code_list(spark: SparkSession, path: str, schema: str, key_pattern: str, encoding: str = "UTF-8") -> DataFrame:
    """Delimited code list; leading title and header lines are the rows whose first column is no code."""
    rows = spark.read.csv(path, schema=schema, quote='"', encoding=encoding, mode="PERMISSIVE")
    return rows.where(F.coalesce(F.col(rows.columns[0]).rlike(key_pattern), F.lit(False)))


def read_fact_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated UTF-16 facts with one header line, one small file per filing (two-byte text cannot be split by lines)."""
    return spark.read.csv(path, schema=schema, sep="\t", encoding="UTF-16", header=True, quote='"', multiLine=True)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("page_id"), F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def parse_news_listing(rows: DataFrame) -> DataFrame:
    """(company, groups of items) to news rows; entities and tags are removed from titles and snippets."""
    items = rows.select("company", F.posexplode("groups").alias("g", "group")).select("company", "g", F.posexplode("group.items").alias("i", "x"))
    at = F.try_to_timestamp(F.concat("x.datetime", F.lit("+0900")), F.lit("yyyyMMddHHmmZ"))
    return items.select("company", F.col("x.id").alias("id"), (F.col("g").cast("long") * (1 << 31) + F.col("i")).alias("pos"), strip_tags("x.title").alias("title"), strip_tags("x.body").alias("snippet"),
                        at.alias("published_at")).where(F.col("published_at").isNotNull())


# ---- logs --------------------------------------------------------------------------------------------------------

FORECAST_LOG = """recorded_at timestamp, ticker string, as_of_date date, last_close double,
horizons array<struct<horizon:int,probability_up:double,direction:string,confidence:string,expected_return_pct:double,range_lo:double,range_hi:double>>"""


def read_log(spark: SparkSession, path: str, schema: str = FORECAST_LOG) -> DataFrame:
    """JSON Lines log; a torn line is skipped and a missing log is empty."""
    try:
        lines = spark.read.text(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    parsed = F.from_json("value", f"{schema}, _torn string", {"columnNameOfCorruptRecord": "_torn"})
    return lines.where(F.trim("value") != "").select(parsed.alias("r")).select("r.*").where(F.col("_torn").isNull()).drop("_torn")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_summary(parts: dict[str, DataFrame], path: str) -> None:
    """Daily summary: each part as one JSON document under its section name, replacing the last one."""
    packed = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in parts.items()]
    union_all(packed).write.mode("overwrite").partitionBy("section").json(path)
