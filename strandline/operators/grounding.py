"""Citations against documents, numbers against quotes, estimates against their basis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalar import parse_quarter
from strandline.operators.rules import union_all

# Unit words after a number, and the labels and paths of assumptions and estimates.
UNITS = {"천": 1e3, "만": 1e4, "백만": 1e6, "억": 1e8, "십억": 1e9, "조": 1e12,
         "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
NUMERAL_RUN = r"^[천백십만억조]+$"
ASSUMPTION_PATH = r"^(markets\[\d+\]\.(annualGrowth|seasonality|cyclical)|products\[\d+\]\.(shareDelta|operatingMargin)|competitors\[\d+\]\.shareDelta|residual|earningsBridge|valuation\.peMultiple)\.source$"
ESTIMATE_PATH = r"^(markets\[\d+\]\.observations\[\d+\]|products\[\d+\]\.revenue\[\d+\]|competitors\[\d+\]\.revenue\[\d+\])\.source$"
PRODUCT_REVENUE_PATH = r"^products\[\d+\]\.revenue\[\d+\]\.revenue$"
ASSUMPTION_LABEL, ESTIMATE_LABEL = "MODEL_ASSUMPTION:", "MODEL_ESTIMATE:"
HARD_CODES = ("NO_DATASET_NO_REASON", "DATASET_SCHEMA", "SYNTHETIC_DATASET", "TICKER_MISMATCH", "FUTURE_DATE", "FUTURE_SOURCE", "NOT_QUARTERLY")
# Words that say which event, basis or sector a quote is about.
EVENT_WORDS = {"earnings_release": r"(?i)실적\s*발표|잠정\s*실적|경영\s*실적|영업\s*\(?잠정\)?\s*실적|결산\s*발표|결산\s*실적\s*공시\s*예고|earnings\s*(release|call)",
               "guidance_update": r"(?i)가이던스|실적\s*전망\s*(수정|변경)|전망치\s*(수정|변경)|guidance",
               "other_scheduled_disclosure": r"(?i)공시\s*예정|이사회\s*(결의|개최)|주주총회|정기\s*보고서\s*제출|발표\s*예정|scheduled\s*disclosure"}
CONSOLIDATED, DILUTED, BASIC = r"(?i)연결|consolidated", r"(?i)희석|diluted", r"(?i)기본\s*주당|\bbasic\b"
FINANCIAL_SECTOR = r"은행|저축은행|보험|생명보험|화재해상|손해보험|캐피탈|카드사|금융지주|증권(?!거래소|시장)"
EARLIER_FIGURE_PATH = r"^(markets\[\d+\]\.observations\[\d+\]|competitors\[\d+\]\.revenue\[\d+\]|products\[\d+\]\.revenue\[\d+\])\.revenue$"


def check_citations(citations: DataFrame, documents: DataFrame, as_of: Column) -> DataFrame:
    """Add `code`: the first structural fault of a citation, NULL when it stands."""
    read = F.when(~F.coalesce(F.col("published_at") > as_of, F.lit(False)), F.col("text"))  # no quote is looked up in a later text
    docs = documents.select(F.col("doc_id").alias("document_id"), F.col("url").alias("_u"), F.col("published_at").alias("_d"), read.alias("_t"))
    joined = citations.join(docs, "document_id", "left")
    code = (F.when(F.col("_u").isNull(), "CITATION_UNKNOWN_DOCUMENT").when(F.col("url") != F.col("_u"), "CITATION_URL_MISMATCH")
            .when(F.col("published_at") != F.col("_d"), "CITATION_DATE_MISMATCH").when(F.col("_d") > as_of, "CITATION_FUTURE_SOURCE")
            .when(~F.col("_t").contains(F.col("quote")), "CITATION_QUOTE_NOT_FOUND"))
    return joined.withColumn("code", code).drop("_u", "_d", "_t")


def unit_multipliers(quote: Column, number: Column) -> Column:
    """Multipliers authorised by each standalone occurrence of the number: its unit word, 1 without one, 0 for an
    unknown compound (which supports nothing)."""
    pattern = F.concat(F.lit(r"(?<![\d,.])\Q"), number, F.lit(r"\E(?!\d|[,.]\d)\s*([천백십만억조]+|[A-Za-z]+)?"))
    runs = F.regexp_extract_all(quote, pattern, F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])

    def multiplier(run):
        word = F.lower(F.coalesce(run, F.lit("")))
        known = F.try_element_at(table, word)
        return F.when(known.isNotNull(), known).when(word.rlike(NUMERAL_RUN), 0.0).otherwise(1.0)

    return F.transform(runs, multiplier)


def quoted_amounts(citations: DataFrame) -> DataFrame:
    """Add `unquoted`: why the quote does not say quoted_number x multiplier, NULL when it does, and `amount`, that product."""
    seen = unit_multipliers(F.col("quote"), F.col("quoted_number"))
    mult, number = F.coalesce("multiplier", F.lit(1.0)), F.regexp_replace("quoted_number", ",", "").try_cast("double")
    reason = (F.when(F.col("quoted_number").isNull(), "no_quoted_number").when(F.size(seen) == 0, "number_not_standalone")
              .when(~F.array_contains(seen, mult), "multiplier_not_written").when(number.isNull(), "not_a_number"))
    return citations.withColumns({"unquoted": reason, "amount": number * mult})


def value_differs(amount: Column, value: Column) -> Column:
    return F.abs(amount - value) > 1e-9 * F.greatest(F.lit(1.0), F.abs(value))


def numeric_support(citations: DataFrame) -> DataFrame:
    """Add `unsupported`: why quoted_number x multiplier is not the cited value, NULL when it is."""
    reason = F.coalesce("unquoted", F.when(value_differs(F.col("amount"), F.col("value")), "value_differs"))
    return quoted_amounts(citations).withColumn("unsupported", reason).drop("unquoted", "amount")


def observed_numbers(values: DataFrame, citations: DataFrame) -> DataFrame:
    """(ds_id, code, path) of observed numbers without a valid citation, or without one that supports them."""
    good = citations.where(F.col("code").isNull())
    cited = good.groupBy("ds_id", "path").agg(F.max((F.col("url") == F.col("source_url")) & F.col("unsupported").isNull()).alias("ok"))
    joined = values.select("ds_id", "path").join(cited, ["ds_id", "path"], "left")
    code = F.when(F.col("ok").isNull(), "NUMBER_UNCITED").when(~F.col("ok"), "NUMBER_UNSUPPORTED")
    return joined.select("ds_id", code.alias("code"), "path").where(F.col("code").isNotNull())


def resolve_sources(sources: DataFrame, documents: DataFrame, as_of: Column) -> DataFrame:
    """(ds_id, code, path) of sources that are neither a supplied document nor a labelled assumption or estimate."""
    docs = documents.groupBy("url").agg(F.collect_set("published_at").alias("_dates"))
    rows = sources.join(docs, "url", "left")
    ref, path = F.coalesce("manual_reference", F.lit("")), F.col("path")
    by_url = F.when(F.col("_dates").isNull(), "UNKNOWN_SOURCE_URL").when(~F.array_contains("_dates", F.col("published_at")), "SOURCE_DATE_MISMATCH")
    estimate = F.when(~path.rlike(ESTIMATE_PATH), "MODEL_ESTIMATE_ON_OBSERVED_FIELD").when(~F.col("has_estimate"), "ESTIMATE_MISSING")
    assumption = (F.when(~ref.startswith(ASSUMPTION_LABEL), "SOURCE_NOT_SUPPLIED").when(~path.rlike(ASSUMPTION_PATH), "MODEL_ASSUMPTION_ON_OBSERVED_FIELD")
                  .when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "ASSUMPTION_WITHOUT_RATIONALE"))
    code = F.when(F.col("url").isNotNull(), by_url).when(ref.startswith(ESTIMATE_LABEL), estimate).otherwise(assumption)
    late = rows.where(F.col("published_at") > as_of).select("ds_id", F.lit("FUTURE_SOURCE").alias("code"), "path")
    return rows.select("ds_id", code.alias("code"), "path").where(F.col("code").isNotNull()).unionByName(late)


def estimate_rules(estimates: DataFrame, paths: DataFrame, documents: DataFrame) -> DataFrame:
    """(ds_id, code, path) of estimates without a label, a basis, or a basis their method needs.

    estimates(ds_id, path, method, based_on array, labelled), paths(ds_id, path) are numeric dataset paths."""
    refs = estimates.select("ds_id", "path", F.explode("based_on").alias("ref"))
    known = paths.select("ds_id", F.col("path").alias("ref"), F.lit(True).alias("_p"))
    docs = documents.select(F.col("doc_id").cast("string").alias("ref"), F.lit(True).alias("_d")).distinct()
    looked = refs.join(known, ["ds_id", "ref"], "left").join(docs, "ref", "left")
    basis = looked.groupBy("ds_id", "path").agg(F.countDistinct(F.when(F.col("_d"), F.col("ref"))).alias("docs"), F.max(F.col("ref").rlike(EARLIER_FIGURE_PATH) | F.col("_d").isNotNull()).alias("earlier"),
                                                F.max(F.col("ref").rlike(PRODUCT_REVENUE_PATH)).alias("product"))
    rows = estimates.join(basis, ["ds_id", "path"], "left")

    def hit(df, cond, code):
        return df.where(F.coalesce(cond, F.lit(False))).select("ds_id", F.lit(code).alias("code"), "path")

    m = F.col("method")
    return union_all([
        hit(rows, ~F.col("labelled"), "ESTIMATE_NOT_LABELLED"), hit(rows, (m != "model_knowledge") & (F.size("based_on") == 0), "ESTIMATE_WITHOUT_BASIS"),
        hit(looked, F.col("ref") == F.col("path"), "ESTIMATE_SELF_REFERENCE"),
        hit(looked, (F.col("ref") != F.col("path")) & F.col("_p").isNull() & F.col("_d").isNull(), "ESTIMATE_BASIS_UNKNOWN"),
        hit(rows, ((m == "share_implied") & ~F.coalesce("product", F.lit(False))) | ((m == "article_synthesis") & (F.coalesce("docs", F.lit(0)) < 2))
            | ((m == "prior_extrapolation") & ~F.coalesce("earlier", F.lit(False))), "ESTIMATE_BASIS_MISMATCH")])


def verdict(datasets: DataFrame, issues: DataFrame) -> DataFrame:
    """verified without issues, rejected on a hard one, provisional otherwise."""
    counts = issues.groupBy("ds_id").agg(F.count("*").alias("issues"), F.count(F.when(F.col("code").isin(*HARD_CODES), 1)).alias("hard"))
    joined = datasets.select("ds_id").distinct().join(counts, "ds_id", "left").na.fill(0, ["issues", "hard"])
    return joined.withColumn("verdict", F.when(F.col("hard") > 0, "rejected").when(F.col("issues") > 0, "provisional").otherwise("verified"))


def reconcile_review(observed: DataFrame, estimated: DataFrame, review: DataFrame) -> DataFrame:
    """Second review: observed paths not confirmed, disagreements, estimates rejected. review(ds_id, path, opinion)."""
    def left(paths, code, bad):
        joined = paths.select("ds_id", "path").join(review, ["ds_id", "path"], "left")
        return joined.where(F.coalesce(bad, F.lit(True))).select("ds_id", F.lit(code).alias("code"), "path")

    return union_all([left(observed, "AUDIT_UNCONFIRMED", F.col("opinion").isNull()),
                      left(observed.join(review, ["ds_id", "path"], "left_semi"), "AUDIT_DISAGREES", F.col("opinion") == "disagree"),
                      left(estimated.join(review, ["ds_id", "path"], "left_semi"), "ESTIMATE_REJECTED", F.col("opinion") == "reject")])


def usable_documents(documents: DataFrame, as_of: Column, max_total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable, problems): documents after the as-of date, duplicate ids, invalid dates, total size beyond the limit."""
    dated = F.col("published_at").isNotNull()
    duplicate = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("DUPLICATE_ID").alias("code"))
    late = documents.where(dated & (F.col("published_at") > as_of)).select("doc_id", F.lit("AFTER_AS_OF").alias("code"))
    undated = documents.where(~dated).select("doc_id", F.lit("INVALID_DATE").alias("code"))
    problems = union_all([duplicate, late, undated])
    if max_total is not None:
        size = documents.agg(F.sum(F.length("text")).alias("s")).where(F.col("s") > max_total).select(F.lit(None).cast("long").alias("doc_id"), F.lit("TOO_LARGE").alias("code"))
        problems = problems.unionByName(size)
    return documents.where(dated & (F.col("published_at") <= as_of)), problems


# ---- strategy quotes ----------------------------------------------------------------------------------------------


def quarter_tokens(quote: Column) -> Column:
    """Sorted distinct quarter indexes named in a quote ('2026Q4', '2026-Q4', '2026년 4분기')."""
    latin = F.regexp_extract_all(quote, F.lit(r"(\d{4}\s*[.\-]?\s*[Qq]\s*[1-4])\b"), F.lit(1))
    korean = F.regexp_extract_all(quote, F.lit(r"(\d{4}\s*년\s*[1-4]\s*분기)"), F.lit(1))
    digits = F.transform(F.concat(latin, korean), lambda t: F.regexp_replace(t, r"\D", ""))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda d: parse_quarter(F.concat(F.substring(d, 1, 4), F.lit("Q"), F.substring(d, 5, 1))))))


def anchored_horizon(quote: Column) -> Column:
    """Quarters a quote anchors: two tokens three apart with a range mark span four quarters, else the tokens named."""
    tokens = quarter_tokens(quote)
    first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    span = (F.size(tokens) == 2) & (last - first == 3) & quote.rlike(r"(?i)[~\-–—]|부터|까지|to\b")
    return F.when(F.size(tokens) == 0, None).when(span, F.sequence(first, first + 3)).otherwise(tokens)


def horizon_matches(rows: DataFrame) -> DataFrame:
    """Add `horizon_ok`: the quote anchors exactly the claimed quarters (array `horizon`)."""
    return rows.withColumn("horizon_ok", F.coalesce(anchored_horizon(F.col("quote")) == F.col("horizon"), F.lit(False)))


def consensus_basis(rows: DataFrame) -> DataFrame:
    """Add `basis_code`: a consensus quote must say consolidated and diluted, not basic, in the EPS document."""
    q = F.col("quote")
    code = (F.when(~q.rlike(CONSOLIDATED), "NOT_CONSOLIDATED").when(~q.rlike(DILUTED), "NOT_DILUTED").when(q.rlike(BASIC), "BASIC_SHARES")
            .when(F.col("eps_document") != F.col("horizon_document"), "DIFFERENT_DOCUMENTS"))
    return rows.withColumn("basis_code", code)


def event_anchored(rows: DataFrame) -> DataFrame:
    """Add `event_code`: the event's Korean date and a word of its type stand in one quote of the catalyst's document."""
    d = F.to_date(F.from_utc_timestamp("event_at", "Asia/Seoul"))
    plain = F.concat(F.year(d).cast("string"), F.lit("년 "), F.month(d).cast("string"), F.lit("월 "), F.dayofmonth(d).cast("string"), F.lit("일"))
    variants = F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy.MM.dd"), F.date_format(d, "yyyy/MM/dd"), plain)
    word = F.lit(False)
    for event, pattern in EVENT_WORDS.items():
        word = F.when(F.col("event_type") == event, F.col("quote").rlike(pattern)).otherwise(word)
    code = (F.when(F.col("quote_document") != F.col("catalyst_document"), "OTHER_DOCUMENT")
            .when(~F.exists(variants, lambda v: F.col("quote").contains(v)), "DATE_NOT_QUOTED").when(~word, "EVENT_NOT_DESCRIBED"))
    return rows.withColumn("event_code", code)


def strategy_sources(sources: DataFrame, documents: DataFrame, as_of: Column, kinds: tuple[str, ...]) -> DataFrame:
    """(id, code): a strategy source is a real document of an allowed kind known on its published day, by the as-of day. The first
    document of a url (smallest id) stands for it."""
    docs = documents.groupBy("url").agg(F.min_by("published_at", "doc_id").alias("_d"))
    rows = sources.join(docs, "url", "left")
    known = F.to_date(F.from_utc_timestamp("known_at", "Asia/Seoul"))
    code = (F.when(F.col("_d").isNull(), "NOT_A_DOCUMENT").when(~F.col("kind").isin(*kinds), "KIND_NOT_ALLOWED")
            .when(known != F.col("_d"), "KNOWN_DAY_DIFFERS").when(known > as_of, "KNOWN_AFTER_AS_OF"))
    return rows.select("id", code.alias("code")).where(F.col("code").isNotNull())


def financial_sector(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("name").rlike(FINANCIAL_SECTOR), F.lit(False)) | F.coalesce(F.col("sector").rlike(FINANCIAL_SECTOR), F.lit(False)))


def complete_forecasts(forecasts: DataFrame, segments: DataFrame, cited: DataFrame) -> DataFrame:
    """(id, block, code): forecasts lacking a bridge assumption or a cited segment; liquidity and funding fall alone. A path is
    cited for the forecast of its id only."""
    uncited = segments.join(cited.select("id", "path"), ["id", "path"], "left_anti").select("id").distinct()
    flag = lambda df, block, code: df.select("id", F.lit(block).alias("block"), F.lit(code).alias("code"))
    return union_all([
        flag(forecasts.where(~F.col("has_bridge_assumption")), "forecast", "BRIDGE_ASSUMPTION_MISSING"), flag(uncited, "forecast", "SEGMENT_UNCITED"),
        flag(forecasts.where(F.col("has_liquidity") & ~F.col("liquidity_cited")), "liquidity", "LIQUIDITY_UNGROUNDED"),
        flag(forecasts.where(F.col("has_funding") & ~F.col("funding_cited")), "funding", "FUNDING_UNGROUNDED")])


