"""Filing versions, statement rows, company facts and reference tables, for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import TICKER_PATTERN, company_key, kst_date, rnd, tdiv
from strandline.operators.panel import latest_by
from strandline.operators.rules import union_all

# Report kinds and the month distance from the fiscal year end that each period has.
REPORT_PATTERN = r"(사업|반기|분기)보고서\s*\((\d{4})\.(\d{2})\)"
CORRECTION_WORD, ATTACHMENT_WORD = "정정", "첨부"
# Rows that do not add up over periods, and rows counted as money.
NON_ADDITIVE = r"(?i)PerShare|주당|WeightedAverage|가중평균|주식\s*수|NumberOf\w*Shares|률|비율|Ratio|Margin"
RATE_WORD = r"(^|[^A-Za-z])Rate\b|[a-z]Rate\b"
CURRENCY_CODE = r"^[A-Z]{3}$"
REVENUE_TAG, REVENUE_NAME = r"^(ifrs-full|ifrs)_Revenue$", r"^(매출액|수익\(매출액\)|영업수익|매출)$"
# Revenue concepts in order of preference, domestic forms, period lengths in days.
REVENUE_CONCEPTS = ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues",
                    "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet")
DOMESTIC_FORM, ANNUAL_FORM = r"^10-[QK]", "10-K"
QUARTER_DAYS, YEAR_DAYS = (80, 100), (350, 380)
# Disclosure kinds, and how many of each and in all a display shows.
DISCLOSURE_KINDS = (("earnings_schedule", r"기업설명회|\(IR\)개최|IR개최|결산실적공시예고", 2),
                    ("earnings_guidance", r"실적등에대한전망|영업실적전망", 1), ("preliminary_earnings", r"\(잠정\)실적|잠정실적", 1))
MAX_DISCLOSURES = 4
# Names and codes that mark an instrument as something other than a common share.
PREFERRED_NAME = r"(?:\d우[ABC]?|우[ABC]|우\(전환\)|우선주)$|\(우\)"
ETF_NAME = r"\b(?:ETF|ETN)\b|^(?:KODEX|TIGER|KBSTAR|ARIRANG|HANARO|KOSEF)\b|상장지수"
REIT_NAME = r"(?i)리츠|\bREITs?\b|부동산투자회사|부동산투자신탁|위탁관리|기업구조조정부동산"
INFRA_NAME = r"인프라(?:투융자|펀드)|투융자회사|사회기반시설|^맥쿼리인프라$"
SPAC_NAME = r"(?i)스팩|기업인수목적|\bSPAC\b|\bSpecial Purpose Acquisition\b"
SHIP_NAME, FUND_INDUSTRY = r"선박투자회사", r"^6420\d?$"


def classify_reports(rows: DataFrame) -> DataFrame:
    """Period type, end and fiscal year from the report name and the fiscal-year-end month."""
    kind, year, month = (F.regexp_extract("report_name", REPORT_PATTERN, i) for i in (1, 2, 3))
    y, m = year.try_cast("int"), month.try_cast("int")
    k = F.pmod(m - F.col("fye_month") + 12, F.lit(12))
    period = (F.when((kind == "사업") & (k == 0), "FY").when((kind == "반기") & (k == 6), "H1")
              .when((kind == "분기") & (k == 3), "Q1").when((kind == "분기") & (k == 9), "Q3"))
    fiscal = F.when((period == "FY") | (F.col("fye_month") == 12), y).otherwise(y + F.when(m > F.col("fye_month"), 1).otherwise(0))
    return (rows.withColumns({"period_type": period, "period_end": F.last_day(F.make_date(y, m, F.lit(1))), "fiscal_year": fiscal,
                              "is_correction": F.col("report_name").contains(CORRECTION_WORD)})
            .where(F.col("period_type").isNotNull() & ~F.col("report_name").contains(ATTACHMENT_WORD)))


def filings_as_of(filings: DataFrame, day: Column, date_only: bool = True) -> DataFrame:
    """Received by the day (a timestamp cannot order same-day filings, so it excludes them); the period has ended."""
    received = F.col("received_date") <= day if date_only else F.col("received_date") < day
    return filings.where(received & (F.col("period_end") <= day))


def latest_versions(filings: DataFrame, keep: int | None = None) -> DataFrame:
    """Newest version per (company, type, end) with the period's `rank`, newest first; cut where the caller asks."""
    newest = latest_by(filings, ["company", "period_type", "period_end"], [F.col("received_date"), F.col("receipt")])
    order = Window.partitionBy("company").orderBy(F.desc("period_end"), "period_type")
    ranked = newest.withColumn("rank", F.row_number().over(order))
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def with_documents(filings: DataFrame, available: DataFrame, keep: int | None = None) -> DataFrame:
    """Newest version that has a document; a period without any gives its place to the next one."""
    return latest_versions(filings.join(available.select("receipt").distinct(), "receipt", "left_semi"), keep)


def sound_statements(rows: DataFrame, day: Column) -> DataFrame:
    """Rows of statement sets whose rows all share one receipt filed by the day."""
    keys = ["company", "fiscal_year", "period", "basis"]
    good = (rows.groupBy(*keys).agg(F.min("receipt").alias("a"), F.max("receipt").alias("b"), F.max("filed_date").alias("f"))
            .where((F.col("a") == F.col("b")) & (F.col("f") <= day)))
    return rows.join(good.select(*keys), keys, "left_semi")


def preferred_basis(rows: DataFrame) -> DataFrame:
    """Consolidated rows, separate ones only where a period has no consolidated set."""
    keys = ["company", "fiscal_year", "period"]
    chosen = rows.groupBy(*keys).agg(F.min(F.when(F.col("basis") == "CFS", 0).otherwise(1)).alias("_p"))
    return rows.join(chosen, keys).where(F.when(F.col("basis") == "CFS", 0).otherwise(1) == F.col("_p")).drop("_p")


def monetary_rows(rows: DataFrame) -> DataFrame:
    label = F.concat_ws(" ", "account_id", "account_name")
    return rows.where(F.coalesce(F.col("currency").rlike(CURRENCY_CODE), F.lit(False)) & ~label.rlike(NON_ADDITIVE) & ~label.rlike(RATE_WORD))


def derived_q4(rows: DataFrame) -> DataFrame:
    """Fourth quarter = annual less nine months cumulative: same basis, account and currency, additive money rows."""
    keys = ["company", "fiscal_year", "basis", "statement", "account_id", "account_name", "currency"]
    flows = monetary_rows(rows).where(F.col("statement").isin("IS", "CIS"))
    annual = flows.where(F.col("period") == "FY").select(*keys, "period_end", F.col("this_term").alias("annual"), F.col("receipt").alias("annual_receipt"),
                                                         F.col("filed_date").alias("annual_filed"), F.col("is_correction").alias("annual_correction"))
    nine = flows.where(F.col("period") == "Q3").select(*keys, F.col("this_term_cum").alias("nine_months"), F.col("receipt").alias("q3_receipt"),
                                                       F.col("filed_date").alias("q3_filed"), F.col("is_correction").alias("q3_correction"))
    joined = annual.join(nine, keys).where(F.col("annual").isNotNull() & F.col("nine_months").isNotNull())
    withheld = (F.col("q3_filed") > F.col("annual_filed")) | F.col("annual_correction") | F.col("q3_correction")
    return joined.withColumn("amount", F.col("annual") - F.col("nine_months")).withColumn("withheld", withheld)


def revenue_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The revenue line of each set: the tagged one first, then by name; first position wins."""
    tagged, named = F.col("account_id").rlike(REVENUE_TAG), F.regexp_replace("account_name", r"\s+", "").rlike(REVENUE_NAME)
    hits = rows.where(F.col("statement").isin("IS", "CIS") & (tagged | named))
    others = [c for c in hits.columns if c not in keys]
    return (hits.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(F.when(tagged, 0).otherwise(1), F.col("pos"))).alias("_r"))
            .select(*keys, "_r.*"))


def statement_revenue(rows: DataFrame) -> DataFrame:
    """Reported three- and twelve-month revenue and the derived fourth quarter."""
    keys = ["company", "fiscal_year", "period", "basis"]
    reported = revenue_row(rows, keys).where(F.col("this_term").isNotNull() & F.col("currency").isNotNull()).select(
        "company", "fiscal_year", F.when(F.col("period") == "FY", 12).otherwise(3).alias("months"), "period_end", "currency",
        F.col("this_term").alias("revenue"), F.lit("reported").alias("kind"))
    q4 = derived_q4(rows).withColumn("pos", F.lit(0))
    derived = revenue_row(q4, ["company", "fiscal_year", "basis"]).select(
        "company", "fiscal_year", F.lit(3).alias("months"), "period_end", "currency", F.col("amount").alias("revenue"), F.lit("derived").alias("kind"))
    return reported.unionByName(derived)


def share_counts(rows: DataFrame) -> DataFrame:
    """Issued shares by class where one receipt holds them all and a common class exists."""
    cls = (F.when(F.col("class_name").rlike("보통주|common"), "common").when(F.col("class_name").rlike("우선주|종류주|preferred"), "preferred").otherwise("other"))
    tagged = rows.withColumn("share_class", cls)
    good = tagged.groupBy("company").agg(F.min("receipt").alias("a"), F.max("receipt").alias("b"), F.max(F.col("share_class") == "common").alias("c"))
    ok = good.where((F.col("a") == F.col("b")) & F.col("c")).select("company")
    return tagged.join(ok, "company", "left_semi").groupBy("company", "share_class").agg(F.sum("issued").alias("issued"))


def usable_facts(facts: DataFrame, cutoff: Column) -> DataFrame:
    """Facts of domestic forms, public from noon in Korea the day after filing, at or before the cutoff."""
    public = F.to_utc_timestamp(F.date_add("filed", 1).cast("timestamp") + F.expr("interval 12 hours"), "Asia/Seoul")
    return facts.where(F.col("form").rlike(DOMESTIC_FORM) & (public <= cutoff))


def chosen_concept(facts: DataFrame) -> DataFrame:
    """Facts of the revenue concept reported most recently, by preference on ties."""
    order = F.array_position(F.array(*[F.lit(c) for c in REVENUE_CONCEPTS]), F.col("concept"))
    last = facts.where(order > 0).groupBy("company", "concept").agg(F.max("end").alias("_e"), F.max(order).alias("_o"))
    best = last.groupBy("company").agg(F.max_by("concept", F.struct("_e", -F.col("_o"))).alias("concept"))
    return facts.join(best, ["company", "concept"], "left_semi")


def earliest_values(facts: DataFrame) -> DataFrame:
    """One value per (company, start, end): the first filing's."""
    others = [c for c in facts.columns if c not in ("company", "start", "end")]
    return (facts.where(F.col("start").isNotNull()).groupBy("company", "start", "end")
            .agg(F.min_by(F.struct(*others), F.struct("filed", "accession")).alias("_f")).select("company", "start", "end", "_f.*"))


def facts_revenue(facts: DataFrame) -> DataFrame:
    """Quarters, years and the fourth quarter as year less its three contained quarters, with the `rank` of each
    length, newest first."""
    length = F.datediff("end", "start")
    quarters = facts.where(length.between(*QUARTER_DAYS))
    years = facts.where(length.between(*YEAR_DAYS) & F.col("form").startswith(ANNUAL_FORM))
    q = quarters.select("company", F.col("start").alias("qs"), F.col("end").alias("qe"), F.col("val").alias("qv"))
    inside = (years.join(q, "company").where((F.col("qs") >= F.col("start")) & (F.col("qe") <= F.col("end")))
              .groupBy("company", "start", "end", "val").agg(F.count("*").alias("n"), F.sum("qv").alias("s"), F.max("qe").alias("last")))
    closed = q.select("company", F.col("qe").alias("end")).distinct()
    derived = inside.where(F.col("n") == 3).join(closed, ["company", "end"], "left_anti").select(
        "company", F.lit(3).alias("months"), F.date_add("last", 1).alias("start"), "end", (F.col("val") - F.col("s")).alias("revenue"), F.lit("derived").alias("kind"))
    plain = lambda df, months: df.select("company", F.lit(months).alias("months"), "start", "end", F.col("val").alias("revenue"), F.lit("reported").alias("kind"))
    rows = union_all([plain(quarters, 3), plain(years, 12), derived])
    newest = F.row_number().over(Window.partitionBy("company", "months").orderBy(F.desc("end"), "start"))
    return rows.withColumn("rank", newest)


def half_year_filings(docs: DataFrame, elements: dict[str, int], window_days: int, day: Column) -> DataFrame:
    """Revenue of half-year and annual documents filed within the window: best element, consolidated before separate."""
    rank = F.lit(None)
    for name, priority in elements.items():
        rank = F.when(F.col("element") == name, priority).otherwise(rank)
    timely = docs.where((F.col("filed_date") <= day) & (F.datediff("filed_date", "period_end") <= window_days) & rank.isNotNull())
    others = [c for c in docs.columns if c not in ("company", "period_end", "months")]
    order = F.struct(F.when(F.col("consolidated"), 0).otherwise(1), rank, -F.unix_date("filed_date"))
    return timely.groupBy("company", "period_end", "months").agg(F.min_by(F.struct(*others), order).alias("_d")).select("company", "period_end", "months", "_d.*")


def second_half(rows: DataFrame) -> DataFrame:
    """Second half = year less first half on the same consolidation basis."""
    year = rows.where(F.col("months") == 12).select("company", "consolidated", F.col("period_end"), F.col("revenue").alias("full"))
    half = rows.where(F.col("months") == 6).select("company", "consolidated", F.last_day(F.add_months("period_end", 6)).alias("period_end"), F.col("revenue").alias("first"))
    return year.join(half, ["company", "consolidated", "period_end"]).select("company", "consolidated", "period_end", (F.col("full") - F.col("first")).alias("revenue"))


def wide_finance(rows: DataFrame, metrics: dict[str, str], unit: float = 1e8, limit: float = 1e18) -> DataFrame:
    """(company, title, column, is_estimate, value text) rows to one row per column; ambiguous titles are dropped."""
    number = F.regexp_replace("value", ",", "").try_cast("double")
    known = rows.where(F.col("title").isin(*metrics.values()))
    unique = known.groupBy("company", "column", "title").agg(F.count("*").alias("n"), F.max(number).alias("v"), F.max("is_estimate").alias("e"))
    clean = unique.where((F.col("n") == 1) & F.col("v").isNotNull())
    money = F.when(F.col("title").contains("EPS"), F.col("v")).otherwise(F.col("v") * unit)
    kept = clean.withColumn("v", money).where(F.abs("v") <= limit)
    return kept.groupBy("company", "column").agg(F.max("e").alias("is_estimate"), *[
        F.max(F.when(F.col("title") == title, F.col("v"))).alias(name) for name, title in metrics.items()])


def yearly_growth(rows: DataFrame, value: str) -> DataFrame:
    order = Window.partitionBy("company").orderBy("year")
    prev, before = F.lag(value).over(order), F.lag("year").over(order)
    return rows.withColumn("growth_pct", F.when((before == F.col("year") - 1) & (prev > 0), (F.col(value) / prev - 1) * 100))


def recent_closes(closes: DataFrame, day: Column, days: int | None = None) -> DataFrame:
    """Closes up to a day, of the last `days` days where given."""
    known = closes.where(F.col("date") <= day)
    return known if days is None else known.where(F.datediff(day, "date") <= days)


def per_reference(closes: DataFrame, actuals: DataFrame) -> DataFrame:
    """Current, lowest, median and highest multiple of the closes on the last four consecutive quarters' EPS."""
    order = Window.partitionBy("ticker").orderBy(F.desc("q"))
    last4 = actuals.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 4)
    ttm = (last4.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("eps").alias("ttm_eps"), (F.max("q") - F.min("q")).alias("span"))
           .where((F.col("n") == 4) & (F.col("span") == 3) & (F.col("ttm_eps") > 0)).select("ticker", "ttm_eps"))
    rows = closes.join(ttm, "ticker").withColumn("per", F.col("close") / F.col("ttm_eps"))
    return rows.groupBy("ticker").agg(
        F.count("*").alias("sessions"), rnd(F.max("ttm_eps"), 2).alias("ttm_eps"), rnd(F.max_by("per", "date"), 2).alias("current"),
        rnd(F.min("per"), 2).alias("min_per"), rnd(F.percentile("per", F.lit(0.5)), 2).alias("median_per"), rnd(F.max("per"), 2).alias("max_per"))


def cross_rates(rates: DataFrame, day: Column, base: str = "KRW") -> DataFrame:
    """Units of `base` per currency through a common quote, on the last day before `day`."""
    known = rates.where(F.col("date") <= F.date_sub(day, 1))
    last = known.groupBy().agg(F.max("date").alias("date"))
    on = known.join(last, "date")
    anchor = on.where(F.col("currency") == base).select("date", F.col("rate").alias("_b"))
    return on.join(anchor, "date").where((F.col("currency") != base) & (F.col("rate") > 0)).select(
        "currency", "date", rnd(F.col("_b") / F.col("rate"), 4).alias("per_unit"))


def disclosures(rows: DataFrame, capped: bool = False) -> DataFrame:
    """Classified disclosures with their `kind_rank` and `rank`, newest first; under the display's caps where asked."""
    name, kind, cap = F.regexp_replace("report_name", r"\s+", ""), F.lit(None), F.lit(0)
    for label, pattern, limit in reversed(DISCLOSURE_KINDS):
        kind, cap = F.when(name.rlike(pattern), label).otherwise(kind), F.when(name.rlike(pattern), limit).otherwise(cap)
    newest = [F.desc("received_date"), F.desc("receipt")]
    hits = rows.withColumns({"kind": kind, "_cap": cap}).where(F.col("kind").isNotNull())
    hits = hits.withColumn("kind_rank", F.row_number().over(Window.partitionBy("company", "kind").orderBy(*newest)))
    hits = hits.where(F.col("kind_rank") <= F.col("_cap")) if capped else hits
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("company").orderBy(*newest))).drop("_cap")
    return ranked.where(F.col("rank") <= MAX_DISCLOSURES) if capped else ranked


def classify_securities(rows: DataFrame) -> DataFrame:
    """Add `rejections`: why an instrument is not a common share (columns ticker, name, instrument, industry)."""
    name, other = F.trim("name"), F.coalesce(F.lower("instrument") != "stock", F.lit(False))
    suffix = F.col("ticker").rlike(r"^\d{6}$") & ~F.col("ticker").endswith("0")
    tests = [("ETF_ETN", F.when(other, F.col("instrument").rlike("(?i)^et[fn]$")).otherwise(name.rlike(ETF_NAME))),
             ("NON_STOCK", other & ~F.col("instrument").rlike("(?i)^et[fn]$")), ("PREFERRED_STOCK", suffix | name.rlike(PREFERRED_NAME)),
             ("REIT", name.rlike(REIT_NAME)), ("INFRA_FUND", name.rlike(INFRA_NAME) | F.coalesce(F.col("industry").rlike(FUND_INDUSTRY), F.lit(False))),
             ("SPAC", name.rlike(SPAC_NAME)), ("SHIP_FUND", name.rlike(SHIP_NAME))]
    return rows.withColumn("rejections", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in tests])))


def screen_names(rows: DataFrame) -> DataFrame:
    """Add `rejections`, an array of (code, matched): why an instrument is not a common share, judged by all names of a listing
    (columns ticker, names array, instrument, industry, check_suffix). `matched` is the first name that a pattern fits, null where
    no name decided. Blank and null names count for nothing; an unknown `check_suffix` is true."""
    names = F.filter(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: F.length(n) > 0)
    named = lambda pattern: F.get(F.filter(names, lambda n: n.rlike(pattern)), F.lit(0))
    kind = F.col("instrument")
    other, fund = F.coalesce(F.lower(kind) != "stock", F.lit(False)), F.coalesce(kind.rlike("(?i)^et[fn]$"), F.lit(False))
    suffix = F.coalesce("check_suffix", F.lit(True)) & F.coalesce(F.col("ticker").rlike(r"^\d{6}$") & ~F.col("ticker").endswith("0"), F.lit(False))
    none = F.lit(None).cast("string")

    def found(code: str, pattern: str, before: Column | None = None, instead: Column | None = None) -> Column:
        """A rejection by `before` (no name needed), else by a name that fits, else by `instead`."""
        hit = named(pattern)
        reject = lambda matched: F.struct(F.lit(code).alias("code"), matched.alias("matched"))
        out = F.when(hit.isNotNull(), reject(hit)) if before is None else F.when(before, reject(none)).when(hit.isNotNull(), reject(hit))
        return out if instead is None else out.when(instead, reject(none))

    typed = F.when(other, F.struct(F.when(fund, "ETF_ETN").otherwise("NON_STOCK").alias("code"), none.alias("matched"))).otherwise(found("ETF_ETN", ETF_NAME))
    tests = [typed, found("PREFERRED_STOCK", PREFERRED_NAME, before=suffix), found("REIT", REIT_NAME),
             found("INFRA_FUND", INFRA_NAME, instead=F.coalesce(F.col("industry").rlike(FUND_INDUSTRY), F.lit(False))), found("SPAC", SPAC_NAME), found("SHIP_FUND", SHIP_NAME)]
    return rows.withColumn("rejections", F.array_compact(F.array(*tests)))


def list_companies(datasets: DataFrame, search: str | None = None) -> DataFrame:
    """(ticker, name, exchange, sector) of nested datasets; a search term keeps tickers that begin with it and names that hold it."""
    rows = datasets.select("company.ticker", "company.name", "company.exchange", "company.sector")
    term = (search or "").strip().lower()
    return rows.where(F.col("ticker").startswith(term) | F.lower("name").contains(term)) if term else rows


def company_profiles(datasets: DataFrame) -> DataFrame:
    """One row per nested dataset: who it is, its sources, products (id, name, market), markets with the quarter of their last
    observation, quarter of the financials, quote."""
    markets = F.transform("markets", lambda m: F.struct(m["id"].alias("id"), m["name"].alias("name"), m["scope"].alias("scope"), m["currency"].alias("currency"),
                                                        F.try_element_at(m["observations"], F.lit(-1))["quarter"].alias("latest_observation")))
    products = F.transform("products", lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["marketId"].alias("market_id")))
    return datasets.select("company.ticker", "company.name", "company.exchange", "company.sector", "company.description", F.col("company.sources").alias("sources"),
                           products.alias("products"), markets.alias("markets"), F.col("financials.quarter").alias("financials_quarter"), "quote")


def universe(rows: DataFrame) -> DataFrame:
    """Common stocks with a valid code, one row per ticker, sorted by exchange and size (a range-partitioned sort)."""
    good = classify_securities(rows).where((F.size("rejections") == 0) & F.col("ticker").rlike(TICKER_PATTERN)).drop("rejections")
    return latest_by(good, ["ticker"], [F.col("market_cap")]).orderBy("exchange", F.desc("market_cap"), "ticker")


def search_universe(rows: DataFrame, text: str, limit: int) -> DataFrame:
    """Ticker prefix or name part; every row carries the total so a page can say how many there are."""
    needle = text.strip().lower()
    hits = rows.where(F.lower("ticker").startswith(needle) | F.lower("name").contains(needle))
    return hits.withColumn("total", hits.agg(F.count("*")).scalar()).orderBy(F.desc("market_cap"), "ticker").limit(limit)


def industry_peers(rows: DataFrame, first: int = 6) -> DataFrame:
    """Listed common peers of each company, itself removed; the first few in list order are its competitors.

    Only the first few are ranked (a limited window keeps no more per task), then joined back to the whole list."""
    listed = rows.where(F.col("exchange").isin("KOSPI", "KOSDAQ") & (F.col("peer") != F.col("company")))
    one = listed.groupBy("company", "peer").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("company").orderBy("pos", "peer")
    top = one.withColumn("peer_rank", F.row_number().over(order)).where(F.col("peer_rank") <= first).select("company", "peer", "peer_rank")
    return one.join(top, ["company", "peer"], "left").withColumn("is_competitor", F.col("peer_rank").isNotNull())


def agreed_exchange(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exchange two sources agree on; one alone is taken, a conflict is unknown."""
    joined = a.select("ticker", F.col("exchange").alias("xa")).join(b.select("ticker", F.col("exchange").alias("xb")), "ticker", "full")
    conflict = F.col("xa").isNotNull() & F.col("xb").isNotNull() & (F.col("xa") != F.col("xb"))
    return joined.select("ticker", F.when(~conflict, F.coalesce("xa", "xb")).alias("exchange"), conflict.alias("conflict"))


def reference_metrics(rows: DataFrame) -> DataFrame:
    """Number, unit and role of vendor key figures such as '12.3배' or '1,234원'."""
    number = F.regexp_replace(F.regexp_extract("text", r"(-?\d[\d,]*(\.\d+)?)", 1), ",", "").try_cast("double")
    unit = F.regexp_extract("text", r"-?\d[\d,]*(?:\.\d+)?\s*(\D*)$", 1)
    role = F.when(F.col("code").rlike("(?i)^cns|consensus|추정"), "consensus").when(F.col("code").rlike("(?i)per|pbr|eps|bps"), "valuation").otherwise("other")
    return rows.withColumns({"number": number, "unit": F.trim(unit), "role": role})


def valid_quotes(quotes: DataFrame, cutoff: Column) -> DataFrame:
    """Positive closes traded by the cutoff; flags a trade on the cutoff's own day in Korea."""
    return (quotes.where((F.col("close") > 0) & F.col("traded_at").isNotNull() & (F.col("traded_at") <= cutoff))
            .withColumn("same_day", kst_date("traded_at") == kst_date(cutoff)))


def required_inputs(evidence: DataFrame, kinds: list[str]) -> DataFrame:
    """(company, input, present, items) for every required kind of evidence."""
    counts = evidence.groupBy("company").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("input"), F.col(k).alias("items")) for k in kinds])).alias("_i")
    return counts.select("company", pairs).select("company", "_i.input", "_i.items", (F.col("_i.items") > 0).alias("present"))


def provider_status(issues: DataFrame) -> DataFrame:
    """Per company and provider, and overall: failed on an error without data, partial on any issue, else complete."""
    err, warn = F.sum(F.when(F.col("severity") == "error", 1).otherwise(0)), F.sum(F.when(F.col("severity") == "warning", 1).otherwise(0))
    rows = issues.groupingSets([["company", "provider"], ["company"]], "company", "provider").agg(
        err.alias("errors"), warn.alias("warnings"), F.max("items").alias("items"))
    state = F.when((F.col("errors") > 0) & (F.col("items") == 0), "failed").when(F.col("errors") + F.col("warnings") > 0, "partial").otherwise("complete")
    return rows.withColumns({"provider": F.coalesce("provider", F.lit("overall")), "status": state})


def company_codes(markup: DataFrame) -> DataFrame:
    """Listing code to filer code and name from list markup, valid codes only."""
    item = F.explode(F.regexp_extract_all("markup", F.lit(r"(?s)<list>(.*?)</list>"), F.lit(1))).alias("item")
    rows = markup.select(item)
    field = lambda tag: F.trim(F.regexp_extract("item", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return (rows.select(field("stock_code").alias("ticker"), field("corp_code").alias("corp_code"), field("corp_name").alias("name"))
            .where(F.col("ticker").rlike(TICKER_PATTERN) & F.col("corp_code").rlike(r"^\d{8}$")).dropDuplicates(["ticker"]))


# ---- funding plan from statements ---------------------------------------------------------------------------------

# Account patterns of the funding plan (wanted, excluded), read from 'name id' labels.
ACCOUNTS = {
    "cash": ("BS", r"(^현금및현금성자산\s)|ifrs-full_CashAndCashEquivalents$", None),
    "operating_profit": ("IS", r"^영업이익|OperatingIncomeLoss", None),
    "generated_cash": ("CF", r"영업(으로부터|에서)\s*창출된\s*현금|CashFlowsFromUsedInOperations$|NetCashflowsFromUsedInOperations", None),
    "capex": ("CF", r"^(유형자산|무형자산)의?\s*취득|PurchaseOfPropertyPlantAndEquipment|PurchaseOfIntangibleAssets", r"처분|Proceeds"),
    "depreciation": ("CF", r"감가상각비|무형자산상각비|사용권자산상각비|Depreciation|Amortisation|Amortization", r"처분|손상"),
    "taxes": ("CF", r"법인세.*(납부|지급)|IncomeTaxesPaid", r"환급|Refund(?!Classified)"),
    "interest": ("CF", r"이자.*지급|InterestPaid", r"신종자본|Hybrid"),
    "payouts": ("CF", r"배당금.*지급|DividendsPaid|자기주식.*취득|PurchaseOfTreasuryShares|신종자본.*이자|InterestPaidToHybrid", None),
    "receivables": ("BS", r"^매출채권|TradeAndOtherCurrentReceivables$|CurrentTradeReceivables$", r"장기|NonCurrent|Noncurrent"),
    "inventories": ("BS", r"^재고자산|ifrs-full_Inventories$", r"장기|NonCurrent|Noncurrent"),
    "payables": ("BS", r"^매입채무|TradeAndOtherCurrentPayables$|CurrentTradePayables$", r"장기|NonCurrent|Noncurrent"),
}
DEBT_ROW = r"차입금|사채|유동성장기부채|Borrowings|BondsIssued"
NOT_DEBT = r"리스|Lease|이자|미지급|충당|대여|자산|Assets|Receivable|전환권|Derivative"
NONCURRENT, CURRENT, LONG = r"비유동|Noncurrent|NonCurrent", r"단기|유동성|유동\s*(차입|사채)|Shortterm|ShortTerm|Current", r"장기|Longterm|LongTerm|^사채|BondsIssued"
TOTAL_ROW = r"합계|총계|총\s*차입|계$"
RESTRICTED_CASH = r"(?i)사용\s*(이\s*)?제한|제한\s*된?\s*(예금|현금|금융)|담보\s*제공.{0,10}(예금|현금)|RestrictedCash|RestrictedDeposit"
CASH_EQUIVALENTS = r"(?i)현금\s*및\s*현금성\s*자산|CashAndCashEquivalents"
PERIOD_QUARTERS = {"Q1": 1, "H1": 2, "Q3": 3, "FY": 4}


def debt_classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Current and non-current debt per statement, or why the rows cannot be classified without double counting."""
    label = F.concat_ws(" ", "account_name", "account_id")
    debt = rows.where((F.col("statement") == "BS") & label.rlike(DEBT_ROW) & ~label.rlike(NOT_DEBT) & F.col("this_term").isNotNull())
    group = Window.partitionBy(*keys)
    cls = F.when(label.rlike(NONCURRENT), "noncurrent").when(label.rlike(CURRENT), "current").when(label.rlike(LONG), "noncurrent")
    others = F.sum("this_term").over(group) - F.col("this_term")
    marked = debt.withColumns({
        "cls": cls, "_dup": (F.col("account_id") != "") & (F.count("*").over(Window.partitionBy(*keys, "account_id")) > 1),
        "_total": (F.col("account_name").rlike(TOTAL_ROW) | F.col("account_id").rlike("ifrs-full_Borrowings$")) & (F.count("*").over(group) > 1),
        "_sum": (F.count("*").over(group) >= 3) & (F.abs(others - F.col("this_term")) < 1), "_bad": (F.col("currency") != "KRW") | (F.col("this_term") < 0)})
    flags = marked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_bad", "_dup", "_total", "_sum")], F.max(F.col("cls").isNull()).alias("_unknown"),
                                      F.sum(F.when(F.col("cls") == "current", F.col("this_term")).otherwise(0.0)).alias("current_debt"),
                                      F.sum(F.when(F.col("cls") == "noncurrent", F.col("this_term")).otherwise(0.0)).alias("noncurrent_debt"))
    reason = (F.when(F.col("_bad"), "unusable_amount").when(F.col("_dup"), "duplicate_account").when(F.col("_total"), "total_beside_detail")
              .when(F.col("_sum"), "row_equals_sum").when(F.col("_unknown"), "unknown_maturity"))
    return flags.select(*keys, "current_debt", "noncurrent_debt", reason.alias("debt_problem"))


def funding_plan(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Opening balances and quarterly run-rate flows per consolidated statement set, or the reason there is none.

    rows: keys, period, pos, statement, account_id, account_name, currency, this_term, this_term_cum, prior_term."""
    label = F.concat_ws(" ", "account_name", "account_id")
    won = rows.where(F.col("currency") == "KRW")
    ytd = F.when((F.col("statement") == "CF") | F.col("period").isin("Q1", "FY"), F.col("this_term")).otherwise(F.col("this_term_cum"))

    def is_account(name):
        statement, wanted, excluded = ACCOUNTS[name]
        place = F.col("statement").isin("IS", "CIS") if statement == "IS" else F.col("statement") == statement
        return place & label.rlike(wanted) & (~label.rlike(excluded) if excluded else F.lit(True))

    def first(name, value):
        return F.min_by(value, F.when(is_account(name), F.col("pos")))

    def total(name):
        return F.sum(F.when(is_account(name), F.abs(F.coalesce(ytd, F.lit(0.0)))))

    wc = {name: first(name, F.col("this_term") - F.col("prior_term")).alias(f"d_{name}") for name in ("receivables", "inventories", "payables")}
    restricted = (F.col("statement") == "BS") & label.rlike(RESTRICTED_CASH)
    inside = restricted & label.rlike(CASH_EQUIVALENTS)
    sums = won.groupBy(*keys).agg(
        F.max("period").alias("period"), first("cash", F.col("this_term")).alias("cash"), first("operating_profit", ytd).alias("op_ytd"),
        first("generated_cash", F.col("this_term")).alias("generated_ytd"), total("capex").alias("capex_ytd"),
        *[F.coalesce(total(n), F.lit(0.0)).alias(f"{n}_ytd") for n in ("depreciation", "taxes", "interest", "payouts")], *wc.values(),
        F.coalesce(F.sum(F.when(inside, F.abs("this_term"))), F.lit(0.0)).alias("restricted_cash"),
        F.max(restricted & ~inside).alias("_unresolved"))
    joined = sums.join(debt_classes(rows, keys), keys, "left")
    n = F.lit(None)
    for period, quarters in PERIOD_QUARTERS.items():
        n = F.when(F.col("period") == period, F.lit(float(quarters))).otherwise(n)
    working = F.col("d_receivables") + F.col("d_inventories") - F.col("d_payables")
    missing = F.col("cash").isNull() | F.col("op_ytd").isNull() | F.col("generated_ytd").isNull() | F.col("capex_ytd").isNull()
    code = (F.when(missing, "FUNDING_STATEMENT_ROWS_MISSING").when(F.col("debt_problem").isNotNull(), "FUNDING_DEBT_ROWS_AMBIGUOUS")
            .when(F.col("_unresolved") | (F.col("cash") < F.col("restricted_cash")), "FUNDING_RESTRICTED_CASH_UNRESOLVED"))
    debt = F.coalesce("current_debt", F.lit(0.0))
    return joined.select(
        *keys, "period", code.alias("unavailable_code"), (F.col("cash") - F.col("restricted_cash")).alias("opening_cash"),
        (debt + F.coalesce("noncurrent_debt", F.lit(0.0))).alias("opening_debt"), (F.col("depreciation_ytd") / n).alias("depreciation"),
        (F.col("capex_ytd") / n).alias("capex"), F.coalesce(working / n, F.lit(0.0)).alias("delta_working_capital"),
        (F.col("taxes_ytd") / n).alias("cash_taxes"), (F.col("interest_ytd") / n).alias("cash_interest"),
        ((F.col("generated_ytd") - F.col("op_ytd") - F.col("depreciation_ytd") + F.coalesce(working, F.lit(0.0))) / n).alias("other_cash_flow"),
        (debt / 4).alias("principal_due"), (F.col("payouts_ytd") / n).alias("payouts"), debt.alias("current_debt"))
