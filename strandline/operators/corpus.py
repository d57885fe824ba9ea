"""Text jobs over pages, filings and news. Text is processed whole; the optional caps are the caller's display limits.

Markup is taken apart with JVM regular expressions; Python only decodes entities and balances nested containers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import company_key, decode_entities, kst_date, nfkc, title_key
from strandline.operators.panel import latest_by

# Markup dropped with its content, and markup that ends a line.
DROPPED = r"(?is)<!--.*?-->|<(script|style|noscript|iframe|button)\b.*?</\1>"
BLOCK = r"(?i)</?(?:p|div|br|li|tr|h\d|figure|figcaption|article|section|title)\b[^>]*>"
# Default keyword lists, research firms and figure patterns of market news.
RELEVANT = ("제품", "시장", "점유율", "성장", "업황", "시황", "규모", "전망", "수요", "출하", "공급", "market", "share")
FIRMS = (r"(?i)트렌드포스|TrendForce|옴디아|Omdia|카운터포인트|Counterpoint|IDC|가트너|Gartner|SNE\s*리서치|SNE\s*Research|테크인사이츠|TechInsights|욜|Yole|WSTS|SEMI"
         r"|스트래티지\s*애널리틱스|Strategy\s*Analytics|마크라인즈|MarkLines|프리시던스|Precedence|포춘\s*비즈니스|Fortune\s*Business|마켓츠앤마켓츠|MarketsandMarkets"
         r"|디스플레이서치|유비리서치|IHS|S&P\s*글로벌|캐널리스|Canalys|시너지\s*리서치|Synergy")
SCORE_PATTERNS = ((FIRMS, 4),
                  (r"(?i)점유율|market\s*share", 2), (r"시장\s*규모|(글로벌|세계|전\s*세계)\s*\S{0,12}\s*(시장\s*)?매출", 2),
                  (r"\d[\d,.]*\s*(조|억|만)?\s*(달러|원|위안|엔)", 1), (r"\d+(\.\d+)?\s*%", 1), (r"\d\s*분기|Q[1-4]", 1))
SHARE_WORDS, GROWTH_WORDS, SIZE_WORDS = r"점유율|점유|market\s*share", r"성장률|cagr|성장", r"시장\s*규모|market\s*size|시장은|시장의\s*크기"
NEWS_SIZE_WORDS = r"(글로벌|세계|전\s*세계|전체|업계)\s*[^\s,.]{0,12}\s*(시장\s*)?(매출|규모|매출액)"
REVENUE_WORDS, VOLUME_WORDS = r"(?i)매출|revenue|금액\s*기준", r"(?i)출하|판매량|수량|물량|대수|units?\b|shipments?|볼륨"
MONEY_PARTS = r"(?i)^(\d[\d,]*(?:\.\d+)?)\s*(조|억|천억|백만|천만|만|천)?\s*(원|달러|USD|US\$|\$|KRW|엔|위안|유로)$"
PERCENT = r"-?\d+(?:\.\d+)?\s*%"
MONEY = r"\d[\d,]*(?:\.\d+)?\s*(?:조|억|천억|백만|천만|만|천)?\s*(?:원|달러|USD|US\$|\$|KRW|엔|위안|유로)"
PERIOD = r"\d{4}\s*년(?:\s*\d\s*분기)?|Q[1-4]\s*\d{4}|\d{4}\s*Q[1-4]|\d\s*분기"
KEYWORD_REACH = 40
# Section categories by heading.
SECTIONS = (("shares", r"주식의\s*총수|발행\s*(할\s*)?주식|주당\s*(순?이익|순?손익|이익|손실)|기본\s*주당|희석|자본금|우선주|비지배\s*지분|자기\s*주식|주식\s*수"),
            ("business", r"사업의\s*(내용|개요)|주요\s*(제품|상품|서비스)|제품.*서비스|매출\s*(및|과)?\s*수주|매출\s*(실적|현황|구성)|시장\s*(점유|규모|현황|의\s*특성)|산업의\s*(특성|현황)|시장점유|경쟁|사업\s*부문|신규\s*사업|판매\s*(현황|조직)?"),
            ("investments", r"타법인\s*(출자|투자)|출자\s*현황|투자\s*현황"), ("capex", r"(?i)시설\s*투자|자본적\s*지출|설비\s*투자|투자\s*계획|CAPEX"),
            ("debt", r"차입금\s*(만기|현황)|만기\s*(도래|구조|일정)|상환\s*일정|채무\s*만기"), ("cashflow", r"현금\s*흐름(표)?"),
            ("committed_financing", r"약정\s*(한도|현황)|신용\s*한도|한도\s*대출|미사용\s*(약정|한도)|자금\s*조달\s*계획"),
            ("restricted_cash", r"사용\s*(이\s*)?제한.{0,6}(예금|현금)|제한\s*된?\s*(예금|현금)"))
UNIT_NEAR = r"단위\s*[:：]\s*([^)\]\n|]{1,30})"
# Names that are table furniture, not products.
NOT_PRODUCT = r"^(합\s*계|총\s*계|소\s*계|계|기타|구분|합계|해당\s*없음|-)$"
GENERIC_PRODUCT = r"^(기타|상품|제품|서비스|용역|임대|합계|소계|내수|수출|해외|국내|공통|구분|계$)"
# Selection budgets of the evidence documents of one company.
TOTAL_CHARS, DOC_CHARS, MIN_ROOM, MAX_DOCS, MAX_NEWS = 90_000, 20_000, 200, 60, 12
KIND_SHARE = {"quote": 0.05, "statement": 0.25, "derived": 0.08, "disclosure": 0.05, "competitor": 0.07,
              "filing_text": 0.21, "filing_tables": 0.08, "reference": 0.05, "news": 0.16}


def lines_of(markup: Column) -> Column:
    """Non-empty single-spaced lines of a piece of markup."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(markup, DROPPED, ""), BLOCK, "\n"), r"<[^>]*>", " ")
    clean = F.transform(F.split(decode_entities(text), "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(clean, lambda s: s != "")


def _balanced(container: str):
    opening = re.compile(rf"<{container}\b[^>]*>", re.I)
    tags = re.compile(rf"<(/?){container}\b[^>]*>", re.I)

    def body(html: str) -> str | None:
        start = opening.search(html or "")
        if not start:
            return None
        depth = 1
        for tag in tags.finditer(html, start.end()):
            depth += -1 if tag.group(1) else 1
            if depth == 0:
                return html[start.end():tag.start()]
        return html[start.end():]

    def run(batches):
        for pdf in batches:
            yield pdf.assign(body=pdf["html"].map(body))

    return run


def articles(pages: DataFrame, container: str = "article", max_chars: int | None = None) -> DataFrame:
    """Readable body of each page's container and its published time. Containers that nest take the Python path."""
    html = F.col("html")
    close = rf"(?is)<{container}\b[^>]*>(.*?)(?:</{container}>|$)"
    flat = F.regexp_extract(html, close, 1)
    nests = flat.rlike(rf"(?i)<{container}\b")
    has = html.rlike(rf"(?i)<{container}\b")
    simple = pages.where(has & ~nests).withColumn("body", flat)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema) + ", body string"
    nested = pages.where(has & nests).mapInPandas(_balanced(container), schema)
    stamp = F.regexp_extract(html, r"""(?i)<meta\b[^>]*article:published_time["'][^>]*content=["']([^"']+)["']""", 1)
    text = F.array_join(lines_of(F.col("body")), "\n")
    shown = text if max_chars is None else F.substring(text, 1, max_chars)
    return (simple.unionByName(nested).withColumns({"text": shown, "published_at": F.when(stamp != "", stamp).try_cast("timestamp")})
            .where(F.col("text") != "").drop("body", "html"))


# ---- news --------------------------------------------------------------------------------------------------------


def dedupe_news(news: DataFrame) -> DataFrame:
    """First item per id, then per title key, within a company."""
    by_id = latest_by(news, ["company", "id"], [-F.col("pos")]).withColumn("title_key", title_key("title"))
    return latest_by(by_id, ["company", "title_key"], [-F.col("pos")])


def recent(news: DataFrame, cutoff: Column, days: int = 365) -> DataFrame:
    age = F.unix_millis(cutoff) - F.unix_millis("published_at")
    return news.where((age >= 0) & (age <= days * 86_400_000))


def mentions(news: DataFrame, names: DataFrame) -> DataFrame:
    """News naming its company; names(company, key) are normalised and joined by company."""
    keys = names.groupBy("company").agg(F.collect_set("key").alias("_keys"))
    hay = company_key(F.concat_ws(" ", "title", "snippet"))
    return (news.join(keys, "company").withColumn("_hay", hay)
            .where(F.exists("_keys", lambda k: F.col("_hay").contains(k))).drop("_keys", "_hay"))


def relevance(words: tuple[str, ...] = RELEVANT, extra: tuple[str, ...] = ()) -> Column:
    hay = F.lower(F.concat_ws(" ", "title", "snippet"))
    parts = [F.when(hay.contains(w.lower()), weight).otherwise(0) for ws, weight in ((words, 1), (extra, 2)) for w in ws]
    return sum(parts, F.lit(0))


def market_score(text: Column, patterns=SCORE_PATTERNS) -> Column:
    return sum((F.when(text.rlike(p), weight).otherwise(0) for p, weight in patterns), F.lit(0))


def top_by_score(rows: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best-scored newest rows of each company."""
    order = Window.partitionBy("company").orderBy(F.desc("score"), F.desc("published_at"), "id")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def consistent_dates(news: DataFrame, cutoff: Column) -> DataFrame:
    """Articles not stamped after the cutoff and of the same Korean day as their listing."""
    known = F.col("article_at").isNotNull()
    return news.where(~known | ((F.col("article_at") <= cutoff) & (kst_date("article_at") == kst_date("published_at"))))


# ---- filings ------------------------------------------------------------------------------------------------------


def sections(pages: DataFrame, heading: str = "h[1-6]|title", categories=SECTIONS) -> DataFrame:
    """Sections by heading with their category and their number `n` among the document's sections of it."""
    cut = F.split(F.regexp_replace("html", DROPPED, ""), rf"(?i)(?=<(?:{heading})\b)")
    parts = pages.select("page_id", F.posexplode(cut).alias("pos", "part"))
    title = F.array_join(lines_of(F.regexp_extract("part", rf"(?is)^<(?:{heading})\b[^>]*>(.*?)</", 1)), " ")
    body = F.regexp_replace("part", rf"(?is)^<(?:{heading})\b[^>]*>.*?</(?:{heading})>", "")
    kind = F.lit(None)
    for name, pattern in reversed(categories):
        kind = F.when(F.col("title").rlike(pattern), name).otherwise(kind)
    rows = parts.withColumns({"title": title, "body": body}).withColumn("category", kind).where(F.col("category").isNotNull())
    order = Window.partitionBy("page_id", "category").orderBy("pos")
    return rows.withColumn("n", F.row_number().over(order)).withColumn("text", F.array_join(lines_of(F.col("body")), "\n")).drop("part")


def unit_near(*texts: Column) -> Column:
    """The unit named in the first of the texts that names one, null where none does."""
    found = [F.trim(F.regexp_replace(F.regexp_extract(t, UNIT_NEAR, 1), r"\s+", " ")) for t in texts]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def table_rows(sections_: DataFrame, max_rows: int | None = None) -> DataFrame:
    """(page_id, pos, table_no, row_no, cells) of the tables and lists in each section body."""
    tables = sections_.select("page_id", "pos", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<(?:table|ul|ol)\b[^>]*>(.*?)</(?:table|ul|ol)>"), F.lit(1))).alias("table_no", "inner"))
    rows = tables.select("page_id", "pos", "table_no", F.posexplode(F.regexp_extract_all("inner", F.lit(r"(?is)<(?:tr|li)\b[^>]*>(.*?)</(?:tr|li)>"), F.lit(1))).alias("row_no", "row"))
    raw = F.when(F.col("row").rlike(r"(?i)<t[dhe]\b"), F.regexp_extract_all("row", F.lit(r"(?is)<t[dhe]\b[^>]*>(.*?)</t[dhe]>"), F.lit(1))).otherwise(F.array("row"))
    out = rows.withColumn("_raw", raw).withColumn("cells", F.transform("_raw", lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))))
    kept = out.where(F.exists("cells", lambda c: c != "")).select("page_id", "pos", "table_no", "row_no", "cells")
    return kept if max_rows is None else kept.where(F.col("row_no") < max_rows)


def table_lines(rows: DataFrame) -> DataFrame:
    """Each table as one line, cells joined by ' | ' and rows by ' / '."""
    line = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    packed = F.sort_array(F.collect_list(F.struct("row_no", line.alias("line"))))
    return rows.groupBy("page_id", "pos", "table_no").agg(F.array_join(F.transform(packed, lambda s: s.line), " / ").alias("text"))


# ---- figures -----------------------------------------------------------------------------------------------------


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sentences of more than five characters with their position."""
    cut = F.split(F.regexp_replace(text, r"([.!?。])\s+", "$1\n"), "\n")
    rows = docs.select("doc_id", F.posexplode(cut).alias("sent_no", "sentence"))
    clean = rows.withColumn("sentence", F.trim(F.regexp_replace("sentence", r"\s+", " ")))
    return clean.where(F.length("sentence") > 5)


def _last_start(text: Column, words: str) -> Column:
    """Start of the last keyword in a text, -1 without one."""
    greedy = rf"(?is)^(.*)(?:{words})"
    return F.when(text.rlike(rf"(?i){words}"), F.length(F.regexp_extract(text, greedy, 1))).otherwise(-1)


def metric_candidates(sents: DataFrame, value: str = PERCENT, share: str = SHARE_WORDS, growth: str = GROWTH_WORDS) -> DataFrame:
    """Values attributed to the nearest keyword in the 40 characters before them, with the fields of a figure."""
    usable = sents.where(F.col("sentence").rlike(rf"(?i){share}|{growth}") & F.col("sentence").rlike(value))
    cut = usable.withColumns({"_seg": F.split("sentence", value), "_val": F.regexp_extract_all("sentence", F.lit(f"({value})"), F.lit(1))})
    ks = F.sequence(F.lit(0), F.size("_val") - 1)

    def before(k):
        pieces = F.zip_with(F.slice("_seg", 1, k + 1), F.concat(F.slice("_val", 1, k), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.array_join(pieces, "")

    hits = cut.select("doc_id", "sent_no", "sentence", F.explode(F.transform(ks, lambda k: F.struct(
        k.alias("k"), F.get("_val", k).alias("raw"), before(k).alias("before")))).alias("m")).select("doc_id", "sent_no", "sentence", "m.*")
    window = F.when(F.length("before") > KEYWORD_REACH, F.substring("before", -KEYWORD_REACH, KEYWORD_REACH)).otherwise(F.col("before"))
    placed = hits.withColumn("_w", window).withColumns({"_s": _last_start(F.col("_w"), share), "_g": _last_start(F.col("_w"), growth)})
    return (placed.where((F.col("_s") >= 0) | (F.col("_g") >= 0))
            .withColumn("kind", F.when(F.col("_s") > F.col("_g"), "market_share").otherwise("growth_rate"))
            .transform(lambda d: figure_fields(d, F.regexp_replace(F.regexp_replace("raw", "[%,]", ""), r"\s+", ""), F.lit("%"), F.lit(None).cast("string"),
                                               F.when(F.col("kind") == "market_share", measure(F.col("sentence")))))
            .drop("before", "_w", "_s", "_g"))


def figure_fields(rows: DataFrame, number: Column, unit: Column, scale: Column, measured: Column) -> DataFrame:
    """Add label (the text before a figure), value, unit, scale, measure, basis, period hint and the firm a sentence cites."""
    s = F.col("sentence")
    label = F.trim(F.when(F.length("before") > KEYWORD_REACH, F.substring("before", -KEYWORD_REACH, KEYWORD_REACH)).otherwise(F.col("before")))
    some = lambda c: F.when(c != "", c)
    return rows.withColumns({"label": label, "value": number.try_cast("double"), "unit": unit, "scale": scale,
                             "measure": measured, "basis": basis(s), "period_hint": some(F.regexp_extract(s, PERIOD, 0)), "cites": some(F.regexp_extract(s, FIRMS, 0))})


def basis(s: Column) -> Column:
    """A quarterly wording is year on year only with "the same period of last year" or YoY."""
    quarter, same = s.rlike(r"(?i)분기|quarter|QoQ|Q[1-4]"), s.rlike(r"(?i)전년\s*동기|YoY")
    yoy, annual = s.rlike(r"(?i)전년\s*(동기)?\s*대비|YoY"), s.rlike(r"(?i)연간|연평균|연도별|annual|yearly|per\s*year|CAGR")
    return F.when(quarter & same, "yoy").when(quarter, "quarterly").when(yoy, "yoy").when(annual, "annual").otherwise("unspecified")


def measure(s: Column) -> Column:
    revenue, volume = s.rlike(REVENUE_WORDS), s.rlike(VOLUME_WORDS)
    return F.when(revenue == volume, "unspecified").when(revenue, "revenue").otherwise("volume")


def market_sizes(sents: DataFrame, money: str = MONEY, words: str = SIZE_WORDS, parts: str = MONEY_PARTS, news: bool = False) -> DataFrame:
    """Money amounts in sentences about market size, with the fields of a figure; news wordings of a market total if `news`."""
    rows = sents.where(F.col("sentence").rlike(rf"(?i){words}") | (F.col("sentence").rlike(NEWS_SIZE_WORDS) if news else F.lit(False)))
    cut = rows.withColumns({"_seg": F.split("sentence", money), "_val": F.regexp_extract_all("sentence", F.lit(f"({money})"), F.lit(1))})
    before = lambda k: F.array_join(F.zip_with(F.slice("_seg", 1, k + 1), F.concat(F.slice("_val", 1, k), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    hits = cut.where(F.size("_val") > 0).select("doc_id", "sent_no", "sentence", F.explode(F.transform(F.sequence(F.lit(0), F.size("_val") - 1), lambda k: F.struct(
        k.alias("k"), F.get("_val", k).alias("raw"), before(k).alias("before")))).alias("m")).select("doc_id", "sent_no", "sentence", "m.*")
    part = lambda i: F.regexp_extract("raw", parts, i)
    some = lambda c: F.when(c != "", c)
    return figure_fields(hits.withColumn("kind", F.lit("market_size")), F.regexp_replace(part(1), ",", ""), some(part(3)), some(part(2)),
                         F.lit(None).cast("string")).drop("before")


def assemble_metrics(metrics: DataFrame, per_item: int | None = None, total: int | None = None) -> DataFrame:
    """Distinct figures with their number in the document (`item_rank`) and in the company (`rank`), newest documents first; cut
    where the caller asks."""
    same = Window.partitionBy("company", "doc_id", "kind", "raw", "sentence").orderBy("sent_no", "k")
    one = metrics.withColumn("_same", F.row_number().over(same)).where("_same = 1").drop("_same")
    item = Window.partitionBy("company", "doc_id").orderBy("sent_no", "kind", "k")
    whole = Window.partitionBy("company").orderBy(F.desc("published_at"), "doc_id", "sent_no", "kind", "k")
    rows = one.withColumn("item_rank", F.row_number().over(item))
    rows = rows if per_item is None else rows.where(F.col("item_rank") <= per_item)
    rows = rows.withColumn("rank", F.row_number().over(whole))
    return rows if total is None else rows.where(F.col("rank") <= total)


def product_candidates(rows: DataFrame, header: str = "품목|제품|상품|서비스") -> DataFrame:
    """Names under the product column of each table (the first column without such a header)."""
    key = ["page_id", "pos", "table_no"]
    heads = rows.groupBy(*key).agg(F.min_by("cells", "row_no").alias("_h"), F.min("row_no").alias("_first"))
    column = F.array_position(F.transform("_h", lambda c: c.rlike(header)), True)
    picked = rows.join(heads, key).where(F.col("row_no") > F.col("_first")).withColumn("name", F.get("cells", F.greatest(column.cast("int") - 1, F.lit(0))))
    good = (F.length("name").between(2, 40) & F.col("name").rlike(r"\p{L}") & ~F.col("name").rlike(NOT_PRODUCT) & ~F.col("name").rlike(r"^[\d,.\s%()-]+$"))
    return picked.where(good).select("page_id", "name").withColumn("key", F.lower("name")).dropDuplicates(["page_id", "key"])


def clean_product_names(rows: DataFrame, keep: int | None = None) -> DataFrame:
    """Search-ready product names: lists split, segment suffixes dropped, generic words refused; first N distinct."""
    parts = rows.select("company", "pos", F.posexplode(F.split("name", r"[,，·ㆍ/]")).alias("part_no", "part"))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(nfkc(F.col("part")), r"\s*등\s*$", ""), r"\s+", " "))
    named = parts.withColumn("name", F.trim(F.regexp_replace(tidy, r"\s*(사업)?(부문|사업부)$", "")))
    squeezed = F.regexp_replace("name", r"\s+", "")
    good = named.where(F.length("name").between(2, 20) & (F.size(F.split("name", " ")) <= 3) & ~squeezed.rlike(GENERIC_PRODUCT))
    first = good.withColumn("key", F.lower("name")).groupBy("company", "key").agg(F.min(F.struct("pos", "part_no", "name")).alias("_f"))
    order = Window.partitionBy("company").orderBy("_f.pos", "_f.part_no")
    ranked = first.withColumn("rank", F.row_number().over(order)).select("company", "rank", "_f.name")
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


# Search templates.
COMPANY_TEMPLATES, PRODUCT_TEMPLATES = ("%s 전망", "%s 성장률", "%s 시장 점유율"), ("%s 세계 시장 규모", "%s 점유율 매출 분기")


def expand_queries(companies: DataFrame, products: DataFrame) -> DataFrame:
    def fill(df, templates, source):
        texts = F.array(*[F.format_string(t, "name") for t in templates])
        return df.select("company", F.lit(source).alias("source"), F.explode(texts).alias("query"))

    return fill(companies, COMPANY_TEMPLATES, "company").unionByName(fill(products, PRODUCT_TEMPLATES, "product"))


# ---- selection ----------------------------------------------------------------------------------------------------


def _once(value: Column, use) -> Column:
    """`use(value)` with `value` computed once a row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def focus_article(text: Column, limit: int, figure: str, number: str) -> Column:
    """Lead and figure paragraphs, best first while they fit under `limit`, in original order.

    Paragraphs are split and chosen once a text: at most `limit` of them are kept, so its cost follows its length."""
    def taken(paragraphs: Column) -> Column:
        ranked = F.transform(paragraphs, lambda p, i: F.struct(
            (-(F.when(i == 0, 3).otherwise(0) + F.when(p.rlike(figure), 1).otherwise(0) + F.when(p.rlike(number), 1).otherwise(0))).alias("r"),
            i.alias("i"), F.length(p).alias("n")))
        order = F.array_sort(F.filter(ranked, lambda x: x.r < 0))
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("keep"))
        fill = F.aggregate(order, start, lambda acc, x: F.when(acc.used + x.n + 1 > limit, acc).otherwise(
            F.struct((acc.used + x.n + 1).alias("used"), F.concat(acc.keep, F.array(x.i)).alias("keep"))))
        return F.sort_array(fill.keep)

    def joined(paragraphs: Column) -> Column:
        return F.array_join(F.transform(taken(paragraphs), lambda i: F.get(paragraphs, i)), "\n")

    kept = _once(F.filter(F.split(text, "\n"), lambda p: p != ""), joined)
    focused = _once(kept, lambda k: F.when(k != "", k).otherwise(F.substring(text, 1, limit)))
    return F.when(F.length(text) <= limit, text).otherwise(focused)


def fair_level(demands: Column, limit: Column) -> Column:
    """Water level: each category gets its demand up to an equal share of what the smaller ones leave."""
    ordered = F.array_sort(demands)
    n = F.size(ordered)
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("level"))
    end = F.aggregate(ordered, start, lambda acc, d: F.when(acc.level.isNotNull(), acc).when(
        d <= (limit - acc.used) / (n - acc.k), F.struct((acc.used + d).alias("used"), (acc.k + 1).alias("k"), acc.level.alias("level")))
        .otherwise(F.struct(acc.used.alias("used"), acc.k.alias("k"), ((limit - acc.used) / (n - acc.k)).alias("level"))))
    return F.coalesce(end.level, F.array_max(ordered))


# Fixed value: what a cut statement ends with.
TRUNCATED = "\n[TRUNCATED]"


def fitting_lines(lines: Column, budget: Column) -> Column:
    """Lines in order as long as each, with its line end, fits what is left of the budget: one too long is left out, a shorter one
    after it may still fit."""
    start = F.struct(budget.cast("double").alias("left"), F.array().cast("array<string>").alias("kept"))
    return F.aggregate(lines, start, lambda acc, line: F.when(F.length(line) + 1 <= acc.left, F.struct(
        (acc.left - F.length(line) - 1).alias("left"), F.concat(acc.kept, F.array(line)).alias("kept"))).otherwise(acc), lambda acc: acc.kept)


def truncate_statement(head: Column, categories: list[Column], limit: Column) -> Column:
    """(text, truncated, omitted) of a statement: whole if it fits the limit, else its head and, per category (an array of lines, null
    as empty), the lines that fit the category's share by water-filling, with a mark at the end. A head beyond the limit is cut."""
    head = F.coalesce(head, F.lit(""))
    categories = [F.coalesce(c, F.array().cast("array<string>")) for c in categories]
    full = F.array_join(F.concat(F.array(head), *categories), "\n")
    room = F.greatest(F.lit(0), limit - len(TRUNCATED))
    kept_head = F.when(F.length(head) <= room, head).otherwise(F.substring(head, F.lit(1), room))
    demands = [F.aggregate(c, F.lit(0.0), lambda acc, line: acc + F.length(line) + 1) for c in categories]
    level = fair_level(F.filter(F.array(*demands), lambda d: d > 0), room - F.length(kept_head))
    kept = [fitting_lines(c, F.least(d, level)) for c, d in zip(categories, demands)]
    text = F.concat(F.array_join(F.concat(F.array(kept_head), *kept), "\n"), F.lit(TRUNCATED))
    size = lambda arrays: sum((F.size(a) for a in arrays), F.lit(0))
    whole = F.struct(full.alias("text"), F.lit(False).alias("truncated"), F.lit(0).alias("omitted"))
    return F.when(F.length(full) <= limit, whole).otherwise(F.struct(
        F.substring(text, F.lit(1), limit).alias("text"), F.lit(True).alias("truncated"), (size(categories) - size(kept)).alias("omitted")))


def statement_row_budget(rows: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Row caps per statement document and category, funding rows first."""
    cap = F.lit(0)
    for category, n in budgets.items():
        cap = F.when(F.col("category") == category, n).otherwise(cap)
    order = Window.partitionBy("doc_id", "category").orderBy(F.desc("is_funding"), "pos")
    return rows.withColumn("n", F.row_number().over(order)).where((F.col("n") <= max(budgets.values())) & (F.col("n") <= cap))


def evidence_rank(docs: DataFrame, metrics: DataFrame, words: tuple[str, ...], keep: int | None = None) -> DataFrame:
    """A company's documents with their `rank`, by figure score (sizes 3, shares 3) plus keyword coverage, newest first."""
    fig = metrics.groupBy("doc_id").agg((F.max(F.when(F.col("kind") == "market_size", 3).otherwise(0))
                                         + F.max(F.when(F.col("kind") == "market_share", 3).otherwise(0))).alias("_f"))
    covered = sum((F.when(F.col("text").contains(w), 1).otherwise(0) for w in words), F.lit(0))
    order = Window.partitionBy("company").orderBy(F.desc("score"), F.desc("published_at"), "doc_id")
    ranked = (docs.join(fig, "doc_id", "left").withColumn("score", F.coalesce("_f", F.lit(0)) + covered)
              .withColumn("rank", F.row_number().over(order)).drop("_f"))
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


SELECTED = "company string, doc_id long, kind string, priority long, chars int, truncated boolean, round int"
CUT_ROOM = 14  # fixed value: what a cut text leaves of its limit for the mark
REASONS = ("document_count_cap", "news_cap", "character_budget")  # fixed values
SPREAD = 32  # parts of one company's candidates while they meet its ledger


def select_documents(cands: DataFrame, total_chars: int = TOTAL_CHARS, doc_chars: int = DOC_CHARS, max_docs: int = MAX_DOCS,
                     max_news: int = MAX_NEWS, shares: dict[str, float] | None = None) -> DataFrame:
    """Budgeted choice per company: a guaranteed share per kind first (round 1), leftovers in priority order (round 2).

    A text beyond its limit is cut and marked; `chars` is its length with the mark. `priority` is a whole number, ties go by
    id and kind; a null text counts as empty. Within a kind the admitted documents are always a priority prefix of at most
    `max_docs`, so only that prefix (its lengths, not its text) reaches the sequential step: kinds x max_docs rows per
    company, whatever the corpus."""
    shares = shares or KIND_SHARE
    prefix = Window.partitionBy("company", "kind").orderBy("priority", "doc_id")
    short = (cands.select("company", "doc_id", "kind", F.col("priority").cast("long").alias("priority"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
             .withColumn("_r", F.row_number().over(prefix)).where(F.col("_r") <= max_docs))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used, by_kind, news, out, later = 0, {}, 0, [], []
        rows = list(pdf.sort_values(["priority", "doc_id", "kind"]).itertuples(index=False))

        def admit(row, room, in_round):
            nonlocal used, news
            limit = min(doc_chars, room)
            cut = row.n > limit
            chars = int(limit - CUT_ROOM) + len(TRUNCATED) if cut else int(row.n)
            used += chars
            by_kind[row.kind] = by_kind.get(row.kind, 0) + chars
            news += row.kind == "news"
            out.append((row.company, row.doc_id, row.kind, row.priority, chars, cut, in_round))

        for in_round, queue in ((1, rows), (2, later)):
            for row in queue:
                if len(out) >= max_docs or (row.kind == "news" and news >= max_news):
                    continue
                room = total_chars - used
                if in_round == 1:
                    room = min(room, total_chars * shares.get(row.kind, 0.0) - by_kind.get(row.kind, 0))
                if room >= MIN_ROOM:
                    admit(row, room, in_round)
                elif in_round == 1:
                    later.append(row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in SELECTED.split(", ")])

    return short.groupBy("company").applyInPandas(choose, SELECTED)


def selected_texts(cands: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen documents with the text that is passed on: whole, or cut to `chars` with the mark at its end."""
    picked = chosen.select("company", "doc_id", "kind", "chars", "truncated")
    text = F.when(F.col("truncated"), F.concat(F.substring("text", F.lit(1), F.col("chars") - len(TRUNCATED)), F.lit(TRUNCATED))).otherwise(F.col("text"))
    return cands.join(picked, ["company", "doc_id", "kind"]).withColumn("text", text)


def omission_reasons(cands: DataFrame, chosen: DataFrame, max_docs: int = MAX_DOCS, max_news: int = MAX_NEWS) -> DataFrame:
    """Every candidate (company, doc_id, kind, published_at) with its `chars` if chosen, else the `reason` of its omission.

    A cap shuts at the document that fills it, so one row per company tells every reason: the last admitted place of each
    round, for all documents and for news. A document behind the place at which round 1 filled a cap meets that cap; any other
    is put off to round 2, where it meets a cap filled before it, else the spent budget. No candidate list is walked."""
    place = F.struct(F.col("priority").cast("long").alias("p"), F.col("doc_id").cast("long").alias("d"), F.col("kind").alias("k"))
    ledger = chosen.groupBy("company").agg(*[
        f(F.when(cond & (F.col("round") == r), x)).alias(f"{name}_{what}{r}")
        for name, cond in (("all", F.lit(True)), ("news", F.col("kind") == "news")) for r in (1, 2)
        for what, f, x in (("n", F.count, F.lit(1)), ("last", F.max, place))])
    ledger = ledger.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = (cands.select("company", "doc_id", "kind", "published_at", place.alias("at"), F.pmod(F.xxhash64("doc_id", "kind"), F.lit(SPREAD)).cast("int").alias("part"))
            .join(chosen.select("company", "doc_id", "kind", "chars"), ["company", "doc_id", "kind"], "left").join(ledger, ["company", "part"], "left"))

    def shut(name: str, cap: int):
        n1, n2 = (F.coalesce(f"{name}_n{r}", F.lit(0)) for r in (1, 2))
        behind = lambda r: F.coalesce(F.col("at") > F.col(f"{name}_last{r}"), F.lit(True))
        return (n1 >= cap) & behind(1), (n1 >= cap) | ((n1 + n2 >= cap) & behind(2))

    (all1, all2), (news1, news2) = shut("all", max_docs), shut("news", max_news)
    news = F.col("kind") == "news"
    reason = F.when(all1, REASONS[0]).when(news & news1, REASONS[1]).when(all2, REASONS[0]).when(news & news2, REASONS[1]).otherwise(REASONS[2])
    return rows.select("company", "doc_id", "kind", "published_at", "chars", F.when(F.col("chars").isNull(), reason).alias("reason"))


def evidence_inventory(cands: DataFrame, chosen: DataFrame, max_docs: int = MAX_DOCS, max_news: int = MAX_NEWS) -> DataFrame:
    """Per company and kind: documents, newest date, chosen, characters, omitted, and the omitted by reason."""
    return (omission_reasons(cands, chosen, max_docs, max_news).groupBy("company", "kind").agg(
        F.count("*").alias("documents"), F.max("published_at").alias("newest"), F.count("chars").alias("chosen"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count("reason").alias("omitted"),
        *[F.count(F.when(F.col("reason") == r, 1)).alias(f"omitted_{r}") for r in REASONS]))


def evidence_documents(parts: list[DataFrame]) -> DataFrame:
    """Union of (company, doc_id, kind, title, url, published_at, text) parts; rows without text, date or url are dropped."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return (out.where((F.coalesce("text", F.lit("")) != "") & F.col("published_at").isNotNull() & F.col("url").rlike("^https?://"))
            .dropDuplicates(["company", "kind", "doc_id"]))
