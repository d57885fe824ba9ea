"""Corpus and grounding queries over documents, pages, orders and parts. The prose is invented, so keyword lists are
parameters made of words that occur in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import corpus as co
from strandline.operators import grounding as gr
from strandline.operators import markup as mk

from strandline.functions.scalar import format_quarter, quarter_index
from strandline.plans import valuing as vl
from strandline.operators import valuation as va
from strandline.plans.registry import ctes, query, rounded, sql_rnd, table

CUTOFF = "2025-06-30 00:00:00"
WORDS, EXTRA = ("the", "que", "der", "los"), ("license",)
SHARE, GROWTH, NUMBER = "the|de|la", "of|que|und", r"\d+"


def news(spark, sf) -> DataFrame:
    """Documents as news of their source; titles are first lines, dates follow the id."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("company"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("snippet"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 700).cast("int"))).alias("published_at"))


SQL_NEWS = """
news AS (SELECT source AS company, doc_id AS id, split_part(text, chr(10), 1) AS title, text AS snippet, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 AS INTEGER)) AS published_at FROM documents)
"""


@query("news_dedupe", ctes(SQL_NEWS) + r"SELECT company, min(id) AS id FROM news GROUP BY company, regexp_replace(lower(title), '[^\p{L}\p{N}]+', '', 'g')")
def news_dedupe(spark, sf):
    return co.dedupe_news(news(spark, sf)).select("company", "id")


@query("news_recent", ctes(SQL_NEWS) + f"SELECT company, id FROM news WHERE published_at <= TIMESTAMP '{CUTOFF}' AND epoch_ms(TIMESTAMP '{CUTOFF}') - epoch_ms(published_at) <= CAST(365 AS BIGINT) * 86400000")
def news_recent(spark, sf):
    return co.recent(news(spark, sf), F.lit(CUTOFF).cast("timestamp")).select("company", "id")


@query("news_mentions", ctes(SQL_NEWS) + r"SELECT company, id FROM news WHERE regexp_replace(lower(title || ' ' || snippet), '\s+', '', 'g') LIKE '%theand%' OR contains(regexp_replace(lower(title || ' ' || snippet), '\s+', '', 'g'), company || '-llc')")
def news_mentions(spark, sf):
    sources = table(spark, sf, "documents").select(F.col("source").alias("company")).distinct()
    names = sources.select("company", F.explode(F.array(F.lit("theand"), F.concat("company", F.lit("-llc")))).alias("key"))
    return co.mentions(news(spark, sf), names).select("company", "id")


_HAY = "lower(title || ' ' || snippet)"
_SCORE = " + ".join([f"CASE WHEN contains({_HAY}, '{w}') THEN 1 ELSE 0 END" for w in WORDS] + [f"CASE WHEN contains({_HAY}, '{w}') THEN 2 ELSE 0 END" for w in EXTRA])


@query("news_top", ctes(SQL_NEWS) + f"SELECT company, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY score DESC, published_at DESC, id) AS rank FROM (SELECT *, {_SCORE} AS score FROM news)) WHERE rank <= 5")
def news_top(spark, sf):
    return co.top_by_score(news(spark, sf), co.relevance(WORDS, EXTRA), 5).select("company", "id", "score", "rank")


@query("market_score", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\blicense\b|gnu') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '\d+(\.\d+)?') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, 'the\s+of') THEN 2 ELSE 0 END AS score FROM documents")
def market_score(spark, sf):
    patterns = ((r"(?i)\blicense\b|gnu", 4), (r"\d+(\.\d+)?", 1), (r"the\s+of", 2))
    return table(spark, sf, "documents").select("doc_id", co.market_score(F.col("text"), patterns).alias("score"))


@query("news_consistent_dates", ctes(SQL_NEWS) + f"SELECT id FROM news WHERE published_at + to_hours(CAST(id % 30 AS INTEGER)) <= TIMESTAMP '{CUTOFF}' AND CAST(published_at + to_hours(CAST(9 + id % 30 AS INTEGER)) AS DATE) = CAST(published_at + INTERVAL 9 HOURS AS DATE)")
def news_consistent_dates(spark, sf):
    rows = news(spark, sf).withColumn("article_at", F.col("published_at") + F.make_dt_interval(hours=(F.col("id") % 30).cast("int")))
    return co.consistent_dates(rows, F.lit(CUTOFF).cast("timestamp")).select("id")


# ---- pages -------------------------------------------------------------------------------------------------------

_DROP = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<iframe\b.*?</iframe>|<button\b.*?</button>"
_BLOCK = r"(?i)</?(?:p|div|br|li|tr|h\d|figure|figcaption|article|section|title)\b[^>]*>"


def sql_lines(markup: str) -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace({markup}, '{_DROP}', '', 'g'), '{_BLOCK}', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    text = f"replace(replace(replace(replace(replace(replace(replace({text}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"


@query("page_articles", f"SELECT page_id, url, CAST(NULL AS TIMESTAMP) AS published_at, array_to_string({sql_lines('body')}, chr(10)) AS text FROM (SELECT *, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)(?:</article>|$)', 1) AS body FROM pages) WHERE len({sql_lines('body')}) > 0")
def page_articles(spark, sf):
    return co.articles(table(spark, sf, "pages")).select("page_id", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "text")


SECTION_KINDS = (("long", r"\p{L}{12,}"), ("short", r"."))
_HEAD = r"(?is)<(?:h[1-6]|title)\b[^>]*>(.*?)</"


@query("page_sections", f"""WITH p AS (SELECT page_id, unnest(list_slice(string_split(regexp_replace(regexp_replace(html, '{_DROP}', '', 'g'), '(?i)(<(?:h[1-6]|title)\\b)', chr(1) || '\\1', 'g'), chr(1)), 1, 1000)) AS part, generate_subscripts(string_split(regexp_replace(regexp_replace(html, '{_DROP}', '', 'g'), '(?i)(<(?:h[1-6]|title)\\b)', chr(1) || '\\1', 'g'), chr(1)), 1) - 1 AS pos FROM pages),
t AS (SELECT page_id, pos, array_to_string({sql_lines("regexp_extract(part, '" + _HEAD + "', 1)")}, ' ') AS title FROM p WHERE regexp_matches(part, '(?i)^<(?:h[1-6]|title)\\b')),
c AS (SELECT *, CASE WHEN regexp_matches(title, '\\p{{L}}{{12,}}') THEN 'long' WHEN title <> '' THEN 'short' END AS category FROM t)
SELECT page_id, CAST(pos AS INTEGER) AS pos, title, category, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page_id, category ORDER BY pos) AS n FROM c WHERE category IS NOT NULL)""")
def page_sections(spark, sf):
    return co.sections(table(spark, sf, "pages"), categories=SECTION_KINDS).select("page_id", "pos", "title", "category", "n")


SQL_TABLES = r"""
li AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:table|ul|ol)\b[^>]*>(.*?)</(?:table|ul|ol)>', 1)) AS inner_html, generate_subscripts(regexp_extract_all(html, '(?is)<(?:table|ul|ol)\b[^>]*>(.*?)</(?:table|ul|ol)>', 1), 1) - 1 AS table_no FROM pages),
tr AS (SELECT page_id, table_no, unnest(regexp_extract_all(inner_html, '(?is)<(?:tr|li)\b[^>]*>(.*?)</(?:tr|li)>', 1)) AS r, generate_subscripts(regexp_extract_all(inner_html, '(?is)<(?:tr|li)\b[^>]*>(.*?)</(?:tr|li)>', 1), 1) - 1 AS row_no FROM li),
cell AS (SELECT page_id, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, trim(regexp_replace(regexp_replace(r, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM tr)
"""


def page_bodies(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.lit(0).alias("pos"), F.col("html").alias("body"))


@query("page_table_lines", ctes(SQL_TABLES) + "SELECT page_id, table_no, string_agg(c, ' / ' ORDER BY row_no) AS text FROM cell WHERE c <> '' GROUP BY 1, 2")
def page_table_lines(spark, sf):
    return co.table_lines(co.table_rows(page_bodies(spark, sf))).select("page_id", "table_no", "text")


# Statements of units before the lists of a page: in reach of the list, out of reach behind two more lines, or none.
UNIT_LINES = {0: "<p>(단위 : 백만원)</p>", 1: "<p>(단위: %)</p><p>one</p><p>two</p>"}


def stated_pages(spark, sf) -> DataFrame:
    """Pages with a unit stated before their lists, by page."""
    notes = F.when(F.col("page_id") % 3 == 0, UNIT_LINES[0]).when(F.col("page_id") % 3 == 1, UNIT_LINES[1]).otherwise("")
    return table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<ul"), F.concat(notes, F.lit("<ul"))).alias("html"))


def sql_items(body: str) -> str:
    marked = f"regexp_replace(replace(replace(coalesce({body}, ''), chr(1), ''), chr(2), ''), '(?is)(<(?:table|ul|ol)\\b[^>]*>.*?</(?:table|ul|ol)>)', chr(1) || chr(2) || '\\1' || chr(1), 'g')"
    return f"flatten(list_transform(string_split({marked}, chr(1)), lambda s: CASE WHEN starts_with(s, chr(2)) THEN [s] ELSE {sql_lines('s').replace('lambda s:', 'lambda z:').replace('trim(regexp_replace(s,', 'trim(regexp_replace(z,').replace('z: s <>', 'z: z <>')} END))"


SQL_STATED = f"""
sp AS (SELECT page_id, replace(html, '<ul', CASE page_id % 3 WHEN 0 THEN '{UNIT_LINES[0]}' WHEN 1 THEN '{UNIT_LINES[1]}' ELSE '' END || '<ul') AS html FROM pages)
"""
_CELL = sql_lines("r").replace("lambda s:", "lambda z:").replace("trim(regexp_replace(s,", "trim(regexp_replace(z,").replace("z: s <>", "z: z <>")
_ROWS = f"list_filter(list_transform(regexp_extract_all(item, '(?is)<(?:tr|li)\\b[^>]*>(.*?)</(?:tr|li)>', 1), lambda r: array_to_string({_CELL}, ' ')), lambda c: c <> '')"


def _sql_unit(text: str) -> str:
    return f"nullif(trim(regexp_replace(regexp_extract({text}, '{co.UNIT_NEAR}', 1), '\\s+', ' ', 'g')), '')"


@query("table_units", ctes(SQL_STATED) + f""", p AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, '{_DROP}', '', 'g'), '(?i)(<(?:h[1-6]|title)\\b)', chr(1) || '\\1', 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(regexp_replace(html, '{_DROP}', '', 'g'), '(?i)(<(?:h[1-6]|title)\\b)', chr(1) || '\\1', 'g'), chr(1)), 1) - 1 AS pos FROM sp),
t AS (SELECT page_id, pos, part, array_to_string({sql_lines("regexp_extract(part, '" + _HEAD + "', 1)")}, ' ') AS title FROM p WHERE regexp_matches(part, '(?i)^<(?:h[1-6]|title)\\b')),
c AS (SELECT page_id, pos, CASE WHEN regexp_matches(title, '\\p{{L}}{{12,}}') THEN 'long' ELSE 'short' END AS category, {sql_items("regexp_replace(part, '(?is)^<(?:h[1-6]|title)\\b[^>]*>.*?</(?:h[1-6]|title)>', '')")} AS items FROM t WHERE title <> ''),
i AS (SELECT page_id, pos, category, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS item_no FROM c),
b AS (SELECT *, lag(item, 1) OVER w AS b1, lag(item, 2) OVER w AS b2 FROM i WINDOW w AS (PARTITION BY page_id, pos ORDER BY item_no)),
r AS (SELECT page_id, pos, category, item_no, {_ROWS} AS rs, CASE WHEN NOT starts_with(b1, chr(2)) THEN b1 END AS b1, CASE WHEN NOT starts_with(b2, chr(2)) THEN b2 END AS b2 FROM b WHERE starts_with(item, chr(2))),
u AS (SELECT *, coalesce({_sql_unit("array_to_string(rs, chr(10))")}, {_sql_unit("b1")}, {_sql_unit("b2")}) AS unit, row_number() OVER (PARTITION BY page_id, category ORDER BY pos, item_no) AS table_n FROM r WHERE len(rs) > 0)
SELECT page_id, CAST(pos AS INTEGER) AS pos, category, CAST(item_no AS INTEGER) AS item_no, CAST(table_n AS INTEGER) AS table_n, unit, unnest(rs) AS line, CAST(generate_subscripts(rs, 1) - 1 AS INTEGER) AS row_no FROM u""")
def table_units(spark, sf):
    rows = mk.table_rows(co.sections(stated_pages(spark, sf), categories=SECTION_KINDS))
    return rows.select("page_id", "pos", "category", "item_no", "table_n", "unit", F.array_join("cells", " | ").alias("line"), "row_no")


@query("disclosure_texts", ctes(SQL_STATED) + f""", i AS (SELECT page_id, {sql_items("html")} AS items FROM sp)
SELECT page_id, array_to_string(list_filter(list_transform(items, lambda item: CASE WHEN starts_with(item, chr(2)) THEN array_to_string({_ROWS}, ' / ') ELSE item END), lambda x: x <> ''), chr(10)) AS text FROM i""")
def disclosure_texts(spark, sf):
    return mk.disclosure_text(stated_pages(spark, sf))


@query("product_candidates", ctes(SQL_TABLES) + r"""SELECT DISTINCT page_id, lower(c) AS key FROM (SELECT *, min(row_no) OVER (PARTITION BY page_id, table_no) AS f FROM cell WHERE c <> '') WHERE row_no > f AND length(c) BETWEEN 2 AND 40 AND regexp_matches(c, '\p{L}') AND NOT regexp_matches(c, '^(합\s*계|총\s*계|소\s*계|계|기타|구분|합계|해당\s*없음|-)$')""")
def product_candidates(spark, sf):
    return co.product_candidates(co.table_rows(page_bodies(spark, sf))).select("page_id", "key")


# ---- figures -----------------------------------------------------------------------------------------------------

SQL_SENT = r"""
cut AS (SELECT doc_id, source, string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
sent AS (SELECT * FROM (SELECT doc_id, source, unnest(list_transform(parts, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')))) AS sentence, generate_subscripts(parts, 1) - 1 AS sent_no FROM cut) WHERE length(sentence) > 5)
"""


@query("sentences", ctes(SQL_SENT) + "SELECT doc_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars, CAST(max(sent_no) AS INTEGER) AS last_no FROM sent GROUP BY 1")
def sentences(spark, sf):
    return co.sentences(table(spark, sf, "documents")).groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.sum(F.length("sentence")).alias("chars"), F.max("sent_no").alias("last_no"))


SQL_METRICS = SQL_SENT.strip() + f""",
mv AS (SELECT doc_id, source, sent_no, sentence, regexp_split_to_array(sentence, '{NUMBER}') AS seg, regexp_extract_all(sentence, '{NUMBER}') AS val FROM sent WHERE regexp_matches(sentence, '(?i){SHARE}|{GROWTH}') AND regexp_matches(sentence, '{NUMBER}')),
mk AS (SELECT *, unnest(range(0, len(val))) AS k FROM mv),
mb AS (SELECT doc_id, source, sent_no, sentence, k, val[k + 1] AS raw, right(array_to_string(list_transform(range(0, k + 1), lambda i: seg[i + 1] || CASE WHEN i < k THEN val[i + 1] ELSE '' END), ''), 40) AS w FROM mk),
ms AS (SELECT *, CASE WHEN regexp_matches(w, '(?i){SHARE}') THEN length(regexp_extract(w, '(?is)^(.*)(?:{SHARE})', 1)) ELSE -1 END AS s, CASE WHEN regexp_matches(w, '(?i){GROWTH}') THEN length(regexp_extract(w, '(?is)^(.*)(?:{GROWTH})', 1)) ELSE -1 END AS g FROM mb),
metric AS (SELECT *, CASE WHEN s > g THEN 'market_share' ELSE 'growth_rate' END AS kind FROM ms WHERE s >= 0 OR g >= 0)
"""


SQL_BASIS = """CASE WHEN regexp_matches(sentence, '(?i)분기|quarter|QoQ|Q[1-4]') THEN CASE WHEN regexp_matches(sentence, '(?i)전년\\s*동기|YoY') THEN 'yoy' ELSE 'quarterly' END
  WHEN regexp_matches(sentence, '(?i)전년\\s*(동기)?\\s*대비|YoY') THEN 'yoy' WHEN regexp_matches(sentence, '(?i)연간|연평균|연도별|annual|yearly|per\\s*year|CAGR') THEN 'annual' ELSE 'unspecified' END"""


@query("metric_candidates", ctes(SQL_METRICS) + f"SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, CAST(k AS INTEGER) AS k, raw, kind, trim(w) AS label, TRY_CAST(regexp_replace(raw, '[%,]|\\s', '', 'g') AS DOUBLE) AS value, {SQL_BASIS} AS basis FROM metric")
def metric_candidates(spark, sf):
    return co.metric_candidates(co.sentences(table(spark, sf, "documents")), NUMBER, SHARE, GROWTH).select("doc_id", "sent_no", "k", "raw", "kind", "label", "value", "basis")


@query("metric_assembly", ctes(SQL_METRICS) + """, one AS (SELECT DISTINCT ON (source, doc_id, kind, raw, sentence) source, doc_id, sent_no, k, kind, raw FROM metric ORDER BY source, doc_id, kind, raw, sentence, sent_no, k)
SELECT source AS company, doc_id, CAST(sent_no AS INTEGER) AS sent_no, CAST(k AS INTEGER) AS k, kind, CAST(row_number() OVER (PARTITION BY source, doc_id ORDER BY sent_no, kind, k) AS INTEGER) AS item_rank,
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id % 700 DESC, doc_id, sent_no, kind, k) AS INTEGER) AS rank FROM one""")
def metric_assembly(spark, sf):
    docs = table(spark, sf, "documents")
    found = co.metric_candidates(co.sentences(docs), NUMBER, SHARE, GROWTH)
    dated = found.join(docs.select("doc_id", F.col("source").alias("company"), (F.col("doc_id") % 700).alias("published_at")), "doc_id")
    return co.assemble_metrics(dated).select("company", "doc_id", "sent_no", "k", "kind", "item_rank", "rank")


@query("market_sizes", ctes(SQL_SENT) + f"SELECT doc_id, CAST(sent_no AS INTEGER) AS sent_no, len(regexp_extract_all(sentence, '{NUMBER}')) AS amounts FROM sent WHERE regexp_matches(sentence, '(?i){GROWTH}') AND regexp_matches(sentence, '{NUMBER}')")
def market_sizes(spark, sf):
    return co.market_sizes(co.sentences(table(spark, sf, "documents")), NUMBER, GROWTH).groupBy("doc_id", "sent_no").agg(F.count("*").alias("amounts"))


@query("clean_product_names", r"""WITH p AS (SELECT p_brand AS company, p_partkey AS pos, 1 AS part_no, p_name AS n FROM part UNION ALL SELECT p_brand, p_partkey, 2, p_type FROM part), g AS (SELECT company, lower(n) AS key, min((pos, part_no, n)) AS f FROM p WHERE length(n) BETWEEN 2 AND 20 GROUP BY 1, 2)
SELECT company, CAST(rank AS INTEGER) AS rank, f[3] AS name FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY f[1], f[2]) AS rank FROM g)""".replace("f[3]", "f3").replace("ORDER BY f[1], f[2]", "ORDER BY f1, f2").replace("min((pos, part_no, n)) AS f FROM", "arg_min(n, pos * 10 + part_no) AS f3, min(pos * 10 + part_no) AS f1, 0 AS f2 FROM"))
def clean_product_names(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("company"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" 사업부, "), "p_type", F.lit(" 등")).alias("name"))
    return co.clean_product_names(rows)


@query("expand_queries", """SELECT p_brand AS company, 'company' AS source, p_brand || t AS query FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest([' 전망', ' 성장률', ' 시장 점유율']) AS t) UNION ALL SELECT p_brand, 'product', p_type || t FROM (SELECT DISTINCT p_brand, p_type FROM part), (SELECT unnest([' 세계 시장 규모', ' 점유율 매출 분기']) AS t)""")
def expand_queries(spark, sf):
    part = table(spark, sf, "part")
    return co.expand_queries(part.select(F.col("p_brand").alias("company"), F.col("p_brand").alias("name")).distinct(),
                             part.select(F.col("p_brand").alias("company"), F.col("p_type").alias("name")).distinct())


# ---- selection ---------------------------------------------------------------------------------------------------


@query("focus_articles")
def focus_articles(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", co.focus_article(F.col("text"), 3000, "the|que|der", r"\d").alias("focused"))


@query("fair_truncation", f"""WITH d AS (SELECT source, lang, CAST(sum(n_chars) AS DOUBLE) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY source) AS m, sum(n) OVER (PARTITION BY source) / 2 AS lim, coalesce(sum(n) OVER (PARTITION BY source ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cum FROM d),
l AS (SELECT source, min(k) AS k0 FROM r WHERE n > (lim - cum) / (m - k) GROUP BY 1) SELECT r.source, {sql_rnd('(lim - cum) / (m - k)', 3)} AS level FROM r JOIN l ON r.source = l.source AND r.k = l.k0""")
def fair_truncation(spark, sf):
    d = table(spark, sf, "documents").groupBy("source", "lang").agg(F.sum("n_chars").cast("double").alias("n"))
    per = d.groupBy("source").agg(F.collect_list("n").alias("ds"), (F.sum("n") / 2).alias("lim"))
    return rounded(per.select("source", co.fair_level(F.col("ds"), F.col("lim")).alias("level")), ["source"], ["level"], 3)


_STATUSES, _MARK = ("F", "O", "P"), "chr(10) || '[TRUNCATED]'"
_LINE = "o_orderpriority || ' order ' || o_orderkey || ' ' || repeat('x', CAST(o_orderkey % 37 AS INTEGER))"


@query("truncated_statements", f"""WITH RECURSIVE ln AS (SELECT o_custkey AS k, o_orderstatus AS c, {_LINE} AS t, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS i FROM orders),
h AS (SELECT c_custkey AS k, c_name || ' statement' AS head, CAST(c_custkey % 9 * 90 + 15 AS BIGINT) AS lim FROM customer WHERE c_custkey IN (SELECT k FROM ln)),
f AS (SELECT h.k, head, lim, head || chr(10) || string_agg(t, chr(10) ORDER BY c, i) AS whole, substring(head, 1, lim - 12) AS cut FROM h JOIN ln ON h.k = ln.k GROUP BY 1, 2, 3),
d AS (SELECT ln.k, c, sum(length(t) + 1) AS n, lim - 12 - length(cut) AS room FROM ln JOIN f ON f.k = ln.k WHERE length(whole) > lim GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, c) - 1 AS p, count(*) OVER (PARTITION BY k) AS m, coalesce(sum(n) OVER (PARTITION BY k ORDER BY n, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM d),
lv AS (SELECT k, coalesce(arg_min((room - cum) / (m - p), p) FILTER (WHERE n > (room - cum) / (m - p)), max(n)) AS level FROM r GROUP BY k),
fold(k, c, i, remaining, kept) AS (SELECT d.k, c, CAST(0 AS BIGINT), CAST(least(n, level) AS DOUBLE), CAST([] AS VARCHAR[]) FROM d JOIN lv ON lv.k = d.k
  UNION ALL SELECT fold.k, fold.c, fold.i + 1, CASE WHEN length(t) + 1 <= remaining THEN remaining - length(t) - 1 ELSE remaining END, CASE WHEN length(t) + 1 <= remaining THEN list_append(kept, t) ELSE kept END
  FROM fold JOIN ln ON ln.k = fold.k AND ln.c = fold.c AND ln.i = fold.i + 1),
e AS (SELECT k, c, arg_max(kept, i) AS kept FROM fold GROUP BY 1, 2),
o AS (SELECT k, string_agg(CASE WHEN len(kept) > 0 THEN array_to_string(kept, chr(10)) END, chr(10) ORDER BY c) AS body, sum(len(kept)) AS n FROM e GROUP BY k),
z AS (SELECT k, count(*) AS n FROM ln GROUP BY k)
SELECT f.k AS id, CASE WHEN length(whole) <= lim THEN whole ELSE substring(cut || coalesce(chr(10) || body, '') || {_MARK}, 1, lim) END AS text, length(whole) > lim AS truncated, CASE WHEN length(whole) <= lim THEN 0 ELSE z.n - o.n END AS omitted
FROM f JOIN z ON z.k = f.k LEFT JOIN o ON o.k = f.k""")
def truncated_statements(spark, sf):
    """Orders of a customer as a statement of three categories, cut to a limit."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("c"), F.struct("o_orderkey", F.expr(_LINE).alias("t")).alias("x"))
    lines = o.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("c") == s, F.col("x"))))["t"].alias(s) for s in _STATUSES])
    heads = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" statement")).alias("head"), (F.col("c_custkey") % 9 * 90 + 15).cast("int").alias("lim"))
    cut = co.truncate_statement(F.col("head"), [F.col(s) for s in _STATUSES], F.col("lim"))
    return heads.join(lines, "id").select("id", cut.alias("r")).select("id", "r.text", "r.truncated", F.col("r.omitted").cast("long").alias("omitted"))


KINDS = list(co.KIND_SHARE)


def evidence(spark, sf, company: str = "source") -> DataFrame:
    """Documents as evidence of their source (or another column), kinds by id, in one scan."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    rows = table(spark, sf, "documents").select(
        F.col(company).alias("company"), "doc_id", kind.alias("kind"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id").alias("url"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("published_at"), "text")
    return co.evidence_documents([rows])


def sql_choice(company: str, total: int = co.TOTAL_CHARS) -> str:
    """Both rounds of the choice as one walk over all candidates of a company, a row per visit with its outcome."""
    shares = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in co.KIND_SHARE.values()) + "]"
    zeros = "[" + ", ".join("0" for _ in KINDS) + "]"
    return f"""WITH RECURSIVE cand AS (SELECT {company} AS company, doc_id, text, CAST(doc_id % {len(KINDS)} + 1 AS INTEGER) AS kn, {KINDS}[doc_id % {len(KINDS)} + 1] AS kind, length(text) AS n, DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) AS published_at,
  row_number() OVER (PARTITION BY {company} ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY {company}) AS m FROM documents WHERE text <> ''),
walk(company, i, doc_id, outcome, chars, truncated, used, by_kind, docs, news, later) AS (
  SELECT DISTINCT company, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), CAST({zeros} AS BIGINT[]), 0, 0, CAST([] AS BIGINT[]) FROM cand
  UNION ALL
  SELECT company, i, doc_id, outcome, CASE WHEN outcome = 'admit' THEN take END, n > lim, used + CASE WHEN outcome = 'admit' THEN take ELSE 0 END,
    CASE WHEN outcome = 'admit' THEN list_transform(range(1, {len(KINDS) + 1}), lambda x: by_kind[x] + CASE WHEN x = kn THEN take ELSE 0 END) ELSE by_kind END,
    docs + CASE WHEN outcome = 'admit' THEN 1 ELSE 0 END, news + CASE WHEN outcome = 'admit' AND kind = 'news' THEN 1 ELSE 0 END,
    CASE WHEN outcome = 'later' THEN list_append(later, doc_id) ELSE later END
  FROM (SELECT *, least({co.DOC_CHARS}, room) AS lim, CAST(CASE WHEN n > least({co.DOC_CHARS}, room) THEN floor(least({co.DOC_CHARS}, room) - {co.CUT_ROOM}) + {len(co.TRUNCATED)} ELSE n END AS BIGINT) AS take,
      CASE WHEN second AND NOT list_contains(later, doc_id) THEN 'done' WHEN docs >= {co.MAX_DOCS} THEN 'document_count_cap' WHEN kind = 'news' AND news >= {co.MAX_NEWS} THEN 'news_cap'
        WHEN room >= {co.MIN_ROOM} THEN 'admit' WHEN second THEN 'character_budget' ELSE 'later' END AS outcome
    FROM (SELECT walk.company, walk.i + 1 AS i, cand.doc_id, kind, kn, n, used, by_kind, docs, news, later, walk.i >= m AS second,
        CAST(CASE WHEN walk.i >= m THEN {total} - used ELSE least({total} - used, CAST({total} AS DOUBLE) * {shares}[kn] - by_kind[kn]) END AS DOUBLE) AS room
      FROM walk JOIN cand ON cand.company = walk.company AND cand.i = CASE WHEN walk.i >= m THEN walk.i + 1 - m ELSE walk.i + 1 END))),
outcomes AS (SELECT cand.*, w.outcome, w.chars, w.truncated, CASE WHEN w.i > m THEN 2 ELSE 1 END AS round FROM cand JOIN walk AS w ON w.company = cand.company AND w.doc_id = cand.doc_id WHERE w.outcome NOT IN ('done', 'later'))
"""


SQL_INVENTORY = "SELECT company, kind, count(*) AS documents, max(published_at) AS newest, count(chars) AS chosen, coalesce(sum(chars), 0) AS chars, count(*) - count(chars) AS omitted, " + ", ".join(
    f"count(*) FILTER (WHERE outcome = '{r}') AS omitted_{r}" for r in co.REASONS) + " FROM outcomes GROUP BY 1, 2"


@query("evidence_documents", f"SELECT source AS company, {KINDS}[doc_id % {len(KINDS)} + 1] AS kind, count(*) AS n, max(DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER)) AS newest FROM documents WHERE text <> '' GROUP BY 1, 2")
def evidence_documents(spark, sf):
    return evidence(spark, sf).groupBy("company", "kind").agg(F.count("*").alias("n"), F.max("published_at").alias("newest"))


def chosen(spark, sf, company: str = "source", total: int = co.TOTAL_CHARS):
    cands = evidence(spark, sf, company).withColumn("priority", F.col("doc_id"))
    return cands, co.select_documents(cands, total)


@query("evidence_selection", sql_choice("source") + "SELECT company, doc_id, kind, CAST(chars AS INTEGER) AS chars, truncated, CAST(round AS INTEGER) AS round FROM outcomes WHERE outcome = 'admit'")
def evidence_selection(spark, sf):
    return chosen(spark, sf)[1].drop("priority")


@query("selected_evidence", sql_choice("source") + f"SELECT company, doc_id, kind, CASE WHEN truncated THEN substring(text, 1, chars - {len(co.TRUNCATED)}) || {_MARK} ELSE text END AS text FROM outcomes WHERE outcome = 'admit'")
def selected_evidence(spark, sf):
    return co.selected_texts(*chosen(spark, sf)).select("company", "doc_id", "kind", "text")


@query("evidence_inventory", sql_choice("source") + SQL_INVENTORY)
def evidence_inventory(spark, sf):
    return co.evidence_inventory(*chosen(spark, sf))


WIDE_TOTAL = 135_000  # a budget wide enough for documents to meet every reason


@query("evidence_omissions", sql_choice("lang", WIDE_TOTAL) + SQL_INVENTORY.replace(" FROM outcomes", " FROM outcomes WHERE company IS NOT NULL"))
def evidence_omissions(spark, sf):
    """The inventory by language, whose many documents also meet both caps under a wider budget."""
    cands, picked = chosen(spark, sf, "lang", WIDE_TOTAL)
    return co.evidence_inventory(cands.where("company IS NOT NULL"), picked.where("company IS NOT NULL"))


@query("evidence_ranking", ctes(SQL_METRICS) + """, f AS (SELECT doc_id, max(CASE WHEN kind = 'market_share' THEN 3 ELSE 0 END) AS f FROM metric GROUP BY 1), s AS (SELECT d.source AS company, d.doc_id, coalesce(f, 0) + """ + " + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for w in WORDS) + """ AS score FROM documents d LEFT JOIN f USING (doc_id))
SELECT company, doc_id, score, CAST(row_number() OVER (PARTITION BY company ORDER BY score DESC, doc_id % 700 DESC, doc_id) AS INTEGER) AS rank FROM s""")
def evidence_ranking(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("company"), "doc_id", "text", (F.col("doc_id") % 700).alias("published_at"))
    found = co.metric_candidates(co.sentences(docs), NUMBER, SHARE, GROWTH)
    return co.evidence_rank(docs, found, WORDS).select("company", "doc_id", "score", "rank")


@query("statement_row_budget", """SELECT o_custkey AS doc_id, o_orderkey AS pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END DESC, o_orderkey) AS n FROM orders) WHERE n <= CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END""")
def statement_row_budget(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("pos"), (F.col("o_orderpriority") == "1-URGENT").alias("is_funding"))
    return co.statement_row_budget(rows, {"F": 3, "O": 2, "P": 1}).select("doc_id", "pos")


# ---- grounding ---------------------------------------------------------------------------------------------------

DOC_AS_OF = "2025-06-30"


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id").alias("url"),
                                                F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("published_at"))


def citations(spark, sf) -> DataFrame:
    d, k = documents(spark, sf), F.col("doc_id")
    quote = F.substring("text", 5, 60)
    return d.select(k.alias("citation_id"), F.when(k % 11 == 0, k + 10_000_000).otherwise(k).alias("document_id"), F.when(k % 13 == 0, "https://other.example.com").otherwise(F.col("url")).alias("url"),
                    F.when(k % 17 == 0, F.date_add("published_at", 1)).otherwise(F.col("published_at")).alias("published_at"), F.when(k % 7 == 0, F.concat(quote, F.lit("~never~"))).otherwise(quote).alias("quote"))


@query("citation_check", f"""SELECT doc_id AS citation_id, CASE WHEN doc_id % 11 = 0 THEN 'CITATION_UNKNOWN_DOCUMENT' WHEN doc_id % 13 = 0 THEN 'CITATION_URL_MISMATCH' WHEN doc_id % 17 = 0 THEN 'CITATION_DATE_MISMATCH' WHEN DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) > DATE '{DOC_AS_OF}' THEN 'CITATION_FUTURE_SOURCE'
 WHEN NOT contains(text, substring(text, 5, 60) || CASE WHEN doc_id % 7 = 0 THEN '~never~' ELSE '' END) THEN 'CITATION_QUOTE_NOT_FOUND' END AS code FROM documents""")
def citation_check(spark, sf):
    return gr.check_citations(citations(spark, sf), documents(spark, sf), F.to_date(F.lit(DOC_AS_OF))).select("citation_id", "code")


def numbers(spark, sf) -> DataFrame:
    """Order totals quoted with a unit word; the claimed multiplier or value is wrong for some."""
    k, n = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    unit = F.element_at(F.array(F.lit(""), F.lit("억"), F.lit(" million"), F.lit("천만"), F.lit(" won")), (k % 5 + 1).cast("int"))
    true_mult = F.element_at(F.array(F.lit(1.0), F.lit(1e8), F.lit(1e6), F.lit(1e7), F.lit(1.0)), (k % 5 + 1).cast("int"))
    mult = F.when(k % 7 == 0, 1e3).otherwise(true_mult)
    return table(spark, sf, "orders").select(
        k.alias("citation_id"), F.concat(F.lit("total "), n, unit, F.when(k % 9 == 0, "").otherwise(F.lit(" in all"))).alias("quote"), F.when(k % 11 == 0, None).otherwise(n).alias("quoted_number"),
        mult.alias("multiplier"), (F.round(F.col("o_totalprice") * 100) / 100 * true_mult * F.when(k % 13 == 0, 2.0).otherwise(1.0)).alias("value"))


@query("numeric_support", """SELECT o_orderkey AS citation_id, CASE WHEN o_orderkey % 11 = 0 THEN 'no_quoted_number' WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 3 THEN 'multiplier_not_written' WHEN o_orderkey % 13 = 0 THEN 'value_differs' END AS unsupported FROM orders""")
def numeric_support(spark, sf):
    return gr.numeric_support(numbers(spark, sf)).select("citation_id", "unsupported")


@query("observed_numbers", """SELECT o_custkey AS ds_id, CASE WHEN o_orderkey % 3 = 0 THEN 'NUMBER_UNCITED' ELSE 'NUMBER_UNSUPPORTED' END AS code, CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 3 OR o_orderkey % 13 = 0)""")
def observed_numbers(spark, sf):
    values = table(spark, sf, "orders").select(F.col("o_custkey").alias("ds_id"), F.col("o_orderkey").cast("string").alias("path"))
    cited = gr.numeric_support(numbers(spark, sf)).withColumns({"path": F.col("citation_id").cast("string"), "code": F.when(F.col("citation_id") % 3 == 0, "CITATION_URL_MISMATCH"),
                                                                "url": F.lit("u"), "source_url": F.lit("u")}).join(values, "path")
    return gr.observed_numbers(values, cited)


@query("source_resolution", f"""SELECT doc_id AS ds_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'UNKNOWN_SOURCE_URL' ELSE NULL END WHEN doc_id % 4 = 1 THEN 'MODEL_ESTIMATE_ON_OBSERVED_FIELD' WHEN doc_id % 4 = 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'ASSUMPTION_WITHOUT_RATIONALE' END ELSE 'SOURCE_NOT_SUPPLIED' END AS code FROM documents WHERE (doc_id % 4 = 0 AND doc_id % 8 = 0) OR doc_id % 4 IN (1, 3) OR (doc_id % 4 = 2 AND doc_id % 3 = 0)
UNION ALL SELECT doc_id, 'FUTURE_SOURCE' FROM documents WHERE DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) > DATE '{DOC_AS_OF}'""")
def source_resolution(spark, sf):
    d, k = documents(spark, sf), F.col("doc_id")
    sources = d.select(k.alias("ds_id"), F.when(k % 4 == 0, F.when(k % 8 == 0, "https://unknown.example.com").otherwise(F.col("url"))).alias("url"), "published_at",
                       F.when(k % 4 == 1, "MODEL_ESTIMATE: x").when(k % 4 == 2, "MODEL_ASSUMPTION: y").when(k % 4 == 3, "a note").alias("manual_reference"),
                       F.when(k % 4 == 2, "markets[0].annualGrowth.source").otherwise("quote.source").alias("path"), F.lit(True).alias("has_estimate"), F.when(k % 3 != 0, "why").alias("rationale"))
    return gr.resolve_sources(sources, d, F.to_date(F.lit(DOC_AS_OF))).select("ds_id", "code")


def estimate_table(spark, sf):
    t = vl.lifted(spark, sf)
    est, paths = va.estimates(t), va.all_series(t).select("ds_id", F.concat("path", F.lit(".revenue")).alias("path"))
    n = F.col("ds_id")
    own = F.when(F.col("kind") == "market", F.array(F.lit("products[0].revenue[0].revenue"))).when(F.col("kind") == "product", F.array(F.lit("1"), F.lit("2"))).otherwise(F.array().cast("array<string>"))
    based = F.when(n % 5 == 1, F.array("path")).when(n % 5 == 2, F.array(F.lit("no-such"))).otherwise(own)
    return est.select("ds_id", "path", "method", based.alias("based_on"), (n % 4 != 3).alias("labelled")), paths


@query("estimate_rules", ctes(vl.SQL_SERIES) + """, e AS (SELECT ds_id, kind, method FROM ser WHERE method IS NOT NULL), r AS (SELECT ds_id, 'ESTIMATE_NOT_LABELLED' AS code FROM e WHERE ds_id % 4 = 3 UNION ALL SELECT ds_id, 'ESTIMATE_SELF_REFERENCE' FROM e WHERE ds_id % 5 = 1
 UNION ALL SELECT ds_id, 'ESTIMATE_BASIS_UNKNOWN' FROM e WHERE ds_id % 5 = 2 UNION ALL SELECT ds_id, 'ESTIMATE_BASIS_MISMATCH' FROM e WHERE (method = 'share_implied' AND ds_id % 5 IN (1, 2)) OR (method = 'article_synthesis' AND ds_id % 5 IN (1, 2)))
SELECT ds_id, code, count(*) AS n FROM r GROUP BY 1, 2""")
def estimate_rules(spark, sf):
    est, paths = estimate_table(spark, sf)
    return gr.estimate_rules(est, paths, documents(spark, sf)).groupBy("ds_id", "code").agg(F.count("*").alias("n"))


@query("grounding_verdict", f"""WITH i AS (SELECT doc_id % 200 AS ds_id, CASE WHEN doc_id % 17 = 0 THEN 'FUTURE_SOURCE' ELSE 'NUMBER_UNCITED' END AS code FROM documents WHERE doc_id % 3 = 0), d AS (SELECT DISTINCT doc_id % 200 AS ds_id FROM documents)
SELECT d.ds_id, count(code) AS issues, count(CASE WHEN code = 'FUTURE_SOURCE' THEN 1 END) AS hard, CASE WHEN count(CASE WHEN code = 'FUTURE_SOURCE' THEN 1 END) > 0 THEN 'rejected' WHEN count(code) > 0 THEN 'provisional' ELSE 'verified' END AS verdict FROM d LEFT JOIN i ON d.ds_id = i.ds_id GROUP BY 1""")
def grounding_verdict(spark, sf):
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 200).alias("ds_id"), "doc_id")
    found = rows.where(F.col("doc_id") % 3 == 0).select("ds_id", F.when(F.col("doc_id") % 17 == 0, "FUTURE_SOURCE").otherwise("NUMBER_UNCITED").alias("code"))
    return gr.verdict(rows, found)


@query("review_reconciliation", """SELECT o_custkey AS ds_id, CASE WHEN o_orderkey % 4 = 0 THEN 'AUDIT_UNCONFIRMED' WHEN o_orderkey % 4 = 1 THEN 'AUDIT_DISAGREES' ELSE 'ESTIMATE_REJECTED' END AS code, CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE (o_orderkey % 2 = 0 AND o_orderkey % 4 = 0 AND o_orderstatus <> 'P') OR (o_orderkey % 4 = 1 AND o_orderstatus <> 'P') OR (o_orderkey % 4 = 2 AND o_orderstatus = 'P')""")
def review_reconciliation(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    paths = lambda df: df.select(F.col("o_custkey").alias("ds_id"), k.cast("string").alias("path"))
    review = o.where(k % 4 != 0).select(F.col("o_custkey").alias("ds_id"), k.cast("string").alias("path"), F.when(k % 4 == 1, "disagree").when(k % 4 == 2, "reject").otherwise("confirm").alias("opinion"))
    return gr.reconcile_review(paths(o.where("o_orderstatus <> 'P'")), paths(o.where("o_orderstatus = 'P'")), review)


@query("usable_documents", f"SELECT doc_id, 'AFTER_AS_OF' AS code FROM documents WHERE doc_id % 9 <> 0 AND DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) > DATE '{DOC_AS_OF}' UNION ALL SELECT doc_id, 'INVALID_DATE' FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT NULL, 'TOO_LARGE' WHERE (SELECT sum(length(text)) FROM documents) > 1000")
def usable_documents(spark, sf):
    d = documents(spark, sf).withColumn("published_at", F.when(F.col("doc_id") % 9 != 0, F.col("published_at")))
    return gr.usable_documents(d, F.to_date(F.lit(DOC_AS_OF)), max_total=1000)[1]


def quotes(spark, sf) -> DataFrame:
    """Orders phrased as consensus and event quotes."""
    k, q = F.col("o_orderkey"), quarter_index(F.to_date("o_orderdate"))
    span = F.concat(format_quarter(q), F.lit("~"), format_quarter(q + 3))
    korean = F.concat(F.year("o_orderdate").cast("string"), F.lit("년 "), F.quarter("o_orderdate").cast("string"), F.lit("분기"))
    text = F.when(k % 3 == 0, span).when(k % 3 == 1, korean).otherwise("no quarter here")
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (q + i).cast("int"))
    return table(spark, sf, "orders").select(k.alias("id"), F.concat(F.when(k % 2 == 0, "연결 "), F.when(k % 5 != 0, F.lit("희석 ")).otherwise("기본 주당 "), text, F.lit(" EPS")).alias("q0"), text.alias("t"),
                                             F.concat(F.when(k % 2 == 0, "연결 ").otherwise(""), F.when(k % 5 != 0, "희석 ").otherwise("기본 주당 "), text, F.lit(" EPS")).alias("quote"),
                                             F.when(k % 3 == 0, four).otherwise(F.array(q.cast("int"))).alias("horizon"), (k % 7).alias("eps_document"), (k % 7 + F.when(k % 11 == 0, 1).otherwise(0)).alias("horizon_document"),
                                             F.to_timestamp("o_orderdate").alias("event_at"))


@query("horizon_anchor", "SELECT o_orderkey AS id, o_orderkey % 3 <> 2 AS horizon_ok FROM orders")
def horizon_anchor(spark, sf):
    return gr.horizon_matches(quotes(spark, sf)).select("id", "horizon_ok")


@query("consensus_basis", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 <> 0 THEN 'NOT_CONSOLIDATED' WHEN o_orderkey % 5 = 0 THEN 'NOT_DILUTED' WHEN o_orderkey % 11 = 0 THEN 'DIFFERENT_DOCUMENTS' END AS basis_code FROM orders")
def consensus_basis(spark, sf):
    return gr.consensus_basis(quotes(spark, sf)).select("id", "basis_code")


@query("event_anchor", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'OTHER_DOCUMENT' WHEN o_orderkey % 4 = 3 THEN 'DATE_NOT_QUOTED' WHEN o_orderkey % 5 = 0 THEN 'EVENT_NOT_DESCRIBED' END AS event_code FROM orders")
def event_anchor(spark, sf):
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    shown = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "yyyy.MM.dd")).when(k % 4 == 2, F.concat(F.year(d).cast("string"), F.lit("년 "), F.month(d).cast("string"), F.lit("월 "), F.dayofmonth(d).cast("string"), F.lit("일"))).otherwise("soon")
    rows = table(spark, sf, "orders").select(k.alias("id"), F.concat(shown, F.when(k % 5 == 0, " contract").otherwise(" 실적 발표")).alias("quote"), F.lit("earnings_release").alias("event_type"), F.to_timestamp("o_orderdate").alias("event_at"),
                                             F.lit(1).alias("catalyst_document"), F.when(k % 6 == 0, 2).otherwise(1).alias("quote_document"))
    return gr.event_anchored(rows).select("id", "event_code")


@query("strategy_sources", f"SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN 'NOT_A_DOCUMENT' WHEN doc_id % 5 = 0 THEN 'KIND_NOT_ALLOWED' WHEN doc_id % 7 = 0 THEN 'KNOWN_DAY_DIFFERS' ELSE 'KNOWN_AFTER_AS_OF' END AS code FROM documents WHERE doc_id % 8 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 OR DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) > DATE '{DOC_AS_OF}'")
def strategy_sources(spark, sf):
    d, k = documents(spark, sf), F.col("doc_id")
    rows = d.select(k.alias("id"), F.when(k % 8 == 0, "https://none.example.com").otherwise(F.col("url")).alias("url"), F.when(k % 5 == 0, "model_knowledge").otherwise("filing").alias("kind"),
                    (F.date_add("published_at", F.when(k % 7 == 0, 1).otherwise(0)).cast("timestamp") + F.expr("interval 3 hours")).alias("known_at"))
    again = d.withColumns({"doc_id": F.col("doc_id") + 10**9, "published_at": F.date_add("published_at", 400)})  # each url is listed twice
    return gr.strategy_sources(rows, d.unionByName(again), F.to_date(F.lit(DOC_AS_OF)), ("filing", "press_release"))


@query("forecast_completeness", """SELECT c_custkey AS id, 'forecast' AS block, 'BRIDGE_ASSUMPTION_MISSING' AS code FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT DISTINCT o_custkey, 'forecast', 'SEGMENT_UNCITED' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_custkey = o.o_custkey AND c.o_orderkey % 40 = o.o_orderkey % 40 AND (c.o_orderkey + c.o_custkey) % 10 <> 0)
UNION ALL SELECT c_custkey, 'liquidity', 'LIQUIDITY_UNGROUNDED' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'funding', 'FUNDING_UNGROUNDED' FROM customer WHERE c_custkey % 7 = 0""")
def forecast_completeness(spark, sf):
    k = F.col("c_custkey")
    forecasts = table(spark, sf, "customer").select(k.alias("id"), (k % 6 != 0).alias("has_bridge_assumption"), F.lit(True).alias("has_liquidity"), (k % 5 != 0).alias("liquidity_cited"), F.lit(True).alias("has_funding"), (k % 7 != 0).alias("funding_cited"))
    o = table(spark, sf, "orders")  # forecasts share their paths
    segs = o.select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 40).alias("path"))
    return gr.complete_forecasts(forecasts, segs, o.where((F.col("o_orderkey") + F.col("o_custkey")) % 10 != 0).select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 40).alias("path")))


@query("financial_sector", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def financial_sector(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "보험업").otherwise(F.col("c_mktsegment")).alias("sector"))
    return gr.financial_sector(rows).select("id")
