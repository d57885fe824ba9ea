"""Rules over texts and citations that the registered queries meet only in part."""

import datetime as dt

from pyspark.sql import functions as F

from strandline.operators import corpus as co
from strandline.operators import grounding as gr
from strandline.operators import records as rc


def test_basis_measure_and_fields_of_figures(spark):
    rows = [(1, "스마트폰 매출 점유율 12.5% 2024년 3분기 전년 대비"), (2, "출하 점유율 7% 분기 전년 동기 대비"), (3, "연평균 성장률 8.5% TrendForce"), (4, "글로벌 D램 매출 1,200억 달러, 시장 규모 3조 원")]
    sents = spark.createDataFrame([(i, 0, s) for i, s in rows], "doc_id long, sent_no int, sentence string")
    got = {r["doc_id"]: r for r in co.metric_candidates(sents).collect()}
    assert (got[1]["basis"], got[1]["measure"], got[1]["value"], got[1]["period_hint"], got[1]["kind"]) == ("quarterly", "revenue", 12.5, "2024년 3분기", "market_share")
    assert (got[2]["basis"], got[2]["measure"]) == ("yoy", "volume") and got[2]["label"] == "출하 점유율"
    assert (got[3]["basis"], got[3]["measure"], got[3]["cites"], got[3]["kind"]) == ("annual", None, "TrendForce", "growth_rate")
    sizes = sorted((r["k"], r["value"], r["scale"], r["unit"]) for r in co.market_sizes(sents, news=True).where("doc_id = 4").collect())
    assert sizes == [(0, 1200.0, "억", "달러"), (1, 3.0, "조", "원")]


def test_every_figure_of_a_sentence_is_kept(spark):
    sents = spark.createDataFrame([(1, 0, " ".join(f"점유율 {i}%" for i in range(9)))], "doc_id long, sent_no int, sentence string")
    assert co.metric_candidates(sents).count() == 9


def test_a_path_is_cited_for_its_own_forecast_only(spark):
    forecasts = spark.createDataFrame([(i, True, False, False, False, False) for i in (1, 2)], "id int, has_bridge_assumption boolean, has_liquidity boolean, liquidity_cited boolean, has_funding boolean, funding_cited boolean")
    segments = spark.createDataFrame([(1, "segments[0]"), (2, "segments[0]")], "id int, path string")
    out = gr.complete_forecasts(forecasts, segments, segments.where("id = 1")).collect()
    assert [(r["id"], r["code"]) for r in out] == [(2, "SEGMENT_UNCITED")]


def test_prior_extrapolation_needs_an_earlier_figure_or_a_document(spark):
    paths = spark.createDataFrame([("a", "quote.priceKRW"), ("a", "products[0].revenue[1].revenue")], "ds_id string, path string")
    docs = spark.createDataFrame([("d1",)], "doc_id string")
    rows = [("a", "markets[0].observations[0].source", "prior_extrapolation", [ref], True) for ref in ("quote.priceKRW",)] + [
        ("a", "markets[0].observations[1].source", "prior_extrapolation", ["products[0].revenue[1].revenue"], True), ("a", "markets[0].observations[2].source", "prior_extrapolation", ["d1"], True)]
    est = spark.createDataFrame(rows, "ds_id string, path string, method string, based_on array<string>, labelled boolean")
    out = gr.estimate_rules(est, paths, docs).collect()
    assert [(r["code"], r["path"]) for r in out] == [("ESTIMATE_BASIS_MISMATCH", "markets[0].observations[0].source")]


def test_financial_sector_wording(spark):
    rows = [(1, "한국은행지주", None), (2, None, "증권거래소 시스템"), (3, "미래증권", "기타"), (4, "그래픽카드", "반도체"), (5, "신한카드사", None)]
    got = gr.financial_sector(spark.createDataFrame(rows, "id int, name string, sector string")).collect()
    assert sorted(r["id"] for r in got) == [1, 3, 5]


def test_event_words_are_whole(spark):
    at = dt.datetime(2026, 3, 2, 3)
    rows = [(1, "2026-03-02 영업(잠정)실적 공시", "earnings_release"), (2, "2026.03.02 정기보고서 제출", "other_scheduled_disclosure"), (3, "2026-03-02 결산실적공시예고", "earnings_release"), (4, "2026-03-02 계약 만료", "earnings_release")]
    df = spark.createDataFrame([(i, q, e, at, 1, 1) for i, q, e in rows], "id int, quote string, event_type string, event_at timestamp, catalyst_document int, quote_document int")
    assert {r["id"]: r["event_code"] for r in gr.event_anchored(df).collect()} == {1: None, 2: None, 3: None, 4: "EVENT_NOT_DESCRIBED"}


def test_records_of_one_instant_lose_no_row(spark):
    at = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("1", at, "b"), ("1", at, "a"), ("2", at, "c"), ("2", at, "c"), ("3", at, "d")], "id string, recorded_at timestamp, content_hash string")
    accepted, rejected = rc.append(rows.where("id = '3'"), rows)
    assert sorted((r["id"], r["content_hash"]) for r in accepted.collect()) == [("1", "a"), ("2", "c")]
    assert sorted((r["id"], r["content_hash"]) for r in rejected.collect()) == [("1", "b"), ("2", "c"), ("3", "d")]


def test_sections_of_financing_topics_and_unit(spark):
    html = "<h2>약정 한도 현황</h2><p>(단위 : 백만원)</p><h2>사용이 제한된 예금</h2><p>x</p><h2>신규 사업</h2><p>y</p>"
    got = [(r["category"], r["n"]) for r in co.sections(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos").collect()]
    assert got == [("committed_financing", 1), ("restricted_cash", 1), ("business", 1)]
    unit = spark.createDataFrame([("none", "(단위 : 백만원)")], "a string, b string").select(co.unit_near(F.col("a"), F.col("b")).alias("u")).first()["u"]
    assert unit == "백만원"


def cut_by_hand(head, categories, limit):
    """Water-filling and first fit, step by step."""
    mark = "\n[TRUNCATED]"
    full = "\n".join([head, *[x for c in categories for x in c]])
    if len(full) <= limit:
        return full, False, 0
    head = head[:max(0, limit - len(mark))]
    left, shares = max(0, limit - len(head) - len(mark)), {}
    open_ = {i: sum(len(x) + 1 for x in c) for i, c in enumerate(categories) if c}
    while open_:
        share = left / len(open_)
        low = {i: n for i, n in open_.items() if n <= share}
        if not low:
            shares |= dict.fromkeys(open_, share)
            break
        shares |= low
        left -= sum(low.values())
        open_ = {i: n for i, n in open_.items() if i not in low}
    kept = []
    for i, c in enumerate(categories):
        for x in c:
            if len(x) + 1 <= shares.get(i, 0):
                shares[i] -= len(x) + 1
                kept.append(x)
    return ("\n".join([head, *kept]) + mark)[:limit], True, sum(map(len, categories)) - len(kept)


def test_statements_are_cut_by_shares_and_first_fit(spark):
    import random
    draw = random.Random(2)
    rows = []
    for i in range(300):
        cats = [["가" * draw.randint(0, 30) for _ in range(draw.choice([0, 1, 4, 9]))] for _ in range(3)]
        rows.append((i, "h" * draw.choice([0, 5, 40]), *cats, draw.choice([0, 5, 12, 13, 40, 90, 200, 2000])))
    df = spark.createDataFrame(rows, "id long, head string, a array<string>, b array<string>, c array<string>, lim int")
    out = df.select("id", co.truncate_statement(F.col("head"), [F.col(x) for x in "abc"], F.col("lim")).alias("r")).collect()
    got = {r["id"]: tuple(r["r"]) for r in out}
    for i, head, a, b, c, limit in rows:
        assert got[i] == cut_by_hand(head, [a, b, c], limit), rows[i]
    null = spark.createDataFrame([(None, None, 5)], "head string, a array<string>, lim int").select(co.truncate_statement(F.col("head"), [F.col("a")], F.col("lim")).alias("r")).first()
    assert tuple(null["r"]) == ("", False, 0)
