import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from strandline.operators import corpus as co
from strandline.operators import earnings as er
from strandline.operators import filings as fl
from strandline.operators import quality_rules as qr
from strandline.operators import replay as rp
from strandline.operators import screen as sc
from strandline.operators import valuation as va
from strandline.sources import readers as rd

KEYS = ["ticker"]


def funding_case(spark):
    q = spark.range(4).select(F.lit("T").alias("ticker"), (F.col("id") + 8104).cast("int").alias("q"))
    segments = q.select("*", F.lit("s").alias("segment"), *[F.lit(float(v)).alias(k) for k, v in (("volume", 10), ("unit_price", 20), ("variable_cost", 10), ("fixed_cost", 0))])
    quarters = q.select("*", *[F.lit(float(v)).alias(k) for k, v in (("net_interest", -10), ("tax_rate", 0.2), ("noncontrolling_share", 0), ("preferred_claims", 0), ("diluted_shares", 10))])
    plan = q.select("*", *[F.lit(float(v)).alias(k) for k, v in (("depreciation", 20), ("capex", 80), ("delta_working_capital", 30), ("cash_taxes", 20), ("cash_interest", 10),
                                                                 ("other_cash_flow", 0), ("principal_due", 50), ("committed_draw", 0), ("payouts", 5), ("opening_cash", 40), ("opening_debt", 200))])
    return segments, quarters, plan


def test_funding_oracle(spark):
    segments, quarters, plan = funding_case(spark)
    policy = er.RiskPolicy()
    bridge = er.scenario_bridge(segments, quarters, plan, KEYS, policy)
    eps = {r["scenario"]: r["ntm_eps"] for r in er.ntm_eps(bridge, [*KEYS, "scenario"]).collect()}
    assert eps["base"] == pytest.approx(28.8)
    assert eps["stress"] == pytest.approx(sum((76.5 - 10 - i) * 0.8 / 10 for i in (1, 0.75, 0.5, 0.25)))
    roll = er.funding_rollforward(bridge, plan, KEYS, policy)
    first = {r["scenario"]: r for r in roll.where("q = 8104").collect()}
    assert (first["base"]["operating_cash"], first["base"]["free_cash_flow"], first["base"]["ending_cash"], first["base"]["ending_debt"]) == (60, -20, -35, 150)
    assert (first["stress"]["operating_profit"], first["stress"]["ending_cash"]) == (pytest.approx(76.5), pytest.approx(-59.5))
    peak = {r["scenario"]: r["peak_funding"] for r in er.funding_summary(roll, KEYS, policy).collect()}
    assert peak["base"] == 260


def test_invalid_schedule_and_horizon(spark):
    _, quarters, plan = funding_case(spark)
    bad = plan.withColumn("opening_debt", F.lit(10.0)).where("q <> 8107")
    assert {r["code"] for r in er.invalid_schedules(bad, quarters, KEYS).collect()} == {"INVALID_DEBT_SCHEDULE", "FUNDING_HORIZON_MISMATCH"}


def test_replay_by_hand(spark):
    cfg = sc.ScreenConfig(fee_bps=10, slippage_bps=20, sell_tax_bps=18, initial_capital=1_000_000.0, hold_sessions=3)
    at = dt.datetime(2026, 1, 15)
    runs = spark.createDataFrame([("r", at, at, at, "synthetic", "c", "c", at)], "run_id string, decision_at timestamp, selection_decision_at timestamp, evaluated_at timestamp, experiment_mode string, config_digest string, selection_digest string, outcome_known_at timestamp")
    sessions = spark.createDataFrame([("r", i, dt.datetime(2026, 1, 16 + i, 0), dt.datetime(2026, 1, 16 + i, 6)) for i in range(3)], "run_id string, idx int, open_at timestamp, close_at timestamp")
    path = {"T": [(100, 110), (110, 90), (90, 121)], rp.MARKET: [(1000, 1010), (1010, 1005), (1005, 1020)], rp.SECTOR: [(500, 505), (505, 502), (502, 510)]}
    prices = spark.createDataFrame([("r", k, i, float(o), float(c)) for k, v in path.items() for i, (o, c) in enumerate(v)], "run_id string, label string, idx int, open double, close double")
    selection = spark.createDataFrame([("r", "T", 0.2, "s")], "run_id string, ticker string, weight double, sector_key string")
    assert rp.incomplete(runs, selection, sessions, prices, cfg).count() == 0
    missing = rp.incomplete(runs, selection, sessions, prices.where("not (label = 'T' and idx = 1)"), cfg).collect()
    assert [(m["subject"], m["reason"]) for m in missing] == [("T", "missing price")]
    last = spark.createDataFrame([("r", 2)], "run_id string, last_idx int")
    held = rp.positions(selection, prices, last, cfg)
    curve = rp.equity_curve(runs, held, sessions, prices, cfg)
    out = rp.run_summary(runs, held, curve, prices, last, cfg).first()
    units = 200_000 / (100 * 1.002 * 1.001)
    final = 800_000 + units * 121 * 0.998 * (1 - 0.001 - 0.0018)
    assert out["final_equity"] == pytest.approx(final) and out["net_return_pct"] == pytest.approx((final / 1e6 - 1) * 100)
    assert out["gross_return_pct"] == pytest.approx(4.2) and out["market_return_pct"] == pytest.approx(2.0)
    marks = [r["equity"] for r in curve.orderBy("point").collect()]
    assert len(marks) == 4 and out["max_drawdown_pct"] == pytest.approx((marks[1] - marks[2]) / marks[1] * 100)
    idle = rp.run_summary(runs, held.where(F.lit(False)), rp.equity_curve(runs, held.where(F.lit(False)), sessions, prices, cfg), prices, last, cfg).first()
    assert idle["status"] == "no_trade" and idle["final_equity"] == 1e6 and idle["max_drawdown_pct"] == 0


def dataset():
    src = lambda d: {"title": "t", "manualReference": "m", "publishedAt": d}
    tri = lambda *v: {"value": dict(zip(("bear", "base", "bull"), v)), "source": src("2025-12-20")}
    days = ["2025-05-15", "2025-08-15", "2025-11-15", "2026-01-10"]
    series = lambda v, **k: [{"quarter": f"2025Q{i + 1}", "revenue": v, "basis": "quarterly", "source": src(d), **k} for i, d in enumerate(days)]
    return {"schemaVersion": 1, "company": {"ticker": "111110", "name": "Test Co", "exchange": "KOSPI", "description": "d", "sources": [src("2025-12-01")]},
            "quote": {"priceKRW": 50000, "asOf": "2026-01-10", "source": src("2026-01-10")}, "shares": {"dilutedCommon": 10000000, "asOf": "2025-12-31", "source": src("2026-01-05")},
            "fx": [{"currency": "USD", "krwPerUnit": 1000, "asOf": "2026-01-10", "source": src("2026-01-10")}], "financials": {"quarter": "2025Q4", "totalRevenueKRW": 1.25e11, "source": src("2026-01-10")},
            "markets": [{"id": "m1", "name": "Market 1", "scope": "widgets", "currency": "USD", "observations": series(1e9), "annualGrowth": tri(0, 0.1, 0.2),
                         "seasonality": {"value": {"q1": 1, "q2": 1, "q3": 1, "q4": 1}, "source": src("2025-12-20")}, "cyclical": tri(1, 1, 1)}],
            "products": [{"id": "p1", "name": "Product 1", "marketId": "m1", "revenue": series(1e8, currency="USD"), "shareDelta": tri(0, 0, 0), "shareBounds": {"min": 0.05, "max": 0.2}, "operatingMargin": tri(0.1, 0.2, 0.3)}],
            "residual": {"value": {"annualGrowth": {"bear": 0, "base": 0, "bull": 0}, "operatingMargin": {"bear": 0.1, "base": 0.1, "bull": 0.1}}, "source": src("2025-12-20")},
            "earningsBridge": {"value": {"netInterestKRW": 0, "effectiveTaxRate": 0.2, "noncontrollingShare": 0, "preferredClaimsKRW": 0}, "source": src("2025-12-20"), "rationale": "r"},
            "valuation": {"peMultiple": tri(5, 10, 15)}}


def test_nested_dataset_to_target_price(spark, tmp_path):
    (tmp_path / "111110.json").write_text(json.dumps(dataset(), indent=1))
    t = rd.normalise_datasets(rd.read_datasets(spark, str(tmp_path)))
    as_of = F.to_date(F.lit("2026-01-15"))
    assert qr.static_rules(t).count() == 0 and qr.dated_rules(t, as_of).count() == 0 and qr.structure_rules(t).count() == 0
    assert va.target_quarter(t, as_of).first()["target_q"] == 8104
    cov = va.coverage(t).first()
    assert (cov["ratio"], cov["residual"]) == (pytest.approx(0.8), pytest.approx(2.5e10))
    none = spark.createDataFrame([], "ds_id string, q int, eps double")
    base = {r["scenario"]: r for r in va.valuation(t, as_of, none).collect()}["base"]
    op = 1e9 * 1.1**0.25 * 0.1 * 1000 * 0.2 + 2.5e10 * 0.1
    assert base["operating_profit"] == pytest.approx(op) and base["target_price"] == pytest.approx(op * 0.8 / 1e7 * 4 * 10)
    assert base["eps_basis"] == "quarter_x4"


def test_corrupt_dataset_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text("{not json")
    with pytest.raises(Exception):
        rd.read_datasets(spark, str(tmp_path)).collect()


def test_log_skips_a_torn_line_and_missing_is_empty(spark, tmp_path):
    good = json.dumps({"ticker": "T", "as_of_date": "2026-01-01", "horizons": []})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text(good + "\n" + good[:20])
    assert rd.read_log(spark, str(tmp_path / "log")).count() == 1
    assert rd.read_log(spark, str(tmp_path / "none")).count() == 0


def test_append_and_summary_sinks(spark, tmp_path):
    rows = rd.read_log(spark, str(tmp_path / "none"))
    one = spark.createDataFrame([("T", dt.date(2026, 1, 1))], "ticker string, as_of_date date")
    for _ in range(2):
        rd.append_log(one, str(tmp_path / "out"))
    assert rd.read_log(spark, str(tmp_path / "out")).count() == 2 and rows.count() == 0
    for _ in range(2):
        rd.write_summary({"ranking": one, "scores": one}, str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).count() == 2


def test_session_source_problems(spark):
    s = lambda a, b: {"open_at": dt.datetime(2026, 1, a), "close_at": dt.datetime(2026, 1, b)}
    p = {"open": 1.0, "close": 1.0}
    schema = "run_id string, sessions array<struct<open_at:timestamp,close_at:timestamp>>, series array<struct<label:string,prices:array<struct<open:double,close:double>>>>"
    rows = [("ok", [s(1, 2), s(3, 4)], [{"label": "A", "prices": [p, p]}]), ("bad", [s(1, 4), s(3, 5)], [{"label": "A", "prices": [p]}, {"label": "A", "prices": [p, p]}])]
    _, prices, problems = rd.session_prices(spark.createDataFrame(rows, schema))
    assert prices.count() == 5
    assert {(r["run_id"], r["code"]) for r in problems.collect()} == {("bad", c) for c in ("SESSIONS_NOT_ASCENDING", "PRICE_COUNT_DIFFERS", "DUPLICATE_LABEL")}


def brute_selection(docs, total, cap, max_docs, max_news, shares):
    """Straight reading of the two-round rule over the whole candidate list: (chosen lengths, reasons of the others)."""
    used, kinds, news, out, later, reasons = 0, {}, 0, {}, [], {}
    for second, queue in ((False, docs), (True, later)):
        for d in queue:
            at = (d["doc_id"], d["kind"])
            if len(out) >= max_docs:
                reasons[at] = "document_count_cap"
                continue
            if d["kind"] == "news" and news >= max_news:
                reasons[at] = "news_cap"
                continue
            room = total - used if second else min(total - used, total * shares[d["kind"]] - kinds.get(d["kind"], 0))
            if room < 200:
                if second:
                    reasons[at] = "character_budget"
                else:
                    later.append(d)
                continue
            limit = min(cap, room)
            n = len(d["text"] or "")
            take = int(limit - 14) + 12 if n > limit else n
            used, kinds[d["kind"]], news = used + take, kinds.get(d["kind"], 0) + take, news + (d["kind"] == "news")
            out[at] = take
    return out, reasons


@pytest.mark.parametrize("total, max_docs, max_news, news_share", [
    (12_000, 25, 4, 9), (12_000, 300, 300, 9), (60_000, 25, 4, 2), (90_000, 60, 12, 2), (1_000, 25, 4, 2), (12_000, 0, 0, 9), (30_000, 40, 1, 3), (9_000, 12, 2, 2)])
def test_selection_and_reasons_equal_the_rule_on_the_whole_list(spark, total, max_docs, max_news, news_share):
    kinds = list(co.KIND_SHARE)
    docs = [{"company": "c", "doc_id": i, "kind": "news" if i % news_share == 1 else kinds[(i * 7) % len(kinds)], "priority": i // 3, "published_at": i,
             "text": None if i == 5 else "x" * (150 + (i * 137) % 900)} for i in range(300)]
    docs += [{"company": "small", "doc_id": 1, "kind": "news", "priority": 1, "published_at": 7, "text": ""}]
    cands = spark.createDataFrame(docs, "company string, doc_id long, kind string, priority int, published_at int, text string")
    picked = co.select_documents(cands, total_chars=total, doc_chars=600, max_docs=max_docs, max_news=max_news)
    got = co.omission_reasons(cands, picked, max_docs, max_news).collect()
    assert len(got) == len(docs)
    for company in ("c", "small"):
        out, reasons = brute_selection([d for d in docs if d["company"] == company], total, 600, max_docs, max_news, co.KIND_SHARE)
        assert {(r["doc_id"], r["kind"]): r["chars"] for r in got if r["company"] == company and r["reason"] is None} == out
        assert {(r["doc_id"], r["kind"]): r["reason"] for r in got if r["company"] == company and r["reason"]} == reasons
    counts = co.evidence_inventory(cands, picked, max_docs, max_news).selectExpr("sum(omitted) a", "sum(omitted_document_count_cap + omitted_news_cap + omitted_character_budget) b").first()
    assert counts["a"] == counts["b"] == sum(r["reason"] is not None for r in got)
    for r in co.selected_texts(cands, picked).collect():
        whole = next(d["text"] for d in docs if (d["company"], d["doc_id"]) == (r["company"], r["doc_id"])) or ""
        assert len(r["text"] or "") == r["chars"] and (r["text"].endswith("x\n[TRUNCATED]") if r["truncated"] else (r["text"] or "") == whole)


def test_delimited_and_markup_files(spark, tmp_path):
    (tmp_path / "codes.csv").write_text('"Downloaded","x"\n"Code","Name"\n"E00001","A, Ltd"\n"E00002","B"\n', encoding="utf-8")
    codes = rd.read_code_list(spark, str(tmp_path / "codes.csv"), "code string, name string", r"^E\d{5}$")
    assert sorted(tuple(r) for r in codes.collect()) == [("E00001", "A, Ltd"), ("E00002", "B")]
    (tmp_path / "facts.tsv").write_text('element\tvalue\n"NetSales"\t"12"\n', encoding="utf-16")
    assert tuple(rd.read_fact_table(spark, str(tmp_path / "facts.tsv"), "element string, value double").first()) == ("NetSales", 12.0)
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "p.html").write_text("<article><p>한글</p></article>", encoding="utf-8")
    assert co.articles(rd.read_html_files(spark, str(tmp_path / "html"))).first()["text"] == "한글"


def test_a_bad_file_fails_by_itself(spark, tmp_path):
    (tmp_path / "111110.json").write_text(json.dumps(dataset(), indent=1))
    (tmp_path / "222220.json").write_text("{not json")
    (tmp_path / "333330.json").write_text(json.dumps(dataset()))
    (tmp_path / "444440.json").write_text(json.dumps({"schemaVersion": 1}))
    (tmp_path / "notes.json").write_text(json.dumps({"any": "thing"}))
    good, faults = rd.read_dataset_files(spark, str(tmp_path))
    assert [r["company"]["ticker"] for r in good.collect()] == ["111110"]
    assert sorted((r["file"].rsplit("/", 1)[1], r["code"]) for r in faults.collect()) == [
        ("222220.json", "CORRUPT"), ("333330.json", "TICKER_MISMATCH"), ("444440.json", "CORRUPT"), ("notes.json", "NOT_A_DATASET")]
    assert rd.normalise_datasets(good).market.count() == 1


def test_sources_are_walked_in_document_order_and_first_appearance_wins(spark, tmp_path):
    data = dataset()
    web = {"title": "t", "url": "https://x.example.com", "publishedAt": "2026-01-10"}
    data["quote"]["source"] = web
    data["markets"][0]["observations"][1] |= {"source": {"title": "t", "manualReference": "MODEL_ESTIMATE: x", "publishedAt": "2026-01-10"},
                                              "estimate": {"method": "share_implied", "basedOn": ["a"], "rationale": "r"}}
    data["markets"][0]["cyclical"] = None
    (tmp_path / "111110.json").write_text(json.dumps(data))
    good, _ = rd.read_dataset_files(spark, str(tmp_path))
    rows = rd.resolvable_sources(good).orderBy("pos").collect()
    paths = [r["path"] for r in rows]
    assert paths[:6] == ["company.sources[0]", "quote.source", "shares.source", "fx[0].source", "financials.source", "markets[0].observations[0].source"]
    assert paths[-1] == "valuation.peMultiple.source" and "markets[0].cyclical.source" not in paths and len(paths) == len(set(paths)) == 20
    by = {r["path"]: r for r in rows}
    assert by["markets[0].observations[1].source"]["has_estimate"] and by["earningsBridge.source"]["rationale"] == "r" and not by["quote.source"]["has_estimate"]
    found = rd.dataset_provenance(rd.walk_sources(good)).orderBy("rank").collect()
    assert [(r["reference"], r["first_path"]) for r in found][:3] == [("m", "company.sources[0]"), ("https://x.example.com", "quote.source"), ("m", "shares.source")]
    assert sum(r["n"] for r in found) == 20 and [r["rank"] for r in found] == list(range(1, len(found) + 1))


def test_any_name_of_a_listing_can_reject_it(spark):
    rows = [("005930", ["Good Corp", None, " "], "Stock", "26110", None, []), ("005935", ["Good Corp"], None, None, None, [("PREFERRED_STOCK", None)]),
            ("005935", ["Good Corp"], None, None, False, []), ("005930", ["Good Corp", "굿 우선주"], None, None, None, [("PREFERRED_STOCK", "굿 우선주")]),
            ("100000", ["Plain", "KODEX 200"], None, None, None, [("ETF_ETN", "KODEX 200")]), ("100000", ["KODEX 200"], "ETN", None, None, [("ETF_ETN", None)]),
            ("100000", ["KODEX 200"], "Warrant", None, None, [("NON_STOCK", None)]), ("100000", ["A", "에이 리츠", "비 스팩"], None, "64201", None,
                                                                                [("REIT", "에이 리츠"), ("INFRA_FUND", None), ("SPAC", "비 스팩")]),
            ("100000", None, None, None, None, []), (None, [], None, None, None, [])]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "id int, ticker string, names array<string>, instrument string, industry string, check_suffix boolean")
    got = {r["id"]: [tuple(x) for x in r["rejections"]] for r in fl.screen_names(df).collect()}
    assert [got[i] for i in range(len(rows))] == [r[5] for r in rows]


def test_companies_are_listed_by_ticker_or_name_and_profiled(spark, tmp_path):
    (tmp_path / "111110.json").write_text(json.dumps(dataset()))
    good, _ = rd.read_dataset_files(spark, str(tmp_path))
    found = lambda term: [r["ticker"] for r in fl.list_companies(good, term).collect()]
    assert found(None) == found(" TEST ") == found("1111") == ["111110"] and found("110") == found("9") == []
    profile = fl.company_profiles(good).first()
    assert [m["latest_observation"] for m in profile["markets"]] == ["2025Q4"] and [p["market_id"] for p in profile["products"]] == ["m1"]
    assert profile["financials_quarter"] == "2025Q4" and profile["quote"]["priceKRW"] == 50000 and len(profile["sources"]) == 1


def test_statement_sets_are_dealt_before_their_rows_are_made(spark, tmp_path):
    from strandline import plans
    from strandline.plans import sources
    plans.load()
    spark.createDataFrame([(1, 10.0), (2, None), (1, 10.0), (None, 5.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    out = sources.funding_plan(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "hashpartitioning(company" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert sorted((r["company"] or 0, r["opening_cash"], r["unavailable_code"]) for r in out.collect() if r["company"] != 2) == [
        (0, 60000.0, None), (1, 80000.0, "FUNDING_DEBT_ROWS_AMBIGUOUS")]
