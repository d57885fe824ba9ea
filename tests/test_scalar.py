import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalar as sc
from strandline.functions.quantiles import grouped_quantiles
from strandline.operators import corpus as co
from strandline.operators import grounding as gr


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("x, digits, want", [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 1, 1.0), (-0.00000001, 6, 0.0)])
def test_round_half_up_towards_plus_infinity(spark, x, digits, want):
    assert one(spark, sc.rnd(F.lit(x), digits))[0] == want


def test_quarters_round_trip(spark):
    row = one(spark, sc.quarter_index(F.lit("2026-02-10").cast("date")), sc.format_quarter(F.lit(8104)), sc.parse_quarter(F.lit("2026Q1")),
              sc.quarter_end(F.lit(8104)).cast("string"), sc.quarter_start(F.lit(8107)).cast("string"))
    assert tuple(row) == (8104, "2026Q1", 8104, "2026-03-31", "2026-10-01")


@pytest.mark.parametrize("end, months, label, exact", [("2025-06-30", 3, "2025Q2", True), ("2025-09-30", 6, "2025Q2~2025Q3", True),
                                                       ("2025-07-26", 3, "2025Q2", False), ("2025-12-31", 12, "2025Q1~2025Q4", True)])
def test_calendar_label(spark, end, months, label, exact):
    got = one(spark, *sc.calendar_label(F.lit(end).cast("date"), F.lit(months)))
    assert tuple(got) == (label, exact)


@pytest.mark.parametrize("text, ok", [("2026-02-28", True), ("2026-02-30", False), ("2026-2-1", False), ("", False)])
def test_valid_date(spark, text, ok):
    assert one(spark, sc.valid_date(F.lit(text)))[0] is ok


@pytest.mark.parametrize("text, ok", [("2026-01-15T09:00:00+09:00", True), ("2026-01-15T00:00:00Z", True), ("2026-02-30T10:00:00Z", False), ("2026-01-15 09:00:00", False)])
def test_valid_instant(spark, text, ok):
    assert one(spark, sc.valid_instant(F.lit(text)))[0] is ok


def test_date_only_cutoff_is_the_end_of_the_korean_day(spark):
    assert str(one(spark, sc.as_of_cutoff(F.lit("2026-01-15")).cast("string"))[0]) == "2026-01-15 14:59:59.999"


def test_p_value_matches_normal_tail(spark):
    got = one(spark, sc.p_value_above(F.lit(60.0), F.lit(100.0), 0.5))[0]
    assert got == pytest.approx(0.5 * math.erfc(2 / math.sqrt(2)), abs=2e-7)


def test_amounts_names_and_ids(spark):
    row = one(spark, sc.parse_amount(F.lit("1,234.5")), sc.parse_amount(F.lit("n/a")), sc.signed_amount(F.lit("+1,200")), sc.signed_amount(F.lit("-300")),
              sc.company_key(F.lit("(주)ＡＢＣ Motors")), sc.strip_tags(F.lit("<b>a &amp; b</b>&nbsp; c")), sc.parse_competitor_id(F.lit("us: mu")), sc.parse_competitor_id(F.lit("FR:1")))
    assert row[:6] == (1234.5, None, 1200.0, -300.0, "abcmotors", "a & b c")
    assert tuple(row[6]) == ("US", "MU") and row[7] is None


def test_quantiles_equal_numpy_at_every_size(spark):
    sizes = [*range(1, 60), 105, 199, 305, 500, 1003, 4001]
    rows = [(n, float((i * 7919) % n // 2)) for n in sizes for i in range(n)] + [(7, None)]
    probs = {"p01": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    got = grouped_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", probs).collect()
    assert sorted(r["k"] for r in got) == sizes
    values = {n: [v for k, v in rows if k == n and v is not None] for n in sizes}
    for r in got:
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values[r["k"]], p), abs=1e-9), (r["k"], name)


def test_floor_quantile_takes_the_lower_order_statistic(spark):
    assert spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double").agg(sc.floor_quantile("v", 0.5)).first()[0] == 2.0


@pytest.mark.parametrize("quote, number, want", [("매출 1,234억 원", "1,234", [1e8]), ("5백만 대", "5", [1e6]), ("3천만 원", "3", [0.0]), ("10 million and 10 won", "10", [1e6, 1.0]),
                                                 ("110 units", "10", []), ("1.10 units", "10", []), ("value 10.", "10", [1.0])])
def test_unit_after_the_number(spark, quote, number, want):
    assert one(spark, gr.unit_multipliers(F.lit(quote), F.lit(number)))[0] == want


@pytest.mark.parametrize("quote, want", [("2026Q4~2027Q3 컨센서스", [8107, 8108, 8109, 8110]), ("2026년 4분기", [8107]), ("2026-Q1 2026.Q2", [8104, 8105]), ("none", None)])
def test_horizon_in_a_quote(spark, quote, want):
    assert one(spark, gr.anchored_horizon(F.lit(quote)))[0] == want


def test_focus_keeps_lead_and_figures_in_order(spark):
    text = "\n".join(["lead " + "x" * 50, "y" * 200, "market 5% " + "z" * 60, "share 7% tail", "w" * 300])
    got = one(spark, co.focus_article(F.lit(text), 160, "market|share", r"\d%"))[0]
    assert got.split("\n") == [text.split("\n")[i] for i in (0, 2, 3)]


def test_focus_splits_a_text_once(spark):
    text = "\n".join(f"line {i} " + "word " * (i % 7) for i in range(3000))
    used, keep = 0, []
    for i, line in sorted(enumerate(text.split("\n")), key=lambda x: (-3 * (x[0] == 0) - ("9" in x[1]), x[0])):
        if (i == 0 or "9" in line) and used + len(line) + 1 <= 100:
            used, keep = used + len(line) + 1, sorted([*keep, i])
    df = spark.createDataFrame([(text,), ("a\n" * 30 + "b" * 90,), ("y" * 200 + "\nz",), (None,)], "t string").select(
        co.focus_article(F.col("t"), 100, "none", "9").alias("focused"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r[0] for r in df.collect()] == ["\n".join(text.split("\n")[i] for i in keep), "a", "y" * 100, None]


@pytest.mark.parametrize("demands, limit, level", [([10.0, 50.0, 100.0], 90.0, 40.0), ([10.0, 20.0], 100.0, 20.0), ([100.0, 100.0], 60.0, 30.0)])
def test_fair_level(spark, demands, limit, level):
    assert one(spark, co.fair_level(F.array(*[F.lit(d) for d in demands]), F.lit(limit)))[0] == pytest.approx(level)


def test_nested_and_unclosed_containers(spark):
    rows = [(1, "u", "<article><p>a</p><article>b</article>c</article>tail"), (2, "u", "<article>x<script>no</script><br>y"), (3, "u", "<p>none</p>")]
    got = {r["page_id"]: r["text"] for r in co.articles(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: "a\nb\nc", 2: "x\ny"}


def test_metrics_take_the_nearest_keyword(spark):
    docs = spark.createDataFrame([(1, "Market share rose to 31% while growth of 7% slowed. No words 5%.")], "doc_id long, text string")
    got = [(r["raw"], r["kind"]) for r in co.metric_candidates(co.sentences(docs), share=r"market\s*share", growth="growth").orderBy("sent_no", "k").collect()]
    assert got == [("31%", "market_share"), ("7%", "growth_rate")]
