import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import features as ft
from strandline.operators import folds as fd
from strandline.operators import learners, panel
from strandline.operators import backtest as bt
from strandline.operators.regression import grouped_logistic, grouped_ridge

START = dt.date(2020, 1, 1)
BAR = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars(spark, closes, ticker="T"):
    rows = [(ticker, START + dt.timedelta(days=i), None, None, None, float(c), 100.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def closes(df):
    return [r["close"] for r in df.orderBy("date").collect()]


def test_split_is_folded_into_earlier_bars(spark):
    out = panel.adjust_corporate_actions(bars(spark, [100000, 101000, 20400, 20600])).orderBy("date").collect()
    assert [round(r["close"]) for r in out] == [20198, 20400, 20400, 20600]
    assert out[0]["volume"] == pytest.approx(100 / (20400 / 101000))


def test_other_jump_truncates_history(spark):
    out = panel.adjust_corporate_actions(bars(spark, [10000, 10100, 18200, 18000]))
    assert closes(out) == [18200, 18000] and out.first()["truncated_before"] == START + dt.timedelta(days=2)


def test_move_inside_the_daily_limit_is_left_alone(spark):
    assert closes(panel.adjust_corporate_actions(bars(spark, [1000, 701, 700]))) == [1000, 701, 700]


def test_only_splits_after_the_last_reset_count(spark):
    assert closes(panel.adjust_corporate_actions(bars(spark, [100, 50, 90, 91, 45.5]))) == [45.0, 45.5, 45.5]


def test_asof_inclusive_and_strict(spark):
    left = spark.createDataFrame([("A", START + dt.timedelta(days=i)) for i in range(4)], "index_name string, date date")
    right = spark.createDataFrame([("A", START + dt.timedelta(days=i), v) for i, v in ((0, 1400.0), (1, 1410.0), (2, 1420.0))], "index_name string, date date, close double")
    get = lambda strict: [r["fx"] for r in panel.align_series(left, right, "fx", strict=strict).orderBy("date").collect()]
    assert get(True) == [None, 1400.0, 1410.0, 1420.0] and get(False) == [1400.0, 1410.0, 1420.0, 1420.0]


@pytest.mark.parametrize("minute, kept", [("06:39:00", 2), ("06:40:00", 3)])
def test_session_is_final_at_1540_in_korea(spark, minute, kept):
    now = F.lit(f"2020-01-03 {minute}").cast("timestamp")
    assert panel.drop_unfinished_session(bars(spark, [1, 2, 3]), now).count() == kept


def random_panel(spark, n, tickers=4, seed=3, phi=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    index = 1000 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    for k in range(tickers):
        r, last = [], 0.0
        for _ in range(n):
            last = phi * last + rng.normal(0, 0.02)
            r.append(last)
        price = 100 * np.exp(np.cumsum(r))
        for i in range(n):
            rows.append((f"T{k}", START + dt.timedelta(days=i), price[i] * 0.99, price[i] * 1.01, price[i] * 0.98, price[i], float(rng.integers(50, 500)),
                         float(index[i]), 1200.0 + i, float(rng.integers(-50, 50)), float(rng.integers(-50, 50))))
    schema = BAR + ", idx double, fx double, foreign_flow double, organ_flow double"
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema)


def test_features_never_read_later_rows(spark):
    full = random_panel(spark, 200)
    cut = START + dt.timedelta(days=150)
    a = ft.features(panel.log_returns(full)).where(F.col("date") <= cut).select("ticker", "date", *ft.FEATURES).orderBy("ticker", "date").toPandas()
    b = ft.features(panel.log_returns(full.where(F.col("date") <= cut))).select("ticker", "date", *ft.FEATURES).orderBy("ticker", "date").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_features_against_pandas(spark):
    out = ft.features(panel.log_returns(random_panel(spark, 140, tickers=1))).orderBy("date").toPandas()
    ret = np.log(out["close"]).diff()
    np.testing.assert_allclose(out["vol20"], ret.rolling(20, min_periods=2).std(), rtol=1e-9)
    np.testing.assert_allclose(out["ma60Gap"], out["close"] / out["close"].rolling(60).mean() - 1, rtol=1e-9, atol=1e-12)
    idx = np.log(out["idx"]).diff()
    beta = ret.rolling(60, min_periods=30).cov(idx) / idx.where(ret.notna()).rolling(60, min_periods=30).var()
    np.testing.assert_allclose(out["beta60"], beta, rtol=1e-7)
    np.testing.assert_allclose(out["foreign5"], out["foreign_flow"].rolling(5).sum() / (out["volume"].rolling(20, min_periods=10).mean() * 5), rtol=1e-9)


def test_logistic_gradient_vanishes_and_ridge_solves_the_normal_equations():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(400, 3)), rng.uniform(0.5, 1.5, 400)
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    beta = learners.logistic(x, y, 4.0, w, steps=30)
    p = learners.sigmoid(x @ beta[:-1] + beta[-1])
    assert np.abs(x.T @ ((p - y) * w) + 4.0 * beta[:-1]).max() < 1e-8 and abs(((p - y) * w).sum()) < 1e-8
    r = learners.ridge(x, y, 4.0, w)
    err = (x @ r[:-1] + r[-1] - y) * w
    assert np.abs(x.T @ err + 4.0 * r[:-1]).max() < 1e-8 and abs(err.sum()) < 1e-9


def test_boosting_finds_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0)).astype(float)
    trees, edges = learners.boost(x, y, np.ones(len(y)))
    p = learners.boosted_probability(np.asarray(trees), edges, x)
    assert p[y == 1].mean() > p[y == 0].mean() + 0.4


def test_distributed_fits_equal_the_kernels(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.repeat([1, 2], 300), "a": rng.normal(size=600), "b": rng.normal(size=600), "w": rng.uniform(0.5, 2, 600)})
    pdf["y"] = (pdf["a"] + rng.normal(size=600) > 0).astype(float)
    df = spark.createDataFrame(pdf)
    lg = {r["k"]: r["coef"] for r in grouped_logistic(df, ["k"], ["a", "b"], "y", "w", lam_per_row=1e-3).collect()}
    rd = {r["k"]: r["coef"] for r in grouped_ridge(df, ["k"], ["a", "b"], "y", "w", 1e-3).collect()}
    for k, g in pdf.groupby("k"):
        x, y, w = g[["a", "b"]].to_numpy(), g["y"].to_numpy(), g["w"].to_numpy()
        np.testing.assert_allclose(lg[k], learners.logistic(x, y, 0.3, w, 30), atol=1e-8)
        np.testing.assert_allclose(rd[k], learners.ridge(x, y, 0.3, w), atol=1e-9)


def test_windows_schedule_and_backtest_on_a_planted_signal(spark):
    """AR(1) returns: windows equal brute force, and the walk-forward detects the edge without reading ahead."""
    data = panel.log_returns(random_panel(spark, 460, tickers=3, seed=11, phi=0.35))
    rows = fd.long_samples(ft.samples(data)).where(F.col("horizon") == 1).persist()
    o = fd.FoldOptions(max_train=500)
    schedule = fd.fold_schedule(rows, o.min_train, o.step)
    folds = fd.fold_table(schedule)
    pdf = rows.select("ticker", "date", "end_date").toPandas().sort_values(["date", "ticker"])
    got = fd.training_windows(rows, folds, 500).select("fold", "ticker", "date").toPandas()
    for f in folds.collect():
        known = pdf[pdf["end_date"].notna() & (pdf["end_date"] <= f["fold_date"])].tail(500)
        mine = got[got["fold"] == f["fold"]]
        assert set(map(tuple, mine[["ticker", "date"]].to_numpy())) == set(map(tuple, known[["ticker", "date"]].to_numpy()))
    oos = fd.walk_forward(rows, o).persist()
    stats = bt.backtest_stats(oos.withColumn("p", (F.col("p") + F.col("pg")) / 2)).where("ticker = 'ALL'").first()
    assert 0.55 < stats["accuracy"] < 0.75 and stats["edge"] == "detected"
    stacked = fd.stack(oos, o)
    assert stacked.count() == oos.count() and stacked.where("p is null or p <= 0 or p >= 1").count() == 0


def test_calendar_series_are_seen_on_or_before_and_strictly_before(spark):
    bars = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("a", "x", 4), ("a", "y", 2), ("c", "x", 2)], "ticker string, index_name string, d int")
    bars = bars.selectExpr("ticker", "index_name", "date_add(DATE '2025-01-01', d) AS date", "7 AS idx_extra")
    index = spark.createDataFrame([("x", 0, 10.0), ("x", 2, 12.0), ("x", 3, None), ("y", 3, 99.0)], "index_name string, d int, close double")
    index = index.selectExpr("index_name", "date_add(DATE '2025-01-01', d) AS date", "close")
    out = panel.align_calendar(bars, [(index, "idx", False), (index, "fx", True)])
    got = sorted((r["ticker"], r["index_name"], r["date"].day, r["idx"], r["fx"]) for r in out.collect())
    assert got == [("a", "x", 2, 10.0, 10.0), ("a", "x", 5, 12.0, 12.0), ("a", "y", 3, None, None), ("b", "x", 3, 12.0, 10.0), ("c", "x", 3, 12.0, 10.0)]
    assert panel.align_calendar(bars.where("false"), [(index, "idx", False)]).count() == 0


def test_samples_take_one_scan_of_the_lines_and_few_shuffles(spark):
    from strandline import plans
    from strandline.plans import market
    from strandline.operators import features as ft
    plans.load()
    plan = ft.samples(market.ready_bars(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("Exchange hashpartitioning") < 12
    assert market.daily(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_peers_are_cut_from_a_list_not_sorted_per_target(spark):
    rows = spark.createDataFrame([(1, "x", 5.0), (2, "x", 9.0), (3, "x", 9.0), (4, "x", None), (5, "y", 1.0), (6, None, 1.0), (None, "x", 7.0)], "ticker long, exchange string, market_cap double")
    twice = rows.where("ticker = 3").unionByName(spark.createDataFrame([(1, "y", 0.0)], rows.schema))
    out = panel.peer_pool(rows, rows.unionByName(twice), 2)
    got = {t: [(r["exchange"], r["peer"]) for r in sorted(out.collect(), key=lambda r: r["peer_rank"]) if r["ticker"] == t] for t in range(1, 7)}
    assert sorted(got[1]) == [("x", 2), ("y", 5)] and got[2] == [("x", 3)] and got[3] == [("x", 2), ("x", 2)]
    assert got[4] == [("x", 2), ("x", 3)] and got[5] == got[6] == []
    first = out._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")[0]
    assert "posexplode" in out._jdf.queryExecution().optimizedPlan().toString() and "Sort" not in first and "Window" not in first
