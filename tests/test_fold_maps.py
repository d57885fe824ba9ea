import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import fold_maps as fm
from strandline.operators import folds as fd
from strandline.operators import learners


@pytest.fixture(scope="module")
def predictions(spark):
    draw = np.random.default_rng(8)
    n = 900
    day = np.sort(draw.integers(0, 120, n))
    pdf = pd.DataFrame({"horizon": 1, "ticker": [f"T{i % 7}" for i in range(n)], "day": day, "end_day": day + 1, "p": draw.uniform(0.2, 0.8, n), "pg": draw.uniform(0.2, 0.8, n),
                        "r": draw.normal(size=n), "ret1": draw.normal(size=n), "past": np.where(draw.random(n) < 0.1, np.nan, draw.normal(size=n)), "actual": draw.normal(size=n)})
    frame = spark.createDataFrame(pdf.astype({"horizon": "int32", "day": "int32", "end_day": "int32"}))
    out = frame.withColumns({"past": F.when(~F.isnan("past"), F.col("past")), "date": F.date_from_unix_date("day"), "end_date": F.date_from_unix_date("end_day")}).drop("day", "end_day")
    return pdf, out.persist()


@pytest.mark.parametrize("few", [2000, 5])
def test_fold_quantiles_equal_numpy(spark, predictions, monkeypatch, few):
    monkeypatch.setattr(fm, "FEW", few)
    pdf, df = predictions
    rows = df.select("horizon", F.unix_date("end_date").alias("end_day"), "actual", F.round("r", 1).alias("r"))
    days = {1: (np.arange(5), np.array([3, 20, 60, 61, 119]))}
    for strict in (False, True):
        got = fm.fold_quantiles(rows, days, lambda h, c: c["r"][:, None] * np.array([1, 1, -2, 0, 1.0]) + np.array([0, 0, 0, 3, 0]), {"a": 0.01, "b": 0.5, "c": 0.9}, strict)[1]
        for i, day in enumerate(days[1][1]):
            known = pdf[pdf["end_day"] < day] if strict else pdf[pdf["end_day"] <= day]
            v = known["r"].round(1).to_numpy() * [1, 1, -2, 0, 1.0][i] + [0, 0, 0, 3, 0][i]
            np.testing.assert_allclose([got[k][i] for k in "abc"], np.quantile(v, [0.01, 0.5, 0.9]), atol=1e-9)


@pytest.mark.parametrize("few", [2000, 5])
def test_prefix_sums_and_quantiles_equal_numpy(spark, predictions, monkeypatch, few):
    monkeypatch.setattr(fm, "FEW", few)
    pdf, df = predictions
    rows = df.select("horizon", F.unix_date("end_date").alias("end_day"), "actual", F.round("r", 1).alias("r"))
    rows = rows.unionByName(rows.limit(3).withColumns({"end_day": F.lit(None).cast("int")})).unionByName(rows.limit(2).withColumn("horizon", F.lit(9)))
    days = {1: (np.arange(6), np.array([-5, 3, 20, 60, 61, 119]))}
    for strict in (False, True):
        sums = fm.prefix_sums(rows, days, {"n": F.lit(1), "a": F.col("actual")}, strict)[1]
        for column, series in (("actual", pdf["actual"]), ("r", pdf["r"].round(1))):
            got = fm.prefix_quantiles(rows, days, column, {"a": 0.01, "b": 0.5, "c": 0.99}, strict)[1]
            for i, day in enumerate(days[1][1]):
                known = pdf["end_day"] < day if strict else pdf["end_day"] <= day
                assert sums["n"][i] == known.sum() and abs(sums["a"][i] - pdf["actual"][known].sum()) < 1e-9
                want = np.quantile(series[known], [0.01, 0.5, 0.99]) if known.any() else np.full(3, np.nan)
                np.testing.assert_allclose([got[k][i] for k in "abc"], want, atol=1e-12)
    assert fm.prefix_sums(rows, {}, {"n": F.lit(1)}) == {} and fm.prefix_quantiles(rows, {}, "r", {"a": 0.5}) == {}


def test_second_stage_equals_a_fit_per_fold(spark, predictions):
    pdf, df = predictions
    o = fd.FoldOptions(meta_min_rows=100, step=20)
    folds = fd.fold_table(fd.fold_schedule(df, o.meta_min_rows, o.step))
    got = {r["fold"]: r for r in fd.fit_meta(df, folds, o).collect()}
    inputs = fd.meta_inputs(df).toPandas()
    weights = fd.fold_date_weights(df, folds, o.half_life).toPandas()
    assert len(got) == folds.count() > 3
    for f in folds.collect():
        known = inputs[inputs["end_date"] <= f["fold_date"]].merge(weights[weights["fold"] == f["fold"]], on=["horizon", "date"])
        lo, hi = np.quantile(known["actual"], [0.01, 0.99])
        n, w = len(known), known["weight"].to_numpy()
        reg = learners.ridge(known[["r", "m_move"]].to_numpy(), np.clip(known["actual"], lo, hi).to_numpy(), 1e-6 * n, w)
        cls = learners.logistic(known[["m_logit", "m_past", "m_last"]].to_numpy(), known["up"].to_numpy(), 1e-3 * n, w, 30)
        assert got[f["fold"]]["n"] == n
        np.testing.assert_allclose(got[f["fold"]]["reg"], reg, atol=1e-8)
        np.testing.assert_allclose(got[f["fold"]]["cls"], cls, atol=1e-7)
