"""Statistics and calibration of out-of-sample predictions (horizon, ticker, date, end_date, scale, p, r, base_rate,
actual, past). Per-ticker and pooled results come from one grouping-sets aggregate over the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.quantiles import grouped_quantiles
from strandline.functions.ranks import first_sums
from strandline.functions.scalar import clamp, logit, p_value_above, pct, tdiv
from strandline.operators import fold_maps as fm
from strandline.operators.folds import FoldOptions, fold_schedule, fold_table
from strandline.operators.regression import grouped_logistic
from strandline.session import stage

POOLED = "ALL"
# Reliability bins, share of confident predictions, effective sample and p-value behind an edge.
RELIABILITY_BINS = ((0.0, 0.45), (0.45, 0.5), (0.5, 0.55), (0.55, 1.0))
CONFIDENT_SHARE, EDGE_MIN_N, EDGE_P = 0.3, 100, 0.05
DISTANCE_BINS = 1_000_000


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def by_ticker_and_pooled(oos: DataFrame, extra: tuple[str, ...] = ()):
    """Grouping sets ((horizon), (horizon, ticker)), each with `extra` keys."""
    return oos.groupingSets([["horizon", *extra], ["horizon", "ticker", *extra]], "horizon", "ticker", *extra)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("ticker", F.coalesce("ticker", F.lit(POOLED)))


def confident_hits(oos: DataFrame) -> DataFrame:
    """Hit rate of the 30% of predictions farthest from one half (ties in (date, ticker) order), per ticker and pooled.

    The rows are not ranked: counts per narrow distance bin locate the bin holding the cut, counts per distance and date
    inside it the date, and its tickers are counted last."""
    far = F.abs(F.col("p") - 0.5)
    rows = oos.select("horizon", "ticker", "date", far.alias("far"), F.floor(far * DISTANCE_BINS).alias("bin"),
                      _flag((F.col("p") > 0.5) == (F.col("actual") > 0)).alias("hit"),
                      F.explode(F.array(F.col("ticker"), F.lit(POOLED))).alias("grp"))
    keys = ["horizon", "grp"]
    need = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count("*") * CONFIDENT_SHARE)).alias("need"))
    cut = first_sums(rows, keys, need, [[("bin", True)], [("far", True), ("date", False)], [("ticker", False)]], "hit")
    return cut.select("horizon", F.col("grp").alias("ticker"), (F.col("sum") / F.col("n")).alias("confident_accuracy"),
                      F.col("n").alias("confident_n"))


def backtest_stats(oos: DataFrame) -> DataFrame:
    """All backtest statistics per (horizon, ticker) and per horizon (ticker 'ALL')."""
    up, said_up = F.col("actual") > 0, F.col("p") > 0.5
    moved = F.coalesce(F.col("past") != 0, F.lit(False))
    realised = pct("actual")
    base = by_ticker_and_pooled(oos).agg(
        F.count("*").alias("n"), F.min("date").alias("from_date"), F.max("date").alias("to_date"),
        F.avg(_flag(said_up == up)).alias("accuracy"), F.avg(_flag(up)).alias("always_up_accuracy"),
        F.avg(F.when(moved, _flag((F.col("past") > 0) == up))).alias("momentum_accuracy"),
        F.avg(F.pow(F.col("p") - _flag(up), 2)).alias("brier"),
        F.avg(F.pow(F.col("base_rate") - _flag(up), 2)).alias("brier_base_rate"),
        F.avg(F.abs(pct("r") - realised)).alias("mean_abs_error_pct"),
        F.avg(F.abs(realised)).alias("zero_forecast_mae_pct"),
        (F.avg(F.when(said_up, realised)) - F.avg(F.when(~said_up, realised))).alias("up_down_spread_pct"))
    n_eff = F.greatest(F.lit(1.0), F.floor(F.col("n") / F.col("horizon")).cast("double"))
    climate = F.greatest(F.lit(0.5), F.col("always_up_accuracy"), 1 - F.col("always_up_accuracy"))
    best = F.greatest(climate, F.coalesce("momentum_accuracy", F.lit(0.0)))
    hits = F.col("accuracy") * n_eff
    stats = _named(base).withColumns({
        "p_value_vs_coin": p_value_above(hits, n_eff, 0.5),
        "p_value_vs_climatology": p_value_above(hits, n_eff, climate),
        "p_value_vs_best_baseline": p_value_above(hits, n_eff, best)})
    edge = (n_eff >= EDGE_MIN_N) & (F.col("p_value_vs_climatology") < EDGE_P) & (F.col("brier") < F.col("brier_base_rate"))
    stats = stats.withColumn("edge", F.when(edge, F.lit("detected")).otherwise(F.lit("none")))
    return stats.join(confident_hits(oos), ["horizon", "ticker"], "left")


def reliability(oos: DataFrame) -> DataFrame:
    """Predictions by probability bin: count, mean prediction, share that rose."""
    number = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(RELIABILITY_BINS))):
        inside = (F.col("p") >= lo) if hi == 1.0 else (F.col("p") >= lo) & (F.col("p") < hi)
        number = F.when(inside, F.lit(i)).otherwise(number)
    return _named(by_ticker_and_pooled(oos.withColumn("bin", number), ("bin",)).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg(_flag(F.col("actual") > 0)).alias("actual_up_rate")))


# ---- calibration -----------------------------------------------------------------------------------------------


def unit_moves(oos: DataFrame) -> DataFrame:
    return oos.withColumns({"zr": F.col("r") / F.col("scale"), "za": F.col("actual") / F.col("scale")})


def calibrate_returns(rows: DataFrame, keys: list[str], min_rows: int = 100) -> DataFrame:
    """Slope of realised on predicted (clamped to [0, 1]), intercept, 10%/90% residual quantiles, per key."""
    units = unit_moves(rows)
    line = (units.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(tdiv(F.covar_pop("za", "zr"), F.var_pop("zr")), F.lit(0.0)).alias("slope"),
        F.avg("zr").alias("_mx"), F.avg("za").alias("_my"))
        .where(F.col("n") >= min_rows)
        .withColumn("slope", clamp("slope", 0.0, 1.0))
        .withColumn("icpt", F.col("_my") - F.col("slope") * F.col("_mx")).drop("_mx", "_my"))
    residuals = units.join(line, keys).select(
        *keys, (F.col("za") - (F.col("icpt") + F.col("slope") * F.col("zr"))).alias("res"))
    return line.join(grouped_quantiles(residuals, keys, "res", {"q_lo": 0.1, "q_hi": 0.9}), keys)


def range_coverage(oos: DataFrame, o: FoldOptions = FoldOptions()) -> DataFrame:
    """Share of realised returns inside an 80% range built only from outcomes closed strictly before the row's date.

    Per fold the calibration line comes from sums per block of rows added along the folds, the band from quantiles of its residuals
    over one row per prediction."""
    schedule = stage(fold_schedule(oos, o.calibration_min_rows, o.step, strict=True), "coverage-folds")
    days = fm.fold_days(fold_table(schedule))
    units = unit_moves(oos)
    rows = stage(units.select("horizon", F.unix_date("end_date").alias("end_day"), "zr", "za"), "coverage-rows")

    x, y = F.when(F.col("za").isNotNull(), F.col("zr")), F.when(F.col("zr").isNotNull(), F.col("za"))
    sums = fm.prefix_sums(rows, days, {"n": F.lit(1), "m": F.when((x + y).isNotNull(), 1), "x": x, "y": y, "xx": x * x, "xy": x * y}, strict=True)
    line = {}
    for h, s in sums.items():
        m = np.maximum(s["m"], 1)
        mx, my = s["x"] / m, s["y"] / m
        var = s["xx"] / m - mx * mx
        slope = np.clip(np.divide(s["xy"] / m - mx * my, var, out=np.zeros_like(var), where=var > 0), 0.0, 1.0)
        line[h] = slope, my - slope * mx
    bands = fm.fold_quantiles(rows, days, lambda h, c: c["za"][:, None] - (line[h][1][None, :] + line[h][0][None, :] * c["zr"][:, None]),
                              {"q_lo": 0.1, "q_hi": 0.9}, strict=True)
    table = [(int(h), int(fold), float(line[h][0][i]), float(line[h][1][i]), float(bands[h]["q_lo"][i]), float(bands[h]["q_hi"][i]))
             for h, (folds, _) in days.items() for i, fold in enumerate(folds) if sums[h]["n"][i] >= o.calibration_min_rows]
    fitted = oos.sparkSession.createDataFrame(table, "horizon int, fold int, slope double, icpt double, q_lo double, q_hi double")
    scored = (units.join(schedule.select("horizon", "date", "fold"), ["horizon", "date"]).join(fitted, ["horizon", "fold"]))
    center = F.col("icpt") + F.col("slope") * F.col("zr")
    inside = F.col("za").between(center + F.col("q_lo"), center + F.col("q_hi"))
    return _named(by_ticker_and_pooled(scored.withColumn("_in", _flag(inside))).agg(
        F.count("*").alias("coverage_n"), F.avg("_in").alias("range80_coverage")))


def platt(oos: DataFrame, min_rows: int = 100) -> DataFrame:
    """Per horizon: slope and intercept of p' = sigmoid(a*logit(p) + b)."""
    rows = oos.select("horizon", logit("p").alias("x"), _flag(F.col("actual") > 0).alias("y"), F.lit(1.0).alias("w"))
    fitted = grouped_logistic(rows, ["horizon"], ["x"], "y", "w", lam=1e-3, steps=50)
    return (fitted.where(F.col("n") >= min_rows)
            .select("horizon", "n", F.col("coef")[0].alias("a"), F.col("coef")[1].alias("b")))

