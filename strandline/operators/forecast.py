"""Forecasts for the next sessions, their ranking, the forecast log and its scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.ranks import ranked
from strandline.functions.scalar import logit, pct, sigmoid
from strandline.operators import backtest as bt
from strandline.operators import folds as fd
from strandline.operators.features import HORIZONS
from strandline.operators.panel import MIN_HISTORY, latest_by

# Round-trip cost in percent, probability distance of high confidence, rows behind an own record.
ROUND_TRIP_COST_PCT, HIGH_CONFIDENCE, OWN_RECORD_ROWS = 0.25, 0.1, 120


def latest_rows(rows: DataFrame) -> DataFrame:
    """Newest row per (ticker, horizon)."""
    return latest_by(rows, ["ticker", "horizon"], [F.col("date")])


def final_models(rows: DataFrame, o: fd.FoldOptions) -> DataFrame:
    """First-stage models on the last `max_train` labelled rows."""
    return fd.fit_folds(fd.training_windows(rows, fd.final_fold(rows), o.max_train), o)


def forecast_rows(rows: DataFrame, first_stage: DataFrame, stacked: DataFrame, coverage: DataFrame, stats: DataFrame,
                  targets: DataFrame | None = None, o: fd.FoldOptions = fd.FoldOptions()) -> DataFrame:
    """One forecast per (ticker, horizon): calibrated probability, expected return, 80% range, confidence, actionable.

    `rows` are the long samples, `first_stage` and `stacked` the walk-forward tables, `stats` the backtest statistics."""
    newest = latest_rows(rows)
    if targets is not None:
        newest = newest.join(targets.select("ticker").distinct(), "ticker", "left_semi")
    models = final_models(rows, o)
    scored = fd.score_folds(newest.withColumns({"fold": F.lit(fd.FINAL_FOLD), "fwd": F.lit(None).cast("double"),
                                                "end_date": F.lit(None).cast("date")}), models, o)
    meta = fd.fit_meta(first_stage, fd.final_fold(first_stage), o)
    raw = fd.apply_meta(scored.join(meta.drop("n"), ["horizon", "fold"], "left"))
    platt = bt.platt(stacked).select("horizon", "a", "b")
    lines = bt.calibrate_returns(stacked, ["horizon"]).select("horizon", "slope", "icpt", "q_lo", "q_hi")
    closes = newest.select("ticker", "horizon", "close")
    joined = raw.join(platt, "horizon", "left").join(lines, "horizon", "left").join(closes, ["ticker", "horizon"])
    expected = (F.coalesce("icpt", F.lit(0.0)) + F.coalesce("slope", F.lit(0.0)) * F.col("r") / F.col("scale")) * F.col("scale")
    out = (joined
           .withColumn("raw_probability_up", F.col("p"))
           .withColumn("probability_up", F.coalesce(sigmoid(F.col("a") * logit("p") + F.col("b")), F.col("base_rate")))
           .withColumn("_exp", expected)
           .withColumn("expected_return_pct", pct("_exp"))
           .withColumn("range80_lo_pct", pct(F.col("_exp") + F.col("q_lo") * F.col("scale")))
           .withColumn("range80_hi_pct", pct(F.col("_exp") + F.col("q_hi") * F.col("scale")))
           .withColumn("expected_price", F.col("close") * F.exp("_exp")))
    return decide(out, stats, coverage).select(
        "ticker", "horizon", F.col("date").alias("as_of_date"), F.col("close").alias("last_close"), "probability_up",
        "raw_probability_up", F.when(F.col("probability_up") >= 0.5, "up").otherwise("down").alias("direction"),
        "confidence", "expected_return_pct", "range80_lo_pct", "range80_hi_pct", "expected_price", "actionable",
        "backtest_n", "backtest_accuracy", "range80_coverage", "edge")


def decide(forecasts: DataFrame, stats: DataFrame, coverage: DataFrame) -> DataFrame:
    """Edge, confidence and actionability: the pool decides whether there is an edge, a ticker keeps it unless its own
    record is worse than its own always-same-direction rule."""
    pooled = stats.where(F.col("ticker") == bt.POOLED).select("horizon", F.col("edge").alias("edge"))
    own = stats.where(F.col("ticker") != bt.POOLED).select(
        "ticker", "horizon", F.col("n").alias("backtest_n"), F.col("accuracy").alias("backtest_accuracy"),
        F.col("always_up_accuracy").alias("_up"))
    kept = F.coalesce(F.col("backtest_n") < OWN_RECORD_ROWS, F.lit(True)) | F.coalesce(
        F.col("backtest_accuracy") >= F.greatest(F.col("_up"), 1 - F.col("_up")), F.lit(True))
    has_edge = F.coalesce((F.col("edge") == "detected") & kept, F.lit(False))
    move = F.col("expected_return_pct")
    return (forecasts.join(pooled, "horizon", "left").join(own, ["ticker", "horizon"], "left")
            .join(coverage.select("ticker", "horizon", "range80_coverage"), ["ticker", "horizon"], "left")
            .withColumn("_edge", has_edge)
            .withColumn("confidence", F.when(~F.col("_edge"), "low")
                        .when(F.abs(F.col("probability_up") - 0.5) >= HIGH_CONFIDENCE, "high").otherwise("medium"))
            .withColumn("actionable", F.col("_edge") & (F.abs(move) > ROUND_TRIP_COST_PCT)
                        & ((F.col("probability_up") >= 0.5) == (move > 0))))


def ranking(forecasts: DataFrame, horizon: int, names: DataFrame | None = None) -> DataFrame:
    """Forecasts of one horizon by probability of a rise, then expected return; `names` adds name and exchange."""
    rows = forecasts.where(F.col("horizon") == horizon)
    if names is not None:
        rows = rows.join(names, "ticker", "left")
    group = ["exchange"] if "exchange" in rows.columns else ["horizon"]
    return ranked(rows, group, [F.desc("probability_up"), F.desc("expected_return_pct"), F.asc("ticker")])


def failures(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested tickers without a usable history and why."""
    sessions = bars.groupBy("ticker").agg(F.count("*").alias("sessions"))
    return (wanted.select("ticker").distinct().join(sessions, "ticker", "left")
            .where(F.coalesce("sessions", F.lit(0)) <= MIN_HISTORY)
            .select("ticker", F.coalesce("sessions", F.lit(0)).alias("sessions"),
                    F.when(F.col("sessions").isNull(), "not_loaded").otherwise("too_short").alias("reason")))


# ---- log -------------------------------------------------------------------------------------------------------


def log_records(forecasts: DataFrame, recorded_at) -> DataFrame:
    """One log record per (ticker, as-of date) with its horizons as an array."""
    entry = F.struct("horizon", "probability_up", "direction", "confidence", "expected_return_pct",
                     F.col("range80_lo_pct").alias("range_lo"), F.col("range80_hi_pct").alias("range_hi"))
    return (forecasts.groupBy("ticker", "as_of_date").agg(F.sort_array(F.collect_list(entry)).alias("horizons"),
                                                          F.max("last_close").alias("last_close"))
            .select(F.lit(recorded_at).cast("timestamp").alias("recorded_at"), "ticker", "as_of_date", "last_close", "horizons"))


def dedupe_log(log: DataFrame, seq: str = "seq") -> DataFrame:
    """The latest record per (ticker, as-of date)."""
    return latest_by(log, ["ticker", "as_of_date"], [F.col(seq)])


def session_windows(bars: DataFrame) -> DataFrame:
    """Each session with its close and, per horizon, the later session and its close."""
    order = Window.partitionBy("ticker").orderBy("date")
    return bars.select("ticker", F.col("date").alias("as_of_date"), F.col("close").alias("c0"), *[
        F.struct(F.lead("date", h).over(order).alias("date"), F.lead("close", h).over(order).alias("close")).alias(f"t{h}")
        for h in HORIZONS])


def session_windows_of(flat: DataFrame) -> DataFrame:
    """The same from rows that carry their later sessions (ticker, date, close, date1, close1, ...)."""
    return flat.select("ticker", F.col("date").alias("as_of_date"), F.col("close").alias("c0"), *[
        F.struct(F.col(f"date{h}").alias("date"), F.col(f"close{h}").alias("close")).alias(f"t{h}") for h in HORIZONS])


def score_log(log: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per logged horizon against the h-th later session of the same series."""
    return score_sessions(log, session_windows(bars))


def score_sessions(log: DataFrame, base: DataFrame) -> DataFrame:
    """One row per logged horizon against the sessions given as `session_windows` does."""
    rows = log.select("ticker", "as_of_date", F.explode("horizons").alias("h")).select("ticker", "as_of_date", "h.*")
    joined = rows.join(base, ["ticker", "as_of_date"], "left")
    target = F.lit(None)
    for h in HORIZONS:
        target = F.when(F.col("horizon") == h, F.col(f"t{h}")).otherwise(target)
    actual = (F.col("t.close") / F.col("c0") - 1) * 100
    lo, hi = F.col("range_lo"), F.col("range_hi")
    return (joined.withColumn("t", target)
            .withColumn("actual_return_pct", actual)
            .select("ticker", "as_of_date", "horizon",
                    F.when(F.col("c0").isNull(), "unavailable").when(F.col("t.close").isNull(), "pending")
                    .otherwise("scored").alias("status"), F.col("t.date").alias("target_date"), "actual_return_pct",
                    F.col("expected_return_pct").alias("predicted_return_pct"), "probability_up",
                    F.when(F.col("actual_return_pct") != 0, (F.col("probability_up") >= 0.5)
                           == (F.col("actual_return_pct") > 0)).alias("direction_hit"),
                    ((F.col("actual_return_pct") >= lo) & (F.col("actual_return_pct") <= hi)).alias("within_range80"),
                    "confidence"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Summary overall, by horizon and by confidence; status counts ride on every row."""
    done = F.col("status") == "scored"

    def share(c):
        return F.avg(F.when(done, F.when(c, 1.0).when(~c, 0.0)))

    up = F.when(F.col("actual_return_pct") > 0, 1.0).otherwise(0.0)
    return scores.groupingSets([[], ["horizon"], ["confidence"]], "horizon", "confidence").agg(
        F.grouping_id().alias("level"), F.count(F.when(done, 1)).alias("n"),
        F.count(F.when(F.col("status") == "pending", 1)).alias("pending"),
        F.count(F.when(F.col("status") == "unavailable", 1)).alias("unavailable"),
        share(F.col("direction_hit")).alias("direction_accuracy"),
        F.avg(F.when(done, F.abs(F.col("predicted_return_pct") - F.col("actual_return_pct")))).alias("mean_abs_error_pct"),
        share(F.col("within_range80")).alias("range80_coverage"),
        F.avg(F.when(done, F.pow(F.col("probability_up") - up, 2))).alias("brier"))
