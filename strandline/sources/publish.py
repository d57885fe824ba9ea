"""Publishing several tables at once, and the daily forecast job that does so.

A run writes its tables into a folder of its own; the last write appends one row (day, run) to the list of published runs. Readers
take the run of the newest row, so a crash before that row leaves the earlier state in view, and a rerun of a day replaces it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import forecast as fc
from strandline.operators.rules import union_all
from strandline.session import stage

RUNS = "day date, run string, published_at timestamp"
EXCHANGES = ("KOSPI", "KOSDAQ")  # fixed values


def write_run(tables: dict[str, DataFrame], path: str) -> str:
    """The tables of one run in its own folder, in view of nobody yet."""
    run = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.mode("errorifexists").parquet(f"{path}/runs/{run}/{name}")
    return run


def publish(tables: dict[str, DataFrame], path: str, day: str) -> str:
    spark = next(iter(tables.values())).sparkSession
    run = write_run(tables, path)
    row = spark.createDataFrame([(day, run)], "day string, run string").select(F.to_date("day").alias("day"), "run", F.current_timestamp().alias("published_at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return run


def published_run(spark: SparkSession, path: str, day: str | None = None) -> str | None:
    """The run in view: the newest of the latest day, or of the day given; None before the first."""
    try:
        rows = spark.read.schema(RUNS).parquet(f"{path}/published")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    if day is not None:
        rows = rows.where(F.col("day") == F.to_date(F.lit(day)))
    return rows.agg(F.max_by("run", F.struct("day", "published_at", "run"))).first()[0]


def published(spark: SparkSession, path: str, name: str, day: str | None = None) -> DataFrame | None:
    run = published_run(spark, path, day)
    return None if run is None else spark.read.parquet(f"{path}/runs/{run}/{name}")


def daily_job(forecasts: DataFrame, names: DataFrame, log: DataFrame, bars: DataFrame, path: str, day: str, horizon: int = 1,
              exchanges: tuple[str, ...] = EXCHANGES) -> str:
    """Rank each exchange's forecasts of one horizon, append the day's forecasts to the log, score the log, summarise, publish.

    forecasts as `forecast.forecast_rows` gives them, names(ticker, exchange), log(seq, ticker, as_of_date, horizons). An exchange
    without forecasts is in the summary with none. The day's records come last and win over earlier ones of the same session."""
    ranked = stage(fc.ranking(forecasts, horizon, names).where(F.col("exchange").isin(*exchanges)), "daily-ranking")
    fresh = fc.log_records(forecasts, f"{day} 00:00:00").select(F.lit(1).alias("_day"), F.lit(0).cast("long").alias("seq"), "ticker", "as_of_date", "horizons")
    whole = log.select(F.lit(0).alias("_day"), F.col("seq").cast("long").alias("seq"), "ticker", "as_of_date", "horizons").unionByName(fresh)
    kept = stage(fc.dedupe_log(whole.withColumn("seq", F.struct("_day", "seq")).drop("_day")).drop("seq"), "daily-log")
    scores = stage(fc.score_log(kept, bars), "daily-scores")
    listed = forecasts.sparkSession.createDataFrame([(e,) for e in exchanges], "name string")
    counts = ranked.groupBy(F.col("exchange").alias("name")).agg(F.count("*").alias("n"))
    summary = union_all([
        listed.join(counts, "name", "left").select(F.lit("ranked").alias("section"), "name", F.coalesce("n", F.lit(0)).alias("n")),
        scores.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n")).select(F.lit("scores").alias("section"), "name", "n")])
    return publish({"ranking": ranked, "log": kept, "scores": scores, "score_summary": fc.score_summary(scores), "summary": summary}, path, day)
