"""Structured Streaming jobs. Each equals its batch operator on the same input.

What a batch must know of earlier ones is keyed state (`streaming.state`, or a streaming aggregate), so its input is its own rows. A
micro-batch writes one folder, named by its id and replaced on a retry. `compact_bars` and `compact_scores` fold the folders written
so far into one table; one last row moves readers to it."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from strandline.functions.scalar import content_hash
from strandline.operators import forecast as fc
from strandline.operators import panel
from strandline.streaming import state

SCORE_KEYS = ["ticker", "as_of_date", "horizon"]
POINTER = "run string, through long"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed processors need; the session's own choice comes back after."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def _start(rows: DataFrame, step, checkpoint: str, trigger: dict) -> StreamingQuery:
    with _state_store(rows.sparkSession):
        return rows.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a folder, none before it is written."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows with the `batch` that wrote them: the compacted table in view and the folders of later batches."""
    full = StructType([*schema.fields]).add("batch", "long")
    newest = _read(spark, f"{path}-current", StructType.fromDDL(POINTER)).agg(F.max(F.struct("through", "run"))).first()[0]
    rows = _read(spark, path, full)
    if newest is None:
        return rows
    return spark.read.schema(full).parquet(f"{path}-base/{newest['run']}").unionByName(rows.where(F.col("batch") > newest["through"]))


def _compact(spark: SparkSession, path: str, rows: DataFrame, through: int) -> None:
    """Write the folded rows to a folder of their own, then one pointer row. A crash between leaves the earlier state in view."""
    run = uuid.uuid4().hex
    rows.where(F.col("batch") <= through).write.mode("errorifexists").parquet(f"{path}-base/{run}")
    spark.createDataFrame([(run, through)], POINTER).coalesce(1).write.mode("append").parquet(f"{path}-current")


def compact_bars(spark: SparkSession, path: str, schema: StructType, through: int) -> None:
    """Fold the bars of batches up to `through` (a committed batch) to one row per ticker and date."""
    rows = _stored(spark, path, schema).where(F.col("batch") <= through)
    _compact(spark, path, panel.latest_by(rows, ["ticker", "date"], [F.col("ingest_seq"), F.col("batch")]), through)


def compact_scores(spark: SparkSession, path: str, schema: StructType, through: int) -> None:
    """Fold the scores of batches up to `through` (a committed batch) to the latest of each forecast and horizon."""
    rows = _stored(spark, path, schema).where(F.col("batch") <= through)
    _compact(spark, path, panel.latest_by(rows, SCORE_KEYS, [F.col("batch")]), through)


def ingest_bars(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the last arrival of each ticker and date as bars (ticker, date, ..., ingest_seq) come in, late and repeated ones too.

    The last arrivals are the state of a streaming aggregate, combined before its shuffle; a batch writes the bars it touched."""
    bars = panel.latest_by(stream, ["ticker", "date"], [F.col("ingest_seq")]).select(*stream.columns)
    return _start(bars, lambda batch, batch_id: _write(batch, path, batch_id), checkpoint, trigger)


def current_bars(spark: SparkSession, path: str, schema: StructType, now=None) -> DataFrame:
    """Bars as of now: last arrival per ticker and date, today's unfinished session held back."""
    rows = panel.latest_by(_stored(spark, path, schema), ["ticker", "date"], [F.col("ingest_seq"), F.col("batch")]).drop("batch")
    rows = rows.select(*[f.name for f in schema])
    return rows if now is None else panel.drop_unfinished_session(rows, now)


def current_scores(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The latest score of each forecast and horizon: a later batch replaces what late bars changed."""
    return panel.latest_by(_stored(spark, path, schema), SCORE_KEYS, [F.col("batch")]).select(*[f.name for f in schema])


def score_arrivals(stream: DataFrame, log: DataFrame, bars_path: str, scores_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Score logged forecasts as their sessions arrive, and again where a late bar changes a score; read by `current_scores`.

    The sessions of a ticker are keyed state, which returns those whose bar or later bars changed. A batch writes them, then scores
    the forecasts made at them. Bars are stored as (ticker, date, close, ingest_seq); rows without ticker or date take no part."""
    scored_schema = score_schema(log)
    bars = stream.where("ticker IS NOT NULL AND date IS NOT NULL").select(
        "ticker", "date", F.col("close").cast("double").alias("close"), F.col("ingest_seq").cast("long").alias("ingest_seq"))
    windows = (bars.mapInPandas(state.combine_bars, state.BARS).groupBy("ticker")
               .transformWithState(state.Sessions(), state.WINDOWS, "Update", "None"))

    def step(batch: DataFrame, batch_id: int) -> None:
        _write(batch, bars_path, batch_id)
        moved = batch.sparkSession.read.schema(batch.schema).parquet(f"{bars_path}/batch={batch_id}")
        scores = fc.score_sessions(log.join(moved.select("ticker").distinct(), "ticker", "left_semi"), fc.session_windows_of(moved))
        _write(scores.where(F.col("status") == "scored").select(*scored_schema.names), scores_path, batch_id)

    return _start(windows, step, checkpoint, trigger)


def score_schema(log: DataFrame) -> StructType:
    return fc.score_log(log, log.sparkSession.createDataFrame([], "ticker string, date date, close double")).schema


def ingest_records(stream: DataFrame, payload: list[str], times: list[str], path: str, rejects_path: str, checkpoint: str,
                   **trigger) -> StreamingQuery:
    """Store new records with their hash; repeated ids and forward records from the future go to the reject folder.

    Stored ids are keyed state, by buckets of their hash. A record from the future is not stored, so its id may come again."""
    late = (F.col("mode") == "forward") & (F.array_max(F.array(*times)) > F.col("recorded_at"))
    rows = stream.withColumn("content_hash", content_hash(payload))
    schema = StructType([*rows.schema.fields])
    judged = (rows.withColumns({"_late": F.coalesce(late, F.lit(False)), "_bucket": F.pmod(F.xxhash64("id"), F.lit(state.BUCKETS))}).groupBy("_bucket")
              .transformWithState(state.FirstOfId(schema), StructType([*schema.fields]).add("code", StringType()), "Update", "None"))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # two folders from one run of the state
        _write(batch.where("code IS NULL").drop("code"), path, batch_id)
        _write(batch.where("code IS NOT NULL").select("id", "code"), rejects_path, batch_id)
        batch.unpersist()

    return _start(judged, step, checkpoint, trigger)
