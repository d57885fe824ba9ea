import datetime as dt
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.operators import forecast as fc
from strandline.operators import panel
from strandline.streaming import jobs, state

BARS = "ticker string, date date, close double, ingest_seq long"


def feed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def day(i):
    return dt.date(2026, 1, 1 + i)


def test_late_and_repeated_bars_last_arrival_wins(spark, tmp_path):
    batches = [[("A", day(0), 1.0, 1), ("A", day(2), 3.0, 2)], [("A", day(1), 2.0, 3)], [("A", day(0), 9.0, 4), ("A", day(0), 8.0, 5)]]
    stream = feed(spark, tmp_path, batches, BARS)
    jobs.ingest_bars(stream, f"{tmp_path}/bars", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    got = jobs.current_bars(spark, f"{tmp_path}/bars", stream.schema).orderBy("date").collect()
    batch = panel.last_arrival(spark.createDataFrame([r for b in batches for r in b], BARS)).orderBy("date").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in batch] and [r["close"] for r in got] == [8.0, 2.0, 3.0]


def test_forecasts_stay_pending_until_their_session_arrives(spark, tmp_path):
    batches = [[("A", day(0), 100.0, 1), ("A", day(1), 110.0, 2)], [("A", day(2), 50.0, 3)]]
    entries = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(0.7).alias("probability_up"), F.lit("up").alias("direction"), F.lit("low").alias("confidence"),
                                 F.lit(5.0).alias("expected_return_pct"), F.lit(-1.0).alias("range_lo"), F.lit(20.0).alias("range_hi")) for h in (1, 2, 3)])
    log = spark.createDataFrame([("A", day(0))], "ticker string, as_of_date date").withColumn("horizons", entries)
    stream = feed(spark, tmp_path, batches, BARS)
    jobs.score_arrivals(stream, log, f"{tmp_path}/bars", f"{tmp_path}/scores", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    bars = spark.createDataFrame([r for b in batches for r in b], BARS)
    batch = fc.score_log(log, bars)
    got = jobs.current_scores(spark, f"{tmp_path}/scores", jobs.score_schema(log)).select(*batch.columns)
    want = batch.where("status = 'scored'").orderBy("horizon").collect()
    assert [tuple(r) for r in got.orderBy("horizon").collect()] == [tuple(r) for r in want]
    assert [round(r["actual_return_pct"], 6) for r in want] == [10.0, -50.0] and [r["direction_hit"] for r in want] == [True, False]
    assert batch.where("status = 'pending'").count() == 1
    unknown = log.withColumn("as_of_date", F.lit(day(9)))
    assert {r["status"] for r in fc.score_log(unknown, bars).collect()} == {"unavailable"}
    summary = {r["level"]: r for r in fc.score_summary(batch).where("horizon is null and confidence is null").collect()}
    assert list(summary.values())[0]["n"] == 2 and list(summary.values())[0]["pending"] == 1


def test_records_are_stored_once_and_not_from_the_future(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    schema = "id string, ticker string, mode string, recorded_at timestamp, known_at timestamp"
    batches = [[("1", "A", "forward", at(5), at(4)), ("2", "A", "forward", at(5), at(6))], [("1", "B", "forward", at(7), at(1)), ("3", "A", "historical_import_unverified", at(5), at(9))]]
    stream = feed(spark, tmp_path, batches, schema)
    jobs.ingest_records(stream, ["ticker"], ["known_at"], f"{tmp_path}/rec", f"{tmp_path}/rej", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    read = lambda p, s: spark.read.schema(s).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{p}").collect()
    assert sorted((r["id"], r["ticker"]) for r in read("rec", "id string, ticker string")) == [("1", "A"), ("3", "A")]
    assert sorted((r["id"], r["code"]) for r in read("rej", "id string, code string")) == [("1", "RECORD_ID_CONFLICT"), ("2", "RECORD_FROM_FUTURE")]


def drop_last_commit(folder):
    commits = [f for f in os.listdir(f"{folder}/commits") if f.isdigit()]
    os.remove(f"{folder}/commits/{max(commits, key=int)}")
    crc = f"{folder}/commits/.{max(commits, key=int)}.crc"
    if os.path.exists(crc):
        os.remove(crc)


@pytest.mark.parametrize("restarts", [2])
def test_a_batch_that_was_written_but_not_committed_gives_the_same_rows_again(spark, tmp_path, restarts):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    schema = "id string, ticker string, mode string, recorded_at timestamp, known_at timestamp"
    batches = [[("1", "A", "forward", at(5), at(4))], [("1", "B", "forward", at(7), at(1)), ("3", "A", "forward", at(5), at(2))]]
    stream = feed(spark, tmp_path, batches, schema)
    bars = feed(spark, f"{tmp_path}/b", [[("A", day(0), 100.0, 1), ("A", day(1), 110.0, 2)], [("A", day(2), 50.0, 3)]], BARS)
    entries = F.array(F.struct(F.lit(1).alias("horizon"), F.lit(0.7).alias("probability_up"), F.lit("up").alias("direction"), F.lit("low").alias("confidence"),
                               F.lit(5.0).alias("expected_return_pct"), F.lit(-1.0).alias("range_lo"), F.lit(20.0).alias("range_hi")))
    log = spark.createDataFrame([("A", day(0)), ("A", day(1))], "ticker string, as_of_date date").withColumn("horizons", entries)
    for turn in range(1 + restarts):
        jobs.ingest_records(stream, ["ticker"], ["known_at"], f"{tmp_path}/rec", f"{tmp_path}/rej", f"{tmp_path}/cp", availableNow=True).awaitTermination()
        jobs.score_arrivals(bars, log, f"{tmp_path}/bars", f"{tmp_path}/scores", f"{tmp_path}/cp2", availableNow=True).awaitTermination()
        read = lambda p: spark.read.parquet(f"{tmp_path}/{p}").select("id").collect()
        assert sorted(r["id"] for r in read("rec")) == ["1", "3"] and [r["id"] for r in read("rej")] == ["1"]
        assert jobs.current_bars(spark, f"{tmp_path}/bars", bars.schema).count() == 3
        scores = jobs.current_scores(spark, f"{tmp_path}/scores", jobs.score_schema(log)).collect()
        assert sorted(round(r["actual_return_pct"], 4) for r in scores) == [-54.5455, 10.0]
        if turn < restarts:
            drop_last_commit(f"{tmp_path}/cp")
            drop_last_commit(f"{tmp_path}/cp2")


def test_a_late_bar_rescores_its_session(spark, tmp_path):
    batches = [[("A", day(0), 100.0, 1), ("A", day(2), 110.0, 2)], [("A", day(1), 50.0, 3)]]
    entries = F.array(F.struct(F.lit(1).alias("horizon"), F.lit(0.7).alias("probability_up"), F.lit("up").alias("direction"), F.lit("low").alias("confidence"),
                               F.lit(5.0).alias("expected_return_pct"), F.lit(-1.0).alias("range_lo"), F.lit(20.0).alias("range_hi")))
    log = spark.createDataFrame([("A", day(0))], "ticker string, as_of_date date").withColumn("horizons", entries)
    jobs.score_arrivals(feed(spark, tmp_path, batches, BARS), log, f"{tmp_path}/bars", f"{tmp_path}/scores", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    got = jobs.current_scores(spark, f"{tmp_path}/scores", jobs.score_schema(log)).collect()
    want = fc.score_log(log, spark.createDataFrame([r for b in batches for r in b], BARS)).collect()
    assert [round(r["actual_return_pct"], 4) for r in got] == [round(r["actual_return_pct"], 4) for r in want] == [-50.0]


def test_compaction_moves_readers_and_keeps_rows(spark, tmp_path):
    batches = [[("A", day(0), 1.0, 1), ("A", day(2), 3.0, 2)], [("A", day(2), 5.0, 3)], [("A", day(1), 2.0, 4)]]
    stream = feed(spark, tmp_path, batches, BARS)
    path = f"{tmp_path}/bars"
    jobs.ingest_bars(stream, path, f"{tmp_path}/cp", availableNow=True).awaitTermination()
    read = lambda: sorted(tuple(r) for r in jobs.current_bars(spark, path, stream.schema).collect())
    whole = read()
    jobs.compact_bars(spark, path, stream.schema, 1)
    assert read() == whole and [r[2] for r in whole] == [1.0, 2.0, 5.0]
    files = jobs.current_bars(spark, path, stream.schema).inputFiles()
    assert any("bars-base" in f for f in files) and spark.read.parquet(f"{path}-current").count() == 1
    jobs.compact_bars(spark, path, stream.schema, 2)
    assert read() == whole


def test_sessions_far_back_and_equal_arrivals(spark, tmp_path):
    newer = [("A", day(i), 100.0 + i, i) for i in range(10, 20)]
    batches = [newer, [("A", day(1), 50.0, 30), ("A", day(12), 60.0, 31), ("A", day(12), 61.0, 31), ("B", day(3), None, None)], [("A", day(1), 40.0, 29), (None, day(1), 1.0, 1)]]
    stream = feed(spark, tmp_path, batches, BARS)
    entries = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(0.7).alias("probability_up"), F.lit("up").alias("direction"), F.lit("low").alias("confidence"),
                                 F.lit(5.0).alias("expected_return_pct"), F.lit(-1.0).alias("range_lo"), F.lit(20.0).alias("range_hi")) for h in (1, 2, 3)])
    log = spark.createDataFrame([("A", day(i)) for i in range(20)], "ticker string, as_of_date date").withColumn("horizons", entries)
    jobs.score_arrivals(stream, log, f"{tmp_path}/bars", f"{tmp_path}/scores", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    bars = {r[1]: r[2] for r in newer} | {day(1): 50.0, day(12): 61.0}
    want = fc.score_log(log, spark.createDataFrame([("A", d, c) for d, c in bars.items()], "ticker string, date date, close double")).where("status = 'scored'")
    got = jobs.current_scores(spark, f"{tmp_path}/scores", jobs.score_schema(log))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_state_of_records_is_asked_by_bucket(spark, tmp_path, monkeypatch):
    """Every bucket holds many ids; each is judged by itself over batches that fold a bucket's list."""
    at = lambda h: dt.datetime(2026, 1, 1, h)
    monkeypatch.setattr(state, "BUCKETS", 2)
    schema = "id string, ticker string, mode string, recorded_at timestamp, known_at timestamp"
    batches = [[(str(i), "A", "forward", at(5), at(9 if i % 10 == 0 else 4)) for i in range(b * 20, b * 20 + 40)] + [(None, "A", "forward", at(5), at(4)), ("0", "B", "forward", at(6), at(4))]
               for b in range(3)]
    stream = feed(spark, tmp_path, batches, schema)
    jobs.ingest_records(stream, ["ticker"], ["known_at"], f"{tmp_path}/rec", f"{tmp_path}/rej", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    read = lambda p, s: spark.read.schema(s).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{p}").collect()
    stored, seen, rejects = set(), [], []
    for batch in batches:
        for i in dict.fromkeys(r[0] for r in batch):
            own = sorted((r for r in batch if r[0] == i), key=lambda r: r[3])
            code = "RECORD_ID_CONFLICT" if i in stored else "RECORD_FROM_FUTURE" if own[0][4] > own[0][3] else None
            rejects += ([(i, code)] if code else []) + [(i, "RECORD_ID_CONFLICT")] * (len(own) - 1)
            if code is None:
                stored.add(i)
                seen.append(i)
    by = lambda x: tuple(v or "" for v in x)
    assert sorted((r["id"] for r in read("rec", "id string")), key=lambda i: i or "") == sorted(seen, key=lambda i: i or "")
    assert sorted(((r["id"], r["code"]) for r in read("rej", "id string, code string")), key=by) == sorted(rejects, key=by)


def test_stored_ids_of_a_bucket_are_folded():
    class Kept:
        entries: list = []

        def get(self):
            return iter(list(self.entries))

        def put(self, values):
            self.entries = list(values)

        def appendValue(self, value):
            self.entries = [*self.entries, value]

    schema = StructType.fromDDL("id string, recorded_at timestamp, content_hash string, _late boolean, _bucket long")
    judge = state.FirstOfId(schema)
    judge.stored = Kept()
    row = Row(*schema.names)
    for i in range(2 * state.FOLDED):
        out = list(judge.handleInputRows((0,), iter([row(str(i), None, "h", False, 0), row(str(i // 2), None, "h", False, 0)]), None))
        assert [r["code"] for r in out] == ([None, "RECORD_ID_CONFLICT"] if i else ["RECORD_ID_CONFLICT", None])
    assert len(judge.stored.entries) <= state.FOLDED and sorted(int(x) for (ids,) in judge.stored.entries for x in ids) == list(range(2 * state.FOLDED))
