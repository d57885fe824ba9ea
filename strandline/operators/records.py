"""Append-only records: hash, integrity, time guard, revision chain, resolution at a decision time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import content_hash
from strandline.operators.rules import union_all

# Record modes and evidence from weakest to strongest claim.
MODES, EVIDENCE_ORDER = ("forward", "historical_import_unverified"), ("forward", "historical_import_unverified", "synthetic")


def with_hash(records: DataFrame, payload: list[str]) -> DataFrame:
    return records.withColumn("content_hash", content_hash(payload))


def append(existing: DataFrame, incoming: DataFrame, arrival: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the first of an id is accepted unless the id is stored already, every other row is refused.

    First by recording time, then arrival (a column, where there is one), then content; rows equal in all are one another's
    repeats, all but one of them refused."""
    order = ["recorded_at", *([arrival] if arrival else []), *(["content_hash"] if "content_hash" in incoming.columns else [])]
    ranked = incoming.withColumn("_turn", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    known = ranked.join(existing.select("id", F.lit(True).alias("_stored")).distinct(), "id", "left")
    wins = (F.col("_turn") == 1) & F.col("_stored").isNull()
    return (known.where(wins).select(*incoming.columns),
            known.where(~wins).select(*incoming.columns, F.lit("RECORD_ID_CONFLICT").alias("code")))


def audit(records: DataFrame, payload: list[str]) -> DataFrame:
    """(id, code) of stored records that no longer satisfy the envelope rules."""
    def bad(condition, code):
        return records.where(F.coalesce(condition, F.lit(False))).select("id", F.lit(code).alias("code"))

    return union_all([
        bad(F.col("content_hash") != content_hash(payload), "HASH_MISMATCH"), bad(~F.col("mode").isin(*MODES), "UNKNOWN_MODE"),
        bad((F.col("mode") == "historical_import_unverified") & F.col("archive_source").isNull(), "ARCHIVE_SOURCE_MISSING"),
        bad(F.col("synthetic") & (F.col("mode") != "historical_import_unverified"), "SYNTHETIC_MODE")])


def time_guard(records: DataFrame, times: list[str]) -> DataFrame:
    """Forward records containing an observation later than their recording."""
    late = F.array_max(F.array(*times)) > F.col("recorded_at")
    return records.where((F.col("mode") == "forward") & late).select("id", F.lit("RECORD_FROM_FUTURE").alias("code"))


def revision_problems(records: DataFrame) -> DataFrame:
    """Revisions of unknown records or of another ticker's record."""
    prior = records.select(F.col("id").alias("supersedes"), F.col("ticker").alias("prior_ticker"))
    rows = records.where(F.col("supersedes").isNotNull()).join(prior, "supersedes", "left")
    code = F.when(F.col("prior_ticker").isNull(), "RECORD_NOT_FOUND").when(F.col("prior_ticker") != F.col("ticker"), "REVISION_TICKER_MISMATCH")
    return rows.select("id", code.alias("code")).where(F.col("code").isNotNull())


def resolve(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Each (request_id, id, decision_at) with its record, or the reason it may not be used."""
    joined = requests.join(records.select("id", "mode", "synthetic", "recorded_at", "ticker", "content_hash"), "id", "left")
    code = (F.when(F.col("recorded_at").isNull(), "RECORD_NOT_FOUND")
            .when((F.col("mode") == "forward") & (F.col("decision_at") < F.col("recorded_at")), "FORWARD_RECORD_NOT_YET_AVAILABLE"))
    evidence = F.when(F.coalesce("synthetic", F.lit(False)), "synthetic").otherwise(F.col("mode"))
    return joined.withColumns({"code": code, "evidence_mode": evidence})


def evidence_mode(resolved: DataFrame) -> DataFrame:
    """Weakest evidence over a request's inputs: synthetic over historical over forward."""
    order = F.array_position(F.array(*[F.lit(m) for m in EVIDENCE_ORDER]), F.col("evidence_mode"))
    return resolved.groupBy("request_id").agg(F.max_by("evidence_mode", order).alias("evidence_mode"), F.count("*").alias("inputs"))


def chronological(records: DataFrame) -> DataFrame:
    """Records in the order they were written."""
    return records.orderBy("recorded_at", "id")
