"""Rule tables: many checks over one row set in a single pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken_rules(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """(keys, code) for every rule whose condition holds; an unknown condition does not fire."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(code)) for code, condition in rules]))
    return df.select(*keys, F.explode(fired).alias("code"))


def issues(df: DataFrame, keys: list[str], rules: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """(keys, code, path, message) for every (code, condition, path, message) whose condition holds."""
    fired = F.array_compact(F.array(*[
        F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), path.alias("path"), message.alias("message")))
        for code, condition, path, message in rules]))
    return df.select(*keys, F.explode(fired).alias("_i")).select(*keys, "_i.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
