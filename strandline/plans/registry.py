"""Named queries over the driver tables, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import stage, stage_by

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rounding for comparisons is offset a little from one half: inputs lie on decimal grids, so an exact tie is common and
# would turn the last bit of a differently ordered sum into a difference.
ROUND_OFFSET = 0.5003719


def stable(c: Column | str, digits: int = 6) -> Column:
    scale = float(10**digits)
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(scale) + F.lit(ROUND_OFFSET)).cast("double") / F.lit(scale)


def sql_rnd(expr: str, digits: int = 6) -> str:
    """SQL twin of `stable`."""
    scale = f"CAST({float(10**digits):.1f} AS DOUBLE)"
    return f"floor(CAST(({expr}) AS DOUBLE) * {scale} + CAST({ROUND_OFFSET} AS DOUBLE)) / {scale}"


def rounded(df: DataFrame, keys: list, values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[stable(v, digits).alias(v) for v in values])


def sql_rounded(keys: list[str], values: list[str], source: str, digits: int = 6) -> str:
    columns = keys + [f'{sql_rnd(chr(34) + v + chr(34), digits)} AS "{v}"' for v in values]
    return f"SELECT {', '.join(columns)} FROM {source}"


def ctes(*parts: str) -> str:
    """WITH clause from CTE fragments, each 'name AS (...)'; repeated fragments are kept once."""
    seen: list[str] = []
    for part in parts:
        if part.strip() not in seen:
            seen.append(part.strip())
    return "WITH " + ",\n".join(seen) + "\n"


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def _state(spark: SparkSession, folder: str) -> str:
    """Digest of the tables' files as the input's own file system lists them, one level of part files included."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []
    for entry in system.listStatus(path):
        files = system.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        seen += [f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in files]
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def staged(spark: SparkSession, sf: str, name: str, build, *by: str) -> DataFrame:
    """A table several queries of one application share, written once to the shared folder, in buckets of the columns `by` if any.
    The key holds the state of the input files (name, length, time of change), so a changed table is staged anew."""
    key = (spark.sparkContext.applicationId, sf, _state(spark, sf), name)
    if key not in _STAGED:
        _STAGED[key] = stage_by(build(), name, *by) if by else stage(build(), name)
    return _STAGED[key]
