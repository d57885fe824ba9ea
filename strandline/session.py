"""Session settings and the one way this library materialises a reused table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the session's `spark.checkpoint.dir`. Without one, only a local master gets a temporary
    folder: there driver and tasks are one process, on a cluster they would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage is cut, an executor loss costs no recompute,
    and the planner sees the real size of the table."""
    path = f"{stage_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As `stage`, stored in buckets of the keys, as a table of the session: joins and groups by them move nothing again. Rows that
    already lie by the keys are not moved for it either."""
    spark = df.sparkSession
    label = f"{name}-{uuid.uuid4().hex}"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(width, *keys).write.format("parquet").bucketBy(width, *keys).option("compression", "zstd").option(
        "path", f"{stage_dir(spark).rstrip('/')}/{label}").saveAsTable(label.replace("-", "_"))
    return spark.table(label.replace("-", "_"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys over every core. For work whose cost is computation, not bytes: adaptive execution would
    merge such small partitions into one task, an explicit count is left alone."""
    spark = df.sparkSession
    width = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(width, *keys)
