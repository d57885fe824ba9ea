"""Exact ranks and exact cuts within groups of any size, none of which is ordered in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import stage


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with the position (from 1) of each row in its group by `order`, which should tell all rows apart.

    Rows are cut into ranges of (keys, order) that are stored with their number, so a lost executor cannot move a row to another
    range. A window then holds one group of one range; what precedes a range is a running sum over its group's counts per range.
    Null keys are a group of their own."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(df, "unranked")  # finding the ranges reads them twice
    cut = stage(rows.repartitionByRange(width, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    counts = cut.groupBy("_range", *keys).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
                           F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r"))
    return local.join(starts, same).select(*df.columns, (F.col("_local") + F.col("_before")).cast("int").alias(name))


def first_sums(rows: DataFrame, keys: list[str], need: DataFrame, levels: list[list[tuple[str, bool]]], value: str) -> DataFrame:
    """(keys, sum, n): the sum of `value` over the first `need` rows of each group, in the order of the levels' columns (name,
    descending) one after another. `need` is (keys, need); columns of the levels and keys hold no nulls.

    Each level counts rows per cell of its columns inside the cell that held the last level's cut, takes the cells before the cut
    whole and hands the one that holds it on. Rows that the last level cannot tell apart are taken by equal value, greatest first."""
    levels = [*levels, [(value, True)]]
    edge, inside, parts = need, [], []
    for level in levels:
        cell = [name for name, _ in level]
        cells = (rows.join(edge, [*keys, *inside]).groupBy(*keys, *inside, *cell)
                 .agg(F.count("*").alias("_c"), F.sum(F.col(value)).alias("_s"), F.first("need").alias("need")))
        upto = Window.partitionBy(*keys).orderBy(*[F.desc(c) if down else F.asc(c) for c, down in level]).rowsBetween(Window.unboundedPreceding, 0)
        sized = cells.withColumn("_upto", F.sum("_c").over(upto))
        parts.append(sized.where(F.col("_upto") <= F.col("need")).select(*keys, "_s", "_c"))
        inside = [*inside, *cell]
        edge = (sized.where((F.col("_upto") > F.col("need")) & (F.col("_upto") - F.col("_c") < F.col("need")))
                .select(*keys, *inside, (F.col("need") - F.col("_upto") + F.col("_c")).alias("need")))
    parts.append(edge.select(*keys, (F.col(value) * F.col("need")).alias("_s"), F.col("need").alias("_c")))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("_s").alias("sum"), F.sum("_c").alias("n"))
