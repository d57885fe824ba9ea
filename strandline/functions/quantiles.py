"""Exact interpolated quantiles per group without holding a large group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 1000


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """`keys` + one column per entry of `probs`, linearly interpolated between order statistics; nulls do not count.

    One way for groups of every size: a mergeable sketch brackets each quantile, rows inside the bracket are ranked, the rest
    are counted. The two order statistics of a quantile lie in its bracket or are the values next to it, so the greatest value
    below and the least above are kept with the counts."""
    rows = df.where(F.col(value).isNotNull())
    slack = 2.0 / SKETCH_ACCURACY
    brackets = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[
        F.percentile_approx(value, F.array(F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack))),
                            F.lit(SKETCH_ACCURACY)).alias(f"_b_{name}") for name, p in probs.items()])
    joined = rows.select(*keys, value).join(brackets, keys)
    tagged = joined.select(*keys, F.col(value).alias("_v"), "_n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"),
                 F.col(f"_b_{name}")[0].alias("lo"), F.col(f"_b_{name}")[1].alias("hi"))
        for name, p in probs.items()])).alias("q")).select(*keys, "_v", "_n", "q.*")
    zone = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), 1).otherwise(0)
    cells = (tagged.groupBy(*keys, "name", "p", "_n", zone.alias("_zone"), F.when(zone == 0, F.col("_v")).alias("_in"))
             .agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))
    order = Window.partitionBy(*keys, "name").orderBy("_zone", "_in").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_upto", F.sum("_c").over(order))
    at = F.col("p") * (F.col("_n") - 1)
    cell_value = F.when(F.col("_zone") < 0, F.col("_most")).otherwise(F.col("_least"))

    def order_statistic(position):
        return F.min(F.when(F.col("_upto") > position, cell_value))

    found = ranked.groupBy(*keys, "name").agg(order_statistic(F.floor(at)).alias("_lo"),
                                              order_statistic(F.ceil(at)).alias("_hi"), F.first(at).alias("_at"))
    exact = found.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at")))
    return exact.groupBy(*keys).pivot("name", list(probs)).agg(F.first("_q"))
