"""Helpers for keyed work: whole groups of a sorted stream, and connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import stage


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together and in order of the keys, for `whole_groups`. The partition count is given, so adaptive
    execution does not merge partitions whose cost is computation."""
    spark = df.sparkSession
    width = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(width, *keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that hold whole groups only, with the position of each group's first row and, last, the frame's length."""
    held: pd.DataFrame | None = None
    for batch in batches:
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        starts = _starts(frame, keys)
        if len(starts) > 1:
            yield frame.iloc[:starts[-1]], starts
            frame = frame.iloc[starts[-1]:]
        held = frame.reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.append(_starts(held, keys), len(held))


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    changed = np.zeros(len(frame), bool)
    changed[:1] = True
    for key in keys:
        values = frame[key].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each of n items' components under the links left[i]-right[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of a link between two different nodes; root is the component's smallest node.

    Alternating large and small stars: every round joins each node to the least of its neighbourhood, so that chains shorten
    by half, until each component is a star. A hub's links are reduced by partial aggregation and joined back, never
    gathered. Each round is written to the shared folder.
    """
    edges = stage(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "links")
    mark = None
    while True:
        both = edges.selectExpr("hi AS u", "lo AS v").unionByName(edges.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS hi", "m AS lo").distinct()
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(roots, "hi").selectExpr("lo AS hi", "m AS lo").unionByName(roots.selectExpr("hi", "m AS lo"))
        edges = stage(small.where("hi <> lo").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("x")).first()
        if tuple(now) == mark:
            return edges.selectExpr("hi AS node", "lo AS root").unionByName(
                edges.selectExpr("lo AS node", "lo AS root").distinct())
        mark = tuple(now)


def linked_classes(classes: DataFrame, verified: DataFrame) -> DataFrame:
    """(class, class_id, n_links, n_copies) from classes of copies (class, rep, n) and verified rows (class, links, other):
    `links` counts documents linked to the class, `other` is a class of its local component. class_id is the least rep that
    links reach; the links of copies among themselves are n - 1 for each."""
    joined = components(verified.where("class <> other"), "class", "other")
    members = (classes.select("class", "rep", "n")
               .join(verified.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
               .join(joined.withColumnRenamed("node", "class"), "class", "left")
               .withColumn("root", F.coalesce("root", "class")))
    names = members.groupBy("root").agg(F.min("rep").alias("class_id"))
    return members.join(names, "root").select(
        "class", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        (F.col("n") - 1).alias("n_copies"))
