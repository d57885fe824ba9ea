"""Approximate nearest neighbours by shifted Hilbert curves.

Equal vectors are one class, placed once; of its rows the k + 1 of least id are kept, which is all that k neighbours can need.
`fit_index` draws CURVES projections to a few dimensions, each with its own shift, and takes the bounds of BLOCKS key ranges per
curve from a bounded sample of the classes. Every class is indexed: it has a Hilbert key, and so a block, on every curve. A
query meets, on every curve, the classes of its own block and of the REACH nearest blocks that hold any to either side; the
nearest of each meeting are merged over the curves and ranked. Windows are shares of the table, so recall does not fall as the
table grows (isotropic vectors have no small window that holds their neighbours).

Classes and queries of every block are counted first and dealt in chunks of about CHUNK, so a task holds about CHUNK of either
kind at a time, whatever the table's size, its copies or the block. Pairs that tie near the k-th are worked out PAIRS numbers
at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.groups import clustered, whole_groups
from strandline.llm.vectors import matrix, numbered, usable
from strandline.session import stage

CURVES, DIMENSIONS, BITS = 24, 8, 7
BLOCKS, REACH = 64, 2
SAMPLE = 20_000  # most rows that bounds and scales are taken from
CHUNK = 2048
PAIRS = 4_000_000  # numbers of gathered vectors held at once
HOT = 1e-4  # share of the asking rows from which a class's list is broadcast to them


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (rows of `cells`) on the Hilbert curve of their dimension, as one integer each.

    Axes are turned to the transposed index by undoing the curve's rotations from the highest bit down, then Gray decoding.
    """
    axes = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        mask = q - 1
        for i in range(len(axes)):
            set_ = (axes[i] & q) != 0
            swap = np.where(set_, 0, (axes[0] ^ axes[i]) & mask)
            axes[0] ^= np.where(set_, mask, swap)
            if i:
                axes[i] ^= swap
        q >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    q = top
    while q > 1:
        flip ^= np.where((axes[-1] & q) != 0, q - 1, 0)
        q >>= 1
    axes ^= flip
    keys = np.zeros(axes.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << 1) | ((axis >> bit) & 1)
    return keys


@dataclass
class CurveIndex:
    """Projections, scales, shifts and block bounds of every curve: a fixed number of small arrays."""

    directions: np.ndarray  # curve, dimension, axis
    low: np.ndarray  # curve, axis
    width: np.ndarray
    shift: np.ndarray
    bounds: np.ndarray  # curve, block bound
    longest: float  # greatest norm of the sample

    def lifted(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """Largest inner product becomes least distance: rows get one more component that evens out their norms."""
        more = np.zeros(len(vectors)) if queries else np.sqrt(
            np.maximum(self.longest**2 - (vectors * vectors).sum(1), 0))
        return np.column_stack([vectors, more])

    def keys(self, vectors: np.ndarray, curve: int, queries: bool = False) -> np.ndarray:
        placed = (self.lifted(vectors, queries) @ self.directions[curve] - self.low[curve]) / self.width[curve]
        cells = (np.clip(placed, 0, 1) / 2 + self.shift[curve]) * ((1 << BITS) - 1)
        return hilbert_keys(cells.astype(np.int64), BITS)

    def blocks(self, vectors: np.ndarray, curve: int, queries: bool = False) -> np.ndarray:
        return np.searchsorted(self.bounds[curve], self.keys(vectors, curve, queries), side="right")


def fit_index(sample: np.ndarray, curves: int = CURVES, blocks: int = BLOCKS, seed: int = 11) -> CurveIndex:
    draw = np.random.default_rng(seed)
    dimension = sample.shape[1] + 1
    axes = min(DIMENSIONS, dimension)
    directions = np.stack([np.linalg.qr(draw.normal(size=(dimension, axes)))[0] for _ in range(curves)])
    index = CurveIndex(directions, np.zeros((curves, axes)), np.ones((curves, axes)), draw.uniform(0, 0.5, (curves, axes)),
                       np.zeros((curves, blocks - 1), np.int64), float(np.sqrt((sample * sample).sum(1).max())))
    lifted = index.lifted(sample, False)
    for c in range(curves):
        placed = lifted @ directions[c]
        index.low[c] = placed.min(0)
        index.width[c] = np.maximum(placed.max(0) - placed.min(0), 1e-12)
        index.bounds[c] = np.quantile(index.keys(sample, c), np.arange(1, blocks) / blocks, method="lower")
    return index


def _steps(filled: np.ndarray, own: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the blocks `own` have a filled block `step` filled ones further, and those blocks."""
    to = np.searchsorted(filled, own) + step
    inside = (to >= 0) & (to < len(filled))
    return inside, filled[to[inside]]


def _block_counter(index: CurveIndex, asks: bool):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = matrix(batch["vector"].tolist())
                for curve in range(len(index.bounds)):
                    block, n = np.unique(index.blocks(vectors, curve, asks), return_counts=True)
                    yield pd.DataFrame({"curve": curve, "block": block, "n": n})

    return count


def _placer(index: CurveIndex, reach: int, chunks: np.ndarray, query_chunks: np.ndarray):
    """Classes and queries, one line per curve, block and chunk where they meet. `chunks`, `query_chunks`: by curve and block."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = matrix(batch["vector"].tolist())
            asked = batch["asks"].to_numpy(bool)
            hashed = batch["hash"].to_numpy()
            for curve in range(len(index.bounds)):
                filled = np.flatnonzero(chunks[curve])
                out = []

                def meet(rows: pd.DataFrame, hashes: np.ndarray, block: np.ndarray, query: bool):
                    mine, other = (query_chunks, chunks) if query else (chunks, query_chunks)
                    each = other[curve][block]
                    at = np.repeat(np.arange(len(block)), each)
                    dealt = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
                    own = hashes[at] % np.maximum(mine[curve][block[at]], 1)
                    chunk, qchunk = (dealt, own) if query else (own, dealt)
                    out.append(rows.iloc[at].assign(curve=curve, block=block[at], chunk=chunk, qchunk=qchunk, query=query))

                meet(batch, hashed, index.blocks(vectors, curve), False)
                if asked.any():
                    asking, own = batch[asked], index.blocks(vectors[asked], curve, True)
                    for step in range(-reach, reach + 1):
                        inside, to = _steps(filled, own, step)
                        meet(asking[inside], hashed[asked][inside], to, True)
                yield pd.concat(out, ignore_index=True)[["curve", "block", "chunk", "qchunk", "query", "class", "rep", "vector"]]

    return place


def _searcher(most: int):
    """The `most` nearest classes of each query class of a meeting, itself among them; ties go to the class of the least id."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, ["curve", "block", "chunk", "qchunk"]):
            query, classes, reps, vectors = (frame[c].to_numpy() for c in ("query", "class", "rep", "vector"))
            for a, b in zip(starts[:-1], starts[1:]):
                asks, held = a + np.flatnonzero(query[a:b]), a + np.flatnonzero(~query[a:b].astype(bool))
                if not len(asks) or not len(held):
                    continue
                left, right = matrix(vectors[asks].tolist()), matrix(vectors[held].tolist())
                order = np.lexsort((classes[held], reps[held]))
                held, right = held[order], right[order]
                score = left @ right.T
                if len(held) > most:
                    least = -np.partition(-score, most - 1, axis=1)[:, most - 1]
                    # A little below the last: products are taken again in one fixed order, so that they tie the same everywhere.
                    score = score >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None]
                else:
                    score = np.ones(score.shape, bool)
                wide = max(1, PAIRS // left.shape[1])
                found = []
                for q, near in enumerate(map(np.flatnonzero, score)):
                    exact = np.concatenate([(right[near[i:i + wide]] * left[q]).sum(1) for i in range(0, len(near), wide)])
                    best = np.argsort(-exact, kind="stable")[:most]  # classes are in order of their ids
                    found.append((np.full(len(best), classes[asks[q]]), classes[held[near[best]]], exact[best]))
                yield pd.DataFrame(dict(zip(("query_class", "class", "score"), map(np.concatenate, zip(*found)))))

    return search


def nearest(df: DataFrame, k: int, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES,
            blocks: int = BLOCKS, reach: int = REACH) -> DataFrame:
    """The k nearest found of each row that `asks`, by inner product in double precision, nearest first, ties to the smaller id.

    `asks` is a condition on vec_id. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
    do vectors of another length than the longest. A row is no neighbour of itself, its copies are. Rows that repeat an id are
    told apart. Empty table: no rows. Other columns are not read.
    """
    rows = numbered(df, vec_id, vector).where(usable("vector"))
    # Copies are one class, named by two hashes; -0 is made 0, so that they compare equal.
    rows = stage(rows.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).select(
        "*", F.coalesce(asks, F.lit(False)).alias("asks"),
        F.struct(F.xxhash64("vector").alias("a"), F.xxhash64("vector", F.lit(1)).alias("b")).alias("key")), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not size["n"]:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == F.lit(size["d"]))
    asking = rows.where("asks").groupBy("key").agg(F.count("*").alias("n"))
    # The rank limit is applied before the shuffle as well, so a class of many copies sends few rows.
    first = (rows.select("key", "vec_id", "row").withColumn("nth", F.row_number().over(
        Window.partitionBy("key").orderBy("vec_id", "row"))).where(F.col("nth") <= F.lit(k + 1)))
    members = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    classes = stage(rows.groupBy("key").agg(F.first("vector").alias("vector"))
                    .join(members, "key").join(asking, "key", "left")
                    .withColumn("class", F.col("members")[0]["row"])
                    .select("key", "class", "vector", "members", F.col("n").isNotNull().alias("asks"),
                            # A null id comes first, as in the ranking below.
                            F.coalesce(F.col("members")[0]["vec_id"], F.lit(-(1 << 63))).alias("rep"), F.col("n").alias("n_asking"),
                            F.expr("pmod(xxhash64(class), 1000000007L)").alias("hash")), "vector-classes")
    sample = classes.orderBy("hash", "class").limit(SAMPLE).select("vector").toPandas()["vector"]
    index = fit_index(matrix(sample.tolist()), curves, blocks)
    held, asked = np.zeros((curves, blocks), np.int64), np.zeros((curves, blocks), np.int64)
    for into, part, query in ((held, classes, False), (asked, classes.where("asks"), True)):
        for r in part.select("vector").mapInPandas(_block_counter(index, query), "curve int, block int, n long").groupBy(
                "curve", "block").agg(F.sum("n").alias("n")).collect():
            into[r["curve"], r["block"]] = r["n"]
    met = np.zeros_like(held)
    for curve in range(curves):
        filled, own = np.flatnonzero(held[curve]), np.flatnonzero(asked[curve])
        for step in range(-reach, reach + 1):
            inside, to = _steps(filled, own, step)
            np.add.at(met[curve], to, asked[curve][own[inside]])
    placed = classes.select("class", "rep", "vector", "asks", "hash").mapInPandas(
        _placer(index, reach, -(-held // CHUNK), -(-met // CHUNK)),
        "curve int, block int, chunk int, qchunk int, query boolean, class long, rep long, vector array<double>")
    found = clustered(placed, "curve", "block", "chunk", "qchunk").mapInPandas(
        _searcher(k + 1), "query_class long, class long, score double")
    nearest_classes = Window.partitionBy("query_class").orderBy(F.desc("score"), "rep", "class")
    once = (found.groupBy("query_class", "class").agg(F.max("score").alias("score"))
            .join(classes.select("class", "rep"), "class")
            .withColumn("nth", F.row_number().over(nearest_classes)).where(F.col("nth") <= F.lit(k + 1)))
    order = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id", "row")
    lists = (once.join(classes.select("class", "members"), "class")
             .select("query_class", "score", F.inline("members"))
             .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.lit(k + 1))
             .groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "row", "score"))).alias("near")))
    lists = stage(lists.join(classes.where("asks").select(F.col("class").alias("query_class"), "key", "n_asking"), "query_class")
                  .select("key", "near", "n_asking"), "lists")
    # At most 1/HOT classes have such a share of the asking rows; their rows are spread, not joined by key.
    hot = F.col("n_asking") >= F.lit(HOT * (size["q"] or 0))
    askers = (rows.where("asks").select("key", "row", F.col("vec_id").alias("query_id"))
              .join(F.broadcast(lists.where(hot).select("key", F.col("near").alias("hot_near"))), "key", "left")
              .withColumn("spread", F.when(F.col("hot_near").isNull(), F.col("key")).otherwise(
                  F.struct(F.col("row").alias("a"), F.lit(None).cast("long").alias("b")))))
    others = lists.where(~hot).select(F.col("key").alias("spread"), F.col("near").alias("key_near"))
    own = F.col("row")
    near = F.slice(F.filter(F.coalesce("hot_near", "key_near"), lambda x: x["row"] != own), 1, k)
    return (askers.join(others, "spread", "left").select("query_id", F.posexplode(near).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    F.col("x.score").alias("score")))
