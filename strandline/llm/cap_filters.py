"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction of a structured random product code: the space, rotated, is split into PARTS blocks, each with its
own random unit codes, and every choice of one code per block is a direction. A vector passes the directions whose inner
product with it exceeds a threshold; list decoding finds them without trying all: block scores are summed pairwise, and a
pair of sums is only opened where the best of the other half could still lift it over the threshold. Vectors that pass a
common filter meet in its bucket and are verified by their cosine in double precision.

Vectors equal in every component are one class. A bucket is dealt in cells, a tile holds two cells, so a bucket of any size
is compared by tiles of bounded size. A pair is counted at the first filter that both pass only, and a tile returns per
vector its number of links and one link to its local component: rows grow with the vectors, not with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.groups import clustered, linked_classes, local_roots, whole_groups
from strandline.llm.shingles import mix
from strandline.llm.vectors import matrix, numbered, rotation, usable
from strandline.session import stage

SIMILARITY = 0.95
PARTS = 2  # more parts make the directions more alike, and near vectors miss each other (measured)
TABLES = 8  # independent codes, at least
PASSED = 5  # filters of a table that a vector passes, on average
BUCKET = 200  # vectors of a bucket, on average; the number of filters follows from it
CELL = 128


def codes_for(n: int) -> int:
    """Codes per block such that n vectors fill buckets of about BUCKET."""
    return max(8, math.ceil((max(n, 1) * PASSED / BUCKET) ** (1 / PARTS)))


def tables_for(codes: int) -> int:
    """Independent codes: more for finer ones, as a near pair shares a finer direction less often."""
    return max(TABLES, math.ceil(1.15 * PARTS * math.log(codes)))


class ProductCode:
    """Directions of one table for vectors of one dimension."""

    def __init__(self, dimension: int, codes: int, table: int):
        self.turn = rotation(dimension, table)
        self.blocks = np.array_split(np.arange(dimension), min(PARTS, dimension))
        draw = np.random.default_rng([table, dimension, codes])
        self.codes = []
        for block in self.blocks:
            c = draw.normal(size=(codes, len(block)))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(len(self.blocks)))
        self.count = codes ** len(self.blocks)
        share = min(0.5, PASSED / self.count)
        self.threshold = NormalDist().inv_cdf(1 - share) / math.sqrt(dimension)
        self.number = codes

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Directions that each row of unit vectors passes."""
        turned = unit @ self.turn
        scores = [turned[:, b] @ c.T for b, c in zip(self.blocks, self.codes)]
        half = (len(scores) + 1) // 2
        left = self._sums(scores[:half])
        right = self._sums(scores[half:]) if len(scores) > 1 else np.zeros((len(unit), 1))
        row, i = np.nonzero(left + right.max(1, keepdims=True) >= self.threshold)
        found_row, found = [], []
        step = max(1, 2_000_000 // right.shape[1])
        for at in range(0, len(row), step):
            r, k = row[at:at + step], i[at:at + step]
            p, j = np.nonzero(left[r, k][:, None] + right[r] >= self.threshold)
            found_row.append(r[p])
            found.append(k[p] * right.shape[1] + j)
        counts = np.bincount(np.concatenate(found_row), minlength=len(unit)) if found_row else np.zeros(len(unit), int)
        return np.split(np.concatenate(found) if found else np.empty(0, int), np.cumsum(counts)[:-1])

    @staticmethod
    def _sums(scores: list[np.ndarray]) -> np.ndarray:
        total = scores[0]
        for s in scores[1:]:
            total = (total[:, :, None] + s[:, None, :]).reshape(len(s), -1)
        return total


_codes: dict[tuple[int, int, int], ProductCode] = {}


def product_code(dimension: int, codes: int, table: int) -> ProductCode:
    key = dimension, codes, table
    if key not in _codes:
        _codes[key] = ProductCode(*key)
    return _codes[key]


def filters_of(vectors: np.ndarray, codes: int) -> list[np.ndarray]:
    """Sorted 32-bit filter keys of each row, hashed over table and direction (two filters of one hash are one bucket)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    parts, tables = [], tables_for(codes)
    for table in range(tables):
        code = product_code(vectors.shape[1], codes, table)
        parts.append([f * tables + table for f in code.decode(unit)])
    return [np.unique((mix(np.concatenate(rows).astype(np.uint64)) >> np.uint64(33)).astype(np.int32)) for rows in zip(*parts)]


def _filtered(codes: int, kind: str):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["vector"].map(len).to_numpy()
            for size in np.unique(sizes):
                part = batch[sizes == size]
                vectors = matrix(part["vector"].tolist())
                filters = filters_of(vectors, codes)
                yield pd.DataFrame({"class": part["class"], "n": part["n"], "size": int(size),
                                    "raw": [v.tobytes() for v in vectors.astype(kind)], "filters": filters,
                                    "passed": [f.tobytes() for f in filters]})
    return assign


def _verifier(similarity: float, kind: str):
    keys = ["filter", "size", "i1", "i2"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, keys):
            columns = {k: frame[k].to_numpy() for k in ("filter", "i1", "i2", "cell", "class", "n", "raw", "passed")}
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a < 2:
                    continue
                raw = np.stack([np.frombuffer(v, kind) for v in columns["raw"][a:b]]).astype(np.float64)
                norms = np.sqrt((raw * raw).sum(1))
                cosine = (raw / norms[:, None]) @ (raw / norms[:, None]).T
                np.fill_diagonal(cosine, -1)
                if columns["i1"][a] != columns["i2"][a]:
                    cell = columns["cell"][a:b]
                    cosine[cell[:, None] == cell[None, :]] = -1
                linked = cosine >= similarity
                for x, y in np.argwhere(np.abs(cosine - similarity) < 1e-9):
                    linked[x, y] = (raw[x] * raw[y]).sum() / (norms[x] * norms[y]) >= similarity
                if not linked.any():
                    continue
                linked &= ~_met_before([np.frombuffer(f, np.int32) for f in columns["passed"][a:b]], columns["filter"][a])
                left, right = np.nonzero(linked)
                if len(left):
                    ids, n = columns["class"][a:b], columns["n"][a:b]
                    roots = local_roots(b - a, left, right)
                    hit = np.unique(left)
                    out.append(pd.DataFrame({"class": ids[hit], "links": (linked @ n)[hit], "other": ids[roots[hit]]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return verify


def _met_before(filters, current: int) -> np.ndarray:
    """Pairs that share a filter of a smaller key than the current one."""
    earlier = [f[f < current] for f in filters]
    owner = np.repeat(np.arange(len(earlier)), [len(f) for f in earlier])
    if not len(owner):
        return np.zeros((len(earlier), len(earlier)), bool)
    values, column = np.unique(np.concatenate(earlier), return_inverse=True)
    table = np.zeros((len(earlier), len(values)), np.float32)
    table[owner, column] = 1
    return table @ table.T > 0


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                    similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links), kept (vec_id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of another
    length. Rows that repeat an id are vectors of their own; a null id is never a component's name unless it stands alone (then
    null, and not kept). Empty table: no rows. Other columns are not read.
    """
    rows = stage(numbered(df, vec_id, vector).withColumn("ok", usable("vector")), "vectors")
    # Copies are one class: the least row of equal vectors. -0 is made 0, so that they compare equal.
    good = rows.where("ok").select("row", "vec_id", F.expr("transform(vector, x -> x + 0D)").alias("vector"))
    keyed = good.withColumn(
        "key", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64("vector", F.lit(1)).alias("b")))
    classes = stage(keyed.groupBy("key").agg(F.min("row").alias("class"), F.min("vec_id").alias("rep"), F.count("*").alias("n"),
                                             F.first("vector").alias("vector")), "vector-classes")
    codes = codes_for(classes.count())
    kind = "f4" if dict(df.dtypes)[vector] == "array<float>" else "f8"
    filtered = stage(classes.select("class", "n", "vector").mapInPandas(
        _filtered(codes, kind), "class long, n long, size int, raw binary, filters array<int>, passed binary"), "filters")
    # The planner sizes exploded rows as if each array held one value, and would broadcast them: both joins are dealt by key.
    passed = filtered.select("class", "size", F.explode("filters").alias("filter"))
    cells = passed.groupBy("filter", "size").agg(F.count("*").alias("c")).where("c > 1").select(
        "filter", "size", F.ceil(F.col("c") / F.lit(CELL)).cast("int").alias("cells"))
    dealt = (passed.hint("merge").join(cells, ["filter", "size"])
             .withColumn("cell", F.expr("pmod(xxhash64(class, filter), cells)").cast("int"))
             .withColumn("j", F.explode(F.expr("sequence(0, cells - 1)")))
             .select("class", "filter", F.least("cell", "j").alias("i1"), F.greatest("cell", "j").alias("i2"), "cell"))
    tiles = clustered(dealt.hint("merge").join(filtered.drop("filters"), "class"), "filter", "size", "i1", "i2")
    verified = stage(tiles.mapInPandas(_verifier(similarity, kind), "class long, links long, other long"), "verified")
    members = linked_classes(classes, verified)
    found = keyed.join(classes.select("key", "class"), "key").join(members, "class").select("vec_id", "n_links", F.col(
        "class_id").alias("component_id"))
    alone = rows.where("NOT ok").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
