"""Self-join of documents on the Jaccard similarity of their word shingles, by MinHash banding.

1. A map over the documents gives each its shingle set's key and its bands (hashes of `rows` minima each; the number of bands
   follows from the target recall at the least similarity). Equal sets make one class, so copies cost one row.
2. Classes are shuffled on band hashes; each class links to the least class of its bucket (an aggregate joined back, never a
   bucket gathered), and components of these links are candidate groups.
3. Within a candidate group every two classes whose set sizes allow the similarity are verified on their full shingle
   sets. A group is dealt in cells by size band and hash; a tile holds two cells, so its rows are bounded however large the
   group. A tile returns per class the documents linked and one link to its local component: rows grow with the classes,
   not with the pairs.
4. Components of the verified links are the duplicate classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.groups import clustered, components, linked_classes, local_roots, whole_groups
from strandline.llm.shingles import WORDS, mix, set_key, shingle_set
from strandline.session import stage

SIMILARITY, RECALL, ROWS = 0.8, 0.9995, 7
CELL = 32  # classes of a cell, about
SALTS = 16
COLUMNS = 65_536  # shingles compared at a time within a tile


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of `rows` minima such that two sets of the similarity share one with the probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def minhash_bands(shingles: np.ndarray, bands: int, rows: int, multipliers: np.ndarray, shifts: np.ndarray) -> list[int]:
    """One 64-bit hash per band. Minima of multiply-and-shift hashes of 32 bits, taken in stretches of the set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(least, (multipliers[:, None] * short[None, at:at + 4096] + shifts[:, None]).min(1), out=least)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64).tolist()


def _class_of(shingles: np.ndarray) -> int | None:
    return int.from_bytes(set_key(shingles)[:8], "little", signed=True) if len(shingles) else None


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, class (hash of the shingle set; null without words), set size, band hashes."""
    draw = np.random.default_rng(20)
    multipliers = (draw.integers(0, 2**32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    shifts = draw.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "class": pd.array([_class_of(s) for s in sets], dtype="Int64"),
                "size": [len(s) for s in sets],
                "bands": [minhash_bands(s, bands, rows, multipliers, shifts) if len(s) else [] for s in sets]})

    return docs.mapInPandas(sign, "doc_id long, class long, size int, bands array<long>")


def _tiles(classes: DataFrame, similarity: float) -> DataFrame:
    """Rows (class, root, n) dealt to tiles of two cells: (root, band, cell, band, cell). Cells of one size band, or of two
    that follow each other: other sizes cannot reach the similarity."""
    step = math.log(1 / similarity) * (1 + 1e-9)
    dealt = classes.withColumn("b1", F.floor(F.log("size") / F.lit(step)).cast("int"))
    counts = dealt.groupBy("root", "b1").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("cells"))
    after = counts.select("root", (F.col("b1") - 1).alias("b1"), F.col("cells").alias("above"))
    below = counts.select("root", (F.col("b1") + 1).alias("b1"), F.col("cells").alias("under"))
    # Salted: a group's rows meet its counts in SALTS places, not in one.
    counts = (counts.join(after, ["root", "b1"], "left").join(below, ["root", "b1"], "left")
              .withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})"))))
    dealt = (dealt.withColumn("salt", F.expr(f"pmod(xxhash64(class, 7), {SALTS})").cast("int"))
             .join(counts, ["root", "b1", "salt"])
             .withColumn("i", F.expr("pmod(xxhash64(class), cells)").cast("int")))
    tile = "named_struct('b1', {}, 'i1', {}, 'b2', {}, 'i2', {})"
    return dealt.withColumn("tile", F.explode(F.expr(
        "concat("
        f"transform(sequence(0, cells - 1), j -> {tile.format('b1', 'least(i, j)', 'b1', 'greatest(i, j)')}), "
        f"if(above IS NULL, array(), transform(sequence(0, above - 1), j -> {tile.format('b1', 'i', 'b1 + 1', 'j')})), "
        f"if(under IS NULL, array(), transform(sequence(0, under - 1), j -> {tile.format('b1 - 1', 'j', 'b1', 'i')})))"
    ))).selectExpr("root", "tile.b1 AS b1", "tile.i1 AS i1", "tile.b2 AS b2", "tile.i2 AS i2",
                   "b1 = tile.b1 AND i = tile.i1 AS first", "class", "n", "rep", "shingles")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 columns, only shingles that two sets share, COLUMNS at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    held = shared[column]
    owner, column = owner[held], number[column[held]]
    total = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), COLUMNS if at + COLUMNS <= shared.sum() else int(shared.sum()) - at), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def _verifier(similarity: float):
    keys = ["root", "b1", "i1", "b2", "i2"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, keys):
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                tile = frame.iloc[a:b].drop_duplicates("class")
                if len(tile) < 2:
                    continue
                sets = [np.frombuffer(s, np.uint64) for s in tile["shingles"]]
                sizes = np.array([len(s) for s in sets])
                common = _overlaps(sets)
                linked = common / (sizes[:, None] + sizes[None, :] - common) >= similarity
                np.fill_diagonal(linked, False)
                one_cell = tile["b1"].iat[0] == tile["b2"].iat[0] and tile["i1"].iat[0] == tile["i2"].iat[0]
                if not one_cell:
                    first = tile["first"].to_numpy(bool)
                    linked &= first[:, None] != first[None, :]
                left, right = np.nonzero(linked)
                if len(left):
                    ids, n = tile["class"].to_numpy(np.int64), tile["n"].to_numpy(np.int64)
                    roots = local_roots(len(ids), left, right)
                    hit = np.unique(left)
                    out.append(pd.DataFrame({"class": ids[hit], "links": (linked @ n)[hit], "other": ids[roots[hit]]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return verify


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                      similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: class_id (smallest id reachable by links, its own included), n_links (other documents of at
    least the similarity), n_copies (other documents of the same shingle set).

    Texts of fewer words than a shingle have one shingle of all their words. Null, empty and wordless texts have none: they
    link with nothing and are their own class. A row of null id counts as a copy, but a set that only such rows have links with
    no other set; its class is null. Rows that repeat an id are documents of their own. Empty table: no rows.
    """
    bands = bands_for(similarity, recall, rows)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stage(signatures(source, words, bands, rows), "signatures")
    known = signed.where("class IS NOT NULL")
    classes = stage(known.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"),
                                               F.first("size").alias("size"), F.first("bands").alias("bands")), "classes")
    banded = classes.where("rep IS NOT NULL").select("class", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("class").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = components(banded.join(least, "band").where("class <> low").select("class", "low"), "class", "low")

    # Shingles are made again from the representatives' texts: only candidates' texts are needed, once each.
    wanted = (groups.withColumnRenamed("node", "class").join(classes.select("class", "rep", "n", "size"), "class"))
    with_text = source.withColumnRenamed("doc_id", "rep").join(wanted, "rep")

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"]]
            own = np.array([_class_of(s) for s in sets], object) == batch["class"].to_numpy(object)
            yield batch.drop(columns="text").assign(shingles=[s.tobytes() for s in sets])[own]

    shingled = stage(with_text.select("text", "root", "class", "rep", "n", "size").mapInPandas(
        shingle, "root long, class long, rep long, n long, size int, shingles binary"), "shingles")
    tiles = clustered(_tiles(shingled, similarity).drop("rep"), "root", "b1", "i1", "b2", "i2")
    verified = stage(tiles.mapInPandas(_verifier(similarity), "class long, links long, other long"), "verified")
    members = linked_classes(classes, verified)
    return (known.select("doc_id", "class").join(members, "class").select("doc_id", "class_id", "n_links", "n_copies")
            .unionByName(signed.where("class IS NULL").selectExpr("doc_id", "doc_id AS class_id", "0L AS n_links",
                                                                  "0L AS n_copies")))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are the smallest id of their class, with all their columns as they were. Rows of null id stay;
    rows that repeat one id stay or go together."""
    gone = similar_documents(docs, doc_id, text, **options).where("doc_id <> class_id").select(
        F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("__gone"), "left_anti").select(*docs.columns)
