"""Ranked lexical search over hashed max-sketches.

A term's impact in a document is (10^9 tf) div (1000 tf + 8 m), with m growing with the document's length against the mean; a
query term weighs floor(1000 ln((2 N + 2) / (2 df + 1))). The impacts of a document fold into a sketch: coordinate c holds the
greatest impact of its terms hashed to c. Looked up for all queries at once, the sketch gives upper bounds of the scores, since a
term's impact is at most its coordinate. Documents are scored exactly in descending order of bound, until the bound falls below
the k-th best exact score: what is left cannot enter the result.

Each task keeps the k best of what it has read; the best of all tasks are ranked in two steps.
"""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.packing import spans

WIDTH = 16384  # coordinates of a sketch
BLOCK = 1000  # about so many items are searched in one pass over the documents
STRETCH = 1_000_000  # characters of documents in a task's hands
BUCKETS = 64  # first step of the ranking: tasks by remainder
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
# Separators become spaces and A to Z lower case; all bytes of other characters stay.
_TERMS = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in _TERMS)


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters, digits and all other characters, A to Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def damping(n: int, documents: int, length: int) -> int:
    """The m of a document of n terms."""
    return 10 + 90 * n * documents // length


def impact(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _texts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in spans([len(t or "") for t in batch["text"]], STRETCH):
        yield batch.iloc[at]


def statistics(docs: DataFrame, wanted: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, terms with repeats, and the documents that hold each wanted term, over all rows. Every task sends
    one row per wanted term it met; the driver gets one per wanted term."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents = length = 0
        holding: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                found = terms(text)
                documents, length = documents + bool(found), length + len(found)
                holding.update(wanted.intersection(found))
        yield pd.DataFrame([(None, documents, length), *((t, n, 0) for t, n in holding.items())], columns=["term", "documents", "length"])

    rows = (docs.select("text").mapInPandas(count, "term binary, documents long, length long")
            .groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("length").alias("length")).collect())
    total = next((r for r in rows if r["term"] is None), None)
    return ((total["documents"], total["length"]) if total else (0, 0)) + (
        {bytes(r["term"]): r["documents"] for r in rows if r["term"] is not None},)


class Searcher:
    """The k best documents of each query among those shown. Queries are lists of distinct terms; `weights` has each term's."""

    def __init__(self, queries: list[list[bytes]], weights: dict[bytes, int], documents: int, length: int, k: int, width: int = WIDTH):
        self.queries = [[(t, weights[t]) for t in query if weights.get(t)] for query in queries]
        self.wanted = {t for query in self.queries for t, _ in query}
        self.documents, self.length, self.k, self.width = documents, length, k, width
        touched = sorted({self._slot(t) for t in self.wanted})
        self.column = np.full(width, -1)  # coordinates that no query looks up are not kept
        self.column[touched] = np.arange(len(touched))
        self.lookup = np.zeros((len(touched), len(queries)))
        for q, query in enumerate(self.queries):
            for t, w in query:
                self.lookup[self.column[self._slot(t)], q] += w
        self.best: list[list[tuple]] = [[] for _ in queries]  # (-score, id is null, id) in order
        self.rescored = 0

    def _slot(self, term: bytes) -> int:
        return zlib.crc32(term) % self.width

    def sketches(self, counts: list[Counter], ms: list[int]) -> np.ndarray:
        """A row per document: greatest impact per touched coordinate. Whole numbers below 2^53 in doubles: exact."""
        out = np.zeros((len(counts), self.lookup.shape[0]))
        for row, count, m in zip(out, counts, ms):
            slots = self.column[np.fromiter(map(zlib.crc32, count), np.int64, len(count)) % self.width]
            tf = np.fromiter(count.values(), np.int64, len(count))
            kept = slots >= 0
            tf = tf[kept]
            np.maximum.at(row, slots[kept], 1_000_000_000 * tf // (1000 * tf + 8 * m))
        return out

    def show(self, ids: list[int | None], texts: list[str | None]) -> None:
        counts = [Counter(terms(t)) for t in texts]
        held = [i for i, c in enumerate(counts) if c]
        if not held or not self.wanted:
            return
        ids, counts = [ids[i] for i in held], [counts[i] for i in held]
        ms = [damping(c.total(), self.documents, self.length) for c in counts]
        bounds = self.sketches(counts, ms) @ self.lookup
        impacts: list[dict[bytes, int] | None] = [None] * len(ids)
        for q, query in enumerate(self.queries):
            best, bound = self.best[q], bounds[:, q]
            least = -best[-1][0] if len(best) == self.k else 1
            open_ = np.flatnonzero(bound >= least)
            for i in open_[np.argsort(-bound[open_], kind="stable")].tolist():
                if bound[i] < least:
                    break
                own = impacts[i]
                if own is None:
                    own = impacts[i] = {t: impact(counts[i][t], ms[i]) for t in self.wanted.intersection(counts[i])}
                score = sum([w * own[t] for t, w in query if t in own])
                self.rescored += 1
                if score >= least:
                    insort(best, (-score, ids[i] is None, ids[i] or 0))
                    del best[self.k:]
                    least = -best[-1][0] if len(best) == self.k else 1

    def found(self) -> list[tuple[int, int | None, int]]:
        return [(q, None if null else i, -score) for q, best in enumerate(self.best) for score, null, i in best]


def _block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int, width: int) -> DataFrame:
    queries, names = [t for _, t in items], [i for i, _ in items]
    documents, length, holding = statistics(docs, {t for query in queries for t in query})
    weights = {t: weight(documents, df) for t, df in holding.items()}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(queries, weights, documents, length, k, width)
        for batch in batches:
            for part in _texts(batch):
                searcher.show([None if pd.isna(i) else int(i) for i in part["doc_id"]], list(part["text"]))
        out = pd.DataFrame([(names[q], i, score) for q, i, score in searcher.found()], columns=["item_id", "doc_id", "score"])
        yield out.astype({"item_id": "Int64", "doc_id": "Int64"})

    return docs.mapInPandas(search, "item_id long, doc_id long, score long").withColumn("bucket", F.spark_partition_id() % BUCKETS)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, item_id: str = "item_id", query: str = "text", doc_id: str = "doc_id",
           text: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """The k highest-scoring documents of each item with a score above 0 (all, if fewer): item_id, rank from 1, doc_id, score.

    Null or empty texts have no terms and are never found; items without terms, or whose terms no document holds, give no rows.
    Equal scores go by ascending doc_id, null last. Each row is a document: repeated rows are ranked each. The terms of rows
    with one item_id together are one item; null is one more item. Empty tables give no rows. Other columns are not read.
    Items are searched in blocks of about `block` by hash: two passes over the documents each; a block's items, and nothing of
    the documents but counts of its terms, come to the driver. A very long text is one document in one task.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(query).cast("string").alias("text"))
    blocks = max(1, -(-items.count() // block))
    found = None
    for b in range(blocks):
        together: dict[int | None, dict[bytes, None]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():
            together.setdefault(r["item_id"], {}).update(dict.fromkeys(terms(r["text"])))
        part = _block(rows, [(i, list(t)) for i, t in together.items()], k, width)
        found = part if found is None else found.union(part)

    def ranked(df: DataFrame, *keys: str | Column) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    return ranked(ranked(found, "item_id", "bucket").drop("rank"), "item_id").select("item_id", "rank", "doc_id", "score")


def search_sql(k: int = 10, docs: str = "documents", queries: str = "benchmark") -> str:
    """SQL of `search` over all pairs of an item and a document that share a term."""
    upper, pattern = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{pattern}'))"
    return f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM {docs}),
term AS (SELECT r, doc_id, {found} AS t FROM numbered),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM term GROUP BY r, doc_id, t),
size AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS len FROM size),
wanted AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, {found} AS t FROM {queries})),
weighed AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, total GROUP BY t, n_docs),
scored AS (SELECT item_id, r, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // len))))::BIGINT AS score
           FROM wanted JOIN weighed USING (t) JOIN tf USING (t) JOIN size USING (r), total GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
