"""Packing of token streams into windows of near-equal fill by Karmarkar-Karp multiway differencing.

`pack` tokenises every text, ends it with one id, and cuts it freely: whole windows stand alone, what is left of a document
is cut into pieces of at most `piece` tokens, in the last share of a lot of at most `fine`. A task gathers pieces until they
fill `lot` windows but for a small slack (the last piece is cut at that mark), then differences them: each piece starts as a partial partition of k windows with one
filled; the two partitions of the largest spread merge, the fullest window of one onto the emptiest of the other, until one
is left. If a window still exceeds the capacity, the lot is packed again with one window more.

The work is a map over the input's own partitions: no shuffle, and a lost task makes the same rows again. At most the last
lot of each partition has a partly filled window.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.memories import held

CAPACITY = 2048
PIECE = 512
FINE = 16  # size of the last pieces of a lot: differencing levels windows to about half of it
FINE_SHARE = 0.08
LOT = 32
SLACK = 8
STRETCH = 1_000_000  # characters encoded together
CACHE_UNITS, CACHE_WORDS = 400_000, 400_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")
# Fixed value: the word pattern of the tokenizer, after its normal form (NFC, lower case).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# Separators that Python counts as white space and the tokenizer's pattern does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_END_MARK = re.compile(r"[.,;:!?](?<=[^\W_].)(?!\S)")


def multiway_difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of `sizes` in k windows of near-equal sums (largest differencing method). Ties go to the earlier piece."""
    heap: list[tuple[int, int]] = []
    sums: dict[int, np.ndarray] = {}
    members: dict[int, list] = {}
    for i, size in enumerate(sizes):
        start = np.zeros(k, np.int64)
        start[-1] = size
        sums[i], members[i] = start, [None] * (k - 1) + [i]
        heap.append((-size, i))
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        left, right = members.pop(a), members.pop(b)
        joined = [y if x is None else x if y is None else (x, y) for x, y in zip(left, reversed(right))]
        sums[fresh] = total = total[order]
        members[fresh] = [joined[i] for i in order]
        heapq.heappush(heap, (int(total[0] - total[-1]), fresh))
        fresh += 1
    out: list[list[int]] = []
    for tree in members[heap[0][1]] if heap else []:
        found, todo = [], [tree]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node)
            elif node is not None:
                found.append(node)
        out.append(sorted(found))
    return [w for w in out if w]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`, as few as differencing fills: one more whenever capacity is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        packed = multiway_difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in packed):
            return packed
        k += 1


def _lower(text: str) -> str:
    """Lower case letter by letter, as the tokenizer does: Python alone would write a last sigma in its final form."""
    return text.replace("\u03a3", "\u03c3").lower()


class WordTokens:
    """Ids of a text as little-endian 32-bit bytes. The tokenizer's words never span white space and each ends in a token
    that is marked as word end, so stretches between white space are remembered, and their words that are new are encoded
    together, one line of words a batch. Both memories are bounded: full units are set aside and the new memory takes from
    them what is met again; full words start afresh."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = regex.compile(WORD_PATTERN)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.units: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}  # the units before the present ones
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, unit: str) -> list[str]:
        """Words of a unit. Letters alone are told without the pattern."""
        return [unit] if unit.isalpha() else self.words.findall(unit)

    def _learn(self, units: list[str]) -> None:
        split = list(map(self._split, units))
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known = self.known = {}
                new = list({w for words in split for w in words})
            line = self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0]
            ids = np.array(line.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.word_end[ids]) + 1)).tolist()
            if len(ends) == len(new):
                raw = ids.tobytes()
                known.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            else:
                known.update((w, self.whole(w)) for w in new)
        self.units.update(zip(units, [known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words]) for words in split]))

    @staticmethod
    def _plain(text: str) -> str:
        """Normal form of the tokenizer, and a space before each plain mark that ends a word, which the tokenizer cuts off too:
        fewer different stretches."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _END_MARK.sub(r" \g<0>", _lower(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if _ODD_SPACE.search(t) else self._plain(t).split() for t in texts]
        wanted = set(chain.from_iterable(filter(None, split)))
        missing = wanted.difference(self.units)
        if len(self.units) + len(missing) > CACHE_UNITS:
            self.aged, self.units = self.units, {}
            missing = wanted
        aged = self.aged
        met = [u for u in missing if u in aged]
        if met:
            self.units.update(zip(met, map(aged.__getitem__, met)))
            missing = missing.difference(met)
        if missing:
            self._learn(list(missing))
        return [self.whole(text) if units is None else b"".join(map(self.units.__getitem__, units))
                for text, units in zip(texts, split)]


def word_tokens(path: str) -> WordTokens:
    return held(("words", path), lambda: WordTokens(path))


def spans(lengths: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive rows of about `most` characters, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def _packer(path: str, end_id: int, capacity: int, piece: int, fine: int, lot: int, slack: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = word_tokens(path)
        sequence = TaskContext.get().partitionId() << 33
        mark = lot * (capacity - slack)
        coarse = mark - int(FINE_SHARE * mark)
        waiting: list[tuple] = []  # (doc_id, start, length, crc, doc_tokens)
        held = 0
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal waiting, held, sequence
            for window in windows([w[2] for w in waiting], capacity):
                offset, total = 0, sum(waiting[i][2] for i in window)
                for i in window:
                    rows.append((*waiting[i], sequence, offset, total))
                    offset += waiting[i][2]
                sequence += 1
            waiting, held = [], 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows.clear()
            return out

        def encoded(batch: pd.DataFrame) -> Iterator[tuple]:
            for at in spans([len(t or "") for t in batch["text"]], STRETCH):
                part = batch.iloc[at]
                yield from zip(part["doc_id"], tokens.encode([t or "" for t in part["text"]]))

        for batch in batches:
            for doc, ids in encoded(batch):
                doc = None if pd.isna(doc) else int(doc)
                ids += end
                count, at = len(ids) // 4, 0
                while count - at >= capacity:
                    part = ids[4 * at:4 * (at + capacity)]
                    rows.append((doc, at, capacity, zlib.crc32(part), count, sequence, 0, capacity))
                    sequence, at = sequence + 1, at + capacity
                while at < count:
                    size = min(piece if held < coarse else fine, count - at, mark - held)
                    waiting.append((doc, at, size, zlib.crc32(ids[4 * at:4 * (at + size)]), count))
                    held, at = held + size, at + size
                    if held == mark:
                        flush()
                if len(rows) >= 50_000:
                    yield frame()
        if waiting:
            flush()
        if rows:
            yield frame()

    return pack_partition


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE,
         fine: int = FINE, lot: int = LOT, slack: int = SLACK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts and how long it is there, CRC of its ids, its sequence and offset.

    Null or empty text: the end id alone. Null ids stay null. Repeated rows are packed each. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(_packer(tokenizer_path, end_id, capacity, piece, fine, lot, slack), SCHEMA)
