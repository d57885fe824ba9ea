"""Byte-level BPE from a rank file: encoding by a segment tree of pair ranks, and decoding.

A match of the split pattern is encoded by itself. The tree's leaf i holds the rank of the live token that starts at byte i
joined with its live right neighbour; an inner node holds the leftmost minimum of its children. A merge takes the root,
drops the right token's leaf and updates the leaves of the merged token and of its left neighbour: three point updates of
logarithmic cost, however long the match is.

Texts are cut into units (white space with the characters that follow it up to the next white space). No match crosses the
end of a unit and none depends on what is around it, so encoded units are remembered, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.llm.memories import held
from strandline.llm.packing import spans

CACHE_UNITS, CACHE_MATCHES = 350_000, 250_000  # units are held twice at most: the present and the aged memory
STRETCH = 1_000_000  # characters encoded together
WIDEST = 64  # bytes of a match that is merged together with others
NONE = 1 << 60
# Unicode white space (fixed values). Python's own class also has \x1c to \x1f, which the split pattern's does not.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: always the leftmost pair of the lowest rank is merged first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1
    while width < n:
        width *= 2
    after = list(range(1, n + 1))  # start of the next live token
    before = list(range(-1, n - 1))
    get = ranks.get
    # A node holds rank * n + position, so that the smaller value is the lower rank, leftmost among equals.
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    while tree[1] != NONE:
        i = tree[1] % n
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
        for at, start, end in ((i, i, after[k] if k < n else -1), (j, -1, -1), (before[i], before[i], k)):
            if at < 0:
                continue
            rank = get(piece[start:end]) if end > 0 and start >= 0 else None
            node = width + at
            value = NONE if rank is None else rank * n + at
            while node and tree[node] != value:
                tree[node] = value
                node >>= 1
                if node:
                    left, right = tree[2 * node], tree[2 * node + 1]
                    value = left if left < right else right
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class PairRanks:
    """Rank of the token that two tokens make, for many pairs at once, and the same merges for many short matches."""

    def __init__(self, ranks: dict[bytes, int]):
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(rank, np.int64)[order]

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        key = (a << 32) | b
        where = np.searchsorted(self.keys, key)
        where[where == len(self.keys)] = 0
        return np.where((self.keys[where] == key) & (a >= 0) & (b >= 0), self.ranks[where] * width + at, NONE)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """`merge` of each piece; pieces of one tree width are worked on together, a row each."""
        out: list[list[int]] = [[] for _ in pieces]
        lengths = np.array([len(p) for p in pieces])
        widths = 1 << np.ceil(np.log2(np.maximum(lengths, 2))).astype(int)
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            for part in np.array_split(at, -(-len(at) * width // 400_000)):
                for i, ids in zip(part.tolist(), self._rows([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        m = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        slot = np.arange(width)
        live = slot < lengths[:, None]
        # One more column stands for "no token": -1 never forms a pair.
        token = np.full((m, width + 1), -1, np.int64)
        token[:, :width][live] = self.first[raw[live]]
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (m, 1))
        after[:, :width] = np.where(slot + 1 < lengths[:, None], slot + 1, width)
        before = np.tile(np.arange(-1, width), (m, 1))
        before[:, 0] = width
        tree = np.full((m, 2 * width), NONE, np.int64)
        tree[:, width:] = self._leaf(token[:, :width].ravel(), np.take_along_axis(token, after[:, :width], 1).ravel(),
                                     np.tile(slot, m), width).reshape(m, width)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root % width
            j = after[rows, i]
            k = after[rows, j]
            token[rows, i], token[rows, j] = root // width, -1
            after[rows, i] = k
            before[rows, k] = i
            b = before[rows, i]
            tree[rows, width + j] = NONE
            tree[rows, width + i] = self._leaf(token[rows, i], token[rows, k], i, width)
            has = b < width
            tree[rows[has], width + b[has]] = self._leaf(token[rows, b], token[rows, i], b, width)[has]
            for rows_, leaf in ((rows, i), (rows, j), (rows[has], b[has])):
                node = (width + leaf) >> 1
                while len(node) and node[0]:
                    tree[rows_, node] = np.minimum(tree[rows_, 2 * node], tree[rows_, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] != NONE]
        return [row[row >= 0].tolist() for row in token]


class ByteBpe:
    """Encoder and decoder over one rank file; memories are bounded: a full one is set aside and
    a new one takes from it what is met again."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.pairs = PairRanks(self.ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]")
                                     .replace(r"\S", f"[^{SPACE}]"))
        self.units: dict[str, str] = {}  # unit: its ids, written as decimals with commas
        self.aged: tuple[dict[str, str], dict[str, bytes]] = {}, {}  # the memory before the present one
        self.matches: dict[str, tuple[str, bytes]] = {}  # match: its ids so written, their bytes
        self.raw: dict[str, bytes] = {}  # ids of a unit: their bytes

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in merge(m.encode("utf-8", "replace"), self.ranks)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def _split(self, unit: str) -> list[str]:
        """Matches of a unit. Letters with a space before or a plain mark after are told without the pattern."""
        body, mark = (unit[:-1], unit[-1]) if unit[-1] in ".,;:!?" else (unit, "")
        if body.isalpha() or body[:1] == " " and body[1:].isalpha():
            return [body, mark] if mark else [body]
        return self.pattern.findall(unit)

    def _learn(self, units: list[str]) -> None:
        split = list(map(self._split, units))
        known = self.matches
        new = list({m for matches in split for m in matches if m not in known})
        if len(known) + len(new) > CACHE_MATCHES:
            known = self.matches = {}
            new = list({m for matches in split for m in matches})
        raw = [m.encode("utf-8", "replace") for m in new]
        ids: list[list[int]] = [merge(b, self.ranks) if b in self.ranks or len(b) > WIDEST else [] for b in raw]
        open_ = [i for i, x in enumerate(ids) if not x]
        for i, merged in zip(open_, self.pairs.merge_many([raw[i] for i in open_])):
            ids[i] = merged
        known.update((m, (str(x)[1:-1].replace(" ", ""), self.decode(x))) for m, x in zip(new, ids))
        units_, raw_ = self.units, self.raw
        for unit, matches in zip(units, split):
            if len(matches) == 1:
                written, decoded = known[matches[0]]
            else:
                parts = [known[m] for m in matches]
                written, decoded = ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
            units_[unit], raw_[written] = written, decoded

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
        split = list(map(_UNITS.findall, texts))
        wanted = set(chain.from_iterable(split))
        missing = wanted.difference(self.units)
        if len(self.units) + len(missing) > CACHE_UNITS:
            self.aged, self.units = (self.units, self.raw), {}
            self.raw, missing = {}, wanted
        units_, raw_ = self.aged
        new = []
        for unit in missing:
            written = units_.get(unit)
            if written is None:
                new.append(unit)
            else:
                self.units[unit], self.raw[written] = written, raw_[written]
        if new:
            self._learn(new)
        out = []
        for units in split:
            parts = list(map(self.units.__getitem__, units))
            ids = ",".join(parts)
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(b"".join(map(self.raw.__getitem__, parts))).hexdigest()))
        return out


def coder(path: str, pattern: str) -> ByteBpe:
    return held(("bytes", path, pattern), lambda: ByteBpe(path, pattern))


def encode_column(text, path: str, pattern: str):
    """Array of ids of a text column; null: empty array."""
    @pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = coder(path, pattern)
        return pd.Series([bpe.encode(t or "") for t in texts])
    return encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def decode_column(ids, path: str, pattern: str):
    """Bytes of an array of ids; null: empty bytes. An id outside the vocabulary is an error."""
    @pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        bpe = coder(path, pattern)
        return pd.Series([bpe.decode([int(i) for i in r]) if r is not None else b"" for r in rows])
    return decode(F.col(ids) if isinstance(ids, str) else ids)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: number of ids, hash of the ids, hash of the decoded bytes.

    Null text is empty (no ids). Null ids stay null, repeated rows are answered each, an empty table gives no rows, other
    columns are not read. The work is a map over the input's partitions.
    """
    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe = coder(path, pattern)
        whole = [t or "" for t in texts]
        rows = [d for at in spans([len(t) for t in whole], STRETCH) for d in bpe.digests(whole[at])]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text).cast("string")).alias("d"))
            .select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256"))
