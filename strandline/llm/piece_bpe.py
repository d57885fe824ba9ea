"""SentencePiece BPE with byte fallback: encoding that keeps, for every piece, the source bytes it stands for, and decoding.

Normalising walks the text by the longest prefix that the compiled character map (a double-array trie) holds; each character it
writes is noted with the source byte at which what it came from begins. Merging works on the written characters, and the notes
turn every piece back into a span of source bytes.

With an empty character map that keeps spaces, a merge never spans the end of a unit (spaces, marks, letters, in this order and
each optional) unless a piece of the vocabulary does; units are then normalised and merged by themselves, many at a time, and
remembered, up to a bound.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.llm.memories import held
from strandline.llm.packing import spans

CACHE_UNITS = 250_000  # units are held twice at most: the present and the aged memory
STRETCH = 1_000_000  # characters encoded together
SHORT = 40  # characters of a unit that is merged together with others or by scanning; longer ones use a heap
NONE = float("inf")
NEVER = 1 << 40  # the rank of two pieces that do not merge

# Fixed values of the model file format: field numbers, piece types, marks.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
MODEL_TYPE, SUFFIX_SPACES, BYTE_FALLBACK, UNKNOWN_SURFACE = 3, 24, 35, 44
CHARACTER_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
BPE = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
BROKEN = "�"


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message; fixed-width and length-delimited values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[at:at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: the size of the trie, its 32-bit units, then the replacements, each ended
    by a zero byte."""

    def __init__(self, raw: bytes):
        size = struct.unpack("<I", raw[:4])[0] if raw else 0
        self.units = struct.unpack(f"<{size // 4}I", raw[4:4 + size])
        self.texts = raw[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, source: bytes, start: int) -> tuple[str, int] | None:
        """Replacement and byte length of the longest key at a place; None where no key matches."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for at in range(start, len(source)):
            node ^= source[at]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & ((1 << 31) | 0xFF) != source[at]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = self.units[node] & ((1 << 31) - 1), at + 1 - start
        if found is None:
            return None
        text = self.texts[found[0]:self.texts.index(b"\0", found[0])]
        return text.decode("utf-8", "replace"), found[1]


class PieceBpe:
    """Encoder and decoder over one model file. Models of another kind than BPE, with pieces of the user's or unused ones, or
    with spaces as suffixes are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as model:
            parts = list(fields(model.read()))
        trainer = dict(chain.from_iterable(fields(v) for k, v in parts if k == TRAINER))
        normalizer = dict(chain.from_iterable(fields(v) for k, v in parts if k == NORMALIZER))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for piece in (dict(fields(v)) for k, v in parts if k == PIECE):
            self.pieces.append(piece[PIECE_TEXT].decode())
            self.kinds.append(piece.get(PIECE_TYPE, NORMAL))
            scores.append(struct.unpack("<f", piece[PIECE_SCORE])[0] if PIECE_SCORE in piece else 0.0)
        if trainer.get(MODEL_TYPE) != BPE or trainer.get(SUFFIX_SPACES) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with spaces as prefixes and without user-defined or unused pieces are known")
        self.map = CharacterMap(normalizer.get(CHARACTER_MAP, b""))
        self.dummy = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.squeezed = bool(normalizer.get(EXTRA_SPACES, 1))
        self.space = SPACE if normalizer.get(ESCAPE_SPACES, 1) else " "
        self.fallback = bool(trainer.get(BYTE_FALLBACK, 0))
        self.unknown_text = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode()).decode()
        normal = [i for i, kind in enumerate(self.kinds) if kind == NORMAL]
        self.ids = {self.pieces[i]: i for i in normal}
        self.rank = {self.pieces[i]: -scores[i] for i in normal}  # lower merges earlier
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = [i for i, kind in enumerate(self.kinds) if kind == BYTE]  # in the order of the bytes
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.apart = not (self.map.units or self.squeezed or crossing) and self.dummy and self.space == SPACE and SPACE in self.ids
        self.cut = re.compile(self._boundaries())
        self._tables()
        self.known: dict[str, tuple[bytes, bytes, bytes]] = {}  # unit: ids, decoded bytes, source bytes per piece
        self.aged: dict[str, tuple[bytes, bytes, bytes]] = {}

    def _boundaries(self) -> str:
        """Pattern of the units. Marks are the vocabulary's characters of one byte in Latin-1 other than letters, and whatever a
        piece holds before a mark; a unit ends between another character and a mark, which no piece joins, and around a line
        end that is in no piece. If letters come before marks in pieces, units end before spaces alone."""
        marks: set[str] = set()
        more = {c for p in self.ids for c in p if ord(c) < 256 and not c.isalpha()}
        while more:
            marks |= more
            more = {a for p in self.ids for a, b in zip(p, p[1:]) if b in marks and a not in marks and a != SPACE}
        if any(map(str.isalpha, marks)):
            marks = set()
        line = "" if any("\n" in p for p in self.ids) else "\n"
        mark, no_letter = re.escape("".join(sorted(marks))), re.escape("".join(sorted({*marks, *line, " ", SPACE})))
        return (f"{line}|" if line else "") + f"[ {SPACE}]*+" + (f"[{mark}]*+" if marks else "") + f"[^{no_letter}]*+"

    def _tables(self) -> None:
        """Piece of a code point, rank and piece of two pieces, bytes of a piece."""
        self.of_code = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_code[ord(piece)] = i
        left, right, made = [], [], []
        for piece, i in self.ids.items():
            for at in range(1, len(piece)):
                a, b = self.ids.get(piece[:at]), self.ids.get(piece[at:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = np.array(left, np.int64) * len(self.pieces) + np.array(right, np.int64)
        order = np.argsort(keys)
        ranks = np.zeros(len(self.pieces), np.int64)
        normal = list(self.ids.values())
        ranks[normal] = np.unique([self.rank[self.pieces[i]] for i in normal], return_inverse=True)[1]
        self.pair_keys, self.pair_made = keys[order], np.array(made, np.int64)[order]
        self.pair_ranks = ranks[self.pair_made]
        self.bytes_of = np.array([p.replace(SPACE, " ").encode() for p in self.pieces] + [b""], object)

    # Normalising

    def _written(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points that units are written as and the source bytes behind each, one after another: `normalize` of many
        units without a prefix. With an empty map every character is written by itself, a space as its mark."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        return np.where(codes == ord(" "), ord(SPACE), codes), sizes

    def _steps(self, text: str) -> Iterator[tuple[str, int]]:
        """(what is written, source bytes it came from) along the text, before spaces are squeezed or escaped."""
        if not self.map.units:
            yield from zip(text, [len(c.encode("utf-8", "replace")) for c in text])
            return
        source, at = text.encode("utf-8", "replace"), 0
        while at < len(source):
            found = self.map.longest(source, at)
            if found is None:
                size = 1 + (source[at] >= 0xC0) + (source[at] >= 0xE0) + (source[at] >= 0xF0)
                found = source[at:at + size].decode(), size
            yield found
            at += found[1]

    def normalize(self, text: str, dummy: bool | None = None) -> tuple[str, list[int]]:
        """The written text, and for each of its characters the source byte where its origin begins, with the end as last."""
        written: list[str] = []
        starts: list[int] = []
        at, started, spaced = 0, False, self.squeezed
        for new, size in self._steps(text):
            begin, at = at, at + size
            if self.squeezed and not started and new == " ":
                continue
            if not started and (self.dummy if dummy is None else dummy):
                written.append(self.space)
                starts.append(begin)
            started = True
            if self.squeezed:
                new = new.lstrip(" ") if spaced else new
                spaced = new.endswith(" ") if new else spaced
            for c in new:
                written.append(self.space if c == " " else c)
                starts.append(begin)
        starts.append(at)
        while self.squeezed and written and written[-1] == self.space:
            written.pop()
            starts.pop()
        return "".join(written), starts

    # Merging

    def merge(self, text: str) -> list[str]:
        """Pieces of a written text: always the leftmost of the best pairs is merged first."""
        return self._scan(text) if len(text) <= SHORT else self._heap(text)

    def _scan(self, text: str) -> list[str]:
        get, parts = self.rank.get, list(text)
        ranks = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], NONE)
        return parts

    def _heap(self, text: str) -> list[str]:
        get, n = self.rank.get, len(text)
        parts: list[str] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> tuple | None:
            j = after[i]
            if j < n:
                rank = get(parts[i] + parts[j])
                if rank is not None:
                    return rank, i, len(parts[i]) + len(parts[j])
            return None

        heap = [p for i in range(n - 1) if (p := pair(i))]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heappush(heap, p)
        return [p for p in parts if p]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of what two pieces make, for many pairs."""
        key = a * len(self.pieces) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        fits = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(fits, self.pair_ranks[at], NEVER), np.where(fits, self.pair_made[at], -1)

    def merge_many(self, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`merge` of many units, a row each: pieces of their characters (-1 after the last) and the source bytes of each come
        in, those of the merged pieces go out."""
        pieces, sizes = np.pad(pieces, ((0, 0), (0, 1)), constant_values=-1), np.pad(sizes, ((0, 0), (0, 1)))
        ranks, made = self._pairs(pieces[:, :-1].ravel(), pieces[:, 1:].ravel())
        ranks, made = ranks.reshape(len(pieces), -1), made.reshape(len(pieces), -1)
        last = pieces.shape[1] - 1
        slot = np.arange(last + 1)
        rows = np.arange(len(pieces))
        p, z, r, m = pieces, sizes, ranks, made
        while last:
            i = r.argmin(1)
            live = np.flatnonzero(r[np.arange(len(r)), i] < NEVER)
            done = np.setdiff1d(np.arange(len(r)), live, assume_unique=True)
            pieces[rows[done]], sizes[rows[done]] = p[done], z[done]
            if not len(live):
                break
            rows, p, z, r, m, i = rows[live], p[live], z[live], r[live], m[live], i[live]
            row = np.arange(len(live))
            p[row, i], z[row, i] = m[row, i], z[row, i] + z[row, i + 1]
            gone = np.minimum(slot + (slot > i[:, None]), last)
            p, z = np.take_along_axis(p, gone, 1), np.take_along_axis(z, gone, 1)
            r, m = np.take_along_axis(r, gone[:, :-1].clip(max=last - 1), 1), np.take_along_axis(m, gone[:, :-1].clip(max=last - 1), 1)
            r[:, -1] = NEVER
            r[row, i], m[row, i] = self._pairs(p[row, i], p[row, np.minimum(i + 1, last)])
            left = np.flatnonzero(i)
            at = i[left] - 1
            r[left, at], m[left, at] = self._pairs(p[left, at], p[left, at + 1])
        return pieces[:, :last], sizes[:, :last]

    def _placed(self, written: str, starts: list[int]) -> tuple[list[int], list[int]]:
        """Ids of a written text and the source byte where each begins, with the end as last. Of the bytes of a character
        without a piece the last stands for its whole source, those before it for nothing."""
        ids: list[int] = []
        begins: list[int] = []
        at, get = 0, self.ids.get
        for piece in self.merge(written):
            i = get(piece)
            if i is not None:
                ids.append(i)
                begins.append(starts[at])
            elif self.fallback:
                raw = piece.encode("utf-8", "replace")
                ids += [self.byte_ids[b] for b in raw]
                begins += [starts[at]] * len(raw)
            elif not (ids and ids[-1] == self.unknown):
                ids.append(self.unknown)
                begins.append(starts[at])
            at += len(piece)
        begins.append(starts[-1])
        return ids, begins

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first source byte, source byte after) of every piece, without begin and end ids."""
        ids, begins = self._placed(*self.normalize(text))
        return list(zip(ids, begins, begins[1:]))

    # Decoding

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids say nothing, runs of byte ids are read as UTF-8 with a replacement for each broken byte, the
        space that was put before the text goes."""
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in ids:
            if self.kinds[i] == BYTE:
                raw.append(self.byte_ids.index(i) if self.byte_ids[0] + 255 != self.byte_ids[-1] else i - self.byte_ids[0])
                continue
            if raw:
                out.append(_read(bytes(raw)))
                raw.clear()
            first = first and not any(out)
            if self.kinds[i] == CONTROL:
                continue
            if i == self.unknown:
                out.append(self.unknown_text)
                continue
            piece = self.pieces[i]
            if first and (self.dummy or self.squeezed) and piece.startswith(SPACE):
                piece, first = piece[1:], self.squeezed
            out.append(piece.replace(SPACE, " "))
        if raw:
            out.append(_read(bytes(raw)))
        return "".join(out)

    # Many texts

    def _unit(self, unit: str) -> tuple[bytes, bytes, bytes]:
        """Ids, decoded bytes and source bytes per piece of a unit. It is decoded behind a space, which decoding takes off."""
        ids, begins = self._placed(*self.normalize(unit, dummy=False))
        sizes = [b - a for a, b in zip(begins, begins[1:])]
        return (struct.pack(f"<{len(ids)}I", *ids), self.decode([self.ids[SPACE], *ids]).encode("utf-8", "replace"),
                struct.pack(f"<{len(ids)}I", *sizes))

    def _learn(self, units: list[str]) -> None:
        """`_unit` of each: short ones whose characters all have pieces are worked on together, by width."""
        codes, sizes = self._written(units)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(lengths) - lengths
        first = self.of_code[codes]
        strange = np.logical_or.reduceat(first < 0, starts)
        for i in np.flatnonzero(strange | (lengths > SHORT)).tolist():
            self.known[units[i]] = self._unit(units[i])
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, SHORT)):
            at = np.flatnonzero(~strange & (lengths > low) & (lengths <= high))
            for part in np.array_split(at, -(-len(at) * high // 400_000)) if len(at) else ():
                slot = np.arange(min(high, lengths[part].max()))
                inside = slot < lengths[part, None]
                where = np.where(inside, starts[part, None] + slot, 0)
                p, z = self.merge_many(np.where(inside, first[where], -1).astype(np.int64), np.where(inside, sizes[where], 0))
                kept = p >= 0
                ids, ends = p[kept], kept.sum(1).cumsum().tolist()
                texts, raw, behind = self.bytes_of[ids].tolist(), ids.astype("<u4").tobytes(), z[kept].astype("<u4").tobytes()
                self.known.update((units[i], (raw[4 * a:4 * b], b"".join(texts[a:b]), behind[4 * a:4 * b]))
                                  for i, a, b in zip(part.tolist(), [0, *ends], ends))

    def _remember(self, wanted: set[str]) -> None:
        missing = wanted.difference(self.known)
        if len(self.known) + len(missing) > CACHE_UNITS:
            self.aged, self.known, missing = self.known, {}, wanted
        again = missing & self.aged.keys()
        self.known.update(zip(again, map(self.aged.__getitem__, again)))
        new = list(missing - again)
        if new:
            self._learn(new)

    def _joined(self, text: str, units: list[str]) -> tuple[bytes, bytes, bytes]:
        """Ids, decoded bytes, source bytes per piece. The units are those of the text with one more space before it, which
        stands for nothing in the source and is not decoded."""
        if not units:
            return b"", b"", b""
        ids, decoded, sizes = map(b"".join, zip(*map(self.known.__getitem__, units)))
        return ids, decoded[1:], struct.pack("<I", int.from_bytes(sizes[:4], "little") - 1) + sizes[4:]

    def encoded(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """Per text: ids and source bytes per piece as little-endian 32-bit numbers, decoded bytes between them."""
        if not self.apart:
            for text in texts:
                placed = self.encode(text)
                yield (struct.pack(f"<{len(placed)}I", *[i for i, _, _ in placed]),
                       self.decode([i for i, _, _ in placed]).encode("utf-8", "replace"),
                       struct.pack(f"<{len(placed)}I", *[b - a for _, a, b in placed]))
            return
        split = [self.cut.findall(" " + text)[:-1] if text else [] for text in texts]  # the last match is empty
        self._remember(set(chain.from_iterable(split)))
        for text, units in zip(texts, split):
            yield self._joined(text, units)


def _read(raw: bytes) -> str:
    """UTF-8 with one replacement for each byte that begins no character."""
    out, at = [], 0
    while at < len(raw):
        size = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
        try:
            out.append(raw[at:at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append(BROKEN)
            at += 1
    return "".join(out)


def coder(path: str) -> PieceBpe:
    return held(("pieces", path), lambda: PieceBpe(path))


def encode_column(text, path: str, ends: bool = True):
    """Array of (id, first, last) of a text column: the piece stands for the source bytes from `first` up to before `last`.
    Begin and end ids, if asked for, stand for nothing at the text's ends. Null is read as empty."""
    @pandas_udf("array<struct<id:int,first:int,last:int>>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = coder(path)

        def one(t: str) -> list[tuple[int, int, int]]:
            size = len(t.encode("utf-8", "replace"))
            return [(bpe.begin, 0, 0)] * ends + bpe.encode(t) + [(bpe.end, size, size)] * ends
        return pd.Series([[{"id": i, "first": a, "last": b} for i, a, b in one(t)] for t in texts])
    return encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def decode_column(ids, path: str):
    """Text of an array of ids; null: empty. An id outside the vocabulary is an error."""
    @pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        bpe = coder(path)
        return pd.Series([bpe.decode([int(i) for i in r]) if r is not None else "" for r in rows])
    return decode(F.col(ids) if isinstance(ids, str) else ids)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: number of ids with begin and end, hash of the ids, hash of the decoded text, checksum of the spans'
    ends (unsigned 32-bit little-endian source bytes, begin and end ids left out).

    Null text is empty (begin and end ids alone). Null ids stay null, repeated rows are answered each, an empty table gives no
    rows, other columns are not read. A text of any length is encoded whole; a stretch without spaces costs n log n. The work
    is a map over the input's partitions.
    """
    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, ends_crc32 long")
    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe = coder(path)
        begin, end = struct.pack("<I", bpe.begin), struct.pack("<I", bpe.end)
        whole, rows = [t or "" for t in texts], []
        for at in spans([len(t) for t in whole], STRETCH):
            for ids, decoded, sizes in bpe.encoded(whole[at]):
                sums = accumulate(memoryview(sizes).cast("I"))
                rows.append((len(ids) // 4 + 2, hashlib.sha256(begin + ids + end).hexdigest(), hashlib.sha256(decoded).hexdigest(),
                             zlib.crc32(struct.pack(f"<{len(sizes) // 4}I", *sums))))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ends_crc32"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text).cast("string")).alias("d"))
            .select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256", "d.ends_crc32"))
