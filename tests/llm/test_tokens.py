import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandline.llm import byte_bpe, packing

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = "ab  \n\t\r\x1c\x1f\x85 　​1²Ⅷ'sT.!é日́\U0001f642﻿İΣ<|endoftext|>"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_word_tokens_equal_the_library(tokenizer):
    own = packing.WordTokens(WORDS)
    texts = noise(3000)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_word_tokens_of_any_marks_and_forms_equal_the_library(monkeypatch, tokenizer):
    """End marks, combining marks, odd spaces and letters of odd case, with memories that fill and age all the time."""
    monkeypatch.setattr(packing, "CACHE_UNITS", 300)
    monkeypatch.setattr(packing, "CACHE_WORDS", 200)
    parts = ["a", "B", "e\u0301", "\u00e9", "\u03a3", "\u0130", "_", "'s", " ", "\n", ".", ",", "!", "?", "1", "\u00b2", "\ud55c", "\u0301", "-",
             "\u00df", "\u00a0", "\u2003", "\u017f", "\u212a", "\x1c", "x.", "'", ";"]
    pick = random.Random(5)
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(5_000)]
    own = packing.WordTokens(WORDS)
    for at in range(0, len(texts), 50):
        for text, ids in zip(texts[at:at + 50], own.encode(texts[at:at + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert own.aged


def test_byte_bpe_equals_the_library(reference):
    own = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    texts = noise(3000, 2) + ["a" * 5000, "Ω" * 300 + " " * 300]
    for text, (n, ids, raw) in zip(texts, own.digests(texts)):
        want = reference.encode_ordinary(text)
        assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()), text
        assert raw == hashlib.sha256(text.encode()).hexdigest() and own.decode(own.encode(text)) == text.encode()


def test_merges_of_many_equal_merges_of_one(reference):
    ranks = byte_bpe.read_ranks(RANKS)
    pieces = [bytes(random.Random(i).choices(b"abcdetion \xc3\xa9", k=1 + i % 60)) for i in range(2000)]
    assert byte_bpe.PairRanks(ranks).merge_many(pieces) == [byte_bpe.merge(p, ranks) for p in pieces]


def test_differencing_keeps_every_piece_and_levels_windows():
    draw = random.Random(4)
    sizes = [draw.randint(1, 60) for _ in range(300)]
    packed = packing.multiway_difference(sizes, 7)
    assert sorted(i for w in packed for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in packed]
    assert max(sums) - min(sums) <= 3
    assert packing.multiway_difference([], 3) == [] and packing.windows([2048, 1], 2048) in ([[0], [1]], [[1], [0]])
    assert all(sum([700, 700, 700][i] for i in w) <= 1000 for w in packing.windows([700, 700, 700], 1000))


def test_packed_pieces_cover_every_id_once(spark, odd_documents, tokenizer):
    for docs in (odd_documents, odd_documents.limit(0)):
        rows = docs.select("doc_id", "text").collect()
        out = packing.pack(docs, WORDS).toPandas()
        want = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), tuple(
            tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in rows)
        out["doc_id"] = out["doc_id"].fillna(-1).astype(int)
        assert out["length"].sum() == sum(len(ids) for _, ids in want)
        by_id = {}
        for i, ids in want:
            by_id.setdefault(i, []).append(ids)
        for r in out.itertuples():
            options = [np.array(ids[r.start:r.start + r.length], "<u4").tobytes() for ids in by_id[r.doc_id] if len(ids) == r.doc_tokens]
            assert r.ids_crc32 in {zlib.crc32(o) for o in options}
        for _, part in out.groupby("sequence_id"):
            part = part.sort_values("offset")
            assert (part["offset"] == part["length"].cumsum() - part["length"]).all() and part["length"].sum() <= 2048


def test_digests_of_odd_rows(odd_documents, reference):
    out = byte_bpe.digests(odd_documents, RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == odd_documents.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.where("doc_id IS NOT NULL").collect()}
    for r in out:
        if r["doc_id"] is not None:
            assert r["n_tokens"] == len(reference.encode_ordinary(texts[r["doc_id"]]))
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.digests(odd_documents.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_columns_of_ids_and_bytes(spark):
    df = spark.createDataFrame([("héllo  wörld",), (None,), ("",)], "text string")
    ids = df.select("text", byte_bpe.encode_column("text", RANKS, public_tokenizers.PATTERN).alias("ids"))
    back = ids.select("text", byte_bpe.decode_column("ids", RANKS, public_tokenizers.PATTERN).alias("raw")).collect()
    assert [bytes(r["raw"]) for r in back] == [(r["text"] or "").encode() for r in back]
