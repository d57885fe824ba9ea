import hashlib
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
import sentencepiece

from strandline.llm import piece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = "ab  \n\t\r\x00\x01 ▁ 1²Ⅷ'sT.!é日́\U0001f642�İΣ</s>the ing  　\U0010ffff"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return piece_bpe.PieceBpe(MODEL)


def noise(n, seed, most=14):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, most))) for _ in range(n)]


def library_spans(library, text):
    return [(p.id, p.begin, p.end) for p in library.encode(text.encode(), return_type="proto").pieces]


TEXTS = [*noise(4000, 1), *noise(200, 2, 90), " " * 50, "▁" * 33 + "x", "x" * 3000, "日本" * 600, " a", "a ", "  the  thing ", "▁▁the", ""]


def test_ids_texts_and_spans_equal_the_library(library, own):
    for text, (ids, decoded, sizes) in zip(TEXTS, own.encoded(TEXTS)):
        want = library.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, repr(text)
        assert decoded.decode() == library.decode(want) == own.decode(want), repr(text)
        placed = own.encode(text)
        assert placed == library_spans(library, text), repr(text)
        assert list(struct.unpack(f"<{len(sizes) // 4}I", sizes)) == [b - a for _, a, b in placed]


def test_spans_tile_the_source(own):
    for text in TEXTS:
        at = 0
        for _, a, b in own.encode(text):
            assert a == at
            at = b
        assert at == len(text.encode())


def test_scan_and_heap_merge_alike(own):
    for text in noise(1500, 3, 38):
        written = own.normalize(text)[0]
        assert own._scan(written) == own._heap(written)


def test_coarse_units_encode_alike(own, library):
    """A vocabulary that joins letters and marks is cut at spaces only."""
    coarse = piece_bpe.PieceBpe(MODEL)
    coarse.ids["a."] = 0
    coarse.cut = re.compile(coarse._boundaries())
    assert coarse.cut.findall(" a.b, c")[:-1] == [" a.b,", " c"] and own.cut.findall(" a.b, c")[:-1] == [" a", ".b", ",", " c"]
    del coarse.ids["a."]
    for text, a, b in zip(TEXTS, coarse.encoded(TEXTS), own.encoded(TEXTS)):
        assert a == b, repr(text)


def test_decoding_of_any_ids_equals_the_library(library, own):
    draw = random.Random(5)
    choices = [0, 1, 2, *range(3, 259), *[draw.randrange(259, 32000) for _ in range(100)], own.ids["▁"], own.ids["▁▁"], own.ids["▁the"]]
    for _ in range(4000):
        ids = [draw.choice(choices) for _ in range(draw.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids
    smile = [own.byte_ids[b] for b in "\U0001f642".encode()]
    assert own.decode(smile[:3]) == library.decode(smile[:3]) and own.decode(smile) == "\U0001f642"


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("flags", [(True, True), (True, False), (False, True), (False, False)])
def test_longest_prefix_normalising_equals_the_library(own, rule, flags):
    """Compiled maps of the library's own rules, put into the model in hand, with and without prefix and squeezed spaces."""
    dummy, squeezed = flags
    reference = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=True,
                                                      remove_extra_whitespaces=squeezed)
    spec = dict(piece_bpe.fields(next(v for k, v in piece_bpe.fields(reference.serialized_model_proto()) if k == 3)))
    mine = piece_bpe.PieceBpe(MODEL)
    mine.map, mine.dummy, mine.squeezed, mine.apart = piece_bpe.CharacterMap(spec.get(2, b"")), dummy, squeezed, False
    for text in [*noise(1500, 6), "ﬁ½ ①Å ｶﾞ", "    x ", "   "]:
        written, starts = mine.normalize(text)
        want, offsets = reference.normalize(text.encode(), with_offsets=True)
        assert written == (want.decode() if isinstance(want, bytes) else want), repr(text)
        by_byte = [s for c, s in zip(written, starts) for _ in c.encode()] + [starts[-1]]
        assert not written or by_byte == offsets, repr(text)
        assert [b for _, _, b in mine.encode(text)][-1:] == ([starts[-1]] if written else [])


def test_refused_models(tmp_path):
    raw = open(MODEL, "rb").read()
    other = tmp_path / "unigram.model"
    other.write_bytes(raw + b"\x12\x02\x18\x01")  # one more trainer message: model type 1
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(str(other))


def test_digests_of_odd_rows(odd_documents, library):
    out = piece_bpe.digests(odd_documents, MODEL).collect()
    assert len(out) == odd_documents.count()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.where("doc_id IS NOT NULL").collect()}
    for r in out:
        if r["doc_id"] is not None:
            ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
            ends = [b for _, _, b in library_spans(library, texts[r["doc_id"]])]
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
            assert r["ends_crc32"] == zlib.crc32(struct.pack(f"<{len(ends)}I", *ends))
    assert piece_bpe.digests(odd_documents.limit(0), MODEL).count() == 0


def test_columns_of_pieces_and_texts(spark):
    df = spark.createDataFrame([("héllo  wörld",), (None,), ("",)], "text string")
    coded = df.select("text", piece_bpe.encode_column("text", MODEL).alias("pieces"))
    back = coded.select("text", "pieces", piece_bpe.decode_column("pieces.id", MODEL).alias("again")).collect()
    for r in back:
        assert r["again"] == (r["text"] or "") and r["pieces"][0]["id"] == 1 and r["pieces"][-1]["id"] == 2
        assert r["pieces"][-1]["first"] == len((r["text"] or "").encode())
