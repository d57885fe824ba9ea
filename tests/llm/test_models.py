import itertools
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from strandline.llm import language, lm_scores, toxicity
from tests.llm.conftest import LANGUAGES, prose


@pytest.fixture(scope="module")
def language_model(spark):
    rows = [(i, prose(lang, 200, i), lang) for i, lang in enumerate(list(LANGUAGES) * 30)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_of_unseen_texts(language_model):
    for lang in LANGUAGES:
        for i in range(30):
            text = prose(lang, 6 + i, 1000 + i)
            assert language_model.predict(text.upper() + "!!")[0] == lang
            score, rejected = language_model.predict(text)[1:]
            assert 0 <= score <= 1 and not rejected


def test_smallest_size_wins_and_ties_are_rejected(language_model):
    text = language.fold(prose("de", 3000, 5))
    sizes = language_model.sizes(text)
    assert len(text) > language.BLOCK
    whole = [sum(len(c.compress(text[i:i + language.BLOCK])) for i in range(0, len(text), language.BLOCK))
             for c in language_model.compressors()]
    assert sizes == whole and language_model.ranked(text)[0] == min(zip(whole, language_model.dictionaries))
    same = language.LanguageModel({"a": b"the same words", "b": b"the same words"})
    assert same.predict("the same words") == ("a", 0.0, True)


def test_language_of_odd_rows(spark, odd_documents, language_model):
    out = language.detect(odd_documents, language_model).collect()
    assert len(out) == odd_documents.count()
    by = {r["doc_id"]: r for r in out}
    assert by[3]["lang_pred"] == by[4]["lang_pred"] == by[5]["lang_pred"] == by[6]["lang_pred"] == "und"
    assert by[1]["lang_pred"] == by[9]["lang_pred"] == "en" and by[8]["lang_pred"] == "de"
    kept = language.identified(odd_documents, language_model)
    assert kept.columns == odd_documents.columns
    assert {1, 2, 8, 9, 11} <= {r["doc_id"] for r in kept.collect()}
    assert language.detect(odd_documents.limit(0), language_model).count() == 0
    empty = language.fit(odd_documents.limit(0))
    assert empty.dictionaries == {} and empty.predict("text")[0] == "und"


def test_chain_marginals_against_all_labelings():
    draw = np.random.default_rng(0)
    score, starts, move, first = draw.normal(size=40) * 3, np.array([0, 1, 6, 17, 28]), draw.normal(size=(2, 2)), 0.7
    marginal, pairs = toxicity.chain_marginals(score, starts, move, first, pairs=True)
    expected = np.zeros((2, 2))
    for a, b in zip(starts, [*starts[1:], 40]):
        total, ones, moves = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum(score[a + i] for i, v in enumerate(y) if v) + first * y[0] + sum(move[u, v] for u, v in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
            for u, v in zip(y, y[1:]):
                moves[u, v] += w
        assert np.allclose(marginal[a:b], ones / total)
        expected += moves / total
    assert np.allclose(pairs, expected)


@pytest.fixture(scope="module")
def toxic_rows():
    rows = []
    for i in range(400):
        words = prose(["en", "de", "fr"][i % 3], 40, i).split()
        if i % 4 == 0:
            for k in range(3):
                words.insert((7 * k + i) % 40, ["grobjan", "vilefoo", "scumble"][(i // 4 + k) % 3])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxic_spans_and_scores(spark, toxic_rows, odd_documents):
    docs = spark.createDataFrame([r[:2] for r in toxic_rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows if i < 300] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    for i, text, y in toxic_rows:
        assert out[i]["predicted"] == y, (i, out[i]["score"])
        marked = {text[s["start"]:s["end"]] for s in out[i]["spans"]}
        assert not y or any("grobjan" in m or "vilefoo" in m or "scumble" in m for m in marked)
    odd = toxicity.scored(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(r["score"] == 0 for r in odd if r["doc_id"] in (3, 4, 5, 6))
    kept = toxicity.without_toxic(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, y in toxic_rows if not y}
    assert toxicity.scored(docs.limit(0), model).count() == 0
    clean = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.scored(docs, clean).collect())


def test_toxic_words_of_late_texts_train_the_chain():
    """Toxic documents that sort first would fill any place given by text order; the words of the last ones count as well."""
    docs = [([f"aa{i}", *prose("en", 30, i).split(), "grobjan"], 1) for i in range(400)]
    docs += [([f"zz{i}", *prose("de", 30, i).split(), "scumble"], 1) for i in range(60)]
    docs += [([f"mm{i}", *prose(["en", "de"][i % 2], 30, 1000 + i).split()], 0) for i in range(900)]
    model = toxicity.train(sorted(docs))
    for word in ("grobjan", "scumble"):
        score, spans = model.score([f"the river {word} walking"], toxicity.THRESHOLD)[0]
        assert score >= toxicity.THRESHOLD and [s[:2] for s in spans] == [(10, 17)], word
    assert model.score(["the river green walking"], toxicity.THRESHOLD)[0][1] == []


def test_difference_against_plain_counts(spark, odd_documents):
    rows = [(i, prose("en" if i % 3 else "de", 50, i)) for i in range(60)] + [(60, None), (61, ""), (None, "the the"), (3, prose("en", 50, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(None,), (0,)], "doc_id long")
    out = lm_scores.scored(docs, lm_scores.fit(docs, target)).collect()
    assert len(out) == len(rows)
    texts = [(i, (t or "").split()) for i, t in rows]
    words = sorted({w for _, t in texts for w in t})
    shapes = {lm_scores.shape(w) for w in words}
    size = 2 + len(words) + len(shapes)

    def loss_of(chosen):
        uni, bi, ctx, k = Counter(), Counter(), Counter(), lm_scores.STRENGTH
        for i, t in texts:
            if chosen(i):
                for a, b in zip(["<s>", *t], t):
                    uni[b] += 1
                    bi[a, b] += 1
                    ctx[a] += 1
        n = sum(uni.values())
        return lambda t: float(np.mean([-math.log((bi[a, b] + k * (uni[b] + 1) / (n + size)) / (ctx[a] + k))
                                        for a, b in zip(["<s>", *t], t)])) if t else 0.0

    losses = [loss_of(lambda i: i is not None and i % 3 == 0 and i < 60), loss_of(lambda i: True)]
    by_text = {tuple(t): [f(t) for f in losses] for _, t in texts}
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["target_loss"], 9), round(r["background_loss"], 9)) for r in out)
    want = sorted((-1 if i is None else i, round(by_text[tuple(t)][0], 9), round(by_text[tuple(t)][1], 9)) for i, t in texts)
    assert got == want
    odd = lm_scores.scored(odd_documents, lm_scores.fit(odd_documents, odd_documents.where("doc_id = 1").select("doc_id")))
    assert odd.count() == odd_documents.count()
    empty = docs.limit(0)
    assert lm_scores.scored(empty, lm_scores.fit(empty, target)).count() == 0


def test_difference_keeps_rare_and_target_only_pairs(spark, monkeypatch):
    """Shares so high that most words and pairs are none of the broadcast ones; texts of the fit and texts it never saw."""
    monkeypatch.setattr(lm_scores, "WORD_SHARE", 0.02)
    monkeypatch.setattr(lm_scores, "PAIR_SHARE", 0.004)
    rows = [(i, prose("en" if i % 4 else "de", 40, i) + (f" rare{i} Only{i}x tail" if i % 2 else f" good{i} only pair")) for i in range(60)]
    good, new = {i for i in range(0, 60, 4)}, [(100, "the rare1 unseen tail of"), (101, "never Met"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm_scores.fit(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"))
    assert 0 < len(model.often_key) < model.counts.count() / 4
    words = {w for _, t in rows for w in t.split()}
    size, k = 2 + len(words) + len({lm_scores.shape(w) for w in words}), lm_scores.STRENGTH
    got = {r["doc_id"]: r for r in lm_scores.scored(docs.union(spark.createDataFrame(new, docs.schema)), model).collect()}
    assert len(got) == 63 and got[102]["n_tokens"] == got[102]["difference"] == 0
    for column, chosen in (("target_loss", good), ("background_loss", set(range(60)))):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for i, t in rows:
            if i in chosen:
                for a, b in zip(["", *t.split()], t.split()):
                    uni[b], bi[a, b], ctx[a] = uni[b] + 1, bi[a, b] + 1, ctx[a] + 1
        n = sum(uni.values())

        def p(a, b):
            return (bi[a, b] + k * (uni[b] + 1) / (n + size)) / (ctx[a] + k)

        some = next(iter(words))
        assert abs(sum(p(some, b) for b in words) + (size - len(words)) * p(some, "-") - 1) < 1e-9
        for i, t in rows + new[:2]:
            want = np.mean([-math.log(p(a, b)) for a, b in zip(["", *t.split()], t.split())])
            assert abs(got[i][column] - want) < 1e-9, (i, column)


def test_difference_writes_less_than_four_times_its_texts(spark, tmp_path, monkeypatch):
    """Most pairs are rare: a pair is dealt once, not once to be counted and again, with its words' counts, to be scored."""
    monkeypatch.setattr(lm_scores, "PAIR_SHARE", 2e-5)
    chance = np.random.default_rng(7)
    words = np.array([f"w{i:x}" for i in range(60_000)])
    rows = [(i, " ".join(words[(len(words) ** chance.random(400)).astype(int) - 1])) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs, target = spark.read.parquet(str(tmp_path / "docs")), spark.range(0, 1200, 3).withColumnRenamed("id", "doc_id")
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))

    def written() -> dict[str, int]:
        local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        shuffled = {(f := local.apply(i)).getName(): f.length() for i in range(local.size())}
        return {k: n for k, n in shuffled.items() if k.startswith("shuffle_") and k.endswith(".data")} | {
            str(f): f.stat().st_size for f in folder.rglob("*.parquet")}

    before, joins = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
    try:
        assert len(lm_scores.scored(docs, lm_scores.fit(docs, target)).collect()) == 1200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    new = sum(n for k, n in written().items() if k not in before)
    texts = sum(len(t) for _, t in rows)
    assert 0 < new < 4 * texts, new / texts
