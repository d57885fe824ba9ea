import random

import numpy as np
import pytest

from strandline.llm import cap_filters, groups, jaccard, licences, neighbours
from strandline.llm.shingles import shingle_set, word_hashes
from tests.llm.conftest import prose


def roots(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_shingles_are_word_windows():
    a = shingle_set("One two three FOUR five, six")
    assert len(a) == 2 and set(a.tolist()) & set(shingle_set("two three four five six").tolist())
    assert len(shingle_set("one two")) == 1 and len(shingle_set("?!")) == 0 == len(shingle_set(None))
    assert word_hashes("ab cd ab")[0] == word_hashes("ab cd ab")[2] != word_hashes("ab cd ab")[1]


def test_components_of_chains_and_stars(spark):
    draw = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [
        (draw.randint(200, 260), draw.randint(200, 260)) for _ in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in groups.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = roots(261, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert groups.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def varied(rows=160):
    draw = random.Random(5)
    out = []
    for i in range(rows):
        if i % 4 == 0 or not out:
            words = prose(draw.choice(["en", "de", "fr"]), draw.randint(3, 160), 10_000 + i).split()
        else:
            words = list(out[-1][1].split())
            for _ in range(draw.randint(0, max(1, len(words) // 40))):
                words[draw.randrange(len(words))] = draw.choice(["alpha", "beta", "gamma"])
        out.append((i, " ".join(words)))
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 3)
    monkeypatch.setattr(cap_filters, "CELL", 3)


def test_similar_documents_against_all_pairs(spark, small_cells):
    rows = varied() + [(500 + i, "one text that is repeated word for word in many rows of the table") for i in range(30)] + [
        (600, None), (601, ""), (602, "!!")]
    sets = [set(shingle_set(t).tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    links = np.bincount([x for p in pairs for x in p], minlength=len(rows))
    label = roots(len(rows), pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.similar_documents(docs).collect()}
    assert got == {rows[i][0]: (rows[label[i]][0], links[i]) for i in range(len(rows))}
    kept = {r["doc_id"] for r in jaccard.one_per_group(docs).collect()}
    assert kept == {rows[label[i]][0] for i in range(len(rows))}


def test_similar_documents_of_odd_rows(odd_documents):
    out = jaccard.similar_documents(odd_documents)
    assert out.count() == odd_documents.count()
    by = {r["doc_id"]: r for r in out.where("doc_id IS NOT NULL").collect()}
    assert by[2]["class_id"] == 1 and by[1]["n_copies"] == 3 and by[11]["class_id"] == 1 and by[11]["n_links"] == 4
    assert all(by[i]["n_links"] == 0 and by[i]["class_id"] == i for i in (3, 4, 5, 6, 7, 8, 9, 10))
    kept = jaccard.one_per_group(odd_documents)
    assert kept.columns == odd_documents.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 3, 4, 5, 6, 7, 8, 9, 10}
    assert jaccard.similar_documents(odd_documents.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for rows in (4, 7, 9):
        b = jaccard.bands_for(0.8, 0.9995, rows)
        assert 1 - (1 - 0.8**rows) ** b >= 0.9995 > 1 - (1 - 0.8**rows) ** (b - 1)


def vectors(n=400, d=24, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d))
    for i in range(0, n // 2, 5):
        for k in range(1, 5):
            x[i + k] = x[i] * draw.uniform(0.5, 2) + draw.normal(size=d) * draw.choice([0.02, 0.2, 0.33])
    x[300:310] = x[299]
    return x


ODD_VECTORS = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] + [1.0] * 23), (9005, [None] + [1.0] * 23),
               (9006, [float("inf")] * 24), (9007, [1.0, 2.0]), (None, [1.0] + [0.0] * 23)]
VECTOR_ROW = "vec_id long, embedding array<{}>, row long, class long, filter int, size int, score double, asks boolean"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 1, 1, 1, 0.5, True) for i, v in rows], VECTOR_ROW.format(kind))


def test_near_vectors_against_all_pairs(spark, small_cells):
    x = vectors()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    label = roots(len(x), np.argwhere(near).tolist())
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD_VECTORS
    out = cap_filters.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: r for r in out}
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), label[i], label[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _ in ODD_VECTORS if i)
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert cap_filters.near_duplicates(frame(spark, [], "float")).count() == 0


def test_rows_of_filters_are_never_broadcast(spark, monkeypatch):
    """The planner takes an exploded array for one row, so rows per filter and per tile must meet the others by key."""
    made, clustered = [], cap_filters.clustered
    monkeypatch.setattr(cap_filters, "clustered", lambda df, *keys: made.append(df) or clustered(df, *keys))
    cap_filters.near_duplicates(frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors()[:60])]))
    [tiles] = made
    assert "Broadcast" not in tiles._jdf.queryExecution().executedPlan().toString()


def test_filters_are_the_directions_over_the_threshold():
    code = cap_filters.ProductCode(10, 9, 0)
    x = vectors(400, 10)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ code.turn
    left, right = (turned[:, b] @ c.T for b, c in zip(code.blocks, code.codes))
    for row, got in enumerate(code.decode(unit)):
        assert sorted(got) == np.flatnonzero((left[row][:, None] + right[row][None, :]).ravel() >= code.threshold).tolist()


def test_hilbert_curve_steps_to_adjacent_cells():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest_neighbours_recall_and_scores(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(neighbours, "CHUNK", 7)
    x = vectors(600)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD_VECTORS
    out = neighbours.nearest(frame(spark, rows), 20, F.col("vec_id") % 20 == 0).toPandas()
    hit = 0
    for q in range(0, 600, 20):
        found = out[out["query_id"] == q].sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21)) and q not in found["vec_id"].tolist()
        known = found[found["vec_id"].notna()]
        assert np.allclose(known["score"], x[known["vec_id"].astype(int)] @ x[q])
        assert (np.diff(found["score"]) <= 0).all()
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score, kind="stable")[:20]) & set(known["vec_id"].astype(int)))
    assert hit / 600 >= 0.9
    assert neighbours.nearest(frame(spark, []), 20, F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])]), 20, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 1.0)]


def test_needed_words_are_a_bound():
    draw = random.Random(1)
    for texts in licences.NOTICES.values():
        for text in texts:
            grams, needed = set(licences.bigrams(text)), set(licences.needed_words(text, 0.8))
            rest = {g for g in grams if not needed & set(g.split())}
            assert 2 * len(rest) / (len(rest) + len(grams)) < 0.8


def test_licence_scan_of_planted_and_odd_texts(spark, odd_documents):
    body = licences.NOTICES["MIT"][-1]
    rows = [(1, f"{prose('en', 50, 1)}\nReleased under the  MIT license\n{prose('en', 20, 2)}"), (2, body), (3, body.replace("\n", " ").upper()),
            (4, "\n\n".join([prose("de", 30, 3), body.replace(". ", ".\n"), prose("de", 30, 4)])), (5, "the license of the river"),
            (6, None), (7, "")]
    out = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["licence"] for i in range(1, 8)] == ["MIT", "MIT", "MIT", "MIT", None, None, None]
    assert out[2]["dice"] == 1.0 and out[5]["matches"] == []
    odd = licences.scan(odd_documents)
    assert odd.count() == odd_documents.count() and odd.where("licence IS NOT NULL").count() == 0
    assert licences.scan(odd_documents.limit(0)).count() == 0


def test_nearest_neighbours_of_many_copies(spark, monkeypatch):
    """A third of the rows are equal, another third ties with them: no meeting holds more than a chunk's classes, ids break ties."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neighbours, "CHUNK", 16)
    x = vectors(600)
    x[200:400] = x[7]
    x[400:] = np.round(x[400:]) + 0.0
    x[400:, 0] += 9
    placed, clustered = [], neighbours.clustered
    monkeypatch.setattr(neighbours, "clustered", lambda df, *keys: placed.append((df, keys)) or clustered(df, *keys))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[7].tolist())]
    out = neighbours.nearest(frame(spark, rows), 20, (F.col("vec_id") % 20 == 0) | F.col("vec_id").between(200, 260)).toPandas()
    [(meetings, keys)] = placed
    assert meetings.groupBy(*keys, "query").count().agg(F.max("count")).first()[0] <= 4 * neighbours.CHUNK
    queries = sorted({*range(0, 600, 20), *range(200, 261)})
    assert sorted(out["query_id"].unique().tolist()) == queries and len(out) == 20 * len(queries)
    ids = np.arange(601)
    whole, hit = np.vstack([x, x[7:8]]), 0
    for q in queries:
        score = (whole * x[q]).sum(1)
        score[q] = -np.inf
        want = np.lexsort((np.where(ids == 600, -1, ids), -score))[:20]
        found = out[out["query_id"] == q].sort_values("rank")
        got = [600 if np.isnan(v) else int(v) for v in found["vec_id"].astype(float)]
        assert q not in got and len(set(got)) == 20
        hit += len(set(got) & set(want.tolist()))
        if 200 <= q < 400:  # copies that are in the list are those of the least ids, in order
            copies = [i for i in got if (whole[i] == x[7]).all()]
            assert copies == [i for i in [600, 7, *range(200, 400)] if i != q][:len(copies)]
    assert hit / (20 * len(queries)) >= 0.9


def test_blocks_without_rows_are_stepped_over():
    inside, to = neighbours._steps(np.array([0, 40, 63]), np.array([0, 41, 63]), -1)
    assert inside.tolist() == [False, True, True] and to.tolist() == [40, 40]
