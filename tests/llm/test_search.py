import math
import random
import re
from collections import Counter

import duckdb

from strandline.llm import sketch_search
from strandline.llm.queries import ORACLES
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    """All scores by the definition."""
    split = [(i, Counter(t.translate(LOWER) for t in TERM.findall(text or ""))) for i, text in docs]
    split = [(i, c) for i, c in split if c]
    n_docs, length = len(split), sum(c.total() for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in split:
            m = 100 - 90 + 90 * c.total() * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in {t.translate(LOWER) for t in TERM.findall(text or "")} if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_terms_are_the_pattern_s_matches():
    draw = random.Random(1)
    for _ in range(2000):
        text = "".join(draw.choice("aZé9_-`{~ \x00\x7f\t日İ \x85ß@[") for _ in range(draw.randint(0, 12)))
        assert [t.decode() for t in sketch_search.terms(text)] == [t.translate(LOWER) for t in TERM.findall(text)]


def test_search_equals_brute_force_at_any_width(spark):
    docs = [(i, prose(("en", "de", "fr")[i % 3], 5 + i % 40, i) + f" tail{i % 7}") for i in range(300)]
    items = [(i, prose(("en", "de", "fr")[i % 3], 6, 900 + i) + f" tail{i}") for i in range(12)] + [(77, "nowhere"), (78, None)]
    want = brute(docs, items)
    for width, block in ((4096, 1000), (3, 1000), (64, 4)):
        out = sketch_search.search(made(spark, docs, "doc_id long, text string").repartition(5),
                                   made(spark, items, "item_id long, text string"), width=width, block=block).collect()
        assert sorted(map(tuple, out), key=str) == want


def test_odd_rows_ties_and_empty_tables(spark, odd_documents):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    items = [(1, "house river word"), (1, "walking"), (None, "und the"), (2, "")]
    table = made(spark, items, "item_id long, text string").selectExpr("*", "1 AS score", "'x' AS rank")
    together = [(1, "house river word walking"), (None, "und the"), (2, "")]
    assert sorted(map(tuple, sketch_search.search(odd_documents, table).collect()), key=str) == brute(docs, together)
    assert sketch_search.search(odd_documents.limit(0), table).count() == 0
    assert sketch_search.search(odd_documents, table.limit(0)).count() == 0


def test_bounds_hold_and_spare_most_documents():
    draw = random.Random(3)
    words = [f"w{i}".encode() for i in range(3000)]
    texts = [b" ".join(draw.choices(words, k=60)).decode() for _ in range(2000)]
    queries = [[t for t in sketch_search.terms(texts[i])][:12] for i in range(0, 2000, 400)]
    counts = [Counter(sketch_search.terms(t)) for t in texts]
    df = Counter(t for c in counts for t in c)
    searcher = sketch_search.Searcher([list(dict.fromkeys(q)) for q in queries], {t: sketch_search.weight(2000, n) for t, n in df.items()},
                                      2000, 120_000, 10)
    bounds = searcher.sketches(counts, [100] * 2000) @ searcher.lookup
    for q, query in enumerate(searcher.queries):
        for i in range(0, 2000, 97):
            assert bounds[i, q] >= sum(w * sketch_search.impact(counts[i][t], 100) for t, w in query if t in counts[i])
    searcher.show(list(range(2000)), texts)
    assert searcher.rescored < 0.1 * 2000 * len(queries)
    assert [best[0][2] for best in searcher.best] == list(range(0, 2000, 400))


def test_sql_says_the_same(spark, odd_documents):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    items = [(1, "house RIVER word"), (3, "und the é")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op12_ranked_search']})").fetchall()
    assert sorted(got, key=str) == brute(docs, items)
