import hashlib
import zlib

import duckdb
import pytest

from strandline.llm import manifest
from strandline.llm.queries import ORACLES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(row):
    tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
    return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])) if tampered else row


def tree(digests):
    """Levels of nodes, the leaves first."""
    built = [digests]
    while len(built[-1]) > 1:
        built.append([H("".join(built[-1][i:i + 16])) for i in range(0, len(built[-1]), 16)])
    return built


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r), leaf(lowered(r)), r) for r in rows if r[1] == s), key=lambda x: x[:4])
              for s in sources}
    trees = {s: tree([x[2] for x in leaves[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, own, start, row) in enumerate(leaves[s]):
            siblings, folded = "", start
            for built, i in ((trees[s], at), (top, k)):
                for level in built[:-1]:
                    run = level[i // 16 * 16:i // 16 * 16 + 16]
                    siblings += "".join(run[:i % 16] + run[i % 16 + 1:])
                    folded = H("".join(run[:i % 16]) + folded + "".join(run[i % 16 + 1:]))
                    i //= 16
            out.append((row[0], own, trees[s][-1][0], top[-1][0], H(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows_of(sizes, start=0):
    rows, i = [], start
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, "en" if i % 3 else None, i * 7 if i % 4 else None, [f"Text Ä {i}", "lower only", "", None, "ÉA" * 40][i % 5]))
            i += 1
    return rows


CASES = [{"a": 1}, {"a": 5}, {"a": 17}, {"a": 1, None: 1}, {"b": 300, "a": 1, None: 16, "é": 17, "": 2, "z": 33},
         {f"s{i}": 1 + i % 3 for i in range(40)}]


@pytest.mark.parametrize("sizes", CASES)
def test_manifest_equals_brute_force(spark, sizes):
    rows = rows_of(sizes)
    extra = ", tree string, run int, members int, level string"
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA + extra).repartition(3)
    got = manifest.verified(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def odd_rows(odd_documents):
    return [tuple(r) for r in odd_documents.selectExpr("doc_id", "if(doc_id % 2 = 0, 's', null) AS source", "lang", "class AS n_chars",
                                                       "text").collect()]


def test_odd_rows_and_an_empty_table(spark, odd_documents):
    rows = odd_rows(odd_documents)
    got = manifest.verified(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    empty = manifest.verified(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_the_session_keeps_its_bound(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    manifest.verified(spark.createDataFrame(rows_of({"a": 3}), SCHEMA)).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_sql_says_the_same(odd_documents):
    for rows in (odd_rows(odd_documents), *map(rows_of, CASES)):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
        names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
        assert sorted(con.execute(f"SELECT {names} FROM ({ORACLES['op13_merkle_manifest']})").fetchall(), key=str) == brute(rows)
