"""Licence scan: Dice coefficient over word bigrams between text segments and licence templates, in built-in functions only.

A text's segments are its lines, its paragraphs (between blank lines) and itself. Normal form: lower-case words of letters
and digits; a segment is its set of word bigrams (a single word is none). Dice = 2 * shared / (sizes summed).

Two exact bounds prune. A template of m bigrams can only reach the threshold t with a segment of n bigrams if n lies between
m * t / (2 - t) and m * (2 - t) / t. And some of its words must occur: each template has a set of needed words such
that without all of them too few of its bigrams are left to reach t with any segment; a segment that holds none of the needed
words of any template is passed over by one pattern. The scan is one projection: no shuffle, no join.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.licence_texts import NOTICES

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def needed_words(text: str, threshold: float) -> list[str]:
    """Words without which a segment cannot reach the threshold, longest first: they cover all bigrams but too few."""
    pairs = [tuple(b.split(" ")) for b in bigrams(text)]
    # Reaching t takes shared >= t (n + m) / 2 with n >= shared, so shared >= m t / (2 - t).
    least = math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)
    chosen: list[str] = []
    for word in sorted({w for p in pairs for w in p}, key=lambda w: (-len(w), w)):
        if sum(not set(p) & set(chosen) for p in pairs) < least:
            break
        chosen.append(word)
    return chosen


def templates(notices: dict[str, list[str]], threshold: float) -> list[tuple[str, int, int, int, list[str]]]:
    """(licence, bigrams, least and most bigrams of a segment, the bigrams) of every text; texts under two words are left out."""
    out = []
    for name, texts in sorted(notices.items()):
        for text in texts:
            grams = bigrams(text)
            if grams:
                m = len(grams)
                out.append((name, m, math.ceil(m * threshold / (2 - threshold) - 1e-9),
                            math.floor(m * (2 - threshold) / threshold + 1e-9), grams))
    return out


def _literal(rows: list[tuple[str, int, int, int, list[str]]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(m).alias("m"), F.lit(low).alias("low"), F.lit(high).alias("high"),
                              F.array(*[F.lit(g) for g in grams]).alias("grams")) for name, m, low, high, grams in rows])


def matches_column(text: str = "text", notices: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> Column:
    """array(struct(dice, licence, segment)) of a text column, one element per segment and licence that reach the threshold,
    the best text of the licence each; sorted by dice falling, then licence, then segment."""
    notices = NOTICES if notices is None else notices
    rows = templates(notices, threshold)
    needed = sorted({w for texts in notices.values() for t in texts for w in needed_words(t, threshold)}, key=lambda w: (-len(w), w))
    known = _literal(rows)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    pattern = r"(?<![\p{L}\p{N}])(?:" + "|".join(needed) + r")(?![\p{L}\p{N}])"
    lines = F.split(whole, "\r\n|\r|\n")
    paragraphs = F.split(whole, r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")
    segments = F.filter(F.array_distinct(F.concat(lines, paragraphs, F.array(whole))), lambda s: F.lower(s).rlike(pattern))

    def of_segment(segment: Column) -> Column:
        words = F.regexp_extract_all(F.lower(segment), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        many = F.size(words) > 1
        grams = F.array_distinct(F.transform(
            F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"),
                         F.when(many, F.slice(words, 2, F.size(words))).otherwise(F.array()).alias("b")),
            lambda p: F.concat_ws(" ", p["a"], p["b"])))
        # A one-element array holds the bigrams, so that they are worked out once per segment.
        scored = F.flatten(F.transform(F.array(F.when(many, grams).otherwise(F.array().cast("array<string>"))), lambda g: F.transform(
            F.filter(known, lambda t: (F.size(g) >= t["low"]) & (F.size(g) <= t["high"])),
            lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["m"])).alias("dice"),
                               t["name"].alias("licence"), segment.alias("segment")))))
        reached = F.filter(scored, lambda s: s["dice"] >= F.lit(threshold))
        return F.filter(reached, lambda s: ~F.exists(reached, lambda o: (o["licence"] == s["licence"]) & (o["dice"] > s["dice"])))

    found = F.array_distinct(F.flatten(F.transform(segments, of_segment)))
    return F.when(F.lower(whole).rlike(pattern), F.array_sort(found, lambda x, y: F.when(
        x["dice"] != y["dice"], F.when(x["dice"] > y["dice"], -1).otherwise(1)).when(
        x["licence"] != y["licence"], F.when(x["licence"] < y["licence"], -1).otherwise(1)).when(
        x["segment"] < y["segment"], -1).when(x["segment"] > y["segment"], 1).otherwise(0))).otherwise(F.expr(
        "cast(array() as array<struct<dice:double,licence:string,segment:string>>)"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: dict[str, list[str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the best licence with its Dice coefficient and segment (null without one) and all matches.

    Null or empty text matches nothing. Equal coefficients go to the first licence by name. A segment that occurs twice in a
    text counts once. Null ids stay null, repeated rows are answered each, an empty table gives no rows, other columns are
    not read.
    """
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), matches_column(text, notices, threshold).alias("matches"))
            .select("doc_id", F.get("matches", F.lit(0))["licence"].alias("licence"),
                    F.get("matches", F.lit(0))["dice"].alias("dice"), F.get("matches", F.lit(0))["segment"].alias("segment"), "matches"))


def scan_sql(table: str = "documents", notices: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The scan's rows in DuckDB's SQL, without its pruning: every segment is compared with every template."""
    quote = "'{}'".format
    values = ", ".join(f"({quote(name)}, {m}, [{', '.join(map(quote, grams))}])" for name, m, _, _, grams in
                       templates(NOTICES if notices is None else notices, threshold))
    return f"""
WITH templates(licence, m, grams) AS (VALUES {values}),
lines AS (SELECT rowid AS r, doc_id, coalesce(text, '') AS text FROM (SELECT row_number() OVER () AS rowid, * FROM {table})),
segments AS (SELECT DISTINCT r, unnest(list_concat(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), regexp_split_to_array(
  text, '(?:\\r\\n|\\r|\\n)[ \\t]*(?:\\r\\n|\\r|\\n)\\s*'), [text])) AS segment FROM lines),
words AS (SELECT r, segment, regexp_extract_all(lower(segment), '[\\p{{L}}\\p{{N}}]+') AS w FROM segments),
grams AS (SELECT r, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words
  WHERE len(w) > 1),
dice AS (SELECT r, segment, licence, max(2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + m)) AS dice
  FROM grams, templates WHERE len(g) BETWEEN m * {threshold} / (2 - {threshold}) - 1e-9 AND m * (2 - {threshold}) / {threshold} + 1e-9
  GROUP BY ALL),
best AS (SELECT r, licence, dice, segment, count(*) OVER (PARTITION BY r) AS n_matches FROM dice WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, licence, segment) = 1)
SELECT doc_id, licence, dice, segment, coalesce(n_matches, 0)::BIGINT AS n_matches FROM lines LEFT JOIN best USING (r)"""
