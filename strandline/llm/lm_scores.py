"""Cross-entropy difference: how much more a text looks like a target corpus than like the background.

Two bigram models of one form are counted together: the target from the rows marked so, the background from all rows.
Every word is itself and every pair is kept, however rare; a word that was never counted has its shape's place (runs of upper
case, lower case and digits folded) or the unknown word's, whose counts are zero. A pair's probability is (its count + STRENGTH
times the word's probability) / (the first word's count + STRENGTH); the word's is add-one smoothed over words, shapes and two.

Words are known by 64-bit hashes (two of 100 million share one with a chance of 3 in 10,000; pairs are grouped by 64 bits as
well) and counted into a Spark table; those of share PAIR_SHARE or more are broadcast with their counts. Pairs are dealt once,
with the texts that have them: where all lines of a pair meet they are counted, scored, and added up per text. What is shuffled
is packed by lot of texts, so that a pair stands once a lot; its texts come back as one sum per text and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.packing import spans
from strandline.llm.shingles import mix
from strandline.session import stage

WORD_SHARE, PAIR_SHARE = 2e-5, 3e-6  # shares from which a word's pairs are spread, and from which its counts are broadcast
STRENGTH = 8.0
STRETCH, LOT = 2_000_000, 5_000_000  # characters split together, and whose pairs are dealt together
HELD = 500_000  # keys a counting task holds before it passes them on
BROADCAST_IDS = 8_000_000  # most target ids that are sent to the tasks (about 128 MB); more are joined by a shuffle
MOST_BUCKETS, LEAST_TOKENS = 32, 100_000  # buckets (two per core if that is more), and tokens from which there is one more
PART_TOKENS = 800_000  # tokens of a bucket worked on together
HELD_TEXTS = 4_000_000  # texts whose sums a bucket holds before it passes them on
COUNTED, TARGET, SCORED = 1, 2, 4  # marks of a line's text
START, NONE = -0x61C8864680B583EB, -1  # in place of a hash: before a text's first word; no pair but its second word before another
WORD_COUNTS = ("n", "n_target", "n_before", "n_target_before")
SUMS = {"lot": "long", "text": "binary", "loss": "binary", "target_loss": "binary", "doc_id": "binary", "no_id": "binary",
        "n_tokens": "binary"}
LINES = SUMS | {"bucket": "int", "part": "int"} | dict.fromkeys(("times", "n_lines", "first", "second", "n_pairs"), "binary")
_UPPER, _LOWER, _DIGIT = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{Ll}+"), regex.compile(r"\p{N}+")


def shape(word: str) -> str:
    """Runs of upper-case letters, lower-case letters and digits as one A, a and 0; other characters stay."""
    body, mark = (word, "") if word[-1:].isalnum() else (word[:-1], word[-1:])
    if body.isalpha():  # most words; letters of no case count as lower case here
        if body.islower():
            return "a" + mark
        if body.istitle() and len(body) > 1:
            return "Aa" + mark
    return _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))


def tokens(texts: list[str], shapes: set[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the number of words of each; `shapes`, if given, gathers the words' shapes."""
    words, counts = [], []
    for at in spans([len(t) for t in texts], STRETCH):
        split = [t.split() for t in texts[at]]
        flat = list(chain.from_iterable(split))
        counts += map(len, split)
        words.append(hashed(flat))
        if shapes is not None:
            shapes.update(map(shape, set(flat)))
    return np.concatenate([np.empty(0, np.int64), *words]), np.array(counts, np.int64)


def preceding(words: np.ndarray, counts: np.ndarray, start: int = START) -> np.ndarray:
    """The word before each; `start` before a text's first."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = start
    return before


def hashed(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False).view(np.int64)


def _key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))


def _whole(texts, most: int = STRETCH) -> Iterator[tuple[slice, list[str]]]:
    whole = [t or "" for t in texts]
    for at in spans([len(t) for t in whole], most):
        yield at, whole[at]


def _merged(keys: list[str], of: tuple[str, ...]):
    """Adds up frames with the same keys, held back until they are many; `of` are the columns added."""
    kept: list[pd.DataFrame] = []

    def add(frame: pd.DataFrame | None) -> pd.DataFrame | None:
        """What is to be passed on now, if anything; None asks for the rest."""
        nonlocal kept
        kept += [] if frame is None else [frame]
        if not kept or frame is not None and sum(map(len, kept)) <= 2 * HELD:
            return None
        whole = pd.concat(kept, ignore_index=True)
        key = whole[keys[0]].to_numpy() if len(keys) == 1 else _key(*(whole[k].to_numpy() for k in keys))
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        whole = pd.DataFrame({k: whole[k].to_numpy()[first] for k in keys}
                             | {c: np.bincount(at, whole[c], len(first)).astype(np.int64) for c in of})
        kept = [] if frame is None or len(whole) > HELD else [whole]
        return None if kept else whole

    return add


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words of a partition's rows, as a word and as the word before, passed on whenever HELD are held; and the
    shapes met. Words that follow themselves are marked among the shapes (n_before = 1)."""
    shapes: set[str] = set()
    doubled: set[int] = set()
    merge = _merged(["w"], WORD_COUNTS)

    def named() -> pd.DataFrame:
        w = np.append(hashed(list(shapes)), np.fromiter(doubled, np.int64, len(doubled)))
        twice = np.arange(len(w)) >= len(shapes)
        shapes.clear()
        doubled.clear()
        return pd.DataFrame({"w": w, "shape": True} | dict.fromkeys(WORD_COUNTS, 0) | {"n_before": twice.astype(np.int64)})

    for batch in batches:
        for at, texts in _whole(batch["text"]):
            words, counts = tokens(texts, shapes)
            doubled.update(np.unique(words[preceding(words, counts) == words]).tolist())
            target, filled = batch["target"].to_numpy(bool)[at], counts > 0
            w, place = np.unique(words, return_inverse=True)
            last = place[np.cumsum(counts)[filled] - 1]  # words that no word follows
            n, n_target = np.bincount(place, minlength=len(w)), np.bincount(place, np.repeat(target, counts), len(w))
            part = merge(pd.DataFrame({
                "w": np.append(w, START), "n": np.append(n, 0), "n_target": np.append(n_target, 0),
                "n_before": np.append(n - np.bincount(last, minlength=len(w)), filled.sum()),
                "n_target_before": np.append(n_target - np.bincount(last, target[filled], len(w)), (filled & target).sum())}))
            if part is not None:
                yield part.assign(shape=False)
            if len(shapes) + len(doubled) > HELD:
                yield named()
    part = merge(None)
    if part is not None:
        yield part.assign(shape=False)
    if shapes or doubled:
        yield named()


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the pairs of a partition's rows, passed on whenever HELD are held."""
    merge = _merged(["a", "b"], ("n", "n_target"))
    for batch in batches:
        for at, texts in _whole(batch["text"]):
            words, counts = tokens(texts)
            part = merge(pd.DataFrame({"a": preceding(words, counts), "b": words, "n": 1,
                                       "n_target": np.repeat(batch["target"].to_numpy(bool)[at], counts)}))
            if part is not None:
                yield part
    part = merge(None)
    if part is not None:
        yield part


@dataclass
class DifferenceModel:
    """Both models. `words` (w, n, n_target, n_before, n_target_before) has every word, `counts` (a, b, n, n_target) every pair;
    `often_key` are the broadcast words, sorted, with their counts (rows as WORD_COUNTS). `rows` are the texts of the fit."""

    rows: DataFrame
    words: DataFrame
    total: int
    total_target: int
    size: int
    often_key: np.ndarray
    often: np.ndarray
    source: tuple  # the table of the fit and its columns

    @property
    def counts(self) -> DataFrame:
        """Every pair, counted when it is read; scoring counts the pairs where their texts' lines meet."""
        return (self.rows.mapInPandas(_count_pairs, "a long, b long, n long, n_target long")
                .groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")))

    def totals(self) -> tuple[tuple[int, int], ...]:
        """Per model (background, target): its tokens, and those with one added for every word, shape and the two."""
        return tuple((n, n + self.size) for n in (self.total, self.total_target))


def fit(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DifferenceModel:
    """Models from all rows of `docs`; the target's are those whose id is in `target` (a table with the same id column).

    Null texts have no tokens. Rows of null id belong to the background only. No target row: both models still score, the
    target's by its smoothing alone.
    """
    aimed = target.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn(
        "target", F.lit(True))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    few = aimed.count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(aimed) if few else aimed, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    if not few:  # a shuffled partition that is made again must have its rows in the same order
        marked = marked.sortWithinPartitions("doc_id", "text")
    counted = stage(marked.mapInPandas(_count_words, "w long, shape boolean, " + ", ".join(f"{c} long" for c in WORD_COUNTS))
                    .groupBy("w", "shape").agg(*[F.sum(c).alias(c) for c in WORD_COUNTS]), "words")
    words = counted.where("NOT shape").drop("shape")
    # A shape whose word follows itself has no place of its own.
    places = F.when(F.col("shape"), F.col("n_before") == 0).otherwise(F.col("n") > 0)
    whole = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_target")],
                        F.count(F.when(places, 1)).alias("places")).first()
    # At most 2/PAIR_SHARE words can pass.
    often = words.where(F.greatest("n", "n_before") >= F.lit(PAIR_SHARE * whole["n"])).toPandas().sort_values("w")
    return DifferenceModel(marked, words, whole["n"], whole["n_target"], 2 + whole["places"], often["w"].to_numpy(np.int64),
                           often[list(WORD_COUNTS)].to_numpy(np.int64).T.copy(), (docs, doc_id, text))


def _packed(x: np.ndarray) -> bytes:
    """An array's type (the narrowest that holds whole numbers) and its bytes, all first ones before all second ones and so on:
    small numbers compress well so."""
    if x.dtype.kind != "f":
        low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        x = x.astype("i8" if low < 0 else next((t for t in ("u1", "u2", "u4") if high <= np.iinfo(t).max), "i8"))
    return x.dtype.str[1:].encode() + x.view("u1").reshape(len(x), x.itemsize).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:2].decode())
    return np.frombuffer(data, "u1", offset=2).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns whose equal rows are neighbours."""
    if not len(sorted_columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])))


def _line_writer(shared, buckets: int, parts: int):
    """Per lot of texts a row with what is known of them (part -1), and a row per bucket and part with their pairs dealt there.

    A lot's pairs stand once each, by second word, with the texts that have them. Words are coded by their place among the
    broadcast ones, others by their hash. Pairs of words of share WORD_SHARE are dealt by the pair, others by the second word:
    there all its pairs meet, and with them its lines as a word before (first: NONE), which gives both its counts.
    """
    cells = buckets * parts

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often_key, spread, before_loss = shared.value

        def coded(words: np.ndarray) -> np.ndarray:
            if not len(often_key):
                return words
            place = np.searchsorted(often_key, words)
            place[place == len(often_key)] = 0
            return np.where(often_key[place] == words, place, words)

        def common(codes: np.ndarray) -> np.ndarray:
            return (codes >= 0) & (codes < len(often_key))

        start = int(coded(np.array([START]))[0])
        for batch in batches:
            for at, texts in _whole(batch["text"], LOT):
                words, counts = tokens(texts)
                second, of = coded(words), np.repeat(np.arange(len(texts), dtype=np.int32), counts)
                first = preceding(second, counts, start)
                flags = batch["flags"].to_numpy(np.int64)[at]
                lot = int(batch["row"].iloc[at.start])
                scored = np.flatnonzero(flags & SCORED)
                near = common(first)
                if len(scored):
                    ids = pd.array(batch["doc_id"].iloc[at], "Int64")[scored]
                    sums = [np.bincount(of[near], loss[first[near]], len(texts))[scored] for loss in before_loss]
                    yield pd.DataFrame([{
                        "lot": lot, "bucket": lot % buckets, "part": -1, "text": _packed(scored),
                        "doc_id": _packed(ids.fillna(0).to_numpy(np.int64)), "no_id": _packed(ids.isna()),
                        "n_tokens": _packed(counts[scored]), "loss": _packed(sums[0]),
                        "target_loss": _packed(sums[1])}], columns=LINES)
                far = np.flatnonzero(~near)
                second, of = np.append(second, first[far]), np.append(of, of[far])
                first = np.append(first, np.full(len(far), NONE))
                del words, near, far
                key = _key(first, second)
                order = np.argsort(key, kind="stable")  # texts stay in order within a pair
                key, of = key[order], of[order]
                lines = _starts(key, of)
                times, text = np.diff(np.append(lines, len(key))), of[lines] << 3 | flags[of[lines]]
                pairs = _starts(key[lines])
                n_lines, key = np.diff(np.append(pairs, len(lines))), key[lines[pairs]]
                first, second = (x[order[lines[pairs]]] for x in (first, second))
                known = common(second)
                wide = known.copy()
                wide[known] = spread[second[known]]
                cell = (mix(np.where(wide, key, mix(second.view(np.uint64)))) % np.uint64(cells)).astype(np.int64)
                order = np.lexsort((second, cell))
                lens = n_lines[order]
                line = np.repeat(pairs[order] - np.cumsum(lens) + lens, lens) + np.arange(len(lines))
                ends = np.append(0, np.cumsum(lens))
                first, second, cell, text, times = first[order], second[order], cell[order], text[line], times[line]
                groups = _starts(cell, second)
                sizes, cuts = np.diff(np.append(groups, len(cell))), _starts(cell)
                out = []
                for lo, hi in zip(cuts, np.append(cuts[1:], len(cell))):
                    own, (g, h), (k, m) = int(cell[lo]), np.searchsorted(groups, (lo, hi)), ends[[lo, hi]]
                    out.append({"lot": lot, "bucket": own % buckets, "part": own // buckets, "text": _packed(text[k:m]),
                                "times": _packed(times[k:m]), "n_lines": _packed(lens[lo:hi]),
                                "first": _packed(first[lo:hi]), "second": _packed(second[groups[g:h]]),
                                "n_pairs": _packed(sizes[g:h])})
                if out:
                    yield pd.DataFrame(out, columns=LINES)

    return write


def _part_losses(part: list[dict], often: np.ndarray, totals) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """The sums of losses that the pairs of one part add to each scored text of a lot."""
    columns = [[_unpacked(p[c]) for p in part] for c in ("text", "times", "n_lines", "first", "second", "n_pairs")]
    lengths = [len(t) for t in columns[0]]
    text, times, n_lines, first, second, n_pairs = (np.concatenate(columns.pop(0)) for _ in range(6))
    first, second = first.astype(np.int64), second.astype(np.int64)
    word, of_word = np.unique(second, return_inverse=True)
    of_word = np.repeat(of_word.astype(np.int32), n_pairs)
    _, at, pair = np.unique(mix(first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + of_word.astype(np.uint64)),
                            return_index=True, return_inverse=True)
    before, of_word, pair = first[at] == NONE, of_word[at], np.repeat(pair.astype(np.int32), n_lines)
    known = (word >= 0) & (word < often.shape[1])
    losses = []
    for flag, row, (total, room) in zip((COUNTED, TARGET), (0, 1), totals):
        n = np.bincount(pair, np.where(text & flag, times, 0), len(at))
        w = np.bincount(of_word[~before], n[~before], len(word))
        w[known] = often[row, word[known]]
        loss = np.where(before, np.log(n + STRENGTH), -np.log(np.where(before, 1.0, n + STRENGTH * (w[of_word] + 1) / room)))
        losses.append(loss)
    end = 0
    for p, length in zip(part, lengths):
        own = slice(end, end := end + length)
        asked = np.flatnonzero(text[own] & SCORED)
        if len(asked):
            at, n = text[own][asked] >> 3, times[own][asked]
            yield p["lot"], at, [n * loss[pair[own][asked]] for loss in losses]


def _bucket_scorer(shared, totals):
    """Parts of a bucket one after another; each lot's sums over all of them, and the rows of what is known of the lots."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, sums, held = shared.value, {}, 0

        def added(part: list[dict]) -> None:
            nonlocal held
            for lot, at, losses in _part_losses(part, often, totals):
                size = int(at.max()) + 1
                own = sums.get(lot, np.empty((2, 0)))
                if own.shape[1] < size:
                    held += size - own.shape[1]
                    own = sums[lot] = np.pad(own, ((0, 0), (0, size - own.shape[1])))
                for i, loss in enumerate(losses):
                    own[i] += np.bincount(at, loss, own.shape[1])

        def passed() -> Iterator[pd.DataFrame]:
            nonlocal held
            for lot, own in sums.items():
                at = np.flatnonzero(own.any(axis=0))  # a sum of zero adds nothing
                yield pd.DataFrame([{"lot": lot, "text": _packed(at), "loss": _packed(own[0, at]),
                                     "target_loss": _packed(own[1, at])}], columns=SUMS)
            sums.clear()
            held = 0

        part: list[dict] = []
        for batch in batches:
            heads = batch["part"] < 0
            if heads.any():
                yield batch.loc[heads, list(SUMS)]
            for row in batch.loc[~heads].to_dict("records"):
                if part and part[0]["part"] != row["part"]:
                    added(part)
                    part = []
                    if held > HELD_TEXTS:
                        yield from passed()
                part.append(row)
        if part:
            added(part)
        yield from passed()

    return score


def _lot_scores(rows: pd.DataFrame) -> pd.DataFrame:
    """The scored texts of a lot from what is known of them and their sums of all buckets."""
    head = rows[rows["n_tokens"].notna()].iloc[0]
    text = _unpacked(head["text"])
    n = _unpacked(head["n_tokens"])
    ids = pd.array(_unpacked(head["doc_id"]), "Int64")
    ids[_unpacked(head["no_id"]).astype(bool)] = pd.NA
    sums = np.zeros((2, len(text)))
    for row in rows.itertuples():  # each names a text once
        place = np.searchsorted(text, _unpacked(row.text))
        for i, loss in enumerate((row.loss, row.target_loss)):
            sums[i, place] += _unpacked(loss)
    background, target = sums / np.maximum(n, 1)
    return pd.DataFrame({"doc_id": ids, "n_tokens": n, "target_loss": target, "background_loss": background,
                         "difference": target - background})


def scored(docs: DataFrame, model: DifferenceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_tokens, target_loss, background_loss (mean nats per token), difference (target minus background:
    below 0 is closer to the target).

    Null, empty and blank texts have no tokens and all zeros. Null ids stay null, repeated rows are answered each, an empty
    table gives no rows, other columns are not read. The table of the fit is dealt once, to count its pairs and to score them;
    another table's texts are dealt together with those of the fit.
    """
    context = docs.sparkSession.sparkContext
    flags = F.lit(COUNTED) + F.when(F.col("target"), TARGET).otherwise(0)
    n = model.total
    if docs is model.source[0] and (doc_id, text) == model.source[1:]:
        rows = model.rows.select("doc_id", "text", (flags + SCORED).alias("flags"))
    else:
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        n += (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // 2  # no more words than that
        rows = rows.withColumn("flags", F.lit(SCORED)).unionByName(model.rows.select("doc_id", "text", flags.alias("flags")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    buckets = min(max(MOST_BUCKETS, 2 * context.defaultParallelism), 1 + n // LEAST_TOKENS)
    parts = 1 + n // (buckets * PART_TOKENS)
    counts = dict(zip(WORD_COUNTS, model.often))
    often = context.broadcast((model.often_key, counts["n"] >= WORD_SHARE * model.total,
                               np.log(np.stack([counts["n_before"], counts["n_target_before"]]) + STRENGTH)))
    lines = rows.mapInPandas(_line_writer(often, buckets, parts), ", ".join(f"{c} {kind}" for c, kind in LINES.items()))
    own = context.broadcast(np.stack([counts["n"], counts["n_target"]]))
    sums = lines.repartitionById(buckets, "bucket").sortWithinPartitions("part").mapInPandas(
        _bucket_scorer(own, model.totals()), ", ".join(f"{c} {kind}" for c, kind in SUMS.items()))
    return sums.groupBy("lot").applyInPandas(
        _lot_scores, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")
