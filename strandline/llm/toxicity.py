"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

`fit` takes a bounded sample of labelled documents. A token of a toxic document is a toxic token if one of its features (the
word, its first four or five characters) is found in toxic documents so much more often than in clean ones that chance is
ruled out (Chernoff bound over all features of the sample); every other token is clean. All the sample's tokens train a chain
of two states: a weight per feature, per transition and per start, by gradient steps on the chain's likelihood.

`spans_column` gives per text the score (the greatest marginal of the toxic state over its tokens, 0 without tokens) and the
offsets of runs of tokens whose marginal reaches `threshold`. Forward and backward passes are products of 2x2 matrices; a
batch's texts form one stream, with a reset at every text, multiplied blockwise with numpy.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.llm.memories import held
from strandline.llm.packing import spans
from strandline.llm.shingles import mix, shingle_set

SAMPLE = {1: 800, 0: 2400}  # most labelled documents of a class that a fit sees
CHUNK = 200_000  # tokens whose chains a training step holds at once
STRETCH = 2_000_000  # characters scored together
CACHE_WORDS = 500_000
PURE = 0.95  # least share of toxic documents among those that have a feature tied to them
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n)]


def chain_marginals(score: np.ndarray, starts: np.ndarray, move: np.ndarray, first: float,
                    pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Probability of state 1 at every position of a stream of chains, and the expected count of each transition.

    `score`: log-odds that a position's features give state 1. `starts`: positions where a chain begins. `move[a, b]`:
    weight of going from a to b. `first`: log-odds of starting in 1. The counts are worked out where `pairs` is set.
    """
    odds = np.clip(score, -30, 30)
    odds[starts] += first
    e1 = 1 / (1 + np.exp(-odds))
    e0 = 1 - e1
    (m00, m01), (m10, m11) = np.exp(move)
    steps = [m00 * e0, m01 * e1, m10 * e0, m11 * e1]  # from 0 to 0, 0 to 1, 1 to 0, 1 to 1
    back = [s.copy() for s in steps]
    for s, e in zip(steps, (e0, e1, e0, e1)):
        s[starts] = e[starts]  # whatever came before
    for s in back:
        s[starts] = 1.0
    alpha = _running(steps)
    # beta of position t-1 is back[t] times beta of t: the same running product on the reversed, transposed stream.
    turned = [np.concatenate(([1.0], back[i][:0:-1])) for i in (0, 2, 1, 3)]
    beta = _running(turned)[::-1]
    one = alpha * beta
    marginal = one / (one + (1 - alpha) * (1 - beta))
    if not pairs:
        return marginal, np.zeros((2, 2))
    joint = [x * y * z for x, y, z in zip((1 - alpha[:-1], 1 - alpha[:-1], alpha[:-1], alpha[:-1]), (b[1:] for b in back),
                                          (1 - beta[1:], beta[1:], 1 - beta[1:], beta[1:]))]
    inner = np.ones(len(odds), bool)
    inner[starts] = False
    total = sum(joint)
    return marginal, np.array([(j / total)[inner[1:]].sum() for j in joint]).reshape(2, 2)


def _running(steps: list[np.ndarray]) -> np.ndarray:
    """Second part of the normalised vectors v_t = v_{t-1} steps[t], from v = (1/2, 1/2). The stream is cut into blocks:
    products of whole blocks first, then the vector before each block, then all blocks side by side."""
    n = len(steps[0])
    width = max(1, int(np.sqrt(n / 8)))
    blocks = -(-n // width)
    padded = []
    for s, fill in zip(steps, (1.0, 0.0, 0.0, 1.0)):
        wide = np.full(blocks * width, fill)
        wide[:n] = s
        padded.append(np.ascontiguousarray(wide.reshape(blocks, width).T))
    a, b, c, d = padded
    p, q, r, s = a[0], b[0], c[0], d[0]
    for t in range(1, width):
        p, q, r, s = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    y = np.empty(blocks)
    one = 0.5
    for i, (p_, q_, r_, s_) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        y[i] = one
        low, high = (1 - one) * p_ + one * r_, (1 - one) * q_ + one * s_
        one = high / (low + high)
    out = np.empty((width, blocks))
    for t in range(width):
        x = 1 - y
        high = x * b[t] + y * d[t]
        y = high / (x * a[t] + y * c[t] + high)
        out[t] = y
    return out.T.reshape(-1)[:n]


@dataclass
class ToxicityModel:
    """Feature weights (log-odds of the toxic state), bias, transitions and start weight."""

    weights: dict[str, float]
    bias: float
    move: np.ndarray
    first: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False)  # tells models apart in a worker's memory

    def word(self, word: str) -> float:
        """Log-odds that the word alone is toxic: the weights of its `features`."""
        word, get = word.lower(), self.weights.get
        score = self.bias + get(f"={word}", 0.0)
        if len(word) > 3:
            score += get(f"4{word[:4]}", 0.0)
            if len(word) > 4:
                score += get(f"5{word[:5]}", 0.0)
        return score

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        words = [_WORD.findall(t) for t in texts]
        known = held(("toxicity", self.name), dict)
        new = set(chain.from_iterable(words)).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(chain.from_iterable(words))
        known.update((w, self.word(w)) for w in new)
        counts = np.array([len(ws) for ws in words])
        total = int(counts.sum())
        if not total:
            return [np.empty(0) for _ in texts]
        score = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.float64, total)
        begin = np.concatenate(([0], np.cumsum(counts)))
        starts = begin[:-1][counts > 0]
        marginal, _ = chain_marginals(score, starts, self.move, self.first)
        return [marginal[a:b] for a, b in zip(begin[:-1], begin[1:])]

    def score(self, texts: list[str | None], threshold: float) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Per text its score and the spans (start, end, greatest marginal) of runs of offending tokens."""
        whole = [t or "" for t in texts]
        out = []
        for text, p in zip(whole, self.marginals(whole)):
            found: list[list] = []
            if len(p) and p.max() >= threshold:
                last = -2
                for i, m in enumerate(_WORD.finditer(text)):
                    if p[i] >= threshold:
                        if last == i - 1:
                            found[-1][1], found[-1][2] = m.end(), max(found[-1][2], float(p[i]))
                        else:
                            found.append([m.start(), m.end(), float(p[i])])
                        last = i
            out.append((float(p.max()) if len(p) else 0.0, [tuple(f) for f in found]))
        return out


def token_rule(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features tied to toxic documents beyond chance (expected false ones over the whole sample: at most 0.5)."""
    seen = {0: Counter(), 1: Counter()}
    for words, toxic in docs:
        seen[toxic].update({f for w in set(words) for f in features(w)})
    n1 = sum(toxic for _, toxic in docs)
    share = n1 / max(1, len(docs))
    bound = np.log(max(1, len(seen[1])) / 0.5)
    tied = set()
    for f, a in seen[1].items():
        b = seen[0].get(f, 0)
        q = a / (a + b)
        if q > share and 0 < share < 1:
            kl = q * np.log(q / share) + ((1 - q) * np.log((1 - q) / (1 - share)) if q < 1 else 0.0)
            if (a + b) * kl >= bound and q >= PURE:
                tied.add(f)
    return tied


def without_copies(docs: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """One of each group of near copies (any of four minima over the word shingles met before): a group's own words would
    else look tied to its label."""
    met, kept = set(), []
    for words, toxic in docs:
        shingles = shingle_set(" ".join(words))
        keys = {(k, int(mix(shingles ^ np.uint64(7919 * (k + 1))).min())) for k in range(4)} if len(shingles) else set()
        if not keys & met:
            kept.append((words, toxic))
        met |= keys
    return kept


def train(docs: list[tuple[list[str], int]], rounds: int = 30, ridge: float = 1e-4) -> ToxicityModel:
    """Chain weights from documents (lower-case words, toxic or not); without both classes every token is clean."""
    docs = [(w, y) for w, y in without_copies(docs) if w]
    tied = token_rule(docs)
    if not tied or not docs:
        return ToxicityModel({}, -12.0, np.zeros((2, 2)), 0.0)
    words = sorted({w for ws, _ in docs for w in ws})
    number = {w: i for i, w in enumerate(words)}
    bad = np.array([any(f in tied for f in features(w)) for w in words])
    names: dict[str, int] = {}
    owner, name = [], []
    for i, w in enumerate(words):
        for f in features(w):
            owner.append(i), name.append(names.setdefault(f, len(names)))
    owner, name = np.array(owner), np.array(name)
    parts, pairs = [], np.zeros((2, 2))
    for at in spans([len(ws) for ws, _ in docs], CHUNK):
        stream = np.array([number[w] for ws, _ in docs[at] for w in ws])
        lengths = np.array([len(ws) for ws, _ in docs[at]])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        gold = (bad[stream] & np.repeat(np.array([y for _, y in docs[at]], bool), lengths)).astype(np.float64)
        inner = np.ones(len(stream), bool)
        inner[starts] = False
        np.add.at(pairs, (gold[:-1].astype(int)[inner[1:]], gold[1:].astype(int)[inner[1:]]), 1)
        parts.append((stream, starts, gold))

    theta, bias, move, first = np.zeros(len(names)), -3.0, np.zeros((2, 2)), 0.0
    step = [np.full(len(names), 0.5), np.full(1, 0.5), np.full((2, 2), 0.1), np.full(1, 0.1)]
    before = [np.zeros_like(s) for s in step]
    for _ in range(rounds):
        word_score = bias + np.bincount(owner, theta[name], len(words))
        miss, at_start, pair = np.zeros(len(words)), 0.0, np.zeros((2, 2))
        for stream, starts, gold in parts:
            marginal, met = chain_marginals(word_score[stream], starts, move, first, pairs=True)
            miss += np.bincount(stream, gold - marginal, len(words))
            at_start += (gold - marginal)[starts].sum()
            pair += met
        slopes = [np.bincount(name, miss[owner], len(names)) - ridge * len(docs) * theta,
                  np.array([miss.sum()]), pairs - pair, np.array([at_start])]
        # Resilient steps: each weight's own step grows while its slope keeps its sign.
        moves = []
        for s, old, new in zip(step, before, slopes):
            same = old * new
            s *= np.where(same > 0, 1.2, np.where(same < 0, 0.5, 1.0))
            np.clip(s, 1e-6, 2.0, out=s)
            moves.append(np.sign(new) * s)
            old[...] = new
        theta, bias, move, first = theta + moves[0], bias + moves[1][0], move + moves[2], first + moves[3][0]
    kept = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3}
    return ToxicityModel(kept, float(bias), move, float(first))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: dict[int, int] | None = None) -> ToxicityModel:
    """Model from a bounded sample of the labelled rows (`sample`: most rows by class, the smallest hashes of their ids).

    All of them, without near copies, train the chain. Rows with null id, text or label teach nothing.
    """
    sample = sample or SAMPLE
    wanted = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        "doc_id IS NOT NULL AND y IN (0, 1)")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id")
    chosen = None
    for y, most in sorted(sample.items()):
        part = (wanted.where(F.col("y") == y).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most `sample` ids: small by that bound, so they are sent to the scan of the texts.
    picked = rows.join(F.broadcast(chosen), "doc_id").select("text", "y").collect()
    return train(sorted((_WORD.findall(r["text"].lower()), r["y"]) for r in picked))


def spans_column(model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> Column:
    """struct(score, spans) of a text column; the model is bounded by the fit's sample and broadcast."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @pandas_udf("score double, spans array<struct<start:int,end:int,score:double>>")
    def score(texts: pd.Series) -> pd.DataFrame:
        own, whole = shared.value, [t or "" for t in texts]
        rows = [r for at in spans([len(t) for t in whole], STRETCH) for r in own.score(whole[at], threshold)]
        return pd.DataFrame({"score": [r[0] for r in rows],
                             "spans": [[{"start": a, "end": b, "score": p} for a, b, p in r[1]] for r in rows]})

    return score(F.col(text).cast("string"))


def scored(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: score, predicted, offending spans (code-point offsets, end exclusive).

    Null or empty text: score 0, no spans. Null ids stay null, repeated rows are answered each, an empty table gives no
    rows, other columns are not read.
    """
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), spans_column(model, text, threshold).alias("s"))
            .select("doc_id", "s.score", (F.col("s.score") >= F.lit(threshold)).cast("int").alias("predicted"), "s.spans"))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns as they were."""
    return docs.where(spans_column(model, text, threshold)["score"] < F.lit(threshold))
