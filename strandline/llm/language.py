"""Language by compression: a text belongs to the language whose dictionary compresses it smallest.

`fit` gathers per language a bounded sample of labelled texts (the sample's size is a parameter): the rows of the smallest
text hash in each of `slots` hash slots, one stretch of `stretch` characters each, found by a map-side combined aggregate.
The stretches joined are the language's raw-content zstandard dictionary. `predict` folds a text to lower-case letters and spaces, cuts it into blocks, compresses
every block with every dictionary and compares the totals; a text of any length is judged whole. The decision is rejected
where the runner-up is closer than `margin` (share of the winner's bytes).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SLOTS = 200
STRETCH = 1200
BLOCK = 4000
LEVEL = 6
MARGIN = 0.002
NARROW = 0.05
CONTEXTS, FINE_LEVEL = 8, 12
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> bytes:
    """Lower-case letters in UTF-8, every stretch of other characters one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


@dataclass
class LanguageModel:
    """Raw-content dictionaries by language, at most SLOTS * STRETCH characters each."""

    dictionaries: dict[str, bytes]
    _compressors: list = field(default_factory=list, repr=False)
    _fine: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "_compressors": [], "_fine": []}

    def compressors(self) -> list:
        if not self._compressors:
            import zstandard

            for raw in self.dictionaries.values():
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
                self._compressors.append(zstandard.ZstdCompressor(
                    dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._compressors

    def sizes(self, raw: bytes) -> list[int]:
        """Compressed bytes by language."""
        blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors()]

    def _contexts(self) -> list[list[tuple[bytes, int]]]:
        """Per language a few stretches of its dictionary, each with its own compressed size."""
        if not self._fine:
            for raw in self.dictionaries.values():
                stretches = [raw[len(raw) * k // CONTEXTS:][:BLOCK] for k in range(CONTEXTS)]
                self._fine.append([(s, len(self._plain().compress(s))) for s in stretches])
        return self._fine

    @staticmethod
    def _plain():
        import zstandard

        return zstandard.ZstdCompressor(level=FINE_LEVEL, write_content_size=False, write_checksum=False)

    def ranked(self, raw: bytes) -> list[tuple[int, str]]:
        """Languages by size. Where a text of one block is nearly tied, the bytes are added that it costs behind stretches of each
        dictionary: there it shares their entropy codes, which tells a text too short to be compressed by itself."""
        sizes = self.sizes(raw)
        best = sorted(sizes)[:2]
        if len(best) == 2 and best[1] - best[0] <= NARROW * best[0] and len(raw) <= BLOCK:
            plain = self._plain()
            more = [sum(len(plain.compress(s + b" " + raw)) - own for s, own in stretches) for stretches in self._contexts()]
            sizes = [a + b for a, b in zip(sizes, more)]
        return sorted(zip(sizes, self.dictionaries))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the decision is rejected."""
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        ranked = self.ranked(fold(text))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        (best, lang), (second, _) = ranked[:2]
        gap = (second - best) / max(best, 1)
        return lang, gap / (gap + 0.02), gap < MARGIN


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", slots: int = SLOTS, stretch: int = STRETCH) -> LanguageModel:
    """Dictionaries from labelled rows; rows with null text or label teach nothing. Repeated texts count once in a slot.

    The driver receives at most `slots` stretches of `stretch` characters per language. No labelled row: no dictionary, and
    every prediction is `und`.
    """
    sample = (docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
              .where("lang IS NOT NULL AND text rlike '\\\\p{L}'")
              .select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, stretch).alias("part"))
              .groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot"))
              .agg(F.min_by("part", F.struct(F.length("part") < F.lit(stretch // 2), F.col("h"))).alias("part")))
    rows = sorted((r["lang"], r["slot"], r["part"]) for r in sample.collect())
    found: dict[str, list[str]] = {}
    for name, _, part in rows:
        found.setdefault(name, []).append(part)
    return LanguageModel({name: fold(" ".join(parts)) for name, parts in found.items()})


def language_column(model: LanguageModel, text: str = "text") -> Column:
    """struct(lang_pred, score, rejected) of a text column, by a broadcast model (its size is bounded by `fit`)."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict(F.col(text).cast("string"))


def detect(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: lang_pred, score, rejected. Null or letterless text: `und`, score 0, rejected.

    Null ids stay null, repeated rows are answered each, ties go to the first language by name, an empty table gives no
    rows, other columns are not read.
    """
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), language_column(model, text).alias("p"))
            .select("doc_id", "p.lang_pred", "p.score", "p.rejected"))


def identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The documents whose language is decided, with all their columns as they were."""
    return docs.where(~language_column(model, text)["rejected"])
