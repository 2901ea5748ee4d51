"""Hierarchical language identification with linear support vector machines.

A document is first given a language family, then a language within it. Both
steps are one-versus-one votes of linear SVMs over hashed byte trigrams of the
lower-cased letters of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lodestone.session import staged, table

# Families of common languages; one that isn't here is its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
}
UNDETERMINED = "und"
FEATURES = 4096
PER_LANGUAGE = 400
ROWS_IN_ALL = 4000
SLICE = 256

_LETTER = regex.compile(r"\p{L}")
_SPACED = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the whole text: square roots of their counts, of
    length 1. Runs of anything but letters count as one space."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" ", dtype=np.uint8)
    data = data[np.append(True, (data[1:] != 32) | (data[:-1] != 32))].astype(np.uint32)
    if len(data) < 3:
        return np.zeros(FEATURES, dtype=np.float32)
    codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    counts = np.bincount((codes * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    found = np.sqrt(counts).astype(np.float32)
    return found / np.linalg.norm(found)


@F.pandas_udf(ArrayType(FloatType()))
def trigram_column(texts: pd.Series) -> pd.Series:
    return pd.Series([trigrams(t) for t in texts])


class LanguageModel:
    """Classes and the SVM of each pair of them: `pairs` maps (a, b) to weights
    and intercept, positive for a. `families` maps a family to its languages."""

    def __init__(self, families: dict[str, list[str]], pairs: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.families, self.pairs = families, pairs
        self.order = list(pairs)
        self.weights = np.array([pairs[p][0] for p in self.order], dtype=np.float32).reshape(len(self.order), FEATURES)
        self.shifts = np.array([pairs[p][1] for p in self.order], dtype=np.float64)

    def _vote(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        wins = dict.fromkeys(names, 0)
        strength = dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            m = margin[(a, b)]
            wins[a if m > 0 else b] += 1
            strength[a] += m
            strength[b] -= m
        best = max(names, key=lambda n: (wins[n], strength[n]))
        least = min(margin[(a, b)] * (1 if a == best else -1) for a, b in combinations(names, 2) if best in (a, b))
        return best, float(1 / (1 + np.exp(-np.clip(3 * least, -50, 50))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if isinstance(t, str) and _LETTER.search(t)] if self.families else []
        for at in range(0, len(known), SLICE):
            rows = known[at : at + SLICE]
            margins = np.array([trigrams(texts[i]) for i in rows]) @ self.weights.T + self.shifts
            for i, values in zip(rows, margins, strict=True):
                margin = dict(zip(self.order, values.tolist(), strict=True))
                family, sure = self._vote(sorted(self.families), margin)
                lang, surer = self._vote(self.families[family], margin)
                langs[i], scores[i] = lang, sure * surer
        return langs, scores

    def column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("lang_pred string, score double")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                langs, scores = model.predict(texts.tolist())
                yield pd.DataFrame({"lang_pred": langs, "score": scores})

        return predicted(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, rows_in_all: int = ROWS_IN_ALL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit the SVMs on a seeded sample of labelled rows that aren't held out:
    about `per_language` of each language and `rows_in_all` together, whatever
    the size of the table. Sampled texts are used whole."""
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel({}, {})
    most = max(1, min(per_language, rows_in_all // len(counts)))
    part = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(most / n))])
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000)
    sample = staged(drawn.select("lang", array_to_vector(trigram_column("text")).alias("features")), "language-sample")
    present = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in present:
        families.setdefault(family_of(lang), []).append(lang)
    pairs = {}
    for a, b in combinations(sorted(families), 2):
        pairs[(a, b)] = _fit(sample, families[a], families[b])
    for langs in families.values():
        for a, b in combinations(langs, 2):
            pairs[(a, b)] = _fit(sample, [a], [b])
    return LanguageModel(families, pairs)


def _fit(sample: DataFrame, ones: list[str], zeros: list[str]) -> tuple[np.ndarray, float]:
    rows = sample.filter(F.col("lang").isin(ones + zeros)).select(F.col("lang").isin(ones).cast("double").alias("label"), "features")
    fitted = LinearSVC(maxIter=25, regParam=1e-3, standardization=False).fit(rows.coalesce(2))
    return fitted.coefficients.toArray(), float(fitted.intercept)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Only the text is looked at. Defined cases: a null text, or one without any
    letter, is `und` with score 0, as is every text under a model that saw no
    label; with one learned language every other text is that language, score
    1; repeated rows and null ids keep their rows, a null id isn't held out; an
    empty table gives an empty result; other columns are ignored, whatever
    their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), model.column(F.col(text_col)).alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, train(docs))
