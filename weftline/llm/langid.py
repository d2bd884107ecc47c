"""Operator 10: language identification, first the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPARSE, as_vectors, in_fold, map_texts, sparse_rows
from weftline.llm.ngrams import counts

FOLDS, HELD_OUT = 4, 2

# Families of closely related languages, by ISO 639-1 code. A language not listed is its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "da", "no", "nb", "nn", "sv", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, members in families.items() if lang in members), f"own:{lang}")


def features(texts: list, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Square roots of the n-gram shares: rows of length one, whatever the text's length."""
    c = counts(texts, orders, bits)
    return np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class LanguageModel:
    """machines: (kind, positive, negative) to a row of weights, its last element the intercept."""

    orders: tuple[int, ...]
    bits: int
    groups: dict[str, list[str]]
    machines: dict[tuple[str, str, str], np.ndarray]

    def _vote(self, kind: str, names: list[str], margins: dict) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the pairwise machines (most wins, then the largest total margin) and its worst pairwise confidence."""
        n = len(next(iter(margins.values()))) if margins else 0
        wins, total, worst = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
        for i, j in combinations(range(len(names)), 2):
            if (m := margins.get((kind, names[i], names[j]))) is None:
                continue
            p = 1 / (1 + np.exp(-np.clip(2 * m, -40, 40)))
            wins[:, i] += m >= 0
            wins[:, j] += m < 0
            total[:, i] += m
            total[:, j] -= m
            worst[:, i] = np.minimum(worst[:, i], p)
            worst[:, j] = np.minimum(worst[:, j], 1 - p)
        best = np.argmax(wins + 0.5 * np.tanh(total / (1 + np.abs(total).max(initial=0))), axis=1)
        return best, worst[np.arange(n), best]

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        langs, score = ["und"] * len(texts), np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            part = [t or "" for t in texts[at : at + 256]]
            x = features(part, self.orders, self.bits)
            margins = {k: x @ w[:-1] + w[-1] for k, w in self.machines.items()} or {("", "", ""): np.zeros(len(part))}
            names = sorted(self.groups)
            family, sure = self._vote("family", names, margins)
            within = {f: self._vote(f, self.groups[f], margins) for f in names}
            for k, text in enumerate(part):
                if names and any(map(str.isalpha, text)):
                    f = names[family[k]]
                    langs[at + k] = self.groups[f][within[f][0][k]]
                    score[at + k] = sure[k] * within[f][1][k]
        return langs, score


def fit(docs: DataFrame, per_language: int = 1500, most_languages: int = 200, orders: tuple[int, ...] = (1, 2, 3), bits: int = 13, families: dict[str, tuple[str, ...]] = FAMILIES, reg: float = 1e-4) -> LanguageModel:
    """Learns from at most about per_language rows of a language (a documented bound), chosen by a hash of the id.

    Only text and non-null lang of rows outside the held-out fold are read. One linear SVM separates each pair of
    families, and one each pair of languages of a family; each is fitted by Spark ML. Over most_languages different values of
    lang are an error.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(~in_fold("doc_id", FOLDS, HELD_OUT))
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(n) > most_languages:
        raise ValueError(f"more than {most_languages} languages: each pair within a family is a model")
    groups: dict[str, list[str]] = {}
    for lang in sorted(n):
        groups.setdefault(family_of(lang, families), []).append(lang)
    if not n:
        return LanguageModel(orders, bits, groups, {})
    rate = F.element_at(F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, min(1.0, per_language / c))]), F.col("lang"))
    train = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < rate * (1 << 30)).select("lang", "text")

    size = 1 << bits

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            at, v, ends = [], [], [0]
            for i in range(0, len(texts), 256):
                x = features(texts.slice(i, 256).to_pylist(), orders, bits)
                row, place = np.nonzero(x)
                at.append(place)
                v.append(x[row, place])
                ends += (ends[-1] + np.searchsorted(row, np.arange(1, len(x) + 1))).tolist()
            return [sparse_rows(np.array(ends), np.concatenate(at), np.concatenate(v), size)]

        return work

    family = F.element_at(F.create_map(*[F.lit(v) for f, ls in groups.items() for lang in ls for v in (lang, f)]), F.col("lang"))
    points = as_vectors(map_texts(train.withColumn("family", family), "text", f"x {SPARSE}", start).drop("text"), "x")
    seen = {r["lang"] for r in points.select("lang").distinct().collect()}
    groups = {f: kept for f, ls in groups.items() if (kept := [x for x in ls if x in seen])}
    machines = {}
    for kind, names, col, rows in [("family", sorted(groups), "family", points), *[(f, ls, "lang", points.where(F.col("family") == f)) for f, ls in groups.items()]]:
        for a, b in combinations(names, 2):
            pair = rows.where(F.col(col).isin(a, b)).select((F.col(col) == a).cast("double").alias("y"), "x")
            share = pair.agg(F.avg("y")).first()[0]
            pair = pair.withColumn("w", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
            m = LinearSVC(featuresCol="x", labelCol="y", weightCol="w", regParam=reg, standardization=False, maxIter=40).fit(pair)
            machines[kind, a, b] = np.append(m.coefficients.toArray(), m.intercept)
    return LanguageModel(orders, bits, groups, machines)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score. `und` with score 0 where the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by bits and the number of language pairs

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            langs, score = shared.value.predict(texts.to_pylist())
            return [pa.array(langs, pa.string()), pa.array(score)]

        return work

    rows = map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "lang_pred string, score double", start)
    return rows.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """Fits on the training fold of docs and predicts every row; with no language to learn, every row is `und`.

    Each row is predicted by its own text: repeated rows alike, null ids too (they are learnt from as others are). Empty
    tables give empty results; extra columns are ignored.
    """
    return predict(docs, fit(docs, **fitting))
