"""Operator 2: toxicity by a character n-gram linear classifier on naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPARSE, as_vectors, in_fold, map_texts, materialize, slices, sparse_rows
from weftline.llm.ngrams import present

#: The held-out rows of the contract: crc32(id) mod FOLDS is HELD_OUT.
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """table: uint16, bucket to feature + 1; weights: of each feature, the log-count ratio times the fitted coefficient."""

    orders: tuple[int, ...]
    bits: int
    table: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, texts: list) -> np.ndarray:
        """The probability of label 1 for each whole text."""
        rows, features = present(texts, self.orders, self.bits, self.table)
        z = self.intercept + np.bincount(rows, self.weights[features], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, y, w of about per_class labelled rows of each class at most, chosen by a hash of the id; w undoes the choice.

    Rows outside the training fold, with null ids or labels other than 0 and 1 are no part. Ids that repeat with
    different labels count as 1.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~in_fold("doc_id", FOLDS, HELD_OUT))
    ids = ids.groupBy("doc_id").agg(F.max(label).alias("y"))
    n = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = lambda y: min(1.0, per_class / max(n.get(y, 0), 1))
    keep = F.when(F.col("y") == 1, share(1)).otherwise(share(0))
    return ids.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < keep * (1 << 30)).withColumn("w", 1 / keep)


def frequencies(batches: Iterator[pa.RecordBatch], orders: tuple[int, ...], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """bucket, pos, neg: in how many of the rows (text, y), of which no class has over `most`, each bucket is, by class.

    The tally is of a whole task, so its size is fixed; texts are read and the tally is returned by small parts.
    """
    tally = np.zeros((2, 1 << bits), np.min_scalar_type(most))
    for b in batches:
        for at, texts in slices(b.column(0), 1 << 17):
            rows, buckets = present(texts.to_pylist(), orders, bits)
            one = b.column(1).slice(at, len(texts)).to_numpy(zero_copy_only=False)[rows] == 1
            np.add.at(tally[1], buckets[one], 1)
            np.add.at(tally[0], buckets[~one], 1)
    for low in range(0, 1 << bits, 100_000):
        part = tally[:, low : low + 100_000]
        has = np.flatnonzero(part.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (low + has, part[1, has], part[0, has])], ["bucket", "pos", "neg"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, orders: tuple[int, ...] = (4, 5, 6), bits: int = 22, features: int = 16384, least_docs: int = 4, reg: float = 1e-3) -> ToxicityModel:
    """Learns from at most about per_class labelled rows of a class (a documented bound; the sample is broadcast ids).

    Document frequencies of hashed n-grams by class are counted on Spark; the `features` n-grams with the largest
    information about the class are kept, each valued at its naive Bayes log-count ratio where present; a logistic
    regression over these values is fitted by Spark ML. Without rows of both classes every score is the share of ones.
    """
    chosen = F.broadcast(sample_labels(docs, labels, "toxic", per_class))
    train = materialize(docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y", "w"))
    total = {r["y"]: (r["n"], r["w"]) for r in train.groupBy("y").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    n1, n0 = (total.get(y, (0, 0.0))[0] for y in (1, 0))
    table = np.zeros(1 << bits, np.uint16)
    if not n1 or not n0:
        prior = 0.5 if not n1 + n0 else (n1 + 0.5) / (n1 + n0 + 1)
        return ToxicityModel(orders, bits, table, np.zeros(1), float(np.log(prior / (1 - prior))))

    df = train.select("text", "y").mapInArrow(lambda batches: frequencies(batches, orders, bits, max(n1, n0)), "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1.0)
    both = (F.col("pos") + F.col("neg") + 1.0) / (n1 + n0 + 2.0)
    gain = lambda p, n: n * (p * F.log(p / both) + (1 - p) * F.log((1 - p) / (1 - both)))
    top = df.where(F.col("pos") + F.col("neg") >= least_docs).withColumn("ratio", F.log(rate("pos", n1) / rate("neg", n0)))
    top = top.withColumn("gain", gain(rate("pos", n1), n1) + gain(rate("neg", n0), n0)).orderBy(F.desc("gain"), "bucket").limit(features).select("bucket", "ratio").collect()
    if not top:
        return ToxicityModel(orders, bits, table, np.zeros(1), float(np.log(n1 / n0)))
    ratios = np.array([r["ratio"] for r in top])
    table[[r["bucket"] for r in top]] = np.arange(1, len(top) + 1)

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows, found = present(texts.to_pylist(), orders, bits, table)
            return [sparse_rows(np.searchsorted(rows, np.arange(len(texts) + 1)), found, ratios[found], len(top))]

        return work

    points = as_vectors(map_texts(train.select(F.col("y").cast("double").alias("y"), "w", "text"), "text", f"x {SPARSE}", start).drop("text"), "x")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=reg, standardization=False, maxIter=40).fit(points)
    return ToxicityModel(orders, bits, table, ratios * model.coefficients.toArray(), float(model.intercept))


def add_score(docs: DataFrame, model: ToxicityModel, name: str, text_col: str = "text") -> DataFrame:
    """docs with the score of every whole text. Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by bits and features

    start = lambda: lambda texts: [pa.array(shared.value.score(texts.to_pylist()))]
    return map_texts(docs, text_col, f"{name} double", start)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; none is dropped."""
    rows = add_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "score")
    rows = rows.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Fits on the labelled rows outside the held-out fold and scores every row of docs.

    Each row is scored by its own text: repeated rows are each returned with the same score, null texts score as empty
    ones. Rows with null ids are scored, not learnt from. Extra columns of docs are ignored. An empty table gives an
    empty result; with no labels every score is 0.5.
    """
    return score(docs, fit(docs, labels, **fitting))
