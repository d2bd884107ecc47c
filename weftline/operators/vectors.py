"""Vector tables, scaling, similarity and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_form(vectors: DataFrame, id_col: str, vector_col: str, *keep: str) -> DataFrame:
    """(id, keep..., unit from 1, x)."""
    return vectors.select(id_col, *keep, F.posexplode(vector_col).alias("unit", "x")).withColumn("unit", F.col("unit") + 1).withColumn("x", F.col("x").cast("double"))


def scaling(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of every unit; constant units are dropped."""
    return rows.groupBy("unit").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).where("sd > 0")


def condition_means(rows: DataFrame, condition: str) -> DataFrame:
    """The mean of each unit by condition."""
    return rows.groupBy(condition, "unit").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def condition_cosines(means: DataFrame, condition: str) -> DataFrame:
    """Cosine of every two conditions' mean vectors (a < b), through a join on the unit."""
    a = means.select(F.col(condition).alias("a"), "unit", F.col("mean").alias("x"))
    b = means.select(F.col(condition).alias("b"), "unit", F.col("mean").alias("y"))
    size = means.groupBy(F.col(condition).alias("k")).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    dots = a.join(b, "unit").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    dots = dots.join(size.select(F.col("k").alias("a"), F.col("norm").alias("na")), "a").join(size.select(F.col("k").alias("b"), F.col("norm").alias("nb")), "b")
    return dots.select("a", "b", F.try_divide("dot", F.col("na") * F.col("nb")).alias("cosine"))


def binary_metrics(rows: DataFrame, keys: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """N, accuracy, balanced accuracy, precision, recall, Brier score and ROC area (average ranks) by key.

    Figures that need a class that is not there are null. Ranks are worked out on counts by score, so that ties and
    large keys cost a row for each distinct score.
    """
    y, hit = F.col(label), (F.col(score) >= threshold).cast("int")
    plain = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((hit == y).cast("int")).alias("accuracy"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
        F.avg(F.when(y == 1, hit)).alias("recall"), F.avg(F.when(y == 0, 1 - hit)).alias("specificity"), F.avg(F.when(hit == 1, y)).alias("precision"),
    )
    plain = plain.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
    tied = rows.groupBy(*keys, score).agg(F.sum(y).alias("pos"), F.count("*").alias("all"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("below", F.coalesce(F.sum(F.col("all") - F.col("pos")).over(w), F.lit(0)))
    area = tied.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("all") - F.col("pos")) / 2)).alias("u"), F.sum("pos").alias("p"), F.sum(F.col("all") - F.col("pos")).alias("q"))
    area = area.select(*keys, F.try_divide("u", F.col("p") * F.col("q")).alias("auc"))
    return plain.join(area, keys)
