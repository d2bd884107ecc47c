"""Places and quantiles in the order of a key's values, for few keys with many rows.

Rows are dealt by ranges of (key, value), so that a hot key is many tasks, and numbered within each range; a small table
of counts by range gives the numbers that go before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.scratch import shared_folder


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """rows with their place (from 0) among the rows of their key, by the columns of `order`, nulls first."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    by = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, 0
        for b in batches:
            if not len(b):
                continue
            n = b.groupby(by, dropna=False, sort=False).cumcount()
            first, end = tuple(map(str, b[by].iloc[0])), tuple(map(str, b[by].iloc[-1]))
            same = (b[by].astype(str) == list(first)).all(axis=1)
            n[same] += held if first == last else 0
            last, held = end, int(n.iloc[-1]) + 1
            yield b.assign(_n=n)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), "_n bigint"])
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    dealt.mapInPandas(run, schema).write.parquet(path)  # written: ranges are sampled anew at each evaluation
    held = rows.sparkSession.read.parquet(path)
    n = held.groupBy("_part", *keys).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_c")
    starts = n.withColumn("_b", before).select("_part", *[F.col(k).alias(f"_k_{k}") for k in keys], "_b")
    match = F.col("_part") == F.col("_p2")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = held.join(starts.withColumnRenamed("_part", "_p2"), match).withColumn(name, F.col("_n") + F.col("_b"))
    return out.select(*rows.columns, name)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """By key the exact quantiles q0, q1, ... of a value at the shares, linear between two places; nulls do not count."""
    placed = numbered(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), keys, ["_v"], "_at")
    n = placed.groupBy(*keys).agg(F.count("*").alias("_m"))
    asked = n.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_m") - 1) * float(s)).alias("x")) for i, s in enumerate(shares)])))
    asked = asked.select(*keys, "_q.i", "_q.x").withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("x"), F.ceil("x")))))
    met = placed.join(F.broadcast(asked), [*keys, "_at"]).withColumn("_w", F.when(F.floor("x") == F.ceil("x"), 1.0).when(F.col("_at") == F.floor("x"), F.ceil("x") - F.col("x")).otherwise(F.col("x") - F.floor("x")))
    return met.groupBy(*keys).agg(*[F.sum(F.when(F.col("i") == i, F.col("_v") * F.col("_w"))).alias(f"q{i}") for i in range(len(shares))])
