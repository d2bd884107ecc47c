"""Places and running sums in a global order, for keys of which one may have most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """rows (a written table: it is read twice) with `place`, from 0 within their keys by `order`, nulls first, and for
    each column c of `sums` the sum c_upto of all rows up to this one.

    Rows are dealt by ranges of keys and order, so that a hot key is many tasks; each counts from its own first row. A
    range can only carry on the key at its beginning, so what went before is one broadcast row a range at most.
    """
    spread = [*keys, *order]
    held = materialize(rows.repartitionByRange(*spread).sortWithinPartitions(*spread).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    own = Window.partitionBy("_part", *keys).orderBy("_at")
    out = held.withColumns({"place": F.row_number().over(own).cast("long") - 1, **{f"{c}_upto": F.sum(c).over(own) for c in sums}})
    totals = held.groupBy("_part", *keys).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", *[F.col(k).alias(f"_k_{k}") for k in keys], F.sum("_n").over(earlier).alias("_b"), *[F.sum(f"_s_{c}").over(earlier).alias(f"_b_{c}") for c in sums])
    before = F.broadcast(materialize(before.where("_b > 0")).withColumnRenamed("_part", "_p"))
    met = F.col("_part") == F.col("_p")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    plus = lambda c, b: (F.col(c) + F.coalesce(b, F.lit(0))).alias(c)
    return out.join(before, met, "left").select(*rows.columns, plus("place", "_b"), *[plus(f"{c}_upto", f"_b_{c}") for c in sums])
