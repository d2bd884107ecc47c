"""Operator 7: mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import WORDS, materialize

WEIGHTS, TOTAL, MOST = (5, 2, 1), 1.5, 2.0


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Adds target to sources (source, source_size): shares of total * all sizes by weight, none over most * its size.

    Weights go round in the order of the sources' code points, null last. What a source can't take is shared out anew
    by weight: sources are taken by how soon they fill up, and the water level is that of the first that doesn't. The
    windows run over one row for each source, in one task: for millions of sources, not for billions.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    s = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("at", F.row_number().over(order))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("at"))).over(everything))
    return s.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap")).drop("weight", "level", "at")


def tilts(sizes: DataFrame, goals: DataFrame, most: float = MOST, steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """(key, tilt) of every source: the dual solution of entropy balancing.

    Rates r nearest, in the entropy of a rate between 0 and `most`, to one copy of each document, with the sum of
    r * size equal to the target, are r = most / (1 + exp(-tilt * size / mean) * (most - 1)). The dual is convex with a
    tilt for each source. One Newton step for all sources is one Spark aggregation over sizes (key, size, rows); a step
    that leaves the bracket of the root is replaced by bisection. Only (source, size) counts are read, not documents.
    """
    state = materialize(goals.where((F.col("target") < F.col("cap")) & (F.col("target") > 0)).select("key", "target", "mean", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("off")))
    total = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")  # noqa: E731  exact, so that reruns agree in whatever order rows come
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        rate = F.lit(most) / (1 + F.exp(-F.least(F.greatest(F.col("tilt") * x, F.lit(-700.0)), F.lit(700.0))) * (most - 1))
        g = sizes.join(state, "key").groupBy("key").agg(
            total(F.col("rows") * F.col("size") * rate).alias("taken"),
            total(F.col("rows") * F.col("size") * x * rate * (1 - rate / most)).alias("slope"),
        )
        s = state.join(g, "key").withColumn("gap", F.col("taken") - F.col("target")).withColumn("off", F.abs("gap") / F.col("target"))
        s = s.withColumn("high", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("gap") <= 0, F.col("tilt")).otherwise(F.col("low")))
        newton = F.col("tilt") - F.try_divide("gap", "slope")
        bound = 1 + 4 * F.abs("tilt")
        newton = F.least(F.greatest(newton, F.col("tilt") - bound), F.col("tilt") + bound)
        inside = newton.isNotNull() & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, F.when(F.col("gap") > 0, F.col("tilt") - bound).otherwise(F.col("tilt") + bound))
        moved = F.when(F.col("off") <= tolerance, F.col("tilt")).when(inside, newton).otherwise(middle)
        state = materialize(s.select("key", "target", "mean", moved.alias("tilt"), "low", "high", "off"))
        if state.where(F.col("off") > tolerance).isEmpty():
            break
    else:
        gap = state.agg(F.max("off")).first()[0]
        if gap > 1e-6:
            raise RuntimeError(f"{steps} Newton steps left a source {gap:.1e} of its target away")
    return state.select("key", "tilt")


def round_rates(sizes: np.ndarray, rates: np.ndarray, most: int = int(MOST)) -> np.ndarray:
    """Copies from 0 to most; what rounding adds or takes is carried on from longer to shorter documents."""
    copies, carry = np.zeros(len(sizes), np.int64), 0.0
    for i, (size, rate) in enumerate(zip(sizes.tolist(), rates.tolist(), strict=True)):
        if size == 0:
            copies[i] = 1
            continue
        want = rate * size + carry
        copies[i] = c = min(most, max(0, int(np.floor(want / size + 0.5))))
        carry = want - c * size
    return copies


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chunk: int = 2_000, spread: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken of every row of docs.

    Rates become copies within chunks of about `chunk` documents of a source, chosen by the long `spread` (a hash of id
    and text unless given), so that a hot source or one null id on many rows is many tasks; within a chunk, long
    documents first, then by `spread` and id, the rounding error is handed on, and what remains is about half of the
    chunk's smallest document. All is deterministic: rows that tie in all of these are identical but for columns that
    are not read. Null texts have size 0; documents of size 0 stay once and take nothing. A null source is a source; a
    null id stays null. Repeated rows are rounded one by one; an empty table gives an empty result; other columns are
    ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), (F.xxhash64(id_col, text_col) if spread is None else spread).alias("spread"))
    rows = materialize(rows.withColumn("key", _key(F.col("source"))))
    sizes = materialize(rows.groupBy("key", "source", "size").agg(F.count("*").alias("rows")))
    per = sizes.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("documents"))
    goals = materialize(targets(per).withColumn("mean", F.greatest(F.col("source_size") / F.col("documents"), F.lit(1e-9))))
    plan = goals.join(tilts(sizes, goals), "key", "left").select("key", "source_size", "target", "cap", "mean", "tilt", F.ceil(F.col("documents") / chunk).cast("int").alias("chunks"))
    x = F.col("tilt") * F.col("size") / F.col("mean")
    tilted = F.lit(MOST) / (1 + F.exp(-F.least(F.greatest(x, F.lit(-700.0)), F.lit(700.0))) * (MOST - 1))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= F.col("cap"), MOST).otherwise(tilted)
    dealt = rows.join(materialize(plan), "key").select("doc_id", "size", "source_size", "target", rate.alias("rate"), "key", "spread", F.pmod("spread", F.col("chunks")).alias("part"))

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("size", "descending"), ("spread", "ascending"), ("doc_id", "ascending")]))  # ids stay in Arrow: exact, null last
        size = t["size"].to_numpy()
        copies = round_rates(size, t["rate"].to_numpy())
        return t.append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * size)).select(["doc_id", "size", "source_size", "target", "rate", "copies", "taken"])

    return dealt.groupBy("key", "part").applyInArrow(run, f"doc_id {kind}, size bigint, source_size bigint, target double, rate double, copies bigint, taken bigint")
