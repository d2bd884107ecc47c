"""Operator 4: exact deduplication by skew-safe combining, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, lookup, materialize


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; of equal texts the one with the most code points, then the
    smallest id, stays. Rows are combined inside each task (the partial aggregate), then per salted digest, then over
    the salts; each grouping has the whole content as a key, so a digest that two contents share merges nothing. A hot
    group thus reaches the last stage as one row for each salt and original length.

    Null texts count as empty. Rows that repeat an id and a text are one document: each is returned, all kept or all
    dropped. A null id loses to any other. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.regexp_replace(text, SPACES + "+", "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n"), content.alias("content")).withColumn("digest", digest(F.col("content")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    salted = rows.withColumn("salt", salt).groupBy("digest", "salt", "content", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    merged = salted.repartition("digest").groupBy("digest", "content", "n").agg(F.min("doc_id").alias("doc_id"), F.sum("rows").alias("rows"))
    # each length is there once for a content, so max_by has no ties
    winners = merged.groupBy("digest", "content").agg(F.max_by("doc_id", "n").alias("keep_id"), F.sum("rows").alias("group_size"), sha256(F.col("content")).alias("text_sha256"))
    whole = materialize(winners.groupBy("digest").agg(F.count("*").alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    out = lookup(rows.select("doc_id", "digest", *([] if digest is sha256 else ["content"])), whole, "digest", "group_size", "doc_id")
    shared = whole.where("contents > 1")
    if not shared.isEmpty():
        # A digest that several contents have: its rows, and no others, are matched by the contents themselves.
        own = winners.join(shared.select("digest"), "digest", "left_semi").select("digest", "content", F.struct("keep_id", "group_size").alias("_own"))
        few = rows.join(shared.select("digest"), "digest", "left_semi").select("doc_id", "digest", "content").join(own, ["digest", "content"])
        alike = out.where("contents = 1").withColumn("text_sha256", F.col("digest") if digest is sha256 else sha256(F.col("content")))
        few = few.select("doc_id", F.col("_own.keep_id").alias("keep_id"), F.col("_own.group_size").alias("group_size"), sha256(F.col("content")).alias("text_sha256"))
        out = alike.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(few)
    else:
        out = out.withColumn("text_sha256", F.col("digest") if digest is sha256 else sha256(F.col("content")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS c FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY c) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(c) AS text_sha256
FROM t WINDOW w AS (PARTITION BY c ORDER BY length(text) DESC, doc_id)
"""
