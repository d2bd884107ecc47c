"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, langid, merkle, mixing, nearest, prefix_trie, quality, sentencepiece, simhash, substring, token_counts, toxicity, warc
from weftline.llm.common import materialize, scope, table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_repeats(_table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece.round_trip(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ids", "n_tokens", F.xxhash64("ids").alias("ids_digest"), "restored")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def _tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result, of short rows, written and all other tables gone."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scope(spark):
            return materialize(query(spark, sf_dir), keep=True)

    return run


@_tidied
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


@_tidied
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


@_tidied
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = table_path(spark)
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash_near_dedup, op2_toxicity, op3_quality, op4_exact_dedup, op5_token_counts, op6_substring_dedup, op7_mixing, op8_sentencepiece, op9_nearest, op10_language_id, op11_merkle_manifest, op12_prefix_trie, op13_warc, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op6_substring_dedup": substring.ORACLE, "op9_nearest": nearest.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_warc": warc.ORACLE}
