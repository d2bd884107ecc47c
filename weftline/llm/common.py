"""Helpers that the operators of this package share: scratch tables, skew-safe lookups, held-out folds, text batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftline.sources.scratch import shared_folder

#: White space of the contracts: the space and the control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"

#: A key counts as heavy with over 1/HEAVY_SHARE of all rows; so there are fewer than HEAVY_SHARE heavy keys, whatever the input.
HEAVY_SHARE = 1000
#: The most rows of one or two numbers that are broadcast: some 16 MB.
BROADCAST_ROWS = 1_000_000


#: The scratch folders of the work that goes on, innermost last; each thread and each run has its own.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; unset, a new local one in local mode and an error elsewhere."""
    return shared_folder(spark)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tables_in(folder: str) -> Iterator[str]:
    """Meanwhile tables are written to this folder."""
    token = _SCOPES.set((*_SCOPES.get(), folder))
    try:
        yield folder
    finally:
        _SCOPES.reset(token)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """A scratch folder for the tables that are written meanwhile; it goes at the end, and with it all but those kept."""
    outer = _SCOPES.get()
    with tables_in(f"{outer[-1] if outer else scratch_dir(spark)}/{uuid.uuid4().hex}") as folder:
        try:
            yield folder
        finally:
            delete(spark, folder)


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline stage in a scope of its own: what its result still reads are its docs and the tables that it keeps."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scope(spark):
            return function(spark, docs, sf_dir)

    return run


def table_path(spark: SparkSession, keep: bool = False) -> str:
    """A new path in the scope's folder, or with `keep` in the folder around it."""
    folders = (scratch_dir(spark), *_SCOPES.get())
    return f"{folders[max(0, len(folders) - 1 - keep)]}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, schema: StructType | None = None, path: str | None = None, keep: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back (with `schema`): cuts the lineage and survives lost executors.

    The table lies in the scope's folder; with `keep` in the folder around it, and so outlives the scope.
    """
    path = path or table_path(df.sparkSession, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


#: The rows of sparse vectors as Arrow columns: what the ML library's vectors are made of.
SPARSE = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def sparse_rows(ends: np.ndarray, at: np.ndarray, values: np.ndarray, size: int) -> pa.Array:
    """An Arrow column of SPARSE; row i has the places at[ends[i] : ends[i + 1]], in order, with their values."""
    n, ends = len(ends) - 1, pa.array(ends.astype(np.int32))
    columns = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values.astype(float)))]
    return pa.StructArray.from_arrays(columns, ["type", "size", "indices", "values"])


def as_vectors(df: DataFrame, column: str) -> DataFrame:
    """df, written and read again with `column` (SPARSE) as vectors of Spark ML."""
    return materialize(df, StructType([StructField(f.name, VectorUDT() if f.name == column else f.dataType) for f in df.schema]))


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves the remainder `fold`; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def if_few(df: DataFrame) -> DataFrame:
    """df, a written table of short rows, marked for broadcast where it has at most BROADCAST_ROWS rows; beyond, Spark shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def lookup(big: DataFrame, small: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """Left join of big with small (unique key; `weight` = rows of big with it) that no heavy key can skew.

    Keys with over 1/HEAVY_SHARE of the weight, of which there are fewer than HEAVY_SHARE, are broadcast; rows they
    answer then carry a unique key of their own (from the column `spread`) through the shuffled join for all other keys.
    small should be a written table: it is read three times. Null keys match nothing.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    values = [c for c in small.columns if c != key]
    heavy = F.broadcast(small.where(F.col(weight) * HEAVY_SHARE > total).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values]))
    light = small.where(F.col(weight) * HEAVY_SHARE <= total).select(F.col(key).cast("string").alias("_lk"), *[F.col(c).alias(f"_l_{c}") for c in values])
    own = F.concat(F.lit("~"), F.coalesce(F.col(spread).cast("string"), F.lit("")))
    met = big.join(heavy, F.col(key) == F.col("_hk"), "left").withColumn("_bk", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(own))
    met = met.join(light, F.col("_bk") == F.col("_lk"), "left")
    return met.select(*big.columns, *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in values])


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order. By sorting: the hash table of np.unique takes many times the time, and memory that
    the worker keeps."""
    s = np.sort(values)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def by_size(texts: list, most: int, overlap: int) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (row, piece, own) of at most about `most` characters; longer texts are cut into pieces that overlap, of which
    the first `own` characters are a piece's own."""
    out, held = [], 0
    for row, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(1, len(text)), most):
            piece = text if len(text) <= most else text[at : at + most + overlap]
            out.append((row, piece, min(len(text) - at, most)))
            held += len(piece) + 64
            if held >= most:
                yield out
                out, held = [], 0
    if out:
        yield out


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of parts of a batch with about `most` bytes of text each; a row is never divided."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    part = (np.cumsum(sizes) // most).astype(np.int64)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield a, texts.slice(a, b - a)


def map_texts(docs: DataFrame, text_col: str, added: str, start: Callable[[], Callable[[pa.Array], list[pa.Array]]], piece: int = 1 << 20) -> DataFrame:
    """docs with the columns `added` (a schema string; a column with such a name is replaced).

    In each task start() gives a function from some whole texts, about `piece` bytes of them, to the added columns, so
    that a Python worker holds a few MB besides the batch that Spark sends.
    """
    new = [f.split()[0] for f in added.split(", ")]
    kept = docs.drop(*[c for c in new if c != text_col])
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in batches:
            for at, texts in slices(b.column(names.index(text_col)), piece):
                own = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, *work(texts)], [*names, *new])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), added]))
