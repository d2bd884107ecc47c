"""Operator 1: near-duplicates by SimHash fingerprints, linked through sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import lookup, map_texts, materialize

SEED = 42
LANES = np.uint64(0x0101010101010101)


def _hashes(text: bytes, words_per_shingle: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z alone, and the white space of the contract
    if not words:
        return []
    line, k = b" ".join(words), min(words_per_shingle, len(words))
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-k])] if len(words) > k else [0]
    hashed = xxhash.xxh64_intdigest
    return [hashed(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)]


def prints(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """uint64 fingerprints of rows that own `counts` consecutive hashes of h each; a row without any has zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        begins = np.concatenate([[0], np.cumsum(counts)])[full]
        # eight byte lanes hold eight bit counts; at most 255 hashes are added before the lanes are widened
        cuts = np.concatenate([np.arange(b, b + n, 255) for b, n in zip(begins, counts[full], strict=True)])
        owners = np.searchsorted(cuts, begins)
        bits = np.zeros((len(full), 64), np.int64)
        for k in range(8):
            lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, cuts)
            bits[:, k::8] = np.add.reduceat(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8).astype(np.int64), owners, axis=0)
        out[full] = np.packbits(2 * bits > counts[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints_of(texts: list[bytes | None], words_per_shingle: int = 4) -> np.ndarray:
    """uint64 fingerprints: a bit is set if over half of the shingle hashes (repeats included) have it; no words: zero."""
    out = np.zeros(len(texts), np.uint64)
    at = 0
    while at < len(texts):  # some thousand shingles to a million at a time, however long a text is
        lists, rows = [], at
        held = 0
        while rows < len(texts) and (not lists or held < 400_000):
            lists.append(_hashes(texts[rows] or b"", words_per_shingle))
            held += len(lists[-1])
            rows += 1
        out[at:rows] = prints(np.fromiter((v for x in lists for v in x), np.uint64, held), np.array([len(x) for x in lists]))
        at = rows
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text; null texts count as empty."""

    start = lambda: lambda texts: [pa.array(fingerprints_of(texts.cast(pa.binary()).to_pylist(), words_per_shingle).view(np.int64))]
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", "fp bigint", start).drop("text")


class BKTree:
    """Burkhard-Keller tree of fingerprints: the child under edge d differs from its parent in exactly d bits."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.values:
            self.values, self.children = [value], [{}]
            return
        node = 0
        while True:
            d = (self.values[node] ^ value).bit_count()
            if d == 0:
                return
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            node = below

    def near(self, value: int, radius: int) -> list[int]:
        """Members within radius; by the triangle inequality only edges from d - radius to d + radius are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[node])
            for edge, below in self.children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(below)
        return found


def _stars(tree_values: list[int], query_values: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """(value, root) stars that connect just what is linked between a tree's members and the queries (None: the members)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree = BKTree()
    for v in tree_values if query_values is not None else []:
        tree.add(v)
    for v in tree_values if query_values is None else query_values:
        for w in tree.near(v, radius):
            a, b = root(v), root(w)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if query_values is None:
            tree.add(v)
    return [(v, r) for v in list(parent) if (r := root(v)) != v]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, trees, queries = None, [], []

        def close() -> list[tuple[int, int]]:
            if cell is None or len(trees) + len(queries) < 2:
                return []
            return _stars(trees, None if cell[1] == cell[2] else queries, radius)

        for b in batches:
            out: list[tuple[int, int]] = []
            cols = [b.column(i).to_pylist() for i in range(5)]
            for key, i, j, fp, part in zip(*cols, strict=True):
                if (key, i, j) != cell:
                    out += close()
                    cell, trees, queries = (key, i, j), [], []
                (queries if part else trees).append(fp & 0xFFFFFFFFFFFFFFFF)
            yield _edges(out)
        yield _edges(close())

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of keys, one for each choice of blocks - radius blocks of the 64 bits.

    Fingerprints that differ in at most `radius` bits agree in at least blocks - radius blocks, so they share a key.
    """
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def links(fps: DataFrame, radius: int = 4, tree_size: int = 4096, per_bucket: int = 64) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of fps (column fp) exactly as all links within radius do.

    Fingerprints meet in buckets (block_keys); the number of blocks is the least that leaves about per_bucket in a
    bucket, and any number is exact. Each bucket's fingerprints form shard trees of at most about tree_size members.
    A shard tree is sent to every query block of its bucket; that is a broadcast among the bucket's tasks by shuffle,
    since trees of all fingerprints have no size bound that would let them pass through the driver. A task returns
    stars rather than pairs, at most one edge for each member, so a dense group of n costs n edges and not n squared.
    """
    n = fps.count()
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > per_bucket and blocks < radius + 4:
        blocks += 1
    rows = fps.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key"))
    sizes = materialize(rows.groupBy("key").count().where(F.col("count") > tree_size).select("key", F.ceil(F.col("count") / tree_size).cast("int").alias("chunks")))
    if sizes.isEmpty():
        cells = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", F.lit(0).alias("part"))
    else:
        sized = rows.join(sizes, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        as_tree = F.transform(F.sequence(F.col("c"), F.col("chunks") - 1), lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(0).alias("part")))
        as_query = F.when(F.col("c") > 0, F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(i.alias("i"), F.col("c").alias("j"), F.lit(1).alias("part"))))
        cells = sized.select("key", "fp", F.explode(F.concat(as_tree, F.coalesce(as_query, F.expr("array()").cast("array<struct<i:int,j:int,part:int>>")))).alias("x")).select("key", "x.i", "x.j", "fp", "x.part")
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "part", "fp")
    return dealt.mapInArrow(_search(radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b), by alternating large and small stars; root is the least node.

    Each round is joins and aggregates on Spark, written to the shared folder; it ends when a round changes nothing.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    was = mark(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small)
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4, tree_size: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Equal fingerprints are linked too; each fingerprint is searched once, with its smallest id. Null and wordless texts
    have fingerprint zero. Repeated rows are returned as often as they stand; null ids never name a component unless
    it has no other. An empty table gives an empty result; other columns are ignored.
    """
    fps = materialize(fingerprint(docs, id_col, text_col, words_per_shingle))
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")))
    linked = components(links(groups.select("fp"), radius, tree_size))
    rooted = groups.join(linked, groups["fp"] == linked["node"], "left").select("fp", "first_id", "rows", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = materialize(rooted.join(least, "root").select("fp", "component_id", "rows"))
    out = lookup(fps, known, "fp", "rows", "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
