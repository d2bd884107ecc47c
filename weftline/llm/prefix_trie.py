"""Operator 12: a trie of conversation prefixes, by Z-fast tries whose edges are expanded and merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import lookup, materialize
from weftline.llm.merkle import CRC32
from weftline.llm.order import placed

SEGMENT = 512  # turns of a conversation that are one row
LANES = 4
NODE = ("p", "q", "depth")


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """A compacted trie of turn sequences that knows a prefix by its hash.

    A node covers the prefixes of depths (low, high]; `handles` finds it by its handle, the prefix whose depth is two-fattest
    in that interval, and `edges` by its shortest one. A sequence is (start, p, q): the hashes of its prefixes of depths
    start, start + 1, ... Sequences may start at any prefix; each such prefix is the root of a trie of its own.
    """

    def __init__(self) -> None:
        self.handles: dict[tuple[int, int, int, int], int] = {}
        self.edges: dict[tuple[int, int, int, int], int] = {}
        self.low: list[int] = []
        self.high: list[int] = []
        self.parent: list[int] = []
        self.path: list[tuple] = []  # a sequence that runs through the node
        self.own: list[list] = []  # weights of the sequences that end in the node

    def _add(self, low: int, high: int, parent: int, path: tuple, own: list | None = None) -> int:
        node = len(self.low)
        for column, value in ((self.low, low), (self.high, high), (self.parent, parent), (self.path, path), (self.own, own)):
            column.append(value)
        self._name(node)
        return node

    def _key(self, path: tuple, depth: int) -> tuple[int, int, int, int]:
        start, p, q, _ = path
        return start, depth, p[depth - start], q[depth - start]

    def _name(self, node: int) -> None:
        path, low, high = self.path[node], self.low[node], self.high[node]
        self.handles[self._key(path, two_fattest(low, high))] = node
        self.edges[self._key(path, low + 1)] = node

    def exit_node(self, path: tuple) -> tuple[int, int]:
        """(node, depth) where the sequence leaves the trie: it has the node's prefixes up to that depth in common. (-1, -1): no node.

        Fat binary search: a handle that is known and whose node the sequence passes through moves the search below that
        node; one that is not known moves it above. What is left is the edge that begins with the next turn.
        """
        start, p = path[0], path[1]
        end = start + len(p) - 1
        low, high, last = start - 1, end, -1
        while low < high:
            depth = two_fattest(low, high)
            node = self.handles.get(self._key(path, depth))
            if node is None:
                high = depth - 1
                continue
            if self.high[node] <= end and self._key(path, self.high[node]) == self._key(self.path[node], self.high[node]):
                last, low = node, self.high[node]
            else:
                return node, self._common(node, path, depth, end)
        if low < end and (node := self.edges.get(self._key(path, low + 1))) is not None:
            return node, self._common(node, path, low + 1, end)
        return last, low

    def _common(self, node: int, path: tuple, low: int, end: int) -> int:
        """The last depth, from `low` on, at which the sequence and the node's edge are alike."""
        high, mine = min(end, self.high[node]), self.path[node]
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self._key(path, middle) == self._key(mine, middle) else (low, middle - 1)
        return low

    def insert(self, path: tuple, weights: list) -> None:
        start = path[0]
        end = start + len(path[1]) - 1
        node, depth = self.exit_node(path)
        if node < 0:
            node, depth = self._add(start - 1, start, -1, path), start
        if depth < self.high[node]:  # the edge is split: the upper half is a new node
            upper = self._add(self.low[node], depth, self.parent[node], self.path[node])
            self.low[node], self.parent[node] = depth, upper
            self._name(node)
            node = upper
        if depth < end:
            node = self._add(depth, end, node, path)
        held = self.own[node]
        self.own[node] = list(weights) if held is None else [min(held[0], weights[0]), *[a + b for a, b in zip(held[1:], weights[1:], strict=True)]]

    def expanded(self, width: int) -> pa.RecordBatch:
        """A row for each prefix of all edges: its hashes and its parent's, the size of its last turn, and the least first weight
        and the sums of the others of all sequences below. A prefix that sequences start from, but the empty one, is left to them that end there."""
        total: list = [w and list(w) for w in self.own]
        for node in np.argsort(-np.array(self.high, np.int64), kind="stable").tolist():
            above, mine = self.parent[node], total[node]
            if above >= 0:
                total[above] = list(mine) if total[above] is None else [min(total[above][0], mine[0]), *[a + b for a, b in zip(total[above][1:], mine[1:], strict=True)]]
        columns: list[list] = [[] for _ in range(6)]
        often = []
        for node, (start, p, q, n) in enumerate(self.path):
            low, high = self.low[node] + 1, self.high[node]
            if low == start and start > 0:
                low += 1
            root = low == 0
            a, b = low - start, high - start + 1
            often.append(max(0, b - a))
            if a < b:
                zero = [0] if root else []
                for column, values in zip(columns, (p[a:b], q[a:b], range(low, high + 1), zero + p[max(a - 1, 0) : b - 1], zero + q[max(a - 1, 0) : b - 1], zero + n[max(a - 1, 0) : b - 1]), strict=True):
                    column.extend(values)
        weights = [np.repeat(np.array([t[k] for t in total], np.int64), often) for k in range(width)]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], *map(pa.array, weights)], ["p", "q", "depth", "pp", "pq", "n_chars", *[f"w{k}" for k in range(width)]])


def _hashes(start: list[int], lanes: np.ndarray) -> tuple[list[int], list[int]]:
    """p and q of the prefix before the turns and of each one that ends with one of them, from the sums of their lanes."""
    sums = (np.concatenate([[start], lanes]).cumsum(axis=0) & 0xFFFFFFFF).astype(np.uint64)
    mixed = sums[:, ::2] << np.uint64(32) | sums[:, 1::2]
    return mixed[:, 0].view(np.int64).tolist(), mixed[:, 1].view(np.int64).tolist()


def _tries(width: int, most: int):
    """Task: segments (start_depth, s0..s3, turns, limit, w0, ...) to the expanded edges of tries of about `most` turns each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = ZFastTrie(), 0
        for b in batches:
            starts, limits = b.column("start_depth").to_pylist(), b.column("limit").to_pylist()
            sums = list(zip(*[b.column(f"s{k}").to_pylist() for k in range(LANES)], strict=True))
            weights = list(zip(*[b.column(f"w{k}").to_pylist() for k in range(width)], strict=True))
            lists = b.column("turns")
            cuts = [x - lists.offsets[0].as_py() for x in lists.offsets.to_pylist()] if len(lists) else []
            flat = lists.flatten()
            lanes = np.stack([flat.field(f"x{k}").to_numpy() for k in range(LANES)], axis=1)
            sizes = flat.field("n").to_numpy()
            for i, (start, limit) in enumerate(zip(starts, limits, strict=True)):
                a = cuts[i]
                z = min(cuts[i + 1], a + max(0, limit - start))
                p, q = _hashes(sums[i], lanes[a:z])
                trie.insert((start, p, q, sizes[a:z].tolist()), weights[i])
                held += len(p)
                if held >= most:
                    yield trie.expanded(width)
                    trie, held = ZFastTrie(), 0
        if held:
            yield trie.expanded(width)

    return run


def _expand(segments: DataFrame, width: int, most: int = 1 << 17) -> DataFrame:
    """p, q, depth, pp, pq, n_chars, w0, ... of all prefixes that tasks' tries have; a prefix may come from several tries."""
    columns = ["start_depth", "limit", *[f"s{k}" for k in range(LANES)], *[f"w{k}" for k in range(width)], "turns"]
    schema = ", ".join(f"{c} bigint" for c in ("p", "q", "depth", "pp", "pq", "n_chars", *[f"w{k}" for k in range(width)]))
    return segments.select(*columns).mapInArrow(_tries(width, most), schema)


def _ends(ends: DataFrame, chunk: int = 4096) -> DataFrame:
    """NODE, ends_sha256 of ends (NODE, conv): ids are joined to strings of at most `chunk`, as many as an interval of so many
    ids can have, and a node's strings go through SHA-256, which takes bytes in one order alone, as a stream."""
    parts = ends.groupBy(*NODE, F.floor(F.col("conv") / chunk).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            out = []
            for *node, ids in zip(*[b.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if node == last:
                    state.update(b"," + ids.encode())
                else:
                    if last:
                        out.append((*last, state.hexdigest()))
                    last, state = node, hashlib.sha256(ids.encode())
            yield _digest_rows(out)
        if last:
            yield _digest_rows([(*last, state.hexdigest())])

    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids").mapInArrow(run, "p bigint, q bigint, depth bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])


def _mixed(*sums: Column) -> tuple[Column, Column]:
    """p and q of a prefix from the sums of its lanes, as _hashes has them."""
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    pair = lambda a, b: F.shiftleft(low(a), 32).bitwiseOR(low(b))
    return pair(sums[0], sums[1]), pair(sums[2], sums[3])


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 100, heads: int = 6) -> DataFrame:
    """conv, at (from 0), a, b (hashes of the turn), n (code points of its text) of every rebuilt conversation, at -1 a mark for each.

    c takes the first h turns of conversation c - c % family, then its own turns but the first h; h = crc32(c) % heads.
    """
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), whole.alias("whole"), F.length(text).cast("long").alias("n"))
    turns = turns.select("conv", "turn", F.xxhash64(F.lit(1), "whole").alias("a"), F.xxhash64(F.lit(2), "whole").alias("b"), "n", F.monotonically_increasing_id().alias("row"))
    turns = materialize(placed(materialize(turns), ["conv"], ["turn", "a", "b", "row"]))
    convs = turns.select("conv").distinct()
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    donor = F.col("conv") - F.col("conv") % family
    given = turns.where((donor == F.col("conv")) & (F.col("place") < heads - 1)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "a", "b", "n"))).alias("given"))
    given = materialize(given.withColumnRenamed("conv", "donor"))
    first = convs.withColumn("donor", donor).withColumn("h", head).join(given, "donor", "left")
    front = first.select("conv", F.explode(F.filter("given", lambda x: x["place"] < F.col("h"))).alias("x")).select("conv", F.col("x.place").alias("at"), "x.a", "x.b", "x.n")
    sized = given.select("donor", F.size("given").alias("had"))
    own = turns.withColumn("h", head).where(F.col("place") >= F.col("h")).withColumn("donor", donor).join(sized, "donor", "left")
    own = own.select("conv", (F.col("place") - F.col("h") + F.least("h", F.coalesce("had", F.lit(0)))).cast("long").alias("at"), "a", "b", "n")
    mark = convs.select("conv", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    return mark.unionByName(front).unionByName(own)


def prefix_trie(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of conversations given as rebuilt() does: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, all of the contract.

    A prefix is known by 128 bits and its depth: the sums of four 32-bit hashes of each turn with its place, so that a long
    conversation can be cut into segments of `segment` turns whose sums are added up. Tasks put segments into Z-fast tries
    and expand the edges; nodes merge over tasks by a sum, to which a hot prefix comes as one row a trie.

    Each node names its smallest member. The nodes that name the same one follow each other down to that conversation's end:
    a chain. What a subtree sums up is what lies below on the node's own chain, and the totals of the chains that branch
    off at or below it; those are put into Z-fast tries again, along the path above each chain, with the totals as weights.
    """
    lanes = [F.xxhash64(F.lit(k), "at", "a", "b").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"x{k}") for k in range(LANES)]
    rows = turns.withColumn("part", F.when(F.col("at") < 0, F.lit(0)).otherwise(F.floor(F.col("at") / segment)).cast("long"))
    item = F.when(F.col("at") >= 0, F.struct("at", *lanes, "n"))
    cut = materialize(rows.groupBy("conv", "part").agg(F.sort_array(F.collect_list(item)).alias("turns")))
    summed = cut.select("conv", "part", F.size("turns").cast("long").alias("size"), *[F.expr(f"aggregate(turns, 0L, (acc, x) -> acc + x.x{k})").alias(f"x{k}") for k in range(LANES)])
    order = Window.partitionBy("conv").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = summed.select("conv", "part", "size", *[F.coalesce(F.sum(f"x{k}").over(before), F.lit(0)).alias(f"s{k}") for k in range(LANES)], *[(F.coalesce(F.sum(f"x{k}").over(before), F.lit(0)) + F.col(f"x{k}")).alias(f"e{k}") for k in range(LANES)], F.lead("part").over(order).isNull().alias("last"))
    summed = materialize(summed.withColumn("start_depth", F.col("part") * segment))
    p, q = _mixed(*[F.col(f"e{k}") for k in range(LANES)])
    ends = materialize(summed.where("last").select(p.alias("p"), q.alias("q"), (F.col("start_depth") + F.col("size")).alias("depth"), "conv"))
    segments = cut.join(summed.drop("size", "last", *[f"e{k}" for k in range(LANES)]), ["conv", "part"])

    nodes = _expand(segments.withColumns({"limit": F.lit(1 << 62), "w0": F.col("conv"), "w1": F.lit(1).cast("long")}), 2)
    nodes = materialize(nodes.groupBy(*NODE).agg(F.min("w0").alias("conv_id"), F.sum("w1").alias("n_convs"), F.first("pp").alias("pp"), F.first("pq").alias("pq"), F.first("n_chars").alias("n_chars")))
    children = nodes.where("depth > 0").groupBy(F.col("pp").alias("p"), F.col("pq").alias("q"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumns({"up": -F.col("depth"), "saved": (F.col("n_convs") - 1) * F.col("n_chars"), "leaf": (F.col("n_children") == 0).cast("long")}))

    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    chains = materialize(chains.where("top > 0").withColumnRenamed("conv_id", "conv"))
    upper = segments.join(chains, "conv").where("start_depth < top").withColumns({"limit": F.col("top") - 1, "w0": F.col("conv"), "w1": F.col("saved"), "w2": F.col("leaf")})
    below = _expand(upper, 3).groupBy(*NODE).agg(F.sum("w1").alias("more_saved"), F.sum("w2").alias("more_leaves"))

    nodes = placed(nodes, ["conv_id"], ["up"], ["saved", "leaf"]).drop("place")
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in NODE])
    above = F.concat_ws(":", F.col("pp").cast("string"), F.col("pq").cast("string"), (F.col("depth") - 1).cast("string"))
    tops = nodes.join(chains.select(F.col("conv").alias("conv_id"), F.col("top").alias("depth")), ["conv_id", "depth"]).select(*NODE, above.alias("above"))
    parents = materialize(nodes.where("n_children > 0").select(name.alias("above"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    tops = lookup(materialize(tops.withColumn("spread", F.monotonically_increasing_id())), parents, "above", "n_children", "spread").select(*NODE, F.col("parent_conv_id").alias("branch"))
    whole = nodes.join(below, list(NODE), "left").join(tops, list(NODE), "left").join(_ends(ends), list(NODE), "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("branch", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaf_upto") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_upto") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


ORACLE = f"""
WITH t AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, ({CRC32.format("c")} % 6)::BIGINT AS h, c - c % 100 AS donor, count(*) AS m FROM t GROUP BY c
), turns AS (
    SELECT convs.c, place AS pos, role, text FROM convs JOIN t ON t.c = donor AND place < h
    UNION ALL
    SELECT t.c, place - a.h + least(a.h, coalesce(b.m, 0)), role, text FROM t JOIN convs a ON a.c = t.c LEFT JOIN convs b ON b.c = a.donor WHERE place >= a.h
), keyed AS (
    SELECT c, pos + 1 AS depth, length(text) AS n, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY pos)) AS key FROM turns
    UNION ALL SELECT c, 0, 0, '' FROM convs
), walk AS (
    SELECT *, lag(key) OVER w AS above, lead(key) OVER w IS NULL AS ends FROM keyed WINDOW w AS (PARTITION BY c ORDER BY depth)
), node AS (
    SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, any_value(above) AS above, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends FROM walk GROUP BY key, depth
), kids AS (
    SELECT above AS key, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2
), full_node AS (
    SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key, depth)
), below AS (
    SELECT k.key, k.depth, sum((v.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.n)::BIGINT AS saved_tokens
    FROM full_node v JOIN keyed k ON k.c = v.conv_id AND k.depth <= v.depth GROUP BY k.key, k.depth
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM full_node v JOIN below USING (key, depth) LEFT JOIN node p ON p.key = v.above AND p.depth = v.depth - 1
"""
