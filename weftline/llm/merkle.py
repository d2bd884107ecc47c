"""Operator 11: a Merkle manifest of a dataset, whose nodes are labelled with the interval of leaf ranks that they cover."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import lookup, materialize
from weftline.llm.order import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3  # nodes of a run
REACH = 5  # levels that one grouping builds: at most FAN ** REACH nodes meet in a row
PATH = "array<struct<before:string,after:string>>"


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """H of the columns: each `-` if null, else its UTF-8 byte count, `:` and itself."""
    texts = [c.cast("string") for c in columns]
    return _hash(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def _height(n: Column) -> Column:
    """Levels above the n leaves of a tree: the powers of FAN below n."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(40)]), lambda p: p < n))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def _parents(nodes: Column) -> Column:
    """Of the consecutive nodes (lo, hi, digest) each run of FAN, the last one maybe shorter, as its parent."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda i: F.slice(nodes, i * FAN + 1, FAN))
    return F.transform(runs, lambda r: F.struct(r[0]["lo"].alias("lo"), F.element_at(r, -1)["hi"].alias("hi"), _hash(_joined(r)).alias("digest")))


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The trees over leaves (tree, n: leaves of the tree, lo: rank, digest, further columns), REACH levels a table.

    A row of table j is a block: the nodes l0 of level j * REACH below one node l5, and the levels between, each node with
    the interval [lo, hi) of leaf ranks that it covers. Levels above a tree's height are not used.
    """
    more = [c for c in leaves.columns if c not in ("tree", "n", "lo", "digest")]
    entries = leaves.select("tree", "n", F.struct("lo", (F.col("lo") + 1).alias("hi"), "digest", *more).alias("node"))
    most, bands, reached = leaves.agg(F.max("n")).first()[0] or 0, [], 1
    while True:
        reached *= FAN**REACH
        blocks = entries.groupBy("tree", "n", F.expr(f"node.lo div {reached}").alias("block")).agg(F.array_sort(F.collect_list("node")).alias("l0"))
        for k in range(REACH):
            blocks = blocks.withColumn(f"l{k + 1}", _parents(F.col(f"l{k}")))
        bands.append(materialize(blocks.withColumn("height", _height(F.col("n")))))
        if most <= reached:
            return bands
        entries = bands[-1].where(F.col("n") > reached).select("tree", "n", F.col(f"l{REACH}")[0].alias("node"))


def _ends_in(j: int) -> Column:
    """True where a tree of that height ends in table j of grow."""
    below = F.col("height") <= REACH * (j + 1)
    return below if j == 0 else below & (F.col("height") > REACH * j)


def roots(bands: list[DataFrame]) -> DataFrame:
    """tree, n, digest of what remains at the top of each tree."""
    found = [b.where(_ends_in(j)).select("tree", "n", F.element_at(F.array(*[F.col(f"l{k}")[0]["digest"] for k in range(REACH + 1)]), F.col("height") - REACH * j + 1).alias("digest")) for j, b in enumerate(bands)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _siblings(x: Column, k: int, level: int) -> Column:
    """What the interval of x's parent holds beside the node that covers x, as the digests before and after it.

    level: of the nodes lk; x.lo div FAN ** (level + 1) is the bucket of the parent, the same for all that it contains.
    """
    first = F.col("l0")[0]["lo"]
    width = FAN ** (level + 1)
    family = F.slice(F.col(f"l{k}"), (F.floor((x["lo"] - first) / width) * FAN + 1).cast("int"), FAN)
    return F.struct(_joined(F.filter(family, lambda s: s["hi"] <= x["lo"])).alias("before"), _joined(F.filter(family, lambda s: s["lo"] > x["lo"])).alias("after"))


def _with_path(j: int) -> Callable[[Column], Column]:
    """From a node of l0 in table j, that node with its path: its own levels of the block, then `more`."""

    def one(x: Column) -> Column:
        own = F.array(*[_siblings(x, k, REACH * j + k) for k in range(REACH)])
        return F.struct(x.alias("node"), F.concat(F.slice(own, F.lit(1), F.least(F.lit(REACH), F.col("height") - REACH * j)), F.col("more")).alias("path"))

    return one


def paths(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, node (a leaf), top, path: the siblings of each leaf and of its ancestors, level by level.

    above: (tree, n, top, path) of the roots. From the top table down, each block meets the one node that contains it:
    both carry the bucket of the block's level, and the node's interval covers the block's. So ancestors are attached
    once a block and not once a leaf.
    """
    known = None
    for j in range(len(bands) - 1, -1, -1):
        width = FAN ** (REACH * (j + 1))
        over = above.withColumn("height", _height(F.col("n"))).where(_ends_in(j)).select("tree", F.lit(0).cast("long").alias("a_lo"), F.col("n").alias("a_hi"), "top", F.col("path").alias("more"))
        if known is not None:
            over = over.unionByName(known.select("tree", F.col("node.lo").alias("a_lo"), F.col("node.hi").alias("a_hi"), "top", F.col("path").alias("more")))
        over = over.withColumn("a_block", F.expr(f"a_lo div {width}")).withColumnRenamed("tree", "a_tree")
        inside = (F.col("tree") == F.col("a_tree")) & (F.col("block") == F.col("a_block")) & (F.col("a_lo") <= F.col("l0")[0]["lo"]) & (F.element_at("l0", -1)["hi"] <= F.col("a_hi"))
        known = bands[j].join(over, inside).select("tree", "top", F.explode(F.transform("l0", _with_path(j))).alias("x")).select("tree", "top", "x.node", "x.path")
    return known


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs.

    A leaf is the digest of the fields. The leaves of a source, by id, are a tree: while several nodes remain, each three
    that follow each other become their H, as does a shorter last run. The trees' roots, by source, are the leaves of the
    tree above. proof_sha256 is H of all siblings up to the root; folded_root is computed again from the leaf, or, where
    `tampered` (a condition; none unless given) holds, from that of the text without line feeds, and the siblings.

    Null fields have a leaf of their own form; a null source is a source, the first, and null ids come first in it. Rows
    that repeat an id are leaves in the order of their digests, equal rows in any order. An empty table gives an empty
    result; other columns are ignored.
    """
    columns = {f: F.col(f) for f in fields}
    changed = {**columns, text_col: F.replace(F.col(text_col), F.lit("\n"), F.lit(""))}
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), key.alias("tree"), F.when(F.col(source_col).isNotNull(), F.col(source_col).cast("string")).alias("source"), leaf_digest(list(columns.values())).alias("digest"),
        F.when(hit, leaf_digest(list(changed.values()))).alias("changed"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = placed(materialize(rows), ["tree"], ["doc_id", "digest", "row"])
    trees = materialize(leaves.groupBy("tree", "source").agg(F.count("*").alias("n")))
    leaves = materialize(lookup(leaves, trees.select("tree", "n"), "tree", "n", "row").select("tree", "n", F.col("place").alias("lo"), "digest", "doc_id", "changed"))
    bands = grow(leaves)

    tops = materialize(roots(bands).select("tree", "digest").join(trees.select("tree", "source"), "tree"))
    count = tops.count()
    upper = grow(materialize(placed(tops, [], ["source"]).select(F.lit("").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("place").alias("lo"), "digest", F.col("tree").alias("own"))))
    top = roots(upper).first()
    root = F.lit(top["digest"] if top else None).cast("string")
    start = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(count).cast("long").alias("n"), root.alias("top"), F.array().cast(PATH).alias("path"))
    heads = materialize(paths(upper, start).select(F.col("node.own").alias("tree"), F.col("node.digest").alias("top"), "path")).join(trees.select("tree", "n"), "tree")

    found = paths(bands, heads).select(F.col("node.doc_id").alias("doc_id"), F.col("node.digest").alias("leaf"), F.col("node.changed").alias("changed"), F.col("top").alias("subroot"), "path")
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    folded = F.aggregate("path", F.coalesce("changed", "leaf"), lambda acc, p: _hash(F.concat(p["before"], acc, p["after"])))
    found = found.select("doc_id", "leaf", "subroot", root.alias("root"), _hash(proof).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of the decimal digits of {0}, in DuckDB's functions.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)), "
    "lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c, b) & 255, [1::UBIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda r, i: xor(r >> 1, 3988292384::UBIGINT * (r & 1))))), 4294967295::UBIGINT)"
)
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"

ORACLE = f"""
WITH RECURSIVE leaf AS (
    SELECT doc_id, source, {_LEAF} AS digest, CASE WHEN {CRC32.format("doc_id")} % 2 = 0 THEN {_LEAF.replace("text::", "replace(text, chr(10), '')::")} END AS changed FROM documents
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS lo, count(*) OVER (PARTITION BY source) AS n FROM leaf
), up AS (
    SELECT source, 0 AS level, lo, n, digest FROM ranked
    UNION ALL SELECT source, level + 1, lo // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY lo)) FROM up WHERE n > 1 GROUP BY source, level, lo // 3, n
), tops AS (
    SELECT source, level AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS lo, count(*) OVER () AS n FROM up WHERE n = 1
), above AS (
    SELECT 0 AS level, lo, n, digest FROM tops
    UNION ALL SELECT level + 1, lo // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY lo)) FROM above WHERE n > 1 GROUP BY level, lo // 3, n
), fold AS (
    SELECT doc_id, r.source, r.digest AS leaf, t.digest AS subroot, 0 AS level, r.lo, t.height, t.lo AS top, coalesce(changed, r.digest) AS acc, '' AS proof
    FROM ranked r JOIN tops t ON r.source IS NOT DISTINCT FROM t.source
    UNION ALL
    SELECT f.doc_id, f.source, leaf, subroot, f.level + 1, f.lo // 3, height, top,
           sha256(coalesce(string_agg(u.digest, '' ORDER BY u.lo) FILTER (u.lo < f.lo), '') || acc || coalesce(string_agg(u.digest, '' ORDER BY u.lo) FILTER (u.lo > f.lo), '')),
           proof || coalesce(string_agg(u.digest, '' ORDER BY u.lo) FILTER (u.lo <> f.lo), '')
    FROM fold f JOIN up u ON u.source IS NOT DISTINCT FROM f.source AND u.level = f.level AND u.lo // 3 = f.lo // 3
    WHERE f.level < height GROUP BY f.doc_id, f.source, leaf, subroot, f.level, f.lo, height, top, acc, proof
), upper AS (
    SELECT doc_id, leaf, subroot, 0 AS level, top AS lo, acc, proof FROM fold WHERE level = height
    UNION ALL
    SELECT f.doc_id, leaf, subroot, f.level + 1, f.lo // 3,
           sha256(coalesce(string_agg(u.digest, '' ORDER BY u.lo) FILTER (u.lo < f.lo), '') || acc || coalesce(string_agg(u.digest, '' ORDER BY u.lo) FILTER (u.lo > f.lo), '')),
           proof || coalesce(string_agg(u.digest, '' ORDER BY u.lo) FILTER (u.lo <> f.lo), '')
    FROM upper f JOIN above u ON u.level = f.level AND u.lo // 3 = f.lo // 3
    WHERE f.level < (SELECT max(level) FROM above) GROUP BY f.doc_id, leaf, subroot, f.level, f.lo, acc, proof
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM upper, (SELECT digest AS root FROM above WHERE n = 1) WHERE level = (SELECT max(level) FROM above)
"""
