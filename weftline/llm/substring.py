"""Operator 6: removal of long repeated word sequences by De Bruijn compaction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
SPREAD = np.uint64(0xFF51AFD7ED558CCD)
SMALL = 3  # words of the short grams that choose k-mers


class Rolling:
    """Hashes of any word span of one batch, from prefix sums of word hashes times powers of an odd base."""

    def __init__(self, words: np.ndarray, base: int = BASE) -> None:
        n = len(words) + 1
        power = np.full(n, base, np.uint64)
        power[0] = 1
        inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        power, self.inverse = np.cumprod(power), np.cumprod(inverse)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * power[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(33)
        h *= SPREAD
        return h ^ (h >> np.uint64(29))


def chosen(rolling: Rolling, n: int, k: int) -> np.ndarray:
    """Positions of closed syncmers: k-mers whose least short gram, the leftmost of equals, is their first or last.

    The choice depends on the k-mer alone, and any k - SMALL consecutive k-mers have one.
    """
    if n < k:
        return np.zeros(0, np.int64)
    at = np.arange(n - SMALL + 1)
    x = rolling.spans(at, at + SMALL)
    reach = k - SMALL
    least, have = x, 1  # least of `have` grams from each place
    while 2 * have <= reach:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    over = np.minimum(least[: len(least) - (reach - have)], least[reach - have :])  # of `reach` grams
    m = n - k + 1
    first = x[:m] <= over[1 : m + 1]
    last = x[reach : reach + m] < over[:m]
    return np.flatnonzero(first | last)


def _batch(texts: list) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [(t or b"").split() for t in texts]
    hashed = xxhash.xxh3_64_intdigest
    flat = np.fromiter((hashed(w) for ws in words for w in ws), np.uint64, sum(map(len, words)))
    return words, flat, np.concatenate([[0], np.cumsum([len(w) for w in words])])


def _rows(b: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """(first row, texts as bytes) of parts of a batch with some MB of text each."""
    texts = b.column("text").cast(pa.binary()).to_pylist()
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= most or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, held = i + 1, 0


def _kmers(flat: np.ndarray, ends: np.ndarray, k: int) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """The rolling hashes, the places of chosen k-mers that lie in one document, and their documents."""
    rolling = Rolling(flat)
    at = chosen(rolling, len(flat), k)
    doc = np.searchsorted(ends, at, "right") - 1
    inside = at + k <= ends[doc + 1] if len(at) else np.zeros(0, bool)
    return rolling, at[inside], doc[inside]


def occurrences(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, version, at, edge, next, prior) of the chosen k-mers of docs (doc_id, version, text).

    edge is a hash of the k words; next and prior are hashes of the words from this k-mer's start to the end of the
    following one, and from the preceding one's start to this one's end: the steps of the De Bruijn graph.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _rows(b):
                _, flat, ends = _batch(texts)
                rolling, at, doc = _kmers(flat, ends, k)
                if not len(at):
                    continue
                edge = rolling.spans(at, at + k)
                follows = np.append(doc[1:] == doc[:-1], False)
                step = rolling.spans(at, np.append(at[1:], at[-1]) + k).view(np.int64)
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("version").take(rows), pa.array((at - ends[doc]).astype(np.int32)), pa.array(edge.view(np.int64)),
                     pa.array(step, mask=~follows), pa.array(np.append(0, step[:-1]), mask=~np.append(False, follows[:-1]))],
                    ["doc_id", "version", "at", "edge", "next", "prior"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "version", "text").mapInArrow(run, f"doc_id {kind}, version bigint, at int, edge bigint, next bigint, prior bigint")


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _check(window: int, k: int):
    """Per document: the spans that compaction removes, with their sources, and the windows it leaves open, with digests."""

    def one(n: int, at: np.ndarray, repeated: np.ndarray, linked: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows that a path decides, the place in `at` of their first k-mer, and starts of open windows."""
        starts = np.arange(n - window + 1)
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + window - k, "right")
        odd = np.concatenate([[0], np.cumsum(~repeated)])
        whole = (hi > lo) & (odd[hi] == odd[lo])  # every chosen k-mer in the window is repeated
        # compacted paths: neighbouring repeated k-mers joined by nonbranching steps
        joins = repeated[:-1] & repeated[1:] & linked[:-1]
        path = np.concatenate([[0], np.cumsum(~joins)])
        begin = at[np.searchsorted(path, path)]
        end = at[np.searchsorted(path, path, "right") - 1] + k
        first = np.minimum(lo, len(at) - 1)
        within = whole & (starts >= begin[first]) & (starts + window <= end[first])
        sure = within & less[first]
        return starts[sure], first[sure], starts[whole & ~within]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, texts in _rows(b):
                count = len(texts)
                lists = b.column("marks").slice(row, count)
                flat_marks = lists.flatten()
                mark = {c: flat_marks.field(c).to_numpy(zero_copy_only=False) for c in ("at", "linked", "src_doc", "src_version", "src_at")}
                mark_cuts = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))])
                ids, versions = b.column("doc_id").slice(row, count), b.column("version").slice(row, count)
                words, flat, ends = _batch(texts)
                _, at, doc = _kmers(flat, ends, k)
                cuts = np.searchsorted(doc, np.arange(count + 1))
                out = {c: [] for c in ("n_words", "sha", "text", "source", "open", "key", "spans", "start", "n", "from", "src_start", "digest")}
                for i, (ws, own, version) in enumerate(zip(words, ids.to_pylist(), versions.to_pylist(), strict=True)):
                    m = slice(mark_cuts[i], mark_cuts[i + 1])
                    sure = open_ = np.zeros(0, np.int64)
                    source, before = False, len(out["start"])
                    if m.stop > m.start:
                        known, src = mark["at"][m], mark["src_doc"][m]
                        source = bool(((src == own) & (mark["src_version"][m] == version)).any())
                        if len(ws) >= window:
                            here = at[cuts[i] : cuts[i + 1]] - ends[i]
                            spot = np.minimum(np.searchsorted(known, here), len(known) - 1)
                            sure, first, open_ = one(len(ws), here, known[spot] == here, mark["linked"][m].astype(bool)[spot], (src < own)[spot])
                    if len(sure):
                        mine = spot[first]
                        move = mark["src_at"][m][mine] - here[first]
                        same = (np.diff(sure) == 1) & (np.diff(move) == 0) & (src[mine[1:]] == src[mine[:-1]]) & (np.diff(mark["src_version"][m][mine]) == 0)
                        heads = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(sure)]])
                        for x, y in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                            begin = int(sure[x])
                            out["start"].append(begin)
                            out["n"].append(y - x)
                            out["from"].append(m.start + int(mine[x]))
                            out["src_start"].append(begin + int(move[x]))
                            out["digest"].append(_sha(ws[begin : begin + y - x + window - 1]))
                    touched = len(sure) + len(open_) > 0
                    out["n_words"].append(len(ws))
                    out["sha"].append(None if touched else hashlib.sha256(b" ".join(ws)).hexdigest())
                    out["text"].append(texts[i] if touched or source else None)
                    out["source"].append(source)
                    out["spans"].append(len(out["start"]) - before)
                    out["open"].append(open_.astype(np.int32))
                    out["key"].append([_sha(ws[p : p + window]) for p in open_.tolist()])
                taken = pa.array(out["from"], pa.int64())
                spans = pa.StructArray.from_arrays(
                    [pa.array(out["start"], pa.int32()), pa.array(out["n"], pa.int32()), flat_marks.field("src_doc").take(taken), flat_marks.field("src_version").take(taken),
                     pa.array(out["src_start"], pa.int32()), pa.array(out["digest"], pa.binary())], ["start", "n", "src_doc", "src_version", "src_start", "digest"],
                )
                spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *out["spans"]]).astype(np.int32)), spans)
                arrays = [ids, versions, pa.array(out["n_words"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["text"], pa.binary()).cast(pa.string()), pa.array(out["source"], pa.bool_())]
                arrays += [pa.array(out["open"], pa.list_(pa.int32())), pa.array(out["key"], pa.list_(pa.binary())), spans]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "version", "n_words", "sha", "text", "source", "open", "key", "spans"])

    return run


def _unproven(checked: DataFrame, window: int) -> DataFrame:
    """(src_doc, src_version, src_start, n, digest) of spans whose words are not those at the source's coordinates.

    Equal spans of one source are one request, so that a passage in many documents is read once at its source.
    """
    at = ["src_doc", "src_version", "src_start", "n"]
    asked = materialize(checked.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).select("s.*").groupBy(*at, "digest").agg(F.count("*").alias("spans")))
    lists = asked.groupBy("src_doc", "src_version").agg(F.collect_set(F.struct("src_start", "n", "digest")).alias("asked"))
    sources = checked.where("source").select(F.col("doc_id").alias("src_doc"), F.col("version").alias("src_version"), "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, (text, asked) in enumerate(zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("asked").to_pylist(), strict=True)):
                words = (text or b"").split()
                for x in asked:
                    if _sha(words[x["src_start"] : x["src_start"] + x["n"] + window - 1]) != x["digest"]:
                        rows.append(i)
                        found.append(x)
            at = pa.array(rows, pa.int64())
            more = [pa.array([x[c] for x in found], kind) for c, kind in (("src_start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("src_doc").take(at), b.column("src_version").take(at), *more], ["src_doc", "src_version", "src_start", "n", "digest"])

    kind = dict(checked.dtypes)["doc_id"]
    met = lists.join(sources, ["src_doc", "src_version"], "left").select("src_doc", "src_version", "text", "asked")
    return materialize(met.mapInArrow(run, f"src_doc {kind}, src_version bigint, src_start int, n int, digest binary"))


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row: words go that a window covers which a smaller id also has.

    Chosen token k-mers are the edges of a De Bruijn graph over all documents; one in two documents or more is
    repeated. Steps that are the only way on from one repeated k-mer and the only way to the next are found by a join
    of the graph with itself; along them neighbouring k-mers form compacted paths, whose windows all stand in the same
    documents, so that the path's smallest id decides for them at once. Each run of such windows is then verified: the
    SHA-256 of its words must be that of the words at its coordinates in the source document; a run that its source does
    not confirm stays. The remaining windows made of repeated k-mers, those over the ends of paths, are compared one by
    one by the SHA-256 of their words. So nothing goes on the k-mers' own 64-bit hashes. Every window has a chosen k-mer
    (2 * k <= window + 4), so none is missed.

    Null texts have no words. Windows are judged on the input. Rows that repeat an id are one document in this; rows
    with a null id lose nothing and are no source. An empty table gives an empty result; other columns are ignored.
    """
    if 2 * k > window + 4:
        raise ValueError("2 * k must be at most window + 4")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("version", F.coalesce(F.xxhash64("text"), F.lit(0)))
    found = occurrences(rows.where(F.col("doc_id").isNotNull()), k)
    source = F.min(F.struct("doc_id", "version", "at")).alias("src")
    repeated = found.groupBy("edge").agg(source, F.max("doc_id").alias("most")).where("src.doc_id < most")
    repeated = materialize(repeated.select("edge", F.col("src.doc_id").alias("src_doc"), F.col("src.version").alias("src_version"), F.col("src.at").alias("src_at")))
    marks = materialize(found.join(repeated, "edge"))  # of written tables: Spark can then split a hot edge's rows in the join
    only = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
    graph = marks.groupBy("edge").agg(F.min("next").alias("next"), F.min("prior").alias("prior"), only("next").alias("one_on"), only("prior").alias("one_to"))
    graph = materialize(graph)
    steps = graph.where("one_on").select(F.col("next").alias("step")).join(graph.where("one_to").select(F.col("prior").alias("step")), "step").distinct()
    steps = materialize(steps)
    linked = marks.join(steps.withColumn("linked", F.lit(True)), marks["next"] == F.col("step"), "left")
    mark = F.struct("at", F.coalesce("linked", F.lit(False)).alias("linked"), "src_doc", "src_version", "src_at")
    lists = linked.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(mark)).alias("marks"))
    checked = rows.join(lists, ["doc_id", "version"], "left").select("doc_id", "version", "text", "marks")
    spans = f"array<struct<start:int,n:int,src_doc:{kind},src_version:bigint,src_start:int,digest:binary>>"
    checked = materialize(checked.mapInArrow(_check(window, k), f"doc_id {kind}, version bigint, n_words bigint, sha string, text string, source boolean, open array<int>, key array<binary>, spans {spans}"))
    open_ = checked.where(F.size("open") > 0).select("doc_id", "version", F.explode(F.arrays_zip("open", "key")).alias("w")).select("doc_id", "version", "w.*")
    least = open_.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = materialize(least)
    more = open_.join(least, "key").where("least < doc_id").groupBy("doc_id", "version").agg(F.collect_set("open").alias("more"))
    unproven = _unproven(checked, window)

    @F.pandas_udf("n_removed bigint, kept_text string")
    def cut(texts: pd.Series, begins: pd.Series, counts: pd.Series, more: pd.Series) -> pd.DataFrame:
        removed, kept = [], []
        for t, a, n, b in zip(texts, begins, counts, more, strict=True):
            words = t.encode("utf-8", "surrogatepass").split()
            mark = np.zeros(len(words) + 1, np.int64)
            for begin, stop in ((a, a + n + window - 1), (b, b + window)) if b is not None else ((a, a + n + window - 1),):
                np.add.at(mark, begin, 1)
                np.add.at(mark, stop, -1)
            stays = np.cumsum(mark)[: len(words)] == 0
            removed.append(int(len(words) - stays.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"n_removed": removed, "kept_text": kept})

    changed = F.col("sha").isNull()
    touched = checked.where(changed).select("doc_id", "version", "n_words", "text", "spans")
    if not unproven.isEmpty():  # a run of windows whose k-mers all collide with others: their documents' spans are taken apart and joined again
        each = touched.select("doc_id", "version", F.explode("spans").alias("s")).select("doc_id", "version", "s.*").join(unproven, ["src_doc", "src_version", "src_start", "n", "digest"], "left_anti")
        good = each.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
        touched = touched.drop("spans").join(good, ["doc_id", "version"], "left")
    none = F.array().cast("array<int>")
    touched = touched.join(more, ["doc_id", "version"], "left").withColumn("c", cut("text", F.coalesce("spans.start", none), F.coalesce("spans.n", none), "more"))
    touched = touched.select("doc_id", "version", "n_words", "c.n_removed", "c.kept_text", F.lit(None).cast("string").alias("sha"))
    plain = checked.where(~changed).select("doc_id", "version", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_text"), "sha")
    return touched.unionByName(plain).drop("version").withColumnRenamed("sha", "sha_of_whole")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; a text from which nothing went brings its digest along instead of itself."""
    return found.select("doc_id", "n_words", "n_removed", F.coalesce("sha_of_whole", F.sha2(F.col("kept_text").cast("binary"), 256)).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS h FROM s),
g AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT h.doc_id, p FROM h JOIN g USING (h) WHERE least < h.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM r),
x AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS gone,
      CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([w[i + 1] FOR i IN range(len(w)) IF NOT list_contains(gone, i)], ' ') END AS kept
      FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, n AS n_words, gone AS n_removed, sha256(kept) AS kept_sha256 FROM k
"""
