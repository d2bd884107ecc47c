"""Operators 11 to 13 against plain versions of their contracts, on odd rows, hot keys and damaged files."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle, prefix_trie, warc
from weftline.llm.order import placed

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, lo long, path string, digest string"
TURNS = "conv_id long, turn long, role string, text string, p long, depth long, conv long, n long, at long"
PAGES = "page_id long, url string, html string, sha256 string, place long, shard long, size long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "t", 7, "p", "d") for r in rows], DOCS)


def tree_of(leaves):
    """The root of a run-of-three tree and each leaf's [before, after] by level."""
    nodes, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k // 3 * 3
            paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 3])))
            at[i] = k // 3
        nodes = [sha("".join(nodes[j : j + 3])) for j in range(0, len(nodes), 3)]
    return (nodes or [None])[0], paths


def manifest_by_force(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], len(r[1]) if r[1] else None, text))))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, digest(r, r[1]), r))
    trees = [(s, sorted(by[s], key=lambda x: x[:3])) for s in sorted(by, key=lambda s: (s is not None, (s or "").encode()))]
    tops = [tree_of([x[2] for x in leaves]) for _, leaves in trees]
    root, upper = tree_of([t[0] for t in tops])
    out = []
    for k, (_, leaves) in enumerate(trees):
        for (_, _, leaf, r), path in zip(leaves, tops[k][1], strict=True):
            path = path + upper[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = digest(r, r[1] if r[1] is None else r[1].replace("\n", "")) if hit else leaf
            for a, b in path:
                acc = sha(a + acc + b)
            out.append((r[0], leaf, tops[k][0], root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return Counter(out)


def manifest_rows(docs):
    found = merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found.collect())


def test_manifest_by_force_on_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, f"text {i}\nline", "en", rng.choice(["a", "a", "b", "é", None])) for i in range(900)]
    rows += [(None, "no id", None, "b"), (None, None, None, None), (3, "again", "en", "a"), (3, "again", "en", "a"), (1 << 60, "", "de", "z"), (5000, "日本\n語" * 50_000, "ja", "lone\n")]
    assert manifest_rows(docs_of(spark, rows)) == manifest_by_force(rows)


@pytest.mark.parametrize("n", [0, 1, 4, 244])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"t\n{i}", "en", "s") for i in range(n)]
    assert manifest_rows(docs_of(spark, rows)) == manifest_by_force(rows)


def test_places_of_a_hot_key_are_many_tasks(spark):
    rows = spark.range(0, 100_000, 1, 4).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), (100_000 - F.col("id")).alias("v"), F.lit(2).alias("w"))
    got = placed(rows, ["k"], ["v"], ["w"]).where("k is null")
    assert got.agg(F.countDistinct("place"), F.min("place"), F.max("place"), F.max("w_upto")).first() == (90_000, 0, 89_999, 180_000)
    assert got.where("w_upto != 2 * (place + 1)").isEmpty()
    assert got.select("v").where("v < 90000").count() > 0
    assert got.orderBy("place").select("v").limit(3).collect() == [(1,), (2,), (3,)]


def trie_by_force(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        has = {k[:-1] for k in nodes if k}
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below), sum(k not in has for k in below), saved, sha(ends)))
    return Counter(out)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("segment", [2, 3, 512])
def test_trie_by_force(spark, segment):
    rng = random.Random(segment)
    rows = []
    for c in [*range(0, 40), *range(97, 140), 205, 100_000_000_007]:
        own = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None])) for t in range(rng.choice([1, 2, 3, 5, 9, 20]))]
        rows += own
    rows += [(50, None, "user", "null turn"), (50, 1, "user", "x"), (50, 1, "user", "x"), (None, 0, "user", "no id"), (-5, 0, "user", "a"), (301, 0, "user", "x" * 100_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(df), segment)
    assert Counter(tuple(r[c] for c in TRIE) for r in got.collect()) == trie_by_force(rows)


def test_trie_of_no_turns_and_of_one_long_conversation(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(none)).count() == 0
    long = spark.range(5000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(long))
    h = zlib.crc32(b"7") % 6
    assert got.count() == 5000 - h + 1 and got.where("n_children = 0").select("depth", "n_leaves").collect() == [(5000 - h, 1)]


def test_fat_search_leaves_the_trie_where_a_plain_comparison_does():
    rng = random.Random(1)
    trie, known = prefix_trie.ZFastTrie(), []
    for _ in range(600):
        seq = tuple(rng.choice("ab") for _ in range(rng.randrange(0, 40)))
        ids = [hash(seq[:d]) for d in range(len(seq) + 1)]
        path = (0, ids, ids, [1] * len(seq))
        common = max((len(os.path.commonprefix([seq, k])) for k in known), default=-1)
        assert trie.exit_node(path)[1] == common
        trie.insert(path, [len(known), 1])
        known.append(seq)
    for node in range(len(trie.low)):
        assert trie.handles[trie._key(trie.path[node], prefix_trie.two_fattest(trie.low[node], trie.high[node]))] == node


def pages_by_force(rows):
    payload = lambda h: (h or "").encode()
    groups = {}
    for r in rows:
        groups.setdefault(payload(r[2]), []).append(r)
    out = []
    for p, same in groups.items():
        same = sorted(same, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        for i, r in enumerate(same):
            again = len(p) >= 1000 and i < len(same) - 1
            out.append((r[0], r[1], len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", same[-1][0] if again else None))
    return Counter(out)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, 3) for r in rows], PAGES)


def page_rows():
    big = "<html>" + "x" * 2000
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"page {i} " * (i % 300)) for i in range(300)]
    return rows + [(None, "http://none", big), (None, None, None), (7, "http://h/7", "again"), (5, None, big + "é"), (5, None, big + "é"), (5, None, big + "é"), (6, "http://h/ü?a=%20", ""), (1 << 60, "http://big", "\r\n\r\nWARC/1.1\r\n" * 100_000), (9, "", "y" * 999), (10, "u", "y" * 999)]


@pytest.mark.parametrize("shard_bytes,file_bytes", [(1 << 24, 1 << 28), (3000, 1 << 28), (40_000, 2000)])
def test_archives_read_back(spark, tmp_path, shard_bytes, file_bytes):
    rows = page_rows()
    folder = f"{tmp_path}/a"
    warc.write_archives(pages_of(spark, rows), folder, shard_bytes=shard_bytes, file_bytes=file_bytes)
    found = warc.read_archives(spark, folder, payloads=True).collect()
    assert Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == pages_by_force(rows)
    assert Counter(bytes(r["html"]) for r in found if r["html"] is not None) == Counter((r[2] or "").encode() for r in rows if (r[2] or "")[:999] != "<html>" + "x" * 993) + Counter({b"<html>" + b"x" * 2000: 1, ("<html>" + "x" * 2000 + "é").encode(): 1})
    assert not os.path.exists(f"{folder}/tmp") and not os.path.exists(f"{folder}/staged")


def test_reruns_write_equal_bytes_whatever_the_partitions(spark, tmp_path):
    rows = page_rows()
    first = warc.write_archives(pages_of(spark, rows), f"{tmp_path}/a", shard_bytes=30_000, file_bytes=4000).collect()
    random.Random(4).shuffle(rows)
    again = warc.write_archives(pages_of(spark, rows).repartition(9), f"{tmp_path}/b", shard_bytes=30_000, file_bytes=4000).collect()
    assert sorted(first) == sorted(again) and len(first) > 3
    for r in first:
        assert open(f"{tmp_path}/a/{r['name']}", "rb").read() == open(f"{tmp_path}/b/{r['name']}", "rb").read()


def test_damage_and_strangers_do_not_pass(spark, tmp_path):
    folder = f"{tmp_path}/a"
    name = warc.write_archives(pages_of(spark, [(1, "u", "z" * 5000)]), folder).first()["name"]
    (tmp_path / "a" / "part-999999-0000.warc.gz").write_bytes(b"left by a lost attempt")
    assert warc.read_archives(spark, folder).count() == 1
    whole = (tmp_path / "a" / name).read_bytes()
    member = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("Page-ID", 1), ("WARC-Payload-Digest", "sha1:" + "A" * 32)], b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nz")
    (tmp_path / "a" / name).write_bytes(member)
    with pytest.raises(Exception, match="damaged|not the file"):
        warc.read_archives(spark, folder).collect()
    (tmp_path / "a" / name).write_bytes(whole[:-20])
    with pytest.raises(Exception, match="within a record|not the file"):
        warc.read_archives(spark, folder).collect()


def test_archives_of_no_pages(spark, tmp_path):
    assert warc.write_archives(pages_of(spark, []), f"{tmp_path}/a").count() == 0
    assert warc.read_archives(spark, f"{tmp_path}/a").count() == 0
