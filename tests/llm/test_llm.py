"""The operators of the llm package on hand-written rows, against brute force and libraries."""

import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, langid, mixing, nearest, quality, simhash, substring, token_counts, toxicity
from weftline.llm import queries as llm_queries
from weftline.llm import sentencepiece as pieces
from weftline.llm.vocabulary import PIECES, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, edge string"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], SCHEMA)


def odd(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", "a"), (5, "One", "en", None), (6, long, "en", "a"), (7, long + " tail", "en", "b")]
    rows += [(8, "start " + passage + " end", "fr", "b"), (9, passage + " more", "fr", "b"), (9, passage + " more", "fr", "b"), (10, "same words " * 60, "de", "c"), (11, "same words " * 80, "de", "c")]
    rows += [(20 + i, passage.replace("w1 ", f"q{i} ") + " x" * i, "de", "c") for i in range(8)]
    return rows


def removed_by_force(rows, window=50):
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in docs:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_against_brute_force(spark):
    rows = odd(spark)
    got = substring.digests(substring.remove_repeats(documents(spark, rows)))
    assert sorted(tuple(r) for r in got.collect()) == removed_by_force(rows)


@pytest.mark.parametrize("seed", range(3))
def test_substring_on_random_text_of_few_words(spark, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("ab") for _ in range(rng.randrange(150))) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(base)[rng.randrange(40) * 2 :] for _ in range(3)), "en", "a") for i in range(25)]
    got = substring.digests(substring.remove_repeats(documents(spark, rows)))
    assert sorted(tuple(r) for r in got.collect()) == removed_by_force(rows)


def prints_by_force(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    rows = odd(spark)
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    fps = {r[0]: prints_by_force(r[1]) for r in rows}
    comp = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


@pytest.mark.parametrize("tree_size", [4096, 8])
def test_links_are_complete_in_dense_buckets(spark, tree_size):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tree_size=tree_size)).collect()
    root = dict(found)
    parent = {v: v for v in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    assert {v: root.get(v, v) for v in signed} == {v: top(v) for v in signed}


def test_exact_dedup_and_colliding_digests(spark):
    rows = [(1, "a b", "en", "a"), (2, "ab", "en", "a"), (3, "a\nb ", "en", "a"), (4, None, "en", "a"), (5, " ", "en", "a"), (6, "", "en", "a"), (7, "c", "en", "a"), (8, "c", "en", "a")]
    want = {1: (3, 3), 2: (3, 3), 3: (3, 3), 4: (5, 3), 5: (5, 3), 6: (5, 3), 7: (7, 2), 8: (7, 2)}
    docs = documents(spark, rows)
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 0)  # noqa: E731  every digest is the same
    for found in (exact_dedup.exact_dedup(docs), exact_dedup.exact_dedup(docs, digest=weak)):
        got = {r["doc_id"]: r for r in found.collect()}
        assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == want
        assert all(r["kept"] == (i == r["keep_id"]) for i, r in got.items()) and got[7]["text_sha256"] == hashlib.sha256(b"c").hexdigest()


TEXTS = ["Hello  world\n a", "", None, "  x ", "a\tb", "élé 日本 <s> x", "ﬁ Ａ\0q", "x" * 3000, "the" * 500 + "  ", "Zugeü chbetz vergeber zu für enerte"]


def test_encoding_equals_the_library_and_goes_back(spark):
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode([t or "" for t in TEXTS])
    rows = documents(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)])
    got = {r["doc_id"]: r for r in pieces.round_trip(rows).collect()}
    assert [got[i]["ids"] for i in range(len(TEXTS))] == want and all(r["restored"] for r in got.values())
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(pieces.encode(rows)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_query_returns_the_ids(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in llm_queries.op8_sentencepiece(spark, sf).collect()}
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(list(texts.values()))
    assert [got[i]["ids"] for i in texts] == want and all(r["restored"] for r in got.values())


def best_by_force(v, unit):
    own = {v.pieces[i]: v.scores[i] for i in v.matched}
    low = min(own.values()) - 10
    best = [(0.0, 0)] + [(-1e300, 0)] * len(unit)
    for end in range(1, len(unit) + 1):
        for n in range(min(end, v.longest), 0, -1):
            p = unit[end - n : end]
            gain, more = (own[p], 1) if p in own else (low, len(v.fallback(p))) if n == 1 else (-1e300, 0)
            if best[end - n][0] + gain > best[end][0]:
                best[end] = best[end - n][0] + gain, best[end - n][1] + more
    return best[-1][1]


def test_token_counts_against_brute_force(spark):
    v = read()
    want = {i: sum(best_by_force(v, u) for us in v.units(v.normalise(t)) for u in us) for i, t in enumerate(TEXTS)}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(documents(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)])).collect()}
    assert got == want


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 37), "en", ["a", "b", None][i % 3]) for i in range(300)] + [(900, None, "en", "z"), (901, "", "en", "z")]
    got = mixing.mix(documents(spark, rows)).toPandas()
    per = got.groupby(["source_size", "target"]).agg(taken=("taken", "sum")).reset_index()
    assert (got["taken"] <= 2 * got["size"]).all() and len(got) == len(rows)
    assert (abs(per["taken"] - per["target"]) <= 2).all() and abs(per["target"].sum() - 1.5 * got["size"].sum()) < 1e-6
    assert got.sort_values("doc_id")["taken"].tolist() == mixing.mix(documents(spark, rows).repartition(7)).toPandas().sort_values("doc_id")["taken"].tolist()


def test_nearest_leaves_out_what_takes_no_part(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 8), (63, [1.0, float("nan")] * 4), (64, [1.0] * 4), (65, [None] * 8)]
    rows += [(70, rows[3][1]), (71, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = nearest.nearest(df, df.where("vec_id % 20 = 0"), candidate_block=16).collect()
    ok = {i: np.array(v) for i, v in rows if i < 60 or i >= 70}
    for q in (0, 20, 40):
        order = sorted((-float(np.dot(ok[q], x) / np.linalg.norm(ok[q]) / np.linalg.norm(x)), i) for i, x in ok.items() if i != q)[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in order]
    assert {r["query_id"] for r in got} == {0, 20, 40}


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    more = docs.select("doc_id", "text", "lang").limit(0).union(spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "12 34", "en")], "doc_id long, text string, lang string"))
    docs = docs.select("doc_id", "text", "lang").union(more)
    for found, label, least in ((toxicity.toxicity(docs, labels), "toxic", 0.85), (quality.quality(docs, labels), "quality", 0.95)):
        found = found.cache()
        assert found.count() == docs.count() and found.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
        assert found.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least
    found = langid.identify(docs).cache()
    assert found.where("held_out").join(docs.where("lang IS NOT NULL AND doc_id >= 0"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert {r["lang_pred"] for r in found.where("doc_id < 0").collect()} == {"und"}


def test_empty_tables(spark):
    docs = documents(spark, odd(spark)).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = [simhash.near_duplicates(docs), exact_dedup.exact_dedup(docs), substring.digests(substring.remove_repeats(docs)), mixing.mix(docs), pieces.round_trip(docs), token_counts.token_counts(docs)]
    found += [toxicity.toxicity(docs, labels), quality.quality(docs, labels), langid.identify(docs)]
    assert [f.count() for f in found] == [0] * len(found)


def test_pieces_of_one_key_are_placed_by_the_first_column():
    encoder = pieces.Encoder(read(PIECES))
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (400, 3)).astype(np.uint64)
    rows = rows[np.lexsort(rows.T[::-1])]
    over = np.iinfo(np.uint64).max
    for beyond, rest in ((False, 0), (True, over)):
        short = np.array([[k, rest, rest] for k in range(5)], np.uint64)
        want = [next((i for i, r in enumerate(rows.tolist()) if r > w or (r == w and not beyond)), len(rows)) for w in short.tolist()]
        assert encoder._search([rows[:, 0].copy(), None, None], short, beyond).tolist() == want  # no other column is read
        every = np.array([[a, b, c] for a in range(4) for b in (0, 1, 2, over) for c in (0, 1, over)], np.uint64)
        want = [next((i for i, r in enumerate(rows.tolist()) if r > w or (r == w and not beyond)), len(rows)) for w in every.tolist()]
        assert encoder._search([rows[:, k].copy() for k in range(3)], every, beyond).tolist() == want
