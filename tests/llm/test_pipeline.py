"""The stages of the pipeline against brute force, with null and repeated ids."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from weftline.llm import mixing, near_copies
from weftline.llm.common import scratch_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def least(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_exact_stage_with_null_and_repeated_ids(spark):
    rows = [(None, "a b", "en", "a"), (None, "ab", "en", "a"), (None, "a b", "en", "a"), (3, "c", "en", "a"), (3, "c", "en", "a"), (2, "c", "en", "a"), (None, "c", "en", "a"), (5, None, "en", "a"), (5, " ", "en", "a")]
    got = Counter((r["doc_id"], r["text"]) for r in cp.drop_exact_copies(spark, documents(spark, rows), "").collect())
    groups = {}
    for r in rows:
        groups.setdefault("".join((r[1] or "").split()), []).append(r)
    longest = {k: [r for r in g if len(r[1] or "") == max(len(x[1] or "") for x in g)] for k, g in groups.items()}
    assert got == Counter(least(g)[:2] for g in longest.values())


def test_near_stage_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(200))
    rows = [(None, text, "en", "a"), (None, text + " ", "en", "a"), (None, text.upper(), "en", "a"), (7, "other words here", "en", "a"), (7, "other words here", "en", "a")]
    got = [(r["doc_id"], (r["text"] or "").lower().strip()) for r in cp.drop_near_copies(spark, documents(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(None, text), (7, "other words here")], key=str)


def test_mix_stage_meets_its_targets_with_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else i % 5, f"t{i} " + "w " * (i % 37), "en", ["a", "b", None][i % 3]) for i in range(300)]
    out = cp.mix_sources(spark, documents(spark, rows), "").collect()
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += len(r["text"].split())
    per = spark.createDataFrame([(s, sum(len(t.split()) for _, t, _, x in rows if x == s)) for s in ("a", "b", None)], "source string, source_size long")
    assert all(abs(sizes[r["source"]] - r["target"]) <= 2 for r in mixing.targets(per).collect())
    assert max(Counter(r["text"] for r in out).values()) <= mixing.MOST
    again = cp.mix_sources(spark, documents(spark, rows).repartition(7), "").collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in out)


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def roots_by_force(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(len(sets))]


@pytest.mark.parametrize("common", [200, 5])
def test_near_copies_of_similarity_from_08_are_all_found(spark, common):
    rng = random.Random(11)
    line = " ".join(f"c{i}" for i in range(30))
    texts = [None, " ", "", "two words", "Two  words", "two words more"]
    for g in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([12, 60, 150, 400]))]
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randrange(1 + len(own) // 40)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own) + (f" {line}" if g % 3 == 0 else ""))
    texts += [f"{line} y{i} " + line.replace("c3 ", f"z{i % 4} ") for i in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_key long, text string")
    got = {r["row"]: r["root"] for r in near_copies.near_copies(rows, "row_key", common=common).collect()}
    assert [got[i] for i in range(len(texts))] == roots_by_force(texts)


def test_near_stage_drops_copies_between_08_and_1(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"x{n}" if n % step == 3 else w for n, w in enumerate(words)) for step in (10**6, 70, 50, 40)]
    kept = cp.drop_near_copies(spark, documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), "").collect()
    assert {r["doc_id"] for r in kept} == set(roots_by_force(texts))


def clashing(spark, rows):
    """documents with columns of the names that stages use for their own."""
    extra = {"row_key": 5, "times": 2, "score": 0.25, "copies": 3, "root": 1, "rank": 1, "row": 9, "keep_id": 4, "none": 1}
    return documents(spark, rows).withColumns({k: F.lit(v) for k, v in extra.items()}), extra


@pytest.mark.parametrize("stage", [cp.drop_exact_copies, cp.drop_near_copies, cp.mix_sources])
def test_columns_that_clash_pass_through(spark, stage):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f g", "en", "a"), (2, "a b c d e f g", "en", "a"), (3, long, "en", "b"), (4, None, None, None), (4, "", "en", "a")]
    docs, extra = clashing(spark, rows)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert all(r[k] == v for r in out.collect() for k, v in extra.items())
    none = docs.where("false")
    assert stage(spark, none, "").collect() == []


def test_toxicity_stage_keeps_the_clean(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["plain", "quiet", "river", "stone"]) for _ in range(20)) + (" vile! filth!" if i % 4 == 0 else ""), "en", "a") for i in range(300)]
    rows += [(None, None, None, None), (None, "plain quiet river", "en", "a"), (7, "plain stone", "en", "a"), (7, "plain stone", "en", "a")]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, extra = clashing(spark, rows)
    out = cp.drop_toxic(spark, docs, str(tmp_path))
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == docs.columns and got == Counter(r[:2] for r in rows if "vile" not in (r[1] or ""))


def test_the_whole_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "n_tokens", "restored"] and out.where("NOT restored").isEmpty()
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for name, stage in cp.STAGES[:4]:
        assert cp.drop_exact_copies.__name__ == "drop_exact_copies" and callable(stage) and name


def test_results_of_two_calls_live_side_by_side(spark, tmp_path):
    rows = [(i, f"text {i % 7} of some words", "en", "a") for i in range(40)]
    docs = documents(spark, rows)
    lazy = [cp.drop_exact_copies(spark, docs, ""), cp.drop_exact_copies(spark, docs, ""), cp.drop_near_copies(spark, docs, ""), cp.mix_sources(spark, docs, "")]
    assert [x.count() for x in lazy[:3]] == [7, 7, 7] and lazy[3].count() > 0


def test_row_numbers_of_written_docs_are_unique_and_lasting(spark, tmp_path):
    documents(spark, [(i, f"t{i}", "en", "a") for i in range(1000)]).repartition(7).write.parquet(f"{tmp_path}/d")
    docs, key = cp._numbered(spark.read.parquet(f"{tmp_path}/d"))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", key]
    one, two = ({r["doc_id"]: r[key] for r in docs.select(*c).collect()} for c in (["doc_id", key], [key, "doc_id"]))
    assert one == two and len(set(one.values())) == 1000


def test_a_run_leaves_one_table(spark, tmp_path):
    folder = scratch_dir(spark).removeprefix("file:")
    documents(spark, [(i, f"text {i} of some words {i % 3}", "en", "ab"[i % 2]) for i in range(60)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = set(os.listdir(folder))
    got = cp.run(spark, str(tmp_path))
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and got.count() >= 0
