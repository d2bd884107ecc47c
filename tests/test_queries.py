"""Every query of the library's own operators against its SQL at sf0.001, and hand-written cases."""

import math

import duckdb
import pytest

from weftline import queries_more as queries
from weftline.operators import align, assembly, history, replays, summaries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([_plain(v) for v in r] for r in df.select(*columns).collect()), key=str)
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(([_plain(v) for v in r] for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)


def _trials(spark, rows):
    """rows: (session, seq, action, reward, state, block); t is constant, so that seq breaks every tie."""
    df = spark.createDataFrame([(s, 0, q, a, r, st, b) for s, q, a, r, st, b in rows], "session int, t int, seq int, action int, reward int, state int, block int")
    return df.selectExpr("*", "int(action = state) AS correct", "action IS NOT NULL AS valid", "0 AS manual")


def test_renewal_counters(spark):
    t = _trials(spark, [(1, i, 1, r, 1, 0) for i, r in enumerate([1, 1, 0, 1, 0, 0, 1])])
    got = history.reward_counters(t).orderBy("seq").select("consecutive_rewards", "renewal_rewards", "renewal_omissions", "value").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0), (1, 1, 0, 1), (2, 2, 0, 2), (0, 2, 1, 1), (1, 1, 1, 2), (0, 1, 1, 1), (0, 1, 2, 0)]


def test_doubt_is_mirrored(spark):
    rows = [(1, i, a, r, 1, 0) for i, (a, r) in enumerate([(1, 0), (0, 0), (1, 0), (1, 1), (0, 0), (1, 0)])]
    flipped = [(s, q, 1 - a, r, 1 - st, b) for s, q, a, r, st, b in rows]
    value = lambda x: [r[0] for r in history.counterfactual_doubt(_trials(spark, x)).orderBy("seq").select("doubt_value").collect()]
    assert value(rows) == [-v for v in value(flipped)]


def test_no_choice_first_and_single_row_block(spark):
    t = _trials(spark, [(1, 0, None, 0, 1, 0), (1, 1, 0, 1, 1, 1), (1, 2, 1, 1, 1, 2)])
    got = {r["block_run"]: (r["trials_to_correct"], r["n_valid"]) for r in summaries.blocks(t).collect()}
    assert got == {1: (None, 0), 2: (None, 1), 3: (0, 1)}


def test_windows_that_touch_are_merged(spark):
    w = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 8, 9), (2, 1, 3)], "session int, start int, stop int")
    got = sorted(tuple(r) for r in align.merge_windows(w).collect())
    assert got == [(1, 1, 0, 7, 2), (1, 2, 8, 9, 1), (2, 1, 1, 3, 1)]


def test_timebase_extrapolates_both_sides(spark):
    anchors = spark.createDataFrame([(1, 10, 100.0), (1, 20, 120.0), (1, 30, 200.0), (2, 5, 7.0)], "session int, x int, y double")
    points = spark.createDataFrame([(1, 1, 5), (1, 2, 15), (1, 3, 20), (1, 4, 40), (2, 5, 9)], "session int, seq bigint, t int")
    got = {r["seq"]: r["mapped"] for r in align.timebase_map(points, anchors).collect()}
    assert got == {1: 90.0, 2: 110.0, 3: 120.0, 4: 280.0, 5: 7.0}


def test_bh_is_monotone(spark):
    rows = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "f string, i int, p double")
    got = {r["i"]: round(r["q"], 6) for r in align.adjust_bh(rows, "f", "p", "i").collect()}
    assert got == {0: 0.04, 1: 0.053333, 2: 0.053333, 3: 0.5}


def test_empty_tables(spark):
    t = _trials(spark, [(1, 0, 1, 1, 1, 0)]).where("false")
    assert summaries.blocks(t).count() == 0 and history.reward_counters(t).count() == 0 and history.incorrect_runs(t).count() == 0


def test_decayed_sums_over_many_chunks(spark):
    rows = [(1, i, i % 3 % 2, (i * 7) % 5 % 2, 1, 0) for i in range(1000)]
    got = [r[0] for r in replays.forgetting_q(_trials(spark, rows), 0.5).orderBy("seq").select("fq_value").collect()]
    want, q = [], 0.0
    for _, _, a, r, _, _ in rows:
        want.append(q)
        q = 0.5 * q + 0.5 * r * (2 * a - 1)
    assert max(abs(g - w) for g, w in zip(got, want, strict=True)) < 1e-12


def test_fold_carries_its_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        t = _trials(spark, [(s, i, 1, 1, 1, 0) for s in (1, 2) for i in range(20)])
        got = replays.ordered_fold(t, "x", 0.0, lambda x, a, r: x + r).orderBy("session", "seq").select("x").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[0] for r in got] == [float(i) for _ in (1, 2) for i in range(20)]


def test_trials_without_outcome_and_with_two(spark):
    names = "correct_choice_left_patch trial_start trial_start wrong_choice_right_patch invalid_switch enter_left_patch trial_start".split()
    log = spark.createDataFrame([(1, i, i, n, "reward_True") for i, n in enumerate(names)], "session int, t int, seq int, event string, note string")
    got = assembly.decode_outcomes(assembly.assemble_trials(log)).orderBy("trial").select("trial", "outcome", "n_outcomes", "action", "correct").collect()
    assert [tuple(r) for r in got] == [(1, "unknown", 0, None, None), (2, "wrong_choice_right_patch", 2, 0, 0)]


def test_welch_finds_a_tone(spark):
    s = spark.createDataFrame([("a", i, math.sin(2 * math.pi * i / 8)) for i in range(256)] + [("short", i, 1.0) for i in range(5)], "series string, i int, v double")
    out = {(r["series"], r["f"]): r["density"] for r in assembly.welch(s, 1.0, 32).collect()}
    assert max(out, key=out.get) == ("a", 4) and not [k for k in out if k[0] == "short"]


def test_every_index_after_the_first_correct_choice(spark):
    got = summaries.post_first_correct(_trials(spark, [(1, i, 1, 1, 1, 0) for i in range(15)])).where("state IS NULL").collect()
    assert sorted(r["ix"] for r in got) == list(range(15))


def test_every_count_of_omissions_has_its_row(spark):
    got = summaries.switches_by_omissions(_trials(spark, [(1, i, 1, 0, 1, 0) for i in range(15)])).where("session IS NULL").collect()
    assert {r["omissions"]: r["n"] for r in got} == {k: 1 for k in range(1, 15)}


def test_blocks_take_the_first_correct_choice_in(spark):
    t = _trials(spark, [(1, 0, 0, 0, 1, 0), (1, 1, None, 0, 1, 0), (1, 2, 1, 1, 1, 0), (1, 3, 1, 1, 1, 1)])
    got = {r["block_run"]: (r["accuracy_from_first"], r["accuracy_after"], r["prev_n_valid"], r["prev_n_trials"]) for r in summaries.blocks(t).collect()}
    assert got == {1: (1.0, None, None, None), 2: (1.0, None, 2, 3)}
