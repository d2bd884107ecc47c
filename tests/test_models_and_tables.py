"""Models against numpy, tables in and out, and streams with late rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import decisions, features, linear, timeline
from weftline.sources import tables
from weftline.streaming import live


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = np.column_stack([x @ [1.0, -2.0, 0.5, 0.0] + 0.3 + 0.1 * rng.normal(size=200), rng.normal(size=200)])
    m = np.column_stack([x, y])
    rows = spark.createDataFrame([(i, i % 5, r.tolist()) for i, r in enumerate(m)], "id int, fold int, v array<double>").repartition(7)
    return m, rows.unionByName(spark.createDataFrame([(900, 0, None), (901, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, 1, [float("nan")] * 6)], "id int, fold int, v array<double>"))


def test_ridge_and_folds_match_numpy(spark, data):
    m, rows = data
    x, y = m[:, :4], m[:, 4:]
    got = {(r["response"], r["term"]): r["coefficient"] for r in linear.ridge(rows, "v", [0, 1, 2, 3], [4, 5]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert all(abs(got[4 + j, i - 1] - want[i, j]) < 1e-9 for j in (0, 1) for i in range(5))
    for r in linear.block_cv(rows, "v", "fold", [0, 1, 2, 3], [4, 5], 0.1).collect():
        out = np.arange(200) % 5 == r["fold"]
        mx, my = x[~out].mean(0), y[~out].mean(0)
        beta = np.linalg.solve((x[~out] - mx).T @ (x[~out] - mx) + 160 * 0.1 * np.eye(4), (x[~out] - mx).T @ (y[~out] - my))
        e = (y[out] - my - (x[out] - mx) @ beta)[:, r["response"] - 4]
        held = y[out][:, r["response"] - 4]
        assert r["n"] == 40 and abs(r["mse"] - (e**2).mean()) < 1e-9 and abs(r["r2"] - (1 - (e**2).sum() / ((held - held.mean()) ** 2).sum())) < 1e-9


def test_components_match_numpy(spark, data):
    m, rows = data
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(m.T)))[::-1] / 6
    got = linear.pca(rows, "v").orderBy("component").collect()
    assert np.allclose([r["ratio"] for r in got], values) and all(max(r["loadings"], key=abs) > 0 for r in got)
    q = [np.linalg.qr(s - s.mean(0))[0] for s in (m[:, :4], m[:, 4:])]
    want = np.linalg.svd(q[0].T @ q[1], compute_uv=False)
    assert np.allclose([r["correlation"] for r in linear.cca(rows, "v", [0, 1, 2, 3], [4, 5]).orderBy("component").collect()], want)
    full = linear.granger(rows, "v", 4, [3], [0, 1, 2]).first()
    assert full["sse_full"] < full["sse_restricted"] and full["granger"] > 1


def test_constant_columns_and_no_rows(spark, data):
    _, rows = data
    none = rows.where("false")
    assert linear.pca(none, "v").count() == linear.cca(none, "v", [0], [1]).count() == linear.ridge(none, "v", [0], [1]).count() == linear.block_cv(none, "v", "fold", [0], [1]).count() == 0
    flat = spark.createDataFrame([([1.0, float(i)],) for i in range(5)], "v array<double>")
    assert [(round(r["ratio"], 9), r["loadings"]) for r in linear.pca(flat, "v").collect()] == [(1.0, [0.0, 1.0])]


def test_event_log(spark, tmp_path):
    lines = ["x;1.5;y;early;", "x;2.0;y;exit_standby;", "x;2.0;y;same_time;", "x;3.0;y;trial_start;a note", "x;4;y;too;many;fields", "x;3.0;y;LED_on;"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    got = [tuple(r) for r in tables.read_event_log(spark, str(tmp_path / "a.txt")).orderBy("seq").select("t", "event", "note").collect()]
    assert got == [(3.0, "trial_start", "a note"), (3.0, "LED_on", None)]
    (tmp_path / "b.txt").write_text("x;1.0;y;trial_start;")
    with pytest.raises(Exception, match="no exit_standby"):
        tables.read_event_log(spark, str(tmp_path / "b.txt")).collect()


def test_tables_in_and_out(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,None,x\nNone,2.5,None\nbad,3,z\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), "a int, b double, c string")
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, None, "x"), (None, 2.5, None), (None, 3.0, "z")], key=str)
    tables.write_results(df, str(tmp_path / "out"), mouse="m1", date="2024-01-02")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3 and {"mouse", "date"} <= set(back.columns) and tables.differing_rows(df, back).count() == 0
    assert {r["side"] for r in tables.differing_rows(df, back.withColumn("b", F.lit(0.0))).collect()} == {"old", "new"}
    with pytest.raises(ValueError, match="no rows"):
        tables.write_results(df.where("false"), str(tmp_path / "none"), mouse="m1")
    assert not os.path.exists(tmp_path / "none")


def test_selections(spark):
    units = spark.createDataFrame([(1, 3, " Good"), (2, 3, None), (3, 3, "noise"), (4, 9, "good"), (5, 3, "NaN")], "u int, ch int, q string")
    assert sorted((r["u"], r["quality_label"]) for r in tables.select_units(units, "ch", [3], "q").collect()) == [(1, "good"), (2, "mua"), (5, "mua")]
    channels = spark.createDataFrame([(1, "True", "Good"), (2, "0", "good"), (3, "yes", "bad")], "ch int, inside string, label string")
    assert [r["ch"] for r in tables.select_channels(channels, "inside", "label", ("good",)).collect()] == [1]
    with pytest.raises(Exception, match="not a boolean"):
        tables.select_channels(channels.withColumn("inside", F.lit("perhaps")), "inside", "label", ("good",)).collect()
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-05",)], "d string")
    assert tables.select_dates(days, "d", "2024-01-01", "2024-01-31", ["2024-01-05"]).count() == 1
    with pytest.raises(ValueError, match="reversed"):
        tables.select_dates(days, "d", "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError, match="no row"):
        tables.select_dates(days, "d", "2025-01-01")


def test_folds_and_cleaning(spark):
    rows = spark.createDataFrame([(1, b) for b, n in enumerate([9, 5, 5, 4, 3, 2]) for _ in range(n)] + [(2, 0), (1, None)], "s int, b int")
    got = {(r["s"], r["b"]): r["fold"] for r in timeline.grouped_folds(rows, "s", "b").collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 4): 4, (1, 5): 4, (2, 0): None}
    text = spark.createDataFrame([("1", "None"), ("x", "2"), ("3", "4")], "a string, b string")
    assert features.clean_rows(text, {"a": "int", "b": "double"}).collect() == [(3, 4.0)] and features.clean_rows(text, {"a": "int", "b": "double"}, "all").count() == 3


def test_late_rows_are_counted_and_dropped(spark, tmp_path):
    schema = "session int, t long, seq long, reward int"
    for i, rows in enumerate([[(1, 10, 1, 1), (1, 5, 0, 0)], [(1, 7, 9, 1), (1, 20, 2, 0), (2, 1, 3, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            f.rename(tmp_path / f"{i}.parquet")
            os.utime(tmp_path / f"{i}.parquet", (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
    got = {r["seq"]: (r["consecutive_rewards"], r["consecutive_omissions"], r["value"], r["n_late"]) for r in live.run_to_end(live.live_counters(stream)).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 1, -1, 0), 2: (1, 0, 0, 1), 3: (0, 0, 0, 0)}


def test_explore_runs_of_five_and_six(spark):
    sides = [1] + [0] * 5 + [1] + [0] * 6 + [1]
    rows = [(1, 0, i, a, int(a == 1), 1, 0, int(a == 1), True) for i, a in enumerate(sides)]
    t = spark.createDataFrame(rows, "session int, t int, seq long, action int, reward int, state int, block int, correct int, valid boolean")
    got = {r["run"]: (r["n"], r["explore"]) for r in decisions.explore_runs(t).collect()}
    assert got == {1: (1, False), 2: (5, True), 3: (1, False), 4: (6, False), 5: (1, False)}
    assert decisions.explore_counts(decisions.explore_runs(t)).select("n_runs", "n_trials").first() == (1, 5)
