import math

import pytest

from contourlake.operators import kits, oracle, signal
from contourlake.plans import signal_queries
from contourlake.storage import Tables

FRAMES, WINDOWS = "clip_id string, t double, f0 double", "clip_id string, tbu_idx int, target string, t0 double, t1 double"


def plan(df):
    """The plan that is made before anything has run, from the sizes of files."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def test_long_windows_stay_few_rows(spark):
    """Windows of a hundred years over a frame a year; a bin a second would be 3e9 rows for each."""
    year = 3.15e7
    frames = spark.createDataFrame([("c", k * year, 100.0 + k) for k in range(300)], FRAMES)
    windows = spark.createDataFrame([("c", k, "H", 100 * k * year, 100 * (k + 1) * year) for k in range(3)] + [("d", 0, "L", 0.0, 1.0)], WINDOWS)
    near = signal.inside(frames, windows, "clip_id", "t", "t0", "t1")
    assert sorted(r["t"] for r in near.collect()) == [k * year for k in range(300)]
    got = {(r["clip_id"], r["tbu_idx"]): r["st"] for r in signal.unit_semitones(frames, windows).collect()}
    assert got[("d", 0)] is None and got[("c", 0)] < got[("c", 1)] < got[("c", 2)]


def test_widths_do_not_depend_on_the_order_of_rows(spark):
    """Bins of points and of windows are made from two sums of the same lengths, which must agree to the last bit."""
    windows = [("c", k, "H", k * 0.1, k * 0.1 + 0.1 * (1 + k % 3)) for k in range(200)]
    frames = [("c", t, 100.0) for w in windows for t in w[3:]]
    f, w = spark.createDataFrame(frames, FRAMES).repartition(4), spark.createDataFrame(windows, WINDOWS)
    want = sum(a <= t < b for _, t, _ in frames for _, _, _, a, b in windows)
    for n in (1, 3, 4):
        assert signal.inside(f, w.repartition(n), "clip_id", "t", "t0", "t1").count() == want


def test_no_table_of_the_oracle_goes_through_the_driver(spark):
    """Files of a few KB would be broadcast whatever rows come of them."""
    tables = Tables(spark, "test")
    frames = tables.put_large("frames", spark.createDataFrame([("c", 0.1 * k, 100.0 + k) for k in range(60)], FRAMES))
    windows = tables.put_large("windows", spark.createDataFrame([("c", k, "HML"[k % 3], float(k), k + 1.0) for k in range(6)], WINDOWS))
    assert "BroadcastHashJoin" in plan(windows.hint("broadcast").join(frames, "clip_id"))
    assert "Broadcast" not in plan(signal.unit_semitones(frames, windows))
    assert "Broadcast" not in plan(oracle.run(frames, windows, {"I2": oracle.absolute_meter()}, ks=(1.0,), most=2))


def test_no_table_of_the_pairs_goes_through_the_driver(spark):
    frames = spark.createDataFrame([("c", 0.05 * k, 150.0 if k // 20 % 3 == 0 else 100.0 if k // 20 % 3 == 1 else 70.0) for k in range(120)], FRAMES)
    windows = spark.createDataFrame([("c", k, "HML"[k % 3], float(k), k + 1.0) for k in range(6)], WINDOWS)
    tables = Tables(spark, "test")
    frames, windows = tables.put_large("frames", frames), tables.put_large("windows", windows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")  # over what is read of a file here, under the product of two
    try:
        pairs, obvious = kits.ab_pairs(frames, windows), kits.catches(frames, windows)
        assert "Broadcast" not in plan(pairs) and "Broadcast" not in plan(obvious)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pairs.count() == 1 and obvious.count() == 1


def test_tone_density_of_empty_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [(1, "ab \u00e1"), (2, ""), (3, None), (4, "xyz"), (5, "   ")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tbu"], r["density"]) for r in signal_queries.tone_density(spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = {d: (n, x) for d, n, x in con.execute(signal_queries.SQL["tone_density"]).fetchall()}
    assert math.isnan(got[2][1]) and math.isnan(want[2][1])
    assert {d: v for d, v in got.items() if d != 2} == {d: v for d, v in want.items() if d != 2} and got[2][0] == want[2][0] == 0
