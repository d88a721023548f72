"""Table functions against the DataFrame operators, without Python in their plans."""

import pytest
from pyspark.sql import functions as F

from contourlake.functions import tables as sql_tables
from contourlake.functions import text as X
from contourlake.operators import conditions


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "bá bà ba"), (2, "Ọ̀rọ̀ kékeré"), (3, "xyz"), (4, ""), (5, None), (6, "ńlá HML")]
    spark.createDataFrame(rows, "id int, text string").createOrReplaceTempView("sentences")
    assert sql_tables.register_tables(spark) == ["all_conditions", "condition_rows", "tbu_rows"]
    return spark.table("sentences")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_of_a_text(spark, texts):
    got = spark.sql("SELECT id, tbu_idx, target FROM sentences, LATERAL tbu_rows(text)")
    want = texts.select("id", F.posexplode(X.tone_sequence(F.col("text"))).alias("tbu_idx", "target"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 8
    assert [tuple(r) for r in spark.sql("SELECT * FROM tbu_rows('bá ba')").collect()] == [(0, "H"), (1, "M")]
    assert "Generate posexplode" in plan(got) and "Python" not in plan(got)


def test_conditions(spark, texts):
    rows = [(c, t / 10, None if (t + c) % 4 == 0 else 100.0 + 7 * t) for c in range(4) for t in range(9)]
    frames = spark.createDataFrame([*rows, (9, 0.0, None)], "clip_id long, t double, f0 double")
    windows = spark.createDataFrame([], "clip_id long, tbu_idx int, target string, t0 double, t1 double")
    frames.groupBy("clip_id").agg(F.collect_list(F.struct("t", "f0")).alias("frames")).createOrReplaceTempView("nested")
    near = lambda df: sorted((r[0], r[1], None if r[2] is None else round(r[2], 9)) for r in df.collect())
    for name in ("original", "roundtrip", "flat", "half"):
        f, _ = conditions.applied(frames, windows, [name])
        got = spark.sql(f"SELECT concat('{name}|', clip_id) AS clip_id, t, f0 FROM nested, LATERAL condition_rows(frames, '{name}')")
        assert near(got) == near(f.select("clip_id", "t", "f0"))
        assert "Python" not in plan(got) and "Join" not in plan(got)
    every = spark.sql("SELECT concat(condition, '|', clip_id) AS clip_id, t, f0 FROM nested, LATERAL all_conditions(frames)")
    assert near(every) == near(conditions.applied(frames, windows, list(sql_tables.EDITS))[0].select("clip_id", "t", "f0"))
    assert spark.sql("SELECT * FROM nested, LATERAL condition_rows(frames, 'loud')").count() == 0
    sql_tables.register_tables(spark, {"octave": "2D * x.f0"})
    up = spark.sql("SELECT sum(f0) FROM nested, LATERAL condition_rows(frames, 'octave')").first()[0]
    assert up == pytest.approx(2 * sum(r[2] for r in rows if r[2]))
