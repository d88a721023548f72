"""Sketches against exact results, merged in any way, replaced part by part."""

import random

import pytest
from pyspark.sql import functions as F

from contourlake.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(rng.choice("abc"), rng.gauss(5, 2) if k % 50 else None, f"s{int(rng.random() ** 3 * 4000)}") for k in range(60_000)]
    return spark.createDataFrame(data, "part string, dur double, speaker string").repartition(6)


def within(rows, got):
    live = rows.where("dur is not null")
    n = live.count()
    for q in (5, 50, 95):
        value = got[f"approx_dur_{q}"]
        below = live.where(F.col("dur") < value).count() / n
        assert abs(below - q / 100) <= sketches.RANK_ERROR
    exact = rows.select("speaker").distinct().count()
    assert abs(got["approx_speaker"] / exact - 1) <= sketches.COUNT_ERROR and got["n"] == rows.count()


def test_bounds_and_merging(spark, rows, tmp_path):
    quantiles = (0.05, 0.5, 0.95)
    parts = sketches.sketched(rows, ["dur"], ["speaker"], ["part"])
    sketches.store(parts, f"{tmp_path}/s", "part")
    stored = spark.read.parquet(f"{tmp_path}/s")
    within(rows, sketches.approximate(sketches.merged(stored), quantiles).first())
    for r in sketches.approximate(stored, quantiles).collect():
        within(rows.where(F.col("part") == r["part"]), r)
    one = sketches.approximate(sketches.sketched(rows, ["dur"], ["speaker"]), quantiles).first()
    within(rows, one)
    less = rows.where("part = 'a' and dur > 5")
    sketches.store(sketches.sketched(less, ["dur"], ["speaker"], ["part"]), f"{tmp_path}/s", "part")
    again = spark.read.parquet(f"{tmp_path}/s")
    assert again.count() == 3
    within(rows.where("part <> 'a'").unionByName(less), sketches.approximate(sketches.merged(again), quantiles).first())


def test_no_rows(spark, rows):
    got = sketches.approximate(sketches.sketched(rows.limit(0), ["dur"], ["speaker"])).first()
    assert got["n"] == 0 and got["approx_speaker"] == 0
