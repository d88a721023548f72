"""Frames in windows and nearest frames, against plain loops, with the plans they must have."""

import random

import pytest
from pyspark.sql import functions as F

from contourlake.operators import signal

FRAMES, WINDOWS = "clip_id string, t double, f0 double", "clip_id string, tbu_idx int, target string, t0 double, t1 double"


def study(rng, clips=14):
    """Frames with gaps; windows that touch, overlap, are empty, tiny, huge or missing."""
    frames, windows = [], []
    for c in range(clips):
        n = rng.randrange(0, 60)
        voiced = rng.random() < 0.9
        for k in range(n):
            voiced = voiced if rng.random() < 0.8 else not voiced
            frames.append((f"c{c}", round(k * 0.25, 2), 100.0 + rng.randrange(80) if voiced else None))
        at = 0.0
        for i in range(rng.randrange(1, 8)):
            size = rng.choice((0.0, 0.1, 0.5, 1.0, 1.5, 3.0, 40.0))
            windows.append((f"c{c}", i, rng.choice("HML"), *((None, None) if rng.random() < 0.15 else (at, at + size))))
            at += rng.choice((0.0, 0.25, 0.5, 1.5, -0.5)) + min(size, 3.0)
    windows.append(("none", 0, "H", 0.0, 1.0))
    return frames, windows


def plain_rhyme(frames, windows, min_s):
    out = {}
    for clip in {w[0] for w in windows}:
        fs, ws = sorted((t, f) for c, t, f in frames if c == clip), sorted((w for w in windows if w[0] == clip), key=lambda w: w[1])
        island, voiced = 0, []
        for t, f in fs:
            if f is None:
                island += 1
            else:
                voiced.append((t, island))
        for k, w in enumerate(ws):
            if w[3] is None:
                continue
            left = next((x[4] for x in reversed(ws[:k]) if x[4] is not None), None)
            right = next((x[3] for x in ws[k + 1 :] if x[3] is not None), None)
            near = [(t, i) for t, i in voiced if (left is None or t >= left) and (right is None or t < right)]
            if near:
                c = (w[3] + w[4]) / 2
                seed = min(near, key=lambda x: (not w[3] <= x[0] < w[4], abs(x[0] - c), x[0]))[1]
                times = [t for t, i in near if i == seed]
                if max(times) - min(times) >= min_s - 1e-9:
                    out[clip, w[1]] = (min(times), max(times))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rhymes(spark, seed):
    frames, windows = study(random.Random(seed), 25)
    f, w = spark.createDataFrame(frames, FRAMES).repartition(3), spark.createDataFrame(windows, WINDOWS).repartition(2)
    for min_s in (0.0, 0.5):
        got = {(r["clip_id"], r["tbu_idx"]): (r["r0"], r["r1"]) for r in signal.voiced_rhyme(f, w, min_s).collect()}
        assert got == plain_rhyme(frames, windows, min_s)


@pytest.mark.parametrize("seed", range(3))
def test_inside(spark, seed):
    frames, windows = study(random.Random(seed))
    f, w = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(windows, WINDOWS)
    got = sorted((r["clip_id"], r["t"], r["tbu_idx"]) for r in signal.inside(f, w.drop("target"), "clip_id", "t", "t0", "t1").collect())
    assert got == sorted((c, t, i) for c, t, _ in frames for d, i, _, a, b in windows if c == d and a is not None and a <= t < b)
    assert signal.inside(f, w.limit(0), "clip_id", "t", "t0", "t1").count() == 0


def test_a_long_clip_is_cut(spark):
    """An hour of frames and its units: the join reads a few windows a frame, in many groups."""
    n = 36_000
    frames = spark.range(n).select(F.lit("c").alias("clip_id"), (F.col("id") * 0.1).alias("t"), (100 + F.col("id") % 7).cast("double").alias("f0"))
    units = spark.range(3600).select(F.lit("c").alias("clip_id"), F.col("id").cast("int").alias("tbu_idx"), F.lit("H").alias("target"), F.col("id").cast("double").alias("t0"), (F.col("id") + 1.0).alias("t1"))
    one = units.unionByName(spark.createDataFrame([("c", 4000, "L", 0.0, 3600.0)], units.schema))
    near = signal.inside(frames, one.select("clip_id", "tbu_idx", "t0", "t1"), "clip_id", "t", "t0", "t1")
    assert near.count() == 2 * n
    met = frames.withColumn("b", F.floor("t")).join(one.withColumn("b", F.explode(F.sequence(F.floor("t0"), F.floor("t1")))), ["clip_id", "b"])
    assert met.count() < 4 * n  # beside each frame: its unit, the long one, and neighbours that touch the bin
    out = signal.unit_semitones(frames, one)
    assert out.count() == 3601 and out.where("st is null").count() == 0


def test_plans(spark):
    frames, windows = study(random.Random(1))
    f, w = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(windows, WINDOWS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rhyme = signal.voiced_rhyme(f, w)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = [line for line in rhyme.splitlines() if "Join" in line]
    assert joins and not any("NestedLoop" in line or "Cartesian" in line for line in joins)
    assert all("tbu_idx" in line or "island" in line for line in joins)  # by unit or island, never by clip alone


def test_nearest_at_the_very_time(spark):
    points = spark.createDataFrame([("a", 1.0, 7), ("a", 2.0, 8), ("b", 5.0, 9)], "k string, t double, v int")
    asked = spark.createDataFrame([("a", 1.0, q, q) for q in range(4)] + [("a", 1.5, q, 10 + q) for q in range(4)] + [("c", 1.0, 0, 20), ("b", 9.0, 2, 21), ("b", 9.0, 1, 22)], "k string, at double, which int, n int")
    got = {r["n"]: r["found"] and r["found"]["v"] for r in signal.nearest(points, asked, "k", "t", "v").collect()}
    assert got == {0: None, 1: 7, 2: 7, 3: 8, 10: 7, 11: 7, 12: 8, 13: 8, 20: None, 21: None, 22: 9}
