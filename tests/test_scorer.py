"""The streaming scorer against the batch meter: shuffled arrival, bounded state, restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from contourlake.operators import signal
from contourlake.streaming import monitor, scorer

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def study(rng, clips=6):
    """Clips that begin a few seconds after each other; pitch frames every 50 ms, some unvoiced, some units without any."""
    rows = []
    for c in range(clips):
        start, slope = 4.0 * c, -rng.random()
        for i in range(rng.randrange(2, 9) * (1 + 4 * (c % 2))):
            tone, t0 = rng.choice("HML"), 0.4 * i
            rows.append((f"c{c}", T0 + timedelta(seconds=start + t0), t0, None, i, tone, t0, t0 + 0.4))
            for k in range(8):
                t = t0 + 0.05 * k
                f0 = 100 * 2 ** (({"H": 3, "M": 0, "L": -3}[tone] + slope * t + rng.gauss(0, 0.4)) / 12)
                rows.append((f"c{c}", T0 + timedelta(seconds=start + t), t, None if i == 3 or rng.random() < 0.1 else f0, None, None, None, None))
    return rows


def batch(spark, rows):
    frames = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[4] is None], "clip_id string, t double, f0 double")
    windows = spark.createDataFrame([(r[0], r[4], r[5], r[6], r[7]) for r in rows if r[4] is not None], "clip_id string, tbu_idx int, target string, t0 double, t1 double")
    return {(r["clip_id"], r["tbu_idx"]): (r["target"], r["pred"], r["res"]) for r in signal.score_tone(frames, windows).collect()}


def feed(spark, folder, rows):
    spark.createDataFrame(rows, scorer.ROWS).coalesce(1).write.mode("append").parquet(folder)


def end(spark, folder, after=120):
    feed(spark, folder, [("tick", T0 + timedelta(seconds=after), 0.0, None, None, None, None, None)])


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    scorer.state_store(spark)
    yield
    spark.conf.set(key, before)


def run(spark, tmp, **how):
    stream = spark.readStream.schema(scorer.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    monitor.run_once(scorer.scores(stream, **how), f"{tmp}/out", f"{tmp}/checkpoint")
    return spark.read.schema(scorer.SCORES).parquet(f"{tmp}/out").collect()


def check(got, want):
    final = {(r["clip_id"], r["tbu_idx"]): (r["target"], r["pred"], r["res"]) for r in got if r["final"]}
    assert len([r for r in got if r["final"]]) == len(final) and {k: v[:2] for k, v in final.items()} == {k: v[:2] for k, v in want.items()}
    assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-9)) for (_, _, a), (_, _, b) in ((final[k], want[k]) for k in want))


def test_shuffled_arrival_restart_and_bounded_state(spark, store, tmp_path):
    rng = random.Random(5)
    rows = study(rng)
    want = batch(spark, rows)
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.random() * 3))  # each comes up to three seconds late
    parts = [rows[k : k + 90] for k in range(0, len(rows), 90)]
    for p in parts[:2]:
        feed(spark, f"{tmp_path}/in", p)
    first = run(spark, tmp_path, delay="4 seconds", gap=2.0)  # stops, and is started again from its checkpoint
    for p in parts[2:]:
        feed(spark, f"{tmp_path}/in", p)
    end(spark, f"{tmp_path}/in")
    got = run(spark, tmp_path, delay="4 seconds", gap=2.0)
    assert len(first) < len(got)
    check(got, want)
    running = [r for r in got if not r["final"]]
    assert running and all(-2 <= r["slope"] <= 0 and r["n_closed"] > 0 for r in running)


def test_late_frames_do_not_count(spark, store, tmp_path):
    rows = study(random.Random(3), clips=1)
    feed(spark, f"{tmp_path}/in", rows)
    feed(spark, f"{tmp_path}/in", [("other", T0 + timedelta(seconds=60), 0.0, 100.0, None, None, None, None)])
    feed(spark, f"{tmp_path}/in", [("c0", rows[0][1], rows[0][2], 399.0, None, None, None, None)] * 50)
    end(spark, f"{tmp_path}/in", 200)
    check(run(spark, tmp_path, delay="1 seconds", gap=1.0), batch(spark, rows))


def test_frames_of_closed_units_are_dropped():
    s = scorer.Scorer(5.0, 1.0, 1.0, 1.0, 0.5)
    state = {"t": [k / 10 for k in range(100)], "f0": [100.0] * 100, "idx": [0, 1], "target": ["H", "L"], "t0": [0.0, 4.0], "t1": [4.0, 8.0], "st": [None, None], "closed": [False, False]}
    s._settle(state, 6.0)
    assert state["closed"] == [True, False] and state["st"] == [0.0, None]
    assert min(state["t"]) == 4.0 and len(state["t"]) == 60  # the open unit's, and those the watermark has not passed
    s._settle(state, 20.0)
    assert state["closed"] == [True, True] and state["t"] == []
