"""Training of the recurrent probe: gradients, a rule of order alone, layouts, going on after a stop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.operators import metrics, probe, recurrent

SCHEMA = "clip_id string, tbu_idx int, target string, segment array<array<float>>"


def ordered_segments(rng, n):
    """Which of two marks comes first decides the class, so means over frames say nothing."""
    out = []
    for k in range(n):
        target = "HLM"[k % 3]
        size = rng.randrange(5, 9)
        frames = [[rng.gauss(0, 0.1) for _ in range(3)] for _ in range(size)]
        i, j = sorted(rng.sample(range(size), 2))
        first, second = {"H": (0, 1), "L": (1, 0), "M": (0, 1)}[target]
        frames[i][first] += 2
        frames[j][second] += 2
        if target == "M":
            frames[i], frames[j] = [[rng.gauss(0, 0.1) + (2 if c < 2 else 0) for c in range(3)] if x == 0 else [rng.gauss(0, 0.1) for _ in range(3)] for x in (0, 1)]
        out.append((f"c{k // 4}", k % 4, target, frames))
    return out


def f1_of(rows, p):
    return metrics.weighted_f1(probe.predicted(rows, p)).first()["weighted_f1"]


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(5)
    layout = recurrent.Layout(3, 4)
    v, sizes = layout.start(1), np.array([5, 2, 1, 4])
    x = rng.normal(size=(4, 5, 3))
    labels, w = np.array([0, 2, 1, 2]), np.array([0.5, 1.0, 2.0, 1.5])
    _, g = recurrent.gradient(layout, v, x, sizes, labels, w)
    for k in range(layout.size()):
        up, down = v.copy(), v.copy()
        up[k], down[k] = up[k] + 1e-6, down[k] - 1e-6
        slope = (recurrent.gradient(layout, up, x, sizes, labels, w)[0] - recurrent.gradient(layout, down, x, sizes, labels, w)[0]) / 2e-6
        assert g[k] == pytest.approx(slope, abs=1e-7, rel=1e-5)
    x[1, 2:] = 99  # frames past a segment's end count for nothing
    assert recurrent.gradient(layout, v, x, sizes, labels, w)[1].tolist() == g.tolist()


def test_loss_is_that_of_the_probe_which_predicts():
    rng = np.random.default_rng(2)
    layout = recurrent.Layout(3, 4)
    v = layout.start(3)
    segments = [rng.normal(size=(n, 3)) for n in (4, 1, 6)]
    p = layout.probe(v, {})
    logits = p.pooled(segments) @ p.weight.T + p.bias
    want = sum(np.log(np.exp(z).sum()) - z[k] for z, k in zip(logits, (2, 0, 1), strict=True))
    x = np.zeros((3, 6, 3))
    for k, s in enumerate(segments):
        x[k, : len(s)] = s
    assert recurrent.gradient(layout, v, x, np.array([4, 1, 6]), np.array([2, 0, 1]), np.ones(3))[0] == pytest.approx(want)


def test_chunks_are_padded_in_bounds(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 30, 50)
    frames = rng.normal(size=(sizes.sum(), 2))
    monkeypatch.setattr(recurrent, "FRAMES", 64)
    seen, ends = [], np.cumsum(sizes)
    for rows, x in recurrent._padded(frames, sizes, 2):
        assert x.shape[0] * x.shape[1] <= 64
        for r, s in zip(rows.tolist(), x, strict=True):
            seen.append(r)
            assert s[: sizes[r]].tolist() == frames[ends[r] - sizes[r] : ends[r]].tolist() and not s[sizes[r] :].any()
    assert sorted(seen) == list(range(50))


@pytest.fixture(scope="module")
def sets(spark):
    rng = random.Random(7)
    odd = [("x", 0, "H", None), ("x", 1, None, [[0.0, 0.0, 0.0]]), ("x", 2, "Q", [[9.0, 9.0, 9.0]]), ("x", 3, "H", [])]
    train = spark.createDataFrame(ordered_segments(rng, 360) + odd, SCHEMA).repartition(5)
    return train, spark.createDataFrame(ordered_segments(rng, 150) + odd[:1], SCHEMA)


def test_a_rule_of_order_is_learned(spark, sets, tmp_path):
    train, dev = sets
    p, f1, history = recurrent.train(train, dev, hidden=12, epochs=16, batch=90, rate=0.03, seed=3, meta={"layer": "9"})
    assert f1 > 0.95 and f1 == max(h["dev_f1"] for h in history) == f1_of(dev, p) and len(history) == 16
    assert history[-1]["loss"] < 0.4 * history[0]["loss"]
    linear, _ = probe.train(train.where("size(segment) > 0"), dev)
    assert f1_of(dev, linear) < 0.5  # the means are alike: chance
    probe.save(spark, p, f"{tmp_path}/p")
    again = probe.load(spark, f"{tmp_path}/p")
    assert again.meta == {"layer": "9"} and f1_of(dev, again) == f1


def test_partitions_do_not_matter(spark, sets, monkeypatch):
    train, dev = sets
    few = train.where("tbu_idx < 2")
    one, _, a = recurrent.train(few.coalesce(1), dev, hidden=5, epochs=2, batch=64, rate=0.01)
    monkeypatch.setattr(recurrent, "CHUNK", 8)
    monkeypatch.setattr(recurrent, "FAN", 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        many, _, b = recurrent.train(few.repartition(8), dev, hidden=5, epochs=2, batch=64, rate=0.01)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for x, y in ((one.weight, many.weight), (one.lstm["hidden"], many.lstm["hidden"]), (one.lstm["input"], many.lstm["input"])):
        assert np.abs(x - y).max() < 1e-9
    assert [h["loss"] for h in a] == pytest.approx([h["loss"] for h in b], abs=1e-9)


def test_a_stopped_run_goes_on(spark, sets, tmp_path):
    train, dev = sets
    few = train.where("tbu_idx = 0")
    whole = recurrent.train(few, dev, hidden=4, epochs=3, batch=60, rate=0.02)
    recurrent.train(few, dev, hidden=4, epochs=1, batch=60, rate=0.02, state=f"{tmp_path}/s")
    rest = recurrent.train(few, dev, hidden=4, epochs=3, batch=60, rate=0.02, state=f"{tmp_path}/s")
    assert np.abs(rest[0].weight - whole[0].weight).max() < 1e-12 and rest[1] == whole[1]
    assert [h["epoch"] for h in rest[2]] == [0, 1, 2] and [h["loss"] for h in rest[2]] == pytest.approx([h["loss"] for h in whole[2]])
    assert spark.read.parquet(f"{tmp_path}/s").count() == 3
    with pytest.raises(ValueError):
        recurrent.train(few.limit(0), dev)
