import threading

import numpy as np
import pytest

from contourlake.leaves import backend, synth
from contourlake.plans import study_queries


def test_what_is_heard_once_is_not_written(spark, data):
    out = study_queries.audio_transitions(spark, data)
    assert [f.rsplit("/", 1)[1] for f in out.inputFiles()] == ["part.parquet"]
    assert {(r["target"], r["pred"]) for r in out.collect()} == {(k, k) for k in ("R", "F", "level")}


def test_arrays_that_are_used_again_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    clips = [(backend.read_wav(synth.hummed("HMLLHM"))[0], 16_000)] + [(rng.normal(size=n) * 0.1, rate) for n in (0, 888, 30_000, 1100) for rate in (16_000, 11_025, 44_100)]

    def alone(x, rate):
        out = []
        t = threading.Thread(target=lambda: out.append(backend.pitch(x, rate)))  # whose arrays are new
        t.start()
        t.join()
        return out[0]

    for x, rate in clips * 2:
        for a, b in zip(backend.pitch(x, rate), alone(x, rate), strict=True):
            np.testing.assert_array_equal(a, b)
    whole = [backend.pitch(*c) for c in clips]
    monkeypatch.setattr(backend, "FRAMES", 7)
    for c, w in zip(clips, whole, strict=True):
        for a, b in zip(backend.pitch(*c), w, strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_clips_leave_together_and_stay_themselves(spark, monkeypatch):
    tones = ["HML", "LMH", "H", "HML", "LLHHM"]
    rows = spark.createDataFrame([(str(k), None if k == 2 else "bá ba", list(t)) for k, t in enumerate(tones)], "clip_id string, text string, tones array<string>")
    made = synth.clips(rows.coalesce(1))
    assert {r["clip_id"]: bytes(r["content"]) for r in made.collect()} == {str(k): synth.hummed(t) for k, t in enumerate(tones)}
    bad = spark.createDataFrame([("x", "bá", bytearray(b"none")), ("y", None, bytearray(b"RIFF"))], "clip_id string, text string, content binary")
    got = {r["clip_id"]: r for r in backend.precompute(made.unionByName(bad).coalesce(1)).collect()}
    assert len(got) == 7 and got["x"]["times"] == [] and got["x"]["t0"] == [None] and got["y"]["targets"] == [] and got["0"]["latents"] is None
    for k, t in enumerate(tones):
        times, f0, _ = backend.pitch(*backend.read_wav(synth.hummed(t)))
        assert got[str(k)]["times"] == times.tolist() and got[str(k)]["f0"] == [None if np.isnan(v) else v for v in f0]
        assert got[str(k)]["t1"] == ([] if k == 2 else pytest.approx(np.linspace(*times[np.flatnonzero(~np.isnan(f0))[[0, -1]]], 3)[1:].tolist()))
