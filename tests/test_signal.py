import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.leaves import backend
from contourlake.operators import signal

STEPS = {"H": 3.0, "M": 0.0, "L": -3.0}
FRAMES, WINDOWS = "clip_id long, t double, f0 double", "clip_id long, tbu_idx int, target string, t0 double, t1 double"


def clip(spark, tones, slope=0.0, unvoiced=(), loose=(), step=STEPS, heard=None):
    """A clip of 0.2 s a unit and 10 ms a frame with the pitch its tones ask for."""
    frames, windows = [], []
    for i, tone in enumerate(tones):
        t0 = round(0.2 * i, 3)
        for k in range(20):
            t = round(t0 + 0.01 * k, 3)
            st = step[(heard or tones)[i]] + slope * t
            frames.append((1, t, None if i in unvoiced else 100 * 2 ** (st / 12)))
        windows.append((1, i, tone, *((None, None) if i in loose else (t0, round(t0 + 0.2, 3)))))
    return spark.createDataFrame(frames, FRAMES), spark.createDataFrame(windows, WINDOWS)


def score(frames, windows, **how):
    rows = signal.score_tone(frames, windows, **how)
    return signal.clip_scores(rows).first(), [r["pred"] for r in rows.orderBy("tbu_idx").collect()], rows


def test_clean_and_downdrift(spark):
    s, pred, _ = score(*clip(spark, "HMLHML"))
    assert s["accuracy"] == 1 and s["coverage"] == 1 and pred == list("HMLHML")
    s, _, rows = score(*clip(spark, "HMLHML", slope=-1.5))
    assert s["accuracy"] >= 0.83 and rows.first()["slope"] < -0.5
    s, _, rows = score(*clip(spark, "HMLHML", slope=-1.5), mode="fw")
    assert s["accuracy"] == 1 and rows.first()["slope"] == pytest.approx(-1.5, abs=0.01)


def test_flat_pitch_is_mid_and_gaps_abstain(spark):
    _, pred, _ = score(*clip(spark, "HMLHML", heard="MMMMMM"))
    assert set(pred) == {"M"}
    s, pred, _ = score(*clip(spark, "HMLHML", unvoiced=(2,), loose=(4,)))
    assert s["coverage"] == pytest.approx(4 / 6) and pred[2] is None and pred[4] is None


def test_theil_sen(spark):
    line = lambda b: spark.createDataFrame([(1, i, "M", 1 + b * x, float(x)) for i, x in enumerate(range(6))], "clip_id long, tbu_idx int, target string, st double, t_mid double")
    assert signal.theil_sen(line(-1.3)).first()["slope"] == pytest.approx(-1.3)
    assert signal.theil_sen(line(5.0)).first()["slope"] == 0
    assert signal.theil_sen(line(-1.3).limit(2)).first()["slope"] == 0


def test_transitions(spark):
    def steps(tones, **how):
        frames, windows = clip(spark, tones, **how)
        u = signal.unit_semitones(frames, windows)
        return signal.transitions(signal.residuals(u, signal.theil_sen(u))).collect()

    got = steps("HMLHML", loose=(2,))
    assert len(got) == 5 and sum(r["pred"] is not None for r in got) == 3
    assert all(r["pred"] == r["target"] for r in got if r["pred"])
    assert sum(r["pred"] == r["target"] for r in steps("HHMMLL", heard="MMMMMM")) == 3


def test_rhyme(spark):
    frames = spark.createDataFrame([(1, round(0.01 * k, 2), 120.0 if 10 <= k <= 27 else None) for k in range(40)], FRAMES)
    windows = spark.createDataFrame([(1, 0, "H", 0.14, 0.16)], WINDOWS)
    r = signal.voiced_rhyme(frames, windows).first()
    assert (r["r0"], r["r1"]) == (0.10, 0.27)
    edged = spark.createDataFrame([(1, 0, "H", 0.10, 0.12), (1, 1, "L", 0.14, 0.16), (1, 2, "H", 0.24, 0.26)], WINDOWS)
    got = {x["tbu_idx"]: (x["r0"], x["r1"]) for x in signal.voiced_rhyme(frames, edged).collect()}
    assert got[1] == (0.12, 0.23)
    assert signal.voiced_rhyme(frames, windows, min_s=0.2).count() == 0


def test_edits(spark):
    frames, windows = clip(spark, "HML")
    edit = spark.createDataFrame([(1, 0.2, 0.4, 6.0)], "clip_id long, e0 double, e1 double, semitones double")
    _, pred, _ = score(signal.shift_window(frames, edit), windows, mid_ref=0.0)
    assert pred == ["H", "H", "L"]
    assert signal.flatten(frames).select(F.round("f0", 6)).distinct().count() == 1
    points = signal.flip_contour(spark.createDataFrame([(1, 0.0, 0.2, 3.0, 0.0)], "clip_id long, e0 double, e1 double, r double, slope double"))
    assert points.count() == 21 and points.first()["f0"] == pytest.approx(100 * 2 ** (3 / 12))
    span = lambda hi: spark.createDataFrame([(1, 0.0, hi)], "clip_id long, e0 double, e1 double")
    again = signal.set_contour(frames, span(0.2), signal.contour_points(frames, span(0.19)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, frames.collect()))
    levels = signal.levels(signal.unit_semitones(frames, windows).withColumn("res", F.col("st"))).first()
    assert levels["delta_hl"] == pytest.approx(6)


def test_audio_to_tones(spark, tmp_path):
    rate, parts = 16000, []
    for st in (4, 0, -4, 4, 0, 4):
        t = np.arange(int(rate * 0.25)) / rate
        parts.append(sum(np.sin(2 * np.pi * h * 130 * 2 ** (st / 12) * t) / h for h in range(1, 6)))
    x = backend.peak_normalised(np.concatenate(parts), 0.5)
    with wave.open(str(tmp_path / "one.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(struct.pack("<h", int(v * 32767)) for v in x))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    frames = backend.frames(backend.clips(spark, str(tmp_path))).cache()
    bad = frames.where("clip_id = 'bad'").collect()
    assert len(bad) == 1 and bad[0]["status"].startswith("unreadable") and bad[0]["t"] is None
    assert {r["status"] for r in frames.where("clip_id = 'one'").collect()} == {"ok"}
    windows = spark.createDataFrame([("one", i, t, 0.25 * i, 0.25 * (i + 1)) for i, t in enumerate("HMLHMH")], WINDOWS.replace("clip_id long", "clip_id string"))
    rows = signal.score_tone(frames, windows, mid_ref=12 * math.log2(1.3)).orderBy("tbu_idx").collect()
    assert [r["pred"] for r in rows] == list("HMLHMH")


def test_alignment():
    logits = np.full((10, 3), -5.0)
    for k, s in enumerate((0, 1, 1, 0, 0, 2, 2, 0, 1, 0)):
        logits[k, s] = 5
    assert backend.ctc_windows(logits, [1, 2, 1], 1.0) == [pytest.approx((0.1, 0.3)), pytest.approx((0.5, 0.7)), pytest.approx((0.8, 0.9))]
    assert backend.ctc_windows(logits[:2], [1, 2, 1], 1.0) == [None] * 3
    assert backend.greedy_decode(logits, ["", "a", "b"]) == "aba"
    assert backend.segment(np.zeros((50, 4)), 0.1, 0.2).shape == (5, 4) and backend.segment(np.zeros((5, 4)), None, None) is None
