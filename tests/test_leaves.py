"""Audio leaves, the probe and what is built on them, with a backend whose models are schedules."""

import io
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.functions import text as X
from contourlake.leaves import backend
from contourlake.operators import probe, signal
from contourlake.plans import pipelines

RATE = 16_000


def tone_wav(semitones, width=2, channels=1, rate=RATE, each=0.2):
    """A voiced clip with a step of pitch per entry."""
    t = np.arange(int(rate * each)) / rate
    x = np.concatenate([sum(np.sin(2 * np.pi * h * 140 * 2 ** (st / 12) * t) / h for h in range(1, 6)) for st in semitones])
    x = np.repeat(backend.peak_normalised(x, 0.6)[:, None], channels, axis=1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        scaled = np.round(x * ((1 << (8 * width - 1)) - 1)).astype(np.int64)
        if width == 1:
            w.writeframes((scaled + 128).astype(np.uint8).tobytes())
        elif width == 3:
            w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in scaled.ravel()))
        else:
            w.writeframes(scaled.astype(f"<i{width}").tobytes())
    return out.getvalue()


def schedule_backend():
    """Hears ba ba ba ba: each character a fortieth of a second after the other, and its latents say the tone of each fifth of a second."""

    class Schedule(backend.Backend):
        name = "schedule"
        vocabulary = ("_", "a", "b", "|")

        def emissions(self, x):
            out = np.full((len(x) // 320, 4), -6.0)
            out[:, 0] = 6
            for k in range(4):
                for at, s in ((0.02, 2), (0.08, 1), (0.18, 3)):
                    f = int((0.2 * k + at) / 0.02)
                    out[f : f + (5 if s == 1 else 1)] = -6
                    out[f : f + (5 if s == 1 else 1), s] = 6
            return out

        def latents(self, x):
            rng = np.random.default_rng(0)
            out = rng.normal(0, 0.3, (len(x) // 320, 6)).astype(np.float32)
            for k, t in enumerate("HMLH"):
                out[10 * k : 10 * k + 10, probe.CLASSES.index(t)] += 2
            return out

        def voice(self, x):
            return np.array([1.0, 0.5])

    return Schedule


def clips_of(spark, rows):
    return spark.createDataFrame(rows, "clip_id string, kind string, text string, content binary")


@pytest.mark.parametrize("width,channels", [(1, 1), (2, 2), (3, 1), (4, 1)])
def test_sample_widths(width, channels):
    x, rate = backend.read_wav(tone_wav([0, 5], width, channels))
    want, _ = backend.read_wav(tone_wav([0, 5]))
    assert rate == RATE and x.ndim == 1 and np.abs(x - want).max() < (0.02 if width == 1 else 1e-3) and 0.5 < np.abs(x).max() <= 0.61


def test_pitch_of_many_frames_at_once():
    x, rate = backend.read_wav(tone_wav([0, 4, -4]))
    times, f0, sure = backend.pitch(x, rate)
    for k, st in enumerate((0, 4, -4)):
        inside = (times > 0.2 * k + 0.03) & (times < 0.2 * k + 0.15)
        assert np.allclose(f0[inside], 140 * 2 ** (st / 12), rtol=0.01) and (sure[inside] > 0.9).all()
    assert np.isnan(backend.pitch(np.zeros(8000), rate)[1]).all() and len(backend.pitch(np.zeros(10), rate)[0]) == 0
    noise = np.random.default_rng(1).normal(0, 0.3, 16000)
    assert np.isnan(backend.pitch(noise, rate)[1]).mean() > 0.8


def test_align_text():
    assert X.align_text("Bá n\u0304 ọ̀ṣun, kẹ́") == ("ba n ọṣun, kẹ", [1, 3, 5, 7, 12], "HMLMH")
    assert X.align_text("b\u00e1") == X.align_text("ba\u0301") and X.align_text("") == ("", [], "")


def test_units_without_their_character_abstain_alone():
    hears = schedule_backend()()
    logits = hears.emissions(np.zeros(int(0.8 * RATE)))
    found = backend.unit_windows(hears, "bá bẹ bà bá", logits, 0.8)
    assert found[1] is None and [w is not None for w in found] == [True, False, True, True]
    assert backend.unit_windows(hears, "bá bẹ bà bá", logits, 0.8, whole=True) is None and backend.unit_windows(hears, "zz", logits, 0.8) is None


def test_precompute(spark):
    good = tone_wav([4, 0, -4, 4])
    rows = [("one", "a", "bá ba bà bá", good), ("none", "a", None, good), ("bad", "b", "bá", b"nothing"), ("still", "b", "bá ba", tone_wav([0], each=0.01)[:44])]
    pre = {r["clip_id"]: r for r in backend.precompute(clips_of(spark, rows), schedule_backend()).collect()}
    one = pre["one"]
    assert (one["status"], one["method"], one["backend"], one["hyp"], one["voice"]) == ("ok", "forced-align", "schedule", "ba ba ba ba", [1.0, 0.5])
    assert one["targets"] == list("HMLH") and all(0.2 * k <= lo < hi <= 0.2 * (k + 1) for k, (lo, hi) in enumerate(zip(one["t0"], one["t1"], strict=True)))
    assert pre["bad"]["status"].startswith("unreadable") and pre["bad"]["t0"] == [None] and pre["none"]["targets"] == []
    plain = backend.precompute(clips_of(spark, rows[:1]), backend.Backend)
    r = plain.first()
    assert r["method"] == "proportional" and r["latents"] is None and r["hyp"] is None and len(r["t0"]) == 4
    assert [x["pred"] for x in signal.score_tone(backend.frames_of(plain), backend.windows_of(plain), mid_ref=12 * math.log2(1.4)).orderBy("tbu_idx").collect()] == list("HMLH")
    assert backend.precompute(clips_of(spark, []), backend.Backend).count() == 0


def segments(spark, n, seed):
    rng, rows = np.random.default_rng(seed), []
    for k in range(n):
        tone = "LMH"[k % 3]
        x = rng.normal(0, 0.3, (int(rng.integers(4, 12)), 6))
        x[:, probe.CLASSES.index(tone)] += 2
        rows.append((f"c{k}", 0, tone, x.tolist()))
    return spark.createDataFrame([*rows, ("none", 0, "H", None)], "clip_id string, tbu_idx int, target string, segment array<array<float>>")


def test_probe(spark, tmp_path):
    trained, tried = probe.train(segments(spark, 240, 1), segments(spark, 60, 2), penalties=(0.01, 10.0), meta={"layer": "9"})
    assert max(f for _, f in tried) >= 0.95 and len(tried) == 2
    dev = segments(spark, 60, 3)
    out = probe.predicted(dev, trained).collect()
    assert sum(r["pred"] == r["target"] for r in out) >= 57 and {r["pred"] for r in out if r["clip_id"] == "none"} == {None}
    probe.save(spark, trained, str(tmp_path / "p"))
    again = probe.load(spark, str(tmp_path / "p"))
    assert again.meta == {"layer": "9"} and np.array_equal(again.weight, trained.weight) and again.predict([np.ones((3, 6))]) == trained.predict([np.ones((3, 6))])
    clips = clips_of(spark, [("one", "a", "bá ba bà bá", tone_wav([4, 0, -4, 4])), ("other", "a", "xyz", tone_wav([0]))])
    scores = {r["clip_id"]: r for r in probe.probe_score(backend.precompute(clips, schedule_backend()), trained).collect()}
    assert (scores["one"]["method"], scores["one"]["accuracy"], scores["one"]["coverage"]) == ("probe", 1.0, 1.0)
    assert (scores["other"]["method"], scores["other"]["accuracy"], scores["other"]["coverage"]) == ("probe-abstain", None, 0.0)


def test_lstm_steps_one_segment_at_a_time():
    rng = np.random.default_rng(4)
    lstm = {"input": rng.normal(size=(12, 5)), "hidden": rng.normal(size=(12, 3)), "bias": rng.normal(size=12)}
    p = probe.Probe(rng.normal(size=(3, 3)), rng.normal(size=3), lstm)
    many = [rng.normal(size=(n, 5)) for n in (2, 7, 4)]

    def plain(x):
        h, c, total = np.zeros(3), np.zeros(3), np.zeros(3)
        for row in x:
            z = lstm["input"] @ row + lstm["hidden"] @ h + lstm["bias"]
            i, f, o = (1 / (1 + np.exp(-z[k : k + 3])) for k in (0, 3, 9))
            c = f * c + i * np.tanh(z[6:9])
            h = o * np.tanh(c)
            total += h
        return total / len(x)

    assert np.allclose(p.pooled(many), [plain(x) for x in many])
    assert p.predict(many, at_once=2) == [probe.CLASSES[int((plain(x) @ p.weight.T + p.bias).argmax())] for x in many]


def test_segments_abstain(spark):
    pre = spark.createDataFrame([("c", ["H", "M", "L", "H"], [0.1, None, 0.5, 1.0], [0.3, None, 0.52, 9.0], [float(k // 2) for k in range(200)], 2)], "clip_id string, targets array<string>, t0 array<double>, t1 array<double>, latents array<float>, latent_width int")
    got = [r["segment"] for r in probe.unit_segments(pre).orderBy("tbu_idx").collect()]
    assert [None if s is None else len(s) for s in got] == [10, None, None, 50] and got[0][0] == [5.0, 5.0]
    assert backend.segment(np.zeros((100, 8)), 0.5, 0.52) is None and len(backend.segment(np.zeros((100, 8)), 1.0, 1.4)) == 20


def test_eval_point_with_probe_and_voices(spark):
    good = tone_wav([4, 0, -4, 4])
    rows = [("one", "long", "bá ba bà bá", good), ("two", "minpair", "bá ba bà bá", good), ("three", "minpair", "bá", b""), ("four", "long", "bá", good)]
    trained, _ = probe.train(segments(spark, 240, 1), segments(spark, 60, 2), penalties=(0.01,))
    voices = spark.createDataFrame([("one", [1.0, 0.5]), ("two", [-1.0, -0.5]), ("three", [1.0, 0.0])], "clip_id string, voice array<double>")
    scored, _ = pipelines.scored_clips(clips_of(spark, rows), schedule_backend(), trained=trained, voices=voices)
    by = {r["clip_id"]: r for r in scored.collect()}
    assert by["one"]["i1"] == by["two"]["i1"] == 1.0 and by["one"]["i1_cov"] == 1.0 and (by["three"]["i1"], by["three"]["i1_cov"]) == (None, 0.0)
    assert by["one"]["ssim"] == pytest.approx(1) and by["two"]["ssim"] == pytest.approx(0) and by["three"]["ssim"] is None and by["four"]["ssim"] is None
    out = {r["subset"]: r for r in pipelines.eval_point(clips_of(spark, rows), schedule_backend(), trained, voices).collect()}
    assert out["ALL"]["ssim"] == pytest.approx(0.5) and out["ALL"]["ssim_least"] == pytest.approx(0) and out["long"]["i1"] == 1.0
    bare = pipelines.eval_point(clips_of(spark, rows), schedule_backend()).where("subset = 'ALL'").first()
    assert bare["i1"] is None and bare["ssim"] is None


def test_eval_point(spark):
    good = tone_wav([4, 0, -4, 4])
    rows = [("one", "long", "bá ba bà bá", good), ("two", "minpair", "bá ba bà bá", good), ("three", "minpair", "bá", b"")]
    out = {r["subset"]: r for r in pipelines.eval_point(clips_of(spark, rows), schedule_backend()).collect()}
    assert out.keys() == {"ALL", "long", "minpair"} and out["ALL"]["n"] == 8 and out["long"]["cer"] == 0.0 and out["minpair"]["len_ratio"] > 0
    random.seed(0)
    scored, units = pipelines.scored_clips(clips_of(spark, rows), schedule_backend(), mids=spark.createDataFrame([("one", 12 * math.log2(1.4))], "clip_id string, mid double"))
    by = {r["clip_id"]: r for r in scored.collect()}
    assert by["one"]["accuracy"] == 1.0 and by["two"]["accuracy"] is None and by["three"]["status"] != "ok"
    assert units.where(F.col("clip_id") == "two").where("pred IS NOT NULL").count() == 0


@pytest.mark.parametrize("rate", (48_000, 44_100, 8_000))
def test_resampling_is_band_limited(rate):
    """A tone below half of the lower rate stays as it is; one above it is gone."""
    t, to = np.arange(rate) / rate, 16_000
    for hz in (300.0, 3_000.0, 0.4 * min(rate, to)):
        y = backend.resampled(np.sin(2 * np.pi * hz * t), rate, to)[400:-400]
        want = np.sin(2 * np.pi * hz * (np.arange(to) / to))[400:-400]
        assert len(y) == to - 800 and np.abs(y - want).max() < 0.01
    if rate > to:
        for hz in (9_500.0, 12_000.0):
            assert np.abs(backend.resampled(np.sin(2 * np.pi * hz * t), rate, to)[400:-400]).max() < 0.01
    assert np.allclose(backend.resampled(np.full(999, 0.25), rate, to), 0.25) and len(backend.resampled(np.empty(0), rate, to)) == 0


def test_peak_goes_through_precompute(spark):
    class Loud(backend.Backend):
        def voice(self, x):
            return np.array([np.abs(x).max()])

    clips = clips_of(spark, [("c", "a", "bá", tone_wav([0]))])
    assert backend.precompute(clips, Loud).first()["voice"][0] == pytest.approx(0.6, abs=1e-3)
    assert backend.precompute(clips, Loud, peak=0.95).first()["voice"][0] == pytest.approx(0.95, abs=1e-3)


def test_precompute_holds_one_clip_at_a_time(spark, tmp_path):
    """500 clips of a minute, 60 s at 1 kHz, whose latents are 4 MB each: 2 GB in all, but a worker stays small."""

    class Wide(backend.Backend):
        rate = 1000

        def pitch(self, x, rate, lo, hi):
            return np.arange(600) / 10, np.where(np.arange(600) % 3, 120.0, np.nan), np.ones(600)

        def latents(self, x):
            return np.zeros((3000, 350), np.float32)

        def voice(self, x):
            import resource

            return np.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024])

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes(np.ones(60_000, "<i2").tobytes())
    clip = out.getvalue()
    clips = spark.range(500).select(F.col("id").cast("string").alias("clip_id"), F.lit("bá").alias("text"), F.lit(clip).alias("content")).coalesce(1)
    pre = backend.precompute(clips, Wide).select(F.size("latents").alias("n"), "latent_width", F.col("voice")[0].alias("mb"))
    r = pre.agg(F.count("*").alias("n"), F.sum("n").alias("values"), F.min("mb").alias("least"), F.max("mb").alias("most")).first()
    assert (r["n"], r["values"]) == (500, 500 * 3000 * 350) and r["most"] - r["least"] < 300
