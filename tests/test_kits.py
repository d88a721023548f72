"""Listening kits, pooled results, composite pipelines and small operators."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_signal import WINDOWS, clip

from contourlake.functions import text as X
from contourlake.operators import conditions, kits, metrics, pilot, resample, selection, signal
from contourlake.plans import pipelines
from contourlake.sources import readers


def test_ab_pairs(spark):
    frames, windows = clip(spark, "HMLHML")
    pairs = kits.ab_pairs(frames, windows, seed=3).collect()
    assert len(pairs) == 1
    p = pairs[0]
    assert p["flip_dir"] in ("H->L", "L->H") and p["realized_st"] >= kits.LEAST_SHIFT
    assert p["tone_i2_frozen_correct"] == 1.0 and p["tone_i2_frozen_flipped"] < 1.0 and p["tone_i2_deployed_correct"] == 1.0
    cands = kits.candidates(frames, windows).collect()
    assert {c["src"] for c in cands} == {"H", "L"} and all((c["r"] > c["mid"] + 1) == (c["expect"] == "H") for c in cands)
    flipped, correct = kits.twins(frames, kits.candidates(frames, windows).limit(1))
    assert flipped.select("clip_id").distinct().count() == 1 and sorted(r["f0"] for r in correct.collect() if r["f0"]) == sorted(r["f0"] for r in frames.collect() if r["f0"])
    flat, same = clip(spark, "HMLHML", heard="MMMMMM")
    assert kits.ab_pairs(flat, same).count() == 0
    caught = kits.catches(frames, windows).collect()
    assert len(caught) == 1 and caught[0]["flip_dir"].endswith("(extreme)")
    assert kits.catches(flat, same).first()["flip_dir"] == "flatten"
    key = kits.ab_key(kits.ab_pairs(frames, windows), kits.catches(frames, windows), 5).collect()
    assert sorted(r["item_id"] for r in key) == ["item01", "item02"] and sum(r["is_catch"] for r in key) == 1
    assert all(r["expect_pick"] == (r["correct_side"] if r["is_catch"] else None) for r in key)


def kit(spark):
    rng = random.Random(1)
    rows = [(f"item{k:02d}", "native" if k % 4 == 0 else "model", rng.random(), k % 10 == 9, "bad" if k % 20 == 19 else None) for k in range(60)]
    key = spark.createDataFrame(rows, "item_id string, source string, tone_i2 double, is_catch boolean, catch_expected string")
    answers = []
    for rater in ("good", "other", "lost"):
        for item, source, t, is_catch, expected in rows:
            right = (expected or "ok") if is_catch else "ok" if source == "native" or t > 0.45 + 0.1 * rng.random() else "bad"
            answers.append((rater, item, right if rater != "lost" else "unsure" if is_catch else right))
    return rows, key, answers, spark.createDataFrame(answers, "rater string, item_id string, label string")


def test_pilot_result(spark):
    rows, key, said, answers = kit(spark)
    r = pilot.pilot_result(answers, key, 0.5, n_rep=400).first()
    by = {x[0]: x for x in rows}
    items = [(by[i][2], int(label == "ok")) for rater, i, label in said if rater != "lost" and not by[i][3]]
    pos, neg = [t for t, y in items if y], [t for t, y in items if not y]
    assert (r["n_kept"], r["n_scored"]) == (2, len(items)) and r["anchor"] == 1.0
    assert r["auroc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    assert r["r"] == pytest.approx(statistics.correlation([t for t, _ in items], [float(y) for _, y in items]))
    n, m = len(items), [int(t >= 0.5) for t, _ in items]
    po, pm, py = sum(a == y for a, (_, y) in zip(m, items, strict=True)) / n, sum(m) / n, len(pos) / n
    pe = pm * py + (1 - pm) * (1 - py)
    assert r["kappa"] == pytest.approx((po - pe) / (1 - pe))
    assert all(r[f"{s}_lo"] <= r[s] <= r[f"{s}_hi"] for s in ("auroc", "r", "kappa")) and r["verdict"] == ("PASS" if r["auroc"] >= 0.7 else "INCONCLUSIVE")
    none = pilot.pilot_result(answers.where("rater = 'lost'"), key, 0.5, n_rep=10).first()
    assert none["verdict"] == "NO SCOREABLE PILOT" and none["n_scored"] == 0 and none["auroc"] is None


def test_item_bootstrap_against_plain_resampling(spark):
    rng = random.Random(2)
    items = [(float(rng.randrange(8)), rng.randrange(2)) for _ in range(60)]
    out = resample.item_bootstrap(spark.createDataFrame(items, "s double, y int"), "s", "y", 600, 1).where("rep >= 0")
    have = sorted(r["auroc"] for r in out.collect())

    def auc(x):
        pos, neg = [a for a, y in x if y], [a for a, y in x if not y]
        return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))

    want = sorted(auc(rng.choices(items, k=60)) for _ in range(600))
    for q in (30, 300, 570):
        assert abs(have[q] - want[q]) < 0.03


def test_ab_result_and_blocks(spark):
    rng = random.Random(5)
    rows = []
    for k in range(40):
        c = k % 8 == 7
        rows.append((f"i{k}", f"p{k}", "AB"[k % 2], c, "AB"[k % 2] if c else None, *(None if c else rng.random() for _ in range(4))))
    rows[0] = (*rows[0][:5], None, *rows[0][6:])
    key = spark.createDataFrame(rows, "item_id string, pair_id string, correct_side string, is_catch boolean, expect_pick string, tone_i2_frozen_correct double, tone_i2_frozen_flipped double, tone_i2_deployed_correct double, tone_i2_deployed_flipped double")
    said = [(r, x[0], (x[2] if x[3] or rng.random() < 0.8 else "B" if x[2] == "A" else "A").lower()) for r in ("r1", "r2") for x in rows] + [("bad", x[0], "unsure") for x in rows]
    answers = spark.createDataFrame(said, "rater string, item_id string, label string")
    r = pilot.ab_result(answers, key, n_rep=300).first()
    by = {x[0]: x for x in rows}
    trials = [(by[i][5] - by[i][6], int(label.upper() == by[i][2])) for rater, i, label in said if rater != "bad" and not by[i][3] and by[i][5] is not None]
    assert (r["n_scored"], r["n_correct"], r["status"]) == (len(trials), sum(y for _, y in trials), "OK")
    assert r["r"] == pytest.approx(statistics.correlation([m for m, _ in trials], [float(y) for _, y in trials])) and r["auroc_lo"] <= r["auroc"] <= r["auroc_hi"]
    blocks = {b["block"]: b for b in metrics.paired_blocks(key).collect()}
    for name, at in (("frozen", 5), ("deployed", 7)):
        live = [(x[at], x[at + 1]) for x in rows if not x[3] and x[at] is not None]
        assert (blocks[name]["usable"], blocks[name]["wins"], blocks[name]["losses"]) == (len(live), sum(a > b for a, b in live), sum(a < b for a, b in live))
    assert metrics.margins(key).count() == blocks["frozen"]["usable"]


def test_pilot_kit(spark):
    part = lambda name, n: spark.createDataFrame([(f"{name}{k}", f"text {k}", bytearray(b"RIFF"), 0.5) for k in range(n)], "clip_id string, text string, audio binary, tone_i2 double")
    items, key, page = pipelines.pilot_kit(part("n", 3), part("m", 4), part("c", 2), 1)
    assert sorted(r["item_id"] for r in items.collect()) == [f"item{k:02d}" for k in range(1, 10)]
    assert {r["item_id"] for r in readers.form_items(spark.createDataFrame([(page,)], "html string")).collect()} == {r["item_id"] for r in items.collect()}
    assert key.first()["json"].count("item") == 9 and items.where("is_catch AND catch_expected = 'bad'").count() == 2


def test_native_anchor_and_answer_key(spark):
    frames, windows = clip(spark, "HMLHML")
    units = signal.score_tone(frames, windows)
    a = pipelines.native_anchor(units, 50).first()
    assert (a["point"], a["lo"], a["hi"], a["clips"], a["n"]) == (1.0, 1.0, 1.0, 1, 6)
    k = pipelines.answer_key_oracle(units, 20, 5).first()
    assert k["right"] == 1.0 and k["swapped"] == pytest.approx(1 / 3) and k["high_low"] == 1.0 and k["delta"] == pytest.approx(2 / 3) and 0 <= k["floor"] <= 1


def test_conditions(spark):
    frames, windows = clip(spark, "HMLHML")
    conditions.register("sham", lambda f: signal.scale_excursion(f, 1.0))
    out = {r["condition"]: r for r in pipelines.condition_table(frames, windows).collect()}
    assert out.keys() == set(conditions.CONDITIONS) and out["original"]["tone_i2"] == out["sham"]["tone_i2"] == 1.0
    assert out["flat"]["tone_i2"] == pytest.approx(1 / 3) and out["flat"]["d_tone"] == pytest.approx(-2 / 3)


def test_dataset_and_budget(spark, tmp_path):
    rows = [(str(k), f"text {k}", "bible", f"s{k % 3}", 10.0 if k else 99.0, f"a/{k}.wav") for k in range(400)]
    m = spark.createDataFrame(rows, readers.MANIFEST)
    held = spark.createDataFrame([("Text  5",), ("text 6",)], "text string")
    train, dev = pipelines.dataset(m, held, 0.5, 0.1, 1.0, 20.0, 4)
    a, b = ({r["id"] for r in d.collect()} for d in (train, dev))
    assert not a & b and not (a | b) & {"0", "5", "6"} and len(b) == 36 and len(a) == 180
    r = pipelines.one_budget(m, held, 0.5, str(tmp_path / "m"), 4).first()
    assert r["clips"] == 180 and r["hours"] == pytest.approx(0.5) and r["steps"] == 50 and spark.read.json(str(tmp_path / "m")).count() == 180
    native = pipelines.select_native(m, 1.0, 20.0, 5, 12, 3).collect()
    assert len(native) == 12 and max(sum(r["speaker_id"] == s for r in native) for s in ("s0", "s1", "s2")) <= 5
    assert selection.train_and_dev(m, dev, train, "id").count() == 216


def test_frozen_centres_and_windows_that_do_not_fit(spark):
    frames, windows = clip(spark, "HMLHML")
    mids = spark.createDataFrame([(1, 99.0)], "clip_id long, mid double")
    assert {r["pred"] for r in signal.score_tone(frames, windows, mid_ref=mids).collect()} == {"L"}
    assert {r["pred"] for r in signal.score_tone(frames, windows, mid_ref=mids.where("clip_id = 2")).collect()} == {None}
    tones = spark.createDataFrame([(1, list("HMLHML")), (2, ["H"])], "clip_id long, tones array<string>")
    assert signal.fitting_windows(windows, tones).where("t0 IS NOT NULL").count() == 6
    assert signal.fitting_windows(windows, spark.createDataFrame([(1, ["H", "M"])], "clip_id long, tones array<string>")).where("t0 IS NULL").count() == 2
    t = signal.transition_scores(frames, windows).first()
    assert (t["accuracy"], t["coverage"], t["n_trans"]) == (1.0, 1.0, 5)
    v1 = signal.v1_scores(frames, windows, spark.createDataFrame([(1, "proportional")], "clip_id long, method string")).first()
    assert v1["method"] == "proportional" and v1["n_tbu"] == 6
    span = spark.createDataFrame([(1, 0.0, 0.2), (7, 0.0, 1.0)], "clip_id long, e0 double, e1 double")
    assert [r["clip_id"] for r in signal.median_in_span(frames, span).collect()] == [1]
    assert windows.schema.simpleString() == spark.createDataFrame([], WINDOWS).schema.simpleString()


def test_clone_diversity(spark):
    rows = [("a", 0.9, 0.5), ("a", 0.8, 0.5), ("b", 0.7, 0.72), ("c", 0.9, 0.4)]
    df = spark.createDataFrame(rows, "speaker_id string, to_voice double, to_other double")
    r = signal.clone_diversity(df).first()
    assert (r["n_voices"], r["n_ok"], r["intact"]) == (3, 2, True) and r["to_voice"] == pytest.approx((0.85 + 0.7 + 0.9) / 3)
    assert not signal.clone_diversity(df.where("speaker_id = 'a'")).first()["intact"] and not signal.clone_diversity(df.limit(0)).first()["intact"]


def test_small_operators(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, 2.0), ("c", 1.0, 5.0)], "k string, h double, t double")
    assert [r["k"] for r in metrics.ordered(df, ascending=["h"], descending=["t"]).collect()] == ["c", "a", "b"]
    seeds, ks = spark.range(3).toDF("seed"), spark.range(4).toDF("k")
    assert metrics.grid(seeds, ks).count() == 12
    with pytest.raises(ValueError):
        metrics.grid(seeds, ks, most=11)
    assert selection.anchored(df.select("k", "h"), spark.createDataFrame([("native", 0.58)], "k string, t double")).count() == 4
    passed = selection.first_passing(spark.createDataFrame([(1, 5, False), (1, 7, True), (1, 6, True), (2, 1, False)], "c int, o int, ok boolean"), "c", "ok", "o")
    assert [tuple(r) for r in passed.collect()] == [(1, 6, True)]
    assert [tuple(r) for r in selection.with_paths(df.select(F.col("k").alias("id")), spark.createDataFrame([("b", "/x")], "id string, path string")).collect()] == [("b", "/x")]
    text = spark.createDataFrame([("oko ati oko", "oko", "ọkọ̀"), ("none", "oko", "x"), (None, "a", "b")], "t string, a string, b string")
    assert [r[0] for r in text.select(X.first_replaced(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["ọkọ̀ ati oko", "none", None]
    words = spark.createDataFrame([(f"w{k}", f"word{k}") for k in range(5)], "id string, text string")
    carriers = spark.createDataFrame([(0, "Mo rí ___"), (1, "___ ni")], "k int, template string")
    long = spark.createDataFrame([("l1", "a long line"), ("l2", "another")], "id string, text string")
    got = [tuple(r) for r in selection.probe_lines(words, carriers, long, 1).collect()]
    assert [g[1] for g in got] == ["long"] * 2 + ["minpair"] * 5 and ("w1", "minpair", "word1 ni") in got and ("w2", "minpair", "Mo rí word2") in got
    assert selection.probe_lines(words, carriers, long.limit(0), 1).count() == 5
