import hashlib
from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.functions import tables as sql_tables
from contourlake.functions.text import align_text, tone_bigrams
from contourlake.leaves import backend
from contourlake.operators import kits, metrics, oracle, pilot, resample, signal
from contourlake.plans import metric_queries
from test_signal import clip

PRE = "clip_id string, targets array<string>, times array<double>, f0 array<double>, t0 array<double>, t1 array<double>"


def test_units_of_precomputed_clips_are_those_of_frames_in_windows(spark):
    rng = np.random.default_rng(5)
    times = [round(0.02 + 0.01 * k, 6) for k in range(60)]
    f0 = [None if rng.random() < 0.3 else float(rng.uniform(80, 300)) for _ in times]
    gone = [None if t < 0.33 else v for t, v in zip(times, f0, strict=True)]
    rows = [
        ("a", list("HML"), times, f0, [0.02, 0.2, 0.4], [0.2, 0.4, 0.6]),
        ("b", list("HML"), times, gone, [0.02, None, 0.3], [0.2, 0.4, 0.37]),
        ("c", list("HL"), [], [], [None, None], [None, None]),
        ("d", [], times, f0, [], []),
    ]
    pre = spark.createDataFrame(rows, PRE)
    got = backend.units_of(pre)
    want = signal.unit_semitones(backend.frames_of(pre), backend.windows_of(pre))
    key = lambda df: sorted((r["clip_id"], r["tbu_idx"], r["target"], r["st"] and pytest.approx(r["st"]), r["t_mid"]) for r in df.select("clip_id", "tbu_idx", "target", F.round("st", 9).alias("st"), "t_mid").collect())
    assert key(got) == key(want) and len(key(got)) == 8
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_pitch_of_windows_that_hops_do_not_divide():
    t = np.arange(12_000) / 11_025
    x = 0.4 * np.sin(2 * np.pi * 150 * t)
    for rate in (11_025, 16_000, 22_050):
        _, f0, sure = backend.pitch(x, rate)
        assert np.nanmedian(f0) == pytest.approx(150 * rate / 11_025, rel=0.01) and sure.min() > 0.5
    assert backend.fft_size(407) == 432 and all(n <= backend.fft_size(n) < 1.2 * n + 1 for n in range(1, 3000))


def test_lateral_tone_rows_make_no_join(spark):
    sql_tables.register_tables(spark)
    texts = spark.createDataFrame([(1, "bá ba"), (2, ""), (3, None), (4, "bá ba"), (5, "tsk"), (6, "ò")], "id int, text string")
    got = spark.sql("SELECT id, tbu_idx, target FROM {t}, LATERAL tbu_rows(text)", t=texts)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "H"), (1, 1, "M"), (4, 0, "H"), (4, 1, "M"), (6, 0, "L")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_bigrams_of_a_language_are_counted_without_a_row_for_each(spark):
    rng = np.random.default_rng(3)
    texts = [("x", "".join(rng.choice(list("áaàb "), size=n))) for n in (0, 1, 2, 3, 40, 300)] + [("x", "ááááá"), ("x", "àáàáà"), ("y", None), ("z", "tsk"), (None, "aa a"), ("y", "á"), ("x", "HM á à")]
    want = {}
    for lang, text in texts:
        tones = align_text(text or "")[2]
        for pair in map("".join, zip(tones, tones[1:], strict=False)):
            want[lang, pair] = want.get((lang, pair), 0) + 1
    got = tone_bigrams(spark.createDataFrame(texts, "lang string, text string"), "text", ["lang"])
    assert {(r["lang"], r["bigram"]): r["n"] for r in got.collect()} == want and dict(got.dtypes)["n"] == "bigint"


def test_permuted_targets_meet_in_one_row(spark):
    rng = np.random.default_rng(2)
    rows = [(c, k, str(rng.choice(list("HML"))), None if rng.random() < 0.2 else str(rng.choice(list("HML")))) for c in range(12) for k in range(int(rng.integers(1, 9)))]
    tbu = spark.createDataFrame(rows, "clip_id long, tbu_idx int, target string, pred string")
    want = set()
    for seed in (0, 3):
        for c in range(12):
            own = [r for r in rows if r[0] == c]
            order = sorted(own, key=lambda r: (int(hashlib.md5(f"{seed}|{c}|{r[1]}".encode()).hexdigest()[:8], 16), r[1]))
            want |= {(c, r[1], seed, o[2], r[3]) for r, o in zip(own, order, strict=True)}
    got = resample.permuted_targets(tbu, 0, 3)
    assert set(map(tuple, got.collect())) == want and got.count() == 2 * len(rows)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_bands_of_all_pairs_of_runs(spark):
    stats = spark.createDataFrame([("a", 1.0, 0.5), ("b", 1.6, 0.2), ("c", 9.0, 0.0), ("d", 8.0, 1.0)], "run string, mean double, std double")
    got = {(r["run_a"], r["run_b"]): r["overlap"] for r in metrics.band_overlaps(stats, "run").collect()}
    assert got == {("a", "b"): True, ("a", "c"): False, ("a", "d"): False, ("b", "c"): False, ("b", "d"): False, ("c", "d"): True}


def test_go_no_go_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    def verdict(keys):
        mean = lambda of: reduce(add, map(of, keys)) / len(keys)
        rest = mean(lambda k: k % 50 / 100) <= 0.25 and 0.5 + mean(lambda k: k % 10 / 15) >= 0.8 and mean(lambda k: k % 9 / 9) >= 0.4 and mean(lambda k: k % 6) <= 2.5 and 0.4 + mean(lambda k: k % 8 / 10) >= 0.7
        climb = mean(lambda k: k % 13 / 16) >= 1 / 3 + 0.04
        return "GO" if rest and climb else "MIXED" if climb else "NO-GO-FLAT"

    rng, rows = np.random.default_rng(1), []
    while len(rows) < 40:
        keys = sorted(map(int, rng.choice(100_000, 10, replace=False)))
        if verdict(keys) != verdict(keys[::-1]):
            rows += [(k, len(rows) // 10) for k in keys[::-1]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    want = {c: verdict(sorted(k for k, o in rows if o == c)) for c in range(4)}
    assert dict(map(tuple, metric_queries.go_no_go(spark, str(tmp_path)).collect())) == want


def test_plans_of_the_oracle_and_the_pairs_stay_small(spark):
    frames, windows = clip(spark, "HMLHML")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    rows = oracle.run(frames, windows, {"I2": oracle.absolute_meter()}, ks=(1.0,), most=2)
    assert joins(rows) <= 10 and rows.count() == 2 + 2
    assert joins(kits.ab_pairs(frames, windows)) <= 10


def test_pilot_result_reads_the_answers_once(spark, tmp_path):
    key = spark.createDataFrame([(f"i{k}", "native" if k % 2 else "model", k / 40, k < 6, None) for k in range(40)], "item_id string, source string, tone_i2 double, is_catch boolean, catch_expected string")
    said = [("r", f"i{k}", "ok" if k < 6 or k % 3 else "bad") for k in range(40)] + [("s", f"i{k}", "bad") for k in range(40)]
    spark.createDataFrame(said, "rater string, item_id string, label string").write.parquet(f"{tmp_path}/answers")
    out = pilot.pilot_result(spark.read.parquet(f"{tmp_path}/answers"), key, 0.5, n_rep=10)
    assert not any(f"{tmp_path}/answers" in f for f in out.inputFiles())
    r = out.first()
    assert (r["n_kept"], r["n_scored"]) == (1, 34)
