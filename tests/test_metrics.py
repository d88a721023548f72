import math
import random

import pytest
from pyspark.sql import functions as F

from contourlake.functions import stats as S
from contourlake.operators import gates, metrics, pilot, resample, selection

TBU = "clip_id long, tbu_idx int, target string, pred string"


def tbu(spark, pairs):
    return spark.createDataFrame([(k // 10, k % 10, t, p) for k, (t, p) in enumerate(pairs)], TBU)


def test_population_and_f1(spark):
    rows = tbu(spark, list(zip("HHML", "HMML", strict=True)))
    p = metrics.population(rows).first()
    assert p["balanced_acc"] == pytest.approx((0.5 + 1 + 1) / 3) and p["micro_acc"] == 0.75
    assert metrics.weighted_f1(rows).first()[0] == pytest.approx(0.75)
    assert metrics.kappa_vs_target(tbu(spark, [("H", "H"), ("M", "M"), ("L", "L")])).first()["kappa"] == 1.0
    assert metrics.kappa_vs_target(tbu(spark, [("H", None)])).first()["kappa"] is None
    assert metrics.population(tbu(spark, [("X", "H")])).first()["n_tbu"] is None


def test_cheats_fail_the_gate(spark):
    pattern = "HMLMHL" * 40
    good = [(t, t) for t in pattern]
    flat = [(t, "M") for t in pattern]
    timid = [(t, t if k % 10 == 0 else None) for k, t in enumerate(pattern)]
    for pairs, want in ((good, "PASS"), (flat, "FAIL"), (timid, "FAIL")):
        rows = tbu(spark, pairs)
        cs = metrics.class_stats(rows)
        at = lambda c, k: F.max(F.when(F.col("target") == k, F.col(c))).alias(f"{c}_{k}")
        wide = cs.agg(F.avg("recall").alias("balanced_acc"), S.share(F.sum("correct"), F.sum("covered")).alias("micro_acc"), S.share(F.sum("covered"), F.sum("support")).alias("coverage"), *(at(c, k) for c in ("recall", "coverage", "support") for k in "HL"))
        wide = wide.select(F.lit("I2").alias("instrument"), F.lit("tone").alias("role"), "*", F.lit(0.2).alias("margin"), F.lit(0.33).alias("shuffled_target"), F.lit(0.35).alias("monotone"))
        assert gates.tone_gate_verdict(wide, ["I2"]).first()[0] == want
        thin = wide.withColumn("support_H", F.lit(10))
        assert gates.layer0_verdict(spark, thin, ["I2"]).first()[0] == "INDETERMINATE"
        blind = wide.withColumn("monotone", F.lit(None).cast("double"))
        assert gates.layer0_verdict(spark, blind, ["I2"]).first()[0] == "INDETERMINATE"
    assert gates.tone_gate_verdict(wide, ["I2", "I1"], spark.createDataFrame([(0.9,)], "kappa double")).first()[0] == "FAIL"
    with pytest.raises(ValueError):
        gates.tone_gate_verdict(wide, ["I1", "I2"])


def test_null_and_nan_thresholds(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (0.5,)], "x double").select(S.at_least(F.col("x"), 0.4), S.at_most_or_missing(F.col("x"), 0.4)).collect()
    assert [tuple(r) for r in rows] == [(False, True), (False, True), (True, False)]


def test_binomial_and_wilson(spark):
    df = spark.createDataFrame([(26, 26), (13, 26), (0, 0), (3, 10)], "k long, n long").select("k", "n", S.binom_two_sided(F.col("k"), F.col("n")).alias("p"), S.wilson(F.col("k"), F.col("n")).alias("w"))
    for r in df.collect():
        k, n = r["k"], r["n"]
        want = sum(math.comb(n, i) for i in range(n + 1) if math.comb(n, i) <= math.comb(n, k)) / 2**n if n else None
        assert r["p"] == (None if n == 0 else pytest.approx(want))
        assert (r["w"]["p"] is None) == (n == 0)


def test_rank_statistics(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), rng.randrange(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "s long, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.auroc(df, "s", "y").first()["auroc"] == pytest.approx(want)
    assert metrics.auroc(df.where("y = 1"), "s", "y").first()["auroc"] is None
    assert metrics.spearman(df.withColumn("t", F.col("s") * 3), "s", "t").first()["rho"] == pytest.approx(1)
    trend = spark.createDataFrame([(0.5, 0.1), (1.0, 0.4), (1.5, 0.6), (2.0, 0.9), (2.5, 0.95)], "x double, y double")
    assert resample.trend_test(trend, "x", "y", 200, 1).first()["p"] < 0.05
    assert resample.trend_test(trend.withColumn("y", F.lit(1.0)), "x", "y", 20, 1).first()["p"] == 1.0


def test_index_quantile_and_bootstrap(spark):
    v = spark.createDataFrame([(float(x),) for x in range(1, 21)], "v double")
    assert resample.index_quantile(v, "v", 0.05).first()[0] == 2.0
    assert resample.index_quantile(v, "v", 1.0).first()[0] == 20.0
    rng = random.Random(0)
    rows = tbu(spark, [(t, t if rng.random() < 0.7 else "M") for t in "HML" * 200])
    b = resample.bootstrap(resample.clip_counts(rows), resample.balanced(), 50, 3, 0.05, 0.95).first()
    assert b["lo"] < b["point"] < b["hi"] and b["point"] == pytest.approx(metrics.population(rows).first()["balanced_acc"])
    shuffled = resample.permuted_targets(rows, 1)
    same = lambda d: sorted(map(tuple, d.groupBy("clip_id", "target").count().collect()))
    assert same(shuffled) == same(rows) and metrics.population(shuffled).first()["balanced_acc"] < 0.55


def test_budget_is_a_prefix_with_the_crossing_row(spark):
    rows = spark.createDataFrame([(k, 1.0) for k in range(50)], "id long, dur double")
    out = selection.budget_prefix(rows, [3.5, 10.0], "dur", 1, "id").collect()
    small, large = ({r["id"] for r in out if r["budget"] == b} for b in (3.5, 10.0))
    assert len(small) == 4 and len(large) == 10 and small < large


def test_listening_test(spark):
    codes = spark.createDataFrame([("r", "PILOT1;item01=OK; item02 = bad ;noise;item01=unsure;item03=a=b")], "rater string, code string")
    assert {(r["item_id"], r["label"]) for r in pilot.answer_rows(codes).collect()} == {("item01", "unsure"), ("item02", "bad"), ("item03", "a=b")}
    flips = [("flip", k, "I2", d, f, 8, None) for k, d, f in ((0.5, True, 1), (0.5, False, 1), (0.5, False, 1), (0.5, False, 1), (1.0, True, 0), (1.0, True, 0), (1.0, True, 0), (1.0, True, 0))]
    rows = spark.createDataFrame([*flips, ("control", None, "I2", None, None, None, False)], "kind string, k double, meter string, detected boolean, false_flips int, ff_total int, flipped boolean")
    s = pilot.oracle_summary(rows, 1.0).first()
    assert s["detect_by_k"] == {0.5: 0.25, 1.0: 1.0} and s["strong_detect"] == 1.0 and s["false_flip_rate"] == 4 / 64 and s["n_flips"] == 8 and s["control_trip"] == 0.0


def test_reward_names_the_first_failing_gate(spark):
    base = dict(tone_acc=0.9, method="forced-align", voiced=0.9, n_kinds=3, cer=0.1, ssim=0.65, dur=1.57, text="0123456789")
    cases = {"ok": {}, "voiced": {"voiced": None}, "align": {"method": None}, "tone_nan": {"tone_acc": float("nan")}, "cer": {"cer": 0.3}, "length": {"dur": 9.0}, "monotone": {"n_kinds": 1}}
    kinds = "tone_acc double, method string, voiced double, n_kinds int, cer double, ssim double, dur double, text string"
    df = spark.createDataFrame([tuple((base | c).values()) for c in cases.values()] + [tuple((base | {"ssim": None}).values())], kinds)
    gate, value = gates.reward()
    out = df.select(gate.alias("g"), value.alias("v")).collect()
    mute = out.pop()
    assert mute["g"] == "ok" and mute["v"] == pytest.approx(0.75 / 0.85)
    assert [r["g"] for r in out] == list(cases) and out[0]["v"] == pytest.approx(0.75 / 0.85 + 0.05 * 0.5) and not any(r["v"] for r in out[1:])
