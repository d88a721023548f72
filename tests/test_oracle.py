import pytest
from pyspark.sql import functions as F

from contourlake.functions import register, stats as S
from contourlake.operators import oracle, pilot, signal
from test_signal import clip


def test_flips_are_read_and_controls_are_not(spark):
    frames, windows = clip(spark, "HMLHML")
    rows = oracle.run(frames, windows, {"I2": oracle.absolute_meter()}, ks=(0.1, 1.0), most=3).cache()
    flips = rows.where("kind = 'flip'").collect()
    assert len(flips) == 6 and all(r["detected"] for r in flips if r["k"] == 1.0) and not any(r["detected"] for r in flips if r["k"] == 0.1)
    units = signal.unit_semitones(frames, windows)
    delta = signal.levels(signal.residuals(units, signal.theil_sen(units))).first()["delta_hl"]
    assert all(r["semitones"] == pytest.approx((delta if r["src"] == "L" else -delta) * r["k"]) for r in flips)
    controls = rows.where("kind = 'control'").collect()
    assert {r["control"] for r in controls} == {"tiny", "roundtrip"} and len(controls) == 2 and not any(r["flipped"] for r in controls)
    s = pilot.oracle_summary(rows, 1.0).first()
    assert s["strong_detect"] == 1.0 and s["control_trip"] == 0.0 and s["n_flips"] == 6
    t = oracle.trend(rows, "I2", 200).first()
    assert t["trend_rho"] == pytest.approx(1.0) and t["trend_p"] < 0.3
    flat, same = clip(spark, "HMLHML", heard="MMMMMM")
    assert oracle.run(flat, same, {"I2": oracle.absolute_meter()}).count() == 0


def test_comparisons(spark):
    real = spark.createDataFrame([("I1", 0.8), ("I2", 0.6)], "instrument string, balanced_acc double")
    controls = spark.createDataFrame([("I1", "shuffled_target", 0.3), ("I1", "monotone", 0.35)], "instrument string, control string, balanced_acc double")
    got = {r["instrument"]: r for r in oracle.compared(real, controls).collect()}
    assert got["I1"]["margin"] == pytest.approx(0.5) and got["I2"]["margin"] is None and got["I2"]["monotone"] is None
    gen = spark.createDataFrame([("I1", 0.8), ("I2", 0.7)], "instrument string, micro_acc double")
    got = {r["instrument"]: r["status"] for r in oracle.generated_against_shuffled(gen, gen.where("instrument = 'I1'")).collect()}
    assert got == {"I1": "ok", "I2": "missing"}


def test_sql_functions(spark):
    names = register.register(spark)
    assert names == ["cer_text", "norm_key", "semitone", "tone_string", "wilson_hi", "wilson_lo"]
    r = spark.sql("SELECT tone_string('Báwo ni') t, cer_text('Ẹkọ́, (dára)!') c, norm_key('  A  b ') n, semitone(200D) s, wilson_lo(3, 10) lo, wilson_hi(3, 10) hi").first()
    w = spark.range(1).select(S.wilson(F.lit(3), F.lit(10)).alias("w")).first()["w"]
    assert (r["t"], r["c"], r["n"], r["s"]) == ("HMM", "eko dara", "a b", 12.0)
    assert r["lo"] == pytest.approx(w["lo"], abs=1e-6) and r["hi"] == pytest.approx(w["hi"], abs=1e-6)
