"""The flip oracle: edit a unit's pitch, score again, see whether the meter reads the flip and only the flip.

All variants of all clips are one table keyed by clip, unit and edit, so every
meter scores them in one plan. Pitch is edited in the F0 track. A meter is a
function (frames, windows, mids) -> tbu rows; mids(clip_id, mid) are the clean
clips' centres, frozen.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..storage import Tables
from . import resample, selection, signal

Meter = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
TINY = 0.2


def absolute_meter(theta_h: float = signal.THETA_H, theta_l: float = signal.THETA_L) -> Meter:
    """The absolute meter with blind slope and the frozen centre."""

    def score(frames: DataFrame, windows: DataFrame, mids: DataFrame) -> DataFrame:
        units = Tables(frames.sparkSession, "meter").put_large("units", signal.unit_semitones(frames, windows))
        res = signal.residuals(units, signal.theil_sen(units)).join(mids, "clip_id")
        c = F.col("res") - F.col("mid")
        return res.withColumn("pred", F.when(c.isNull(), F.lit(None).cast("string")).when(c >= theta_h, "H").when(c <= -theta_l, "L").otherwise("M"))

    return score


def run(frames: DataFrame, windows: DataFrame, meters: Mapping[str, Meter], ks: Sequence[float] = (0.5, 1.0, 1.5), least_delta: float = 1.0, most: int = 6, tiny: float = TINY) -> DataFrame:
    """Oracle rows: kind, clip_id, tbu_idx, src, k, semitones, control, meter, pred_at_tbu, expect, detected, false_flips, ff_total, flipped.

    Clips whose H and L differ by less than least_delta are left out; flips are
    k times that difference, away from the unit's own pole. The first half of a
    clip's candidates, at least one, also gets the controls: a tiny shift and
    no shift. What several plans read is written once, so that no plan holds
    another one many times over.
    """
    tables = Tables(frames.sparkSession, "oracle")
    units = tables.put_large("units", signal.unit_semitones(frames, windows))
    levels = signal.levels(signal.residuals(units, signal.theil_sen(units)))
    ok = tables.put_large("clips", levels.where(F.col("delta_hl") >= least_delta).select("clip_id", "delta_hl", F.col("mid_ref").alias("mid")))
    mids = ok.select("clip_id", "mid")
    base = None
    for name, meter in meters.items():
        one = meter(frames, windows, mids).select("clip_id", "tbu_idx", "target", F.col("pred").alias("base_pred"), F.lit(name).alias("meter"))
        base = one if base is None else base.unionByName(one)
    base = tables.put_large("base", base)
    where = windows.select("clip_id", "tbu_idx", "t0", "t1")
    cands = selection.eligible_flips(base.withColumnRenamed("base_pred", "pred").withColumnRenamed("meter", "instrument").join(where.drop("t1"), ["clip_id", "tbu_idx"]), most)
    by = Window.partitionBy("clip_id")
    half = F.greatest(F.lit(1), F.floor(F.count("*").over(by) / 2))
    cands = cands.withColumn("first", F.row_number().over(by.orderBy("tbu_idx")) <= half).join(ok, "clip_id").join(where, ["clip_id", "tbu_idx"])
    sign = F.when(F.col("target") == "L", 1.0).otherwise(-1.0)
    flips = [F.struct(F.lit("flip").alias("kind"), F.lit(float(k)).alias("k"), (sign * k * F.col("delta_hl")).alias("semitones"), F.lit(None).cast("string").alias("control")) for k in ks]
    shams = [F.struct(F.lit("control").alias("kind"), F.lit(None).cast("double").alias("k"), F.lit(st).alias("semitones"), F.lit(c).alias("control")) for c, st in (("tiny", tiny), ("roundtrip", 0.0))]
    every = F.when(F.col("first"), F.array(*flips, *shams)).otherwise(F.array(*flips))
    edits = cands.select("clip_id", "tbu_idx", F.col("target").alias("src"), "mid", F.col("t0").alias("e0"), F.col("t1").alias("e1"), F.explode(every).alias("e")).select("*", "e.*").drop("e")
    edits = edits.withColumn("variant", F.concat_ws("|", "clip_id", "tbu_idx", "kind", F.coalesce(F.col("k").cast("string"), "control")))
    edits = tables.put_large("edits", edits)
    keyed = edits.select("clip_id", "variant", "e0", "e1", "semitones")
    moved = F.when((F.col("t") >= F.col("e0")) & (F.col("t") < F.col("e1")), F.col("f0") * F.pow(F.lit(2.0), F.col("semitones") / 12)).otherwise(F.col("f0"))
    frames_v = frames.join(keyed, "clip_id").select(F.col("variant").alias("clip_id"), "t", moved.alias("f0"))
    windows_v = windows.join(keyed.select("clip_id", "variant"), "clip_id").select(F.col("variant").alias("clip_id"), "tbu_idx", "target", "t0", "t1")
    mids_v = edits.select(F.col("variant").alias("clip_id"), "mid")
    out = None
    info = edits.select("variant", "clip_id", F.col("tbu_idx").alias("at"), "src", "k", "semitones", "kind", "control")
    for name, meter in meters.items():
        scored = meter(frames_v, windows_v, mids_v).select(F.col("clip_id").alias("variant"), "tbu_idx", "pred").join(info, "variant")
        both = scored.join(base.where(F.col("meter") == name).select("clip_id", "tbu_idx", "base_pred"), ["clip_id", "tbu_idx"])
        other = (F.col("tbu_idx") != F.col("at")) & F.col("pred").isNotNull() & F.col("base_pred").isNotNull()
        one = both.groupBy("variant", "clip_id", "at", "src", "k", "semitones", "kind", "control").agg(
            F.max(F.when(F.col("tbu_idx") == F.col("at"), F.col("pred"))).alias("pred_at_tbu"),
            F.count_if(other & (F.col("pred") != F.col("base_pred"))).alias("false_flips"),
            F.count_if(other).alias("ff_total"),
        )
        out = one.withColumn("meter", F.lit(name)) if out is None else out.unionByName(one.withColumn("meter", F.lit(name)))
    flip = F.col("kind") == "flip"
    expect = F.when(F.col("src") == "L", "H").otherwise("L")
    return out.select(
        "kind", "clip_id", F.col("at").alias("tbu_idx"), "src", "k", "semitones", "control", "meter", "pred_at_tbu",
        F.when(flip, expect).alias("expect"),
        F.when(flip, F.coalesce(F.col("pred_at_tbu") == expect, F.lit(False))).alias("detected"),
        F.when(flip, F.col("false_flips")).alias("false_flips"), F.when(flip, F.col("ff_total")).alias("ff_total"),
        F.when(~flip, F.coalesce(F.col("pred_at_tbu") != F.col("src"), F.lit(False))).alias("flipped"),
    )


def trend(rows: DataFrame, meter: str, n_perm: int = 2000, seed: int = 0) -> DataFrame:
    """Whether detection rises with the shift; p is 1 for fewer than four flips."""
    flips = rows.where((F.col("kind") == "flip") & (F.col("meter") == meter)).select(F.abs("semitones").alias("x"), F.col("detected").cast("double").alias("y"))
    t = resample.trend_test(flips, "x", "y", n_perm, seed)
    return t.select("n", F.when(F.col("n") >= 4, F.col("rho")).alias("trend_rho"), F.when(F.col("n") >= 4, F.col("p")).otherwise(1.0).alias("trend_p"))


def compared(real: DataFrame, controls: DataFrame) -> DataFrame:
    """Per instrument, its balanced accuracy, that of each control (NULL if it was not run) and the margin over the shuffled one. real, controls: (instrument, balanced_acc), the latter with control."""
    wide = controls.groupBy("instrument").pivot("control", ["shuffled_target", "monotone", "all_mid"]).agg(F.max("balanced_acc"))
    out = real.join(wide, "instrument", "left")
    return out.withColumn("margin", F.col("balanced_acc") - F.col("shuffled_target"))


def generated_against_shuffled(generated: DataFrame, shuffled: DataFrame) -> DataFrame:
    """Margins per instrument; an instrument that only one side has is a row with status missing."""
    both = generated.select("instrument", F.col("micro_acc").alias("gen")).join(shuffled.select("instrument", F.col("micro_acc").alias("shuf")), "instrument", "full")
    return both.select("instrument", "gen", "shuf", (F.col("gen") - F.col("shuf")).alias("margin"), F.when(S.no_nan(F.col("gen")).isNull() | S.no_nan(F.col("shuf")).isNull(), "missing").otherwise("ok").alias("status"))
