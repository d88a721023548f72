"""Building A/B stimuli: the same clip with one unit reset to the opposite tone, and with its own contour imposed again.

Pitch is edited in the F0 track, so both twins went through the same edit. All
candidates of all clips are variants of one table; a candidate is shipped if the
reset was realised, landed in the band that was meant and is read so, and of a
clip's candidates the first in a hashed order that passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..storage import Tables
from . import metrics, selection, signal

#: The least difference of a clip's H and L, the least realised shift, how far past the band a reset aims, and the tilt of a high and of a low contour.
LEAST_DELTA, LEAST_SHIFT, PAST, TILT_H, TILT_L = 2.0, 3.0, 0.5, -1.0, -0.2
#: Fixed values of catches: how far past the band, and the least realised shift.
CATCH_PAST, CATCH_SHIFT = 3.0, 6.0


def candidates(frames: DataFrame, windows: DataFrame, theta_h: float = signal.THETA_H, theta_l: float = signal.THETA_L, past: float = PAST, catch: bool = False) -> DataFrame:
    """variant, clip_id, tbu_idx, src, expect, mid, e0, e1, r (the residual aimed at) and slope of each unit that is read right on the clean clip and has a voiced rhyme."""
    tables = Tables(frames.sparkSession, "units")
    units = tables.put_large("units", signal.unit_semitones(frames, windows))
    slopes = tables.put_large("slopes", signal.theil_sen(units))
    res = tables.put_large("res", signal.residuals(units, slopes))
    levels = signal.levels(res).where(F.col("delta_hl") >= (-1e9 if catch else LEAST_DELTA)).select("clip_id", "med_h", "med_l", F.col("mid_ref").alias("mid"))
    right = signal.classify(res, theta_h, theta_l).where(F.col("target").isin("H", "L") & (F.col("pred") == F.col("target"))).select("clip_id", "tbu_idx", F.col("target").alias("src"))
    rhyme = signal.voiced_rhyme(frames, windows).select("clip_id", "tbu_idx", F.col("r0").alias("e0"), F.col("r1").alias("e1"))
    both = right.join(rhyme, ["clip_id", "tbu_idx"]).join(levels, "clip_id").join(slopes, "clip_id")
    up = F.col("src") == "L"
    beyond = lambda step: F.when(up, F.greatest(F.col("med_h"), F.col("mid") + theta_h + step)).otherwise(F.least(F.col("med_l"), F.col("mid") - theta_l - step))
    aim = beyond(0.0) + F.when(up, F.lit(past)).otherwise(F.lit(-past)) if catch else beyond(past)
    tilt = F.lit(0.0) if catch else F.when(up, TILT_H).otherwise(TILT_L)
    named = F.concat_ws("|", F.col("clip_id").cast("string"), F.col("tbu_idx").cast("string"))
    return both.select(named.alias("variant"), "clip_id", "tbu_idx", "src", F.when(up, "H").otherwise("L").alias("expect"), "mid", "e0", "e1", aim.alias("r"), (F.col("slope") + tilt).alias("slope"))


def twins(frames: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames of each variant's flipped and of its correct twin; clip_id is the variant."""
    spans = cands.select(F.col("variant").alias("clip_id"), "e0", "e1", "r", "slope")
    own = frames.join(cands.select("clip_id", "variant"), "clip_id").select(F.col("variant").alias("clip_id"), "t", "f0")
    return signal.set_contour(own, spans, signal.flip_contour(spans)), signal.set_contour(own, spans, signal.contour_points(own, spans))


def balanced(tbu: DataFrame, name: str) -> DataFrame:
    """The balanced accuracy of each variant under a name."""
    return metrics.population(tbu.where(F.col("pred").isNotNull()), ["clip_id"]).select("clip_id", F.col("balanced_acc").alias(name))


def ab_pairs(frames: DataFrame, windows: DataFrame, seed: int = 0, theta_h: float = signal.THETA_H, theta_l: float = signal.THETA_L) -> DataFrame:
    """One A/B pair per clip that has a candidate which passes: where and how it was flipped, the realised shift, and both twins' scores under the frozen and under their own centre."""
    tables = Tables(frames.sparkSession, "ab")
    cands = tables.put_large("candidates", candidates(frames, windows, theta_h, theta_l))
    flipped, correct = (tables.put_large(n, f) for n, f in zip(("flipped", "correct"), twins(frames, cands), strict=True))
    spans = cands.select(F.col("variant").alias("clip_id"), "e0", "e1")
    mids = cands.select(F.col("variant").alias("clip_id"), "mid")
    wins = windows.join(cands.select("clip_id", "variant"), "clip_id").select(F.col("variant").alias("clip_id"), "tbu_idx", "target", "t0", "t1")
    res = {}
    for side, f in (("flipped", flipped), ("correct", correct)):
        units = tables.put_large(f"units_{side}", signal.unit_semitones(f, wins))
        res[side] = tables.put_large(f"res_{side}", signal.residuals(units, signal.theil_sen(units)))
    read = {side: signal.classify(r, theta_h, theta_l, mids) for side, r in res.items()}
    at = read["flipped"].select(F.col("clip_id").alias("variant"), "tbu_idx", "res", "pred")
    moved = signal.median_in_span(flipped, spans).select(F.col("clip_id").alias("variant"), F.col("st").alias("st_flipped")).join(signal.median_in_span(correct, spans).select(F.col("clip_id").alias("variant"), F.col("st").alias("st_correct")), "variant", "full")
    both = cands.join(at, ["variant", "tbu_idx"], "left").join(moved.hint("merge"), "variant", "left")
    s = selection.salience(F.col("st_flipped"), F.col("st_correct"), F.col("res"), F.col("mid"), F.col("pred"), F.col("expect"), theta_h, theta_l, LEAST_SHIFT)
    tried = both.withColumn("s", s).select("variant", "clip_id", "tbu_idx", "src", "expect", "e0", "e1", "r", "mid", "s.realized_st", F.col("s.passed").alias("passed"))
    out = tables.put_large("shipped", selection.first_passing(tried, "clip_id", "passed", S.hash_number(F.lit(seed), F.col("variant")), "variant").drop("passed"))
    for side in ("correct", "flipped"):
        own = signal.classify(res[side], theta_h, theta_l)
        for anchor, tbu in (("frozen", read[side]), ("deployed", own)):
            out = out.join(balanced(tbu, f"tone_i2_{anchor}_{side}").withColumnRenamed("clip_id", "variant").hint("merge"), "variant", "left")
    return out.withColumn("flip_dir", F.concat("src", F.lit("->"), "expect")).drop("src", "expect")


def catches(frames: DataFrame, windows: DataFrame, seed: int = 0) -> DataFrame:
    """One obvious trial per clip: where a unit was reset far beyond the opposite band, the first whose shift was realised; else flatten, the whole clip at its mean."""
    tables = Tables(frames.sparkSession, "catches")
    cands = tables.put_large("candidates", candidates(frames, windows, past=CATCH_PAST, catch=True))
    bad, good = twins(frames, cands)
    spans = cands.select(F.col("variant").alias("clip_id"), "e0", "e1")
    moved = signal.median_in_span(bad, spans).withColumnRenamed("st", "b").join(signal.median_in_span(good, spans).withColumnRenamed("st", "g"), "clip_id").select(F.col("clip_id").alias("variant"), (F.abs(F.col("b") - F.col("g")) >= CATCH_SHIFT).alias("passed"))
    one = selection.first_passing(cands.join(moved, "variant"), "clip_id", "passed", S.hash_number(F.lit(seed), F.col("variant")), "variant")
    every = frames.select("clip_id").distinct().join(one.select("clip_id", "tbu_idx", "e0", "e1", "r", F.concat("src", F.lit("->"), "expect", F.lit("(extreme)")).alias("flip_dir")), "clip_id", "left")
    return every.withColumn("flip_dir", F.coalesce("flip_dir", F.lit("flatten")))


def ab_key(pairs: DataFrame, catch_rows: DataFrame, seed: int) -> DataFrame:
    """The withheld key of a kit of pairs and catches: item_id in a hashed order, the side of the correct twin, and what a catch expects."""
    rows = pairs.withColumns({"pair_id": F.col("clip_id").cast("string"), "is_catch": F.lit(False)}).unionByName(catch_rows.withColumns({"pair_id": F.concat(F.lit("catch|"), F.col("clip_id").cast("string")), "is_catch": F.lit(True)}), allowMissingColumns=True)
    side = selection.random_side(seed, F.col("pair_id"))
    return selection.item_ids(rows.withColumns({"correct_side": side, "expect_pick": F.when(F.col("is_catch"), side)}), seed, "pair_id")
