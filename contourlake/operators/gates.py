"""Decision tables: one row per (instrument, check) with value, threshold and pass, then a verdict.

Thresholds are rows of a small literal table, so a changed rule is a changed
row. A missing value never passes a floor; a missing control passes its ceiling
and is caught by the evidence check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S

#: Fixed values of the Layer-B gate: floors for each instrument.
MICRO_FLOOR = {"I1": 0.72, "I2": 0.68}
MICRO_FLOOR_ELSE = 0.70
LAYER_B = {"coverage": 0.70, "recall_H": 0.60, "recall_L": 0.60, "coverage_H": 0.55, "coverage_L": 0.55, "margin": 0.15}
#: Fixed value: the least kappa between two instruments.
KAPPA_FLOOR = 0.45
#: Fixed values of the Layer-0 gate by role: (check, is a floor, threshold).
LAYER_0 = {
    "quality": (("balanced_acc", True, 0.70), ("coverage", True, 0.70), ("shuffled_target", False, 0.40)),
    "tone": (("balanced_acc", True, 0.52), ("recall_H", True, 0.40), ("recall_L", True, 0.40), ("monotone", False, 0.40), ("margin", True, 0.08), ("shuffled_target", False, 0.40)),
}
#: The least support of H and of L, and the controls that each role must have run.
LEAST_SUPPORT = 150
EVIDENCE = {"quality": ("shuffled_target",), "tone": ("shuffled_target", "monotone")}


def checks(wide: DataFrame, key: str, floors: dict[str, float], ceilings: dict[str, float] | None = None) -> DataFrame:
    """A row for each key and check of a table with one column per check."""
    ceilings = ceilings or {}
    rows = [F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), S.at_least(F.col(c), t).alias("pass")) for c, t in floors.items()]
    rows += [F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), S.at_most_or_missing(F.col(c), t).alias("pass")) for c, t in ceilings.items()]
    return wide.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def tone_gate(wide: DataFrame) -> DataFrame:
    """Layer-B checks of wide(instrument, micro_acc, coverage, recall_H, ..., margin)."""
    floor = F.lit(MICRO_FLOOR_ELSE)
    for name, t in MICRO_FLOOR.items():
        floor = F.when(F.col("instrument") == name, F.lit(t)).otherwise(floor)
    micro = wide.select("instrument", F.lit("micro_acc").alias("check"), F.col("micro_acc").alias("value"), floor.alias("threshold"), S.at_least(F.col("micro_acc"), floor).alias("pass"))
    return micro.unionByName(checks(wide, "instrument", LAYER_B))


def tone_gate_verdict(wide: DataFrame, required: Sequence[str], kappa: DataFrame | None = None) -> DataFrame:
    """PASS or FAIL over the required instruments; of two or more, their kappa is needed, too. A required instrument without scores fails."""
    spark = wide.sparkSession
    need = spark.createDataFrame([(r,) for r in required], "instrument string")
    each = need.join(tone_gate(wide).groupBy("instrument").agg(F.bool_and("pass").alias("ok")), "instrument", "left")
    out = each.agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    if len(required) >= 2:
        if kappa is None:
            raise ValueError("two or more required instruments need their pairs' kappa")
        out = out.crossJoin(F.broadcast(kappa.agg(F.max("kappa").alias("kappa")))).select((F.col("ok") & S.at_least(F.col("kappa"), KAPPA_FLOOR)).alias("ok"))
    return out.select(F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("verdict"))


def layer0(wide: DataFrame) -> DataFrame:
    """Layer-0 checks of wide(instrument, role, balanced_acc, ..., support_H, support_L, shuffled_target, monotone), with support_ok and evidence_ok."""
    parts = []
    for role, rules in LAYER_0.items():
        own = wide.where(F.col("role") == role)
        t = checks(own, "instrument", {c: x for c, floor, x in rules if floor}, {c: x for c, floor, x in rules if not floor})
        parts.append(t.withColumn("role", F.lit(role)))
    support = F.coalesce((F.col("support_H") >= LEAST_SUPPORT) & (F.col("support_L") >= LEAST_SUPPORT), F.lit(False))
    evidence = F.lit(True)
    for role, names in EVIDENCE.items():
        has = F.lit(True)
        for n in names:
            has &= F.col(n).isNotNull()
        evidence = F.when(F.col("role") == role, has).otherwise(evidence)
    ok = wide.select("instrument", support.alias("support_ok"), evidence.alias("evidence_ok"))
    return parts[0].unionByName(parts[1]).join(F.broadcast(ok), "instrument")


def layer0_verdict(spark: SparkSession, wide: DataFrame, required: Sequence[str]) -> DataFrame:
    """INDETERMINATE if a required instrument lacks scores, support or evidence; else PASS if all checks pass, else FAIL."""
    need = spark.createDataFrame([(r,) for r in required], "instrument string")
    each = layer0(wide).groupBy("instrument").agg(F.bool_and("pass").alias("ok"), F.bool_and(F.col("support_ok") & F.col("evidence_ok")).alias("known"))
    out = need.join(each, "instrument", "left").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("known"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    return out.select(F.when(~F.col("known"), "INDETERMINATE").when(F.col("ok"), "PASS").otherwise("FAIL").alias("verdict"))


@dataclass(frozen=True)
class Reward:
    """Fixed values of the reward."""

    voiced: float = 0.35
    cer: float = 0.25
    tone_floor: float = 0.15
    ssim_floor: float = 0.30
    ssim_weight: float = 0.05
    per_char: float = 0.157


def reward(cfg: Reward = Reward()) -> tuple[Column, Column]:
    """(gate, reward) over columns tone_acc, method, voiced, n_kinds (different preds, an abstention being one), cer, ssim, dur, text: the first gate that fails, and 0 there."""
    gate = (
        F.when(~S.at_least(F.col("voiced"), cfg.voiced), "voiced")
        .when(~F.col("method").eqNullSafe(F.lit("forced-align")), "align")
        .when(F.col("tone_acc").isNull() | F.isnan("tone_acc"), "tone_nan")
        .when(~F.coalesce(F.col("cer") <= cfg.cer, F.lit(False)), "cer")
        .when(~F.coalesce(S.length_ok(F.col("dur"), F.col("text"), cfg.per_char), F.lit(False)), "length")
        .when(F.coalesce(F.col("n_kinds"), F.lit(0)) < 2, "monotone")
        .otherwise("ok")
    )
    tone = S.clip((F.col("tone_acc") - cfg.tone_floor) / (1 - cfg.tone_floor))
    voice = F.coalesce(cfg.ssim_weight * S.clip((F.col("ssim") - cfg.ssim_floor) / (1 - cfg.ssim_floor)), F.lit(0.0))
    return gate, F.when(gate == "ok", tone + voice).otherwise(0.0)


def go_no_go() -> Column:
    """GO, NO-GO-FLAT or MIXED over cer, i1_cov, ssim, len_ratio, coverage and tone_i2: flat is a tone score that is missing or near chance."""
    climb = S.at_least(F.col("tone_i2"), 1 / 3 + 0.04)
    under = lambda c, most: F.coalesce(~F.isnan(c) & (F.col(c) <= most), F.lit(False))
    rest = under("cer", 0.25) & under("len_ratio", 2.5) & S.at_least(F.col("i1_cov"), 0.80) & S.at_least(F.col("ssim"), 0.40) & S.at_least(F.col("coverage"), 0.70)
    return F.when(rest & climb, "GO").when(~climb, "NO-GO-FLAT").otherwise("MIXED")


def tone_blind() -> Column:
    """Whether an edit moved tone and not the error rate, over d_cer, d_tone and d_roundtrip."""
    hit = (F.abs("d_cer") < 0.08) & (F.col("d_tone") < -0.12) & (F.abs("d_roundtrip") < 0.12)
    return F.when(F.coalesce(hit, F.lit(False)), "CER IS TONE-BLIND").otherwise("NOT SHOWN")


def export_gate(salient: DataFrame, confirmed: bool) -> DataFrame:
    """Whether a kit may be exported: every item salient, and the operator's word."""
    return salient.agg((F.coalesce(F.bool_and("salient"), F.lit(False)) & F.lit(confirmed)).alias("export"))


def explained(table: DataFrame) -> DataFrame:
    """A line of text for each check."""
    mark = F.when(F.col("pass"), "ok").otherwise("FAIL")
    return table.select(F.format_string("[%s] %s %s: %s against %s", mark, F.col("instrument"), F.col("check"), F.coalesce(F.format_number("value", 3), F.lit("missing")), F.format_number("threshold", 3)).alias("line"))
