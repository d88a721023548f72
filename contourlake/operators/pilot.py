"""Listening tests: answers, keys, tallies and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..storage import Tables
from . import resample

#: What a label says.
JUDGED = {"ok": 1, "bad": 0}
#: Gates of raters and of the pilot.
CATCH_LEAST, SCOREABLE_LEAST, ANCHOR_GATE, AUROC_GATE = 5, 30, 0.75, 0.70
AB_CATCH_SHARE, AB_TRIALS = 0.80, 24
TONE_DEFAULT = 0.58


def answer_parts(code: Column) -> Column:
    """Array of (item_id, label) from `PILOT1;item01=ok;...`: parts without = are skipped, items trimmed, labels trimmed and lowered."""
    parts = F.filter(F.split(code, ";"), lambda p: p.contains("="))
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("item_id"), F.lower(F.trim(F.substr(p, F.locate("=", p) + 1))).alias("label")))


def answer_rows(raters: DataFrame, rater: str = "rater", code: str = "code", order: str | None = None) -> DataFrame:
    """rater, item_id, label of compact codes; of an item's answers in one code the last counts, of several codes that of the last in the order."""
    place = [] if order is None else [order]
    said = raters.select(rater, *place, F.posexplode(answer_parts(F.col(code))).alias("pos", "p")).select(rater, *place, "pos", "p.*")
    return said.groupBy(rater, "item_id").agg(F.max_by("label", F.struct(*place, "pos")).alias("label"))


def judgement(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, v in JUDGED.items():
        out = F.when(label == name, v).otherwise(out)
    return out


def threshold(keymap: DataFrame, override: float | None = None) -> DataFrame:
    """tau: the override, else the median native tone_i2, else the default."""
    native = keymap.where((F.col("source") == "native") & ~F.col("is_catch"))
    middle = resample.exact_median(native, "tone_i2").agg(F.max("median").alias("median"))  # one row, of NULL without natives
    return middle.select(F.coalesce(F.lit(override).cast("double"), "median", F.lit(TONE_DEFAULT)).alias("tau"))


def rater_tallies(answers: DataFrame, keymap: DataFrame) -> DataFrame:
    """Catches passed and seen, natives called good, unsure and scoreable items of each rater. Items not in the key are left out."""
    j = answers.join(keymap, "item_id")
    expected = F.coalesce("catch_expected", F.lit("ok"))
    scoreable = ~F.col("is_catch") & F.col("label").isin("ok", "bad") & F.col("tone_i2").isNotNull()
    native = ~F.col("is_catch") & (F.col("source") == "native") & F.col("label").isin("ok", "bad")
    return j.groupBy("rater").agg(
        F.count_if("is_catch").alias("catch_total"),
        F.count_if(F.col("is_catch") & (F.col("label") == expected)).alias("catch_ok"),
        F.count_if(native).alias("native_total"),
        F.count_if(native & (F.col("label") == "ok")).alias("native_ok"),
        F.count_if(~F.col("is_catch") & (F.col("label") == "unsure")).alias("unsure"),
        F.count_if(scoreable).alias("scoreable"),
    )


def rater_gate(tallies: DataFrame) -> DataFrame:
    """kept: enough catches seen and passed; status of the rater."""
    kept = (F.col("catch_total") >= CATCH_LEAST) & (F.col("catch_ok") >= CATCH_LEAST)
    anchor = S.share(F.col("native_ok"), F.col("native_total"))
    status = F.when(~kept, "FAILED CATCHES").when(F.col("scoreable") < SCOREABLE_LEAST, "NO SCOREABLE PILOT").when(~S.at_least(anchor, ANCHOR_GATE), "ANCHOR LOW").otherwise("OK")
    return tallies.withColumns({"kept": kept, "anchor": anchor, "status": status})


def ab_tallies(answers: DataFrame, keymap: DataFrame) -> DataFrame:
    """Trials won by the correct twin, ties out, and catches, of each rater. keymap(item_id, correct_side, is_catch, expect_pick)."""
    j = answers.join(keymap, "item_id").withColumn("pick", F.upper("label"))
    said = F.col("pick").isin("A", "B")
    return j.groupBy("rater").agg(
        F.count_if(F.col("is_catch")).alias("catch_total"),
        F.count_if(F.col("is_catch") & (F.col("pick") == F.col("expect_pick"))).alias("catch_ok"),
        F.count_if(~F.col("is_catch") & said).alias("trials"),
        F.count_if(~F.col("is_catch") & said & (F.col("pick") == F.col("correct_side"))).alias("wins"),
        F.count_if(~F.col("is_catch") & (F.col("label") == "unsure")).alias("unsure"),
    )


def ab_gate(tallies: DataFrame) -> DataFrame:
    """kept raters and, for each, the Wilson interval and the exact test of its wins."""
    kept = S.at_least(S.share(F.col("catch_ok"), F.col("catch_total")), AB_CATCH_SHARE)
    w = S.wilson(F.col("wins"), F.col("trials"))
    status = F.when(~kept, "FAILED CATCHES").when(F.col("trials") < AB_TRIALS, "NO SCOREABLE PILOT").otherwise("OK")
    return tallies.select("*", kept.alias("kept"), w["p"].alias("share"), w["lo"].alias("lo"), w["hi"].alias("hi"), S.binom_two_sided(F.col("wins"), F.col("trials")).alias("p_value"), status.alias("status"))


def oracle_summary(rows: DataFrame, full_k: float) -> DataFrame:
    """Of oracle rows(kind, k, meter, detected, false_flips, ff_total, flipped): per meter, detection by k and at full_k (or the largest k), false flips, flips and control trips. ``oracle.trend`` adds whether detection rises."""
    flip, control = F.col("kind") == "flip", F.col("kind") == "control"
    ks = rows.where(flip).groupBy("meter", "k").agg(F.avg(F.col("detected").cast("double")).alias("rate"))
    strong = ks.groupBy("meter").agg(F.coalesce(F.max(F.when(F.col("k") == full_k, F.col("rate"))), F.max_by("rate", "k")).alias("strong_detect"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "rate")))).alias("detect_by_k"))
    sums = rows.groupBy("meter").agg(
        F.count_if(flip).alias("n_flips"),
        S.share(F.sum(F.when(flip, F.col("false_flips"))), F.sum(F.when(flip, F.col("ff_total")))).alias("false_flip_rate"),
        S.share(F.count_if(control & F.col("flipped")), F.count_if(control)).alias("control_trip"),
    )
    return sums.join(strong, "meter", "left")


def by_k(column: str) -> Column:
    """Detection by k as text, k=rate in order of k, six decimals."""
    each = F.transform(F.map_entries(column), lambda e: F.concat(F.format_string("%.2f", e["key"].cast("double")), F.lit("="), F.format_string("%.6f", e["value"])))
    return F.array_join(F.array_sort(each), ";")


def judged_pairs(answers: DataFrame, keymap: DataFrame) -> DataFrame:
    """rater, pair_id and correct (1 if the rater picked the correct twin) of trials with a pick, catches left out."""
    pick = F.upper(F.trim("label"))
    j = answers.join(keymap.where(~F.col("is_catch")).select("item_id", "pair_id", "correct_side"), "item_id").where(pick.isin("A", "B"))
    return j.select("rater", "pair_id", (pick == F.col("correct_side")).cast("int").alias("correct"))


def pooled(rows: DataFrame, raters: DataFrame) -> DataFrame:
    """The rows of kept raters."""
    return rows.join(raters.where("kept").select("rater"), "rater", "left_semi")


def scored_items(answers: DataFrame, keymap: DataFrame, tau: float) -> DataFrame:
    """rater, item_id, human, tone_i2 and metric (tone_i2 at tau or more) of judged items with a score, catches left out."""
    human = judgement(F.col("label"))
    j = answers.join(keymap.where(~F.col("is_catch") & F.col("tone_i2").isNotNull()).select("item_id", "tone_i2"), "item_id")
    return j.select("rater", "item_id", human.alias("human"), "tone_i2", (F.col("tone_i2") >= tau).cast("int").alias("metric")).where(F.col("human").isNotNull())


def pilot_result(answers: DataFrame, keymap: DataFrame, tau: float, n_rep: int = 2000, seed: int = 4242) -> DataFrame:
    """One row: kept raters, pooled items and natives; AUROC, r and kappa with limits; gate and verdict. Raters who miss the catches are left out."""
    tables = Tables(answers.sparkSession, "pilot")
    answers = tables.put("answers", answers)
    tallies = tables.put("tallies", rater_gate(rater_tallies(answers, keymap)))
    kept = tallies.where("kept").agg(F.count("*").alias("n_kept"), F.coalesce(F.sum("native_ok"), F.lit(0)).alias("native_ok"), F.coalesce(F.sum("native_total"), F.lit(0)).alias("native_total"))
    items = tables.put("items", pooled(scored_items(answers, keymap, tau), tallies))
    n = items.agg(F.count("*").alias("n_scored"))
    values = tables.put("values", resample.item_bootstrap(items, "tone_i2", "human", n_rep, seed, "metric"))
    out = kept.crossJoin(F.broadcast(n))
    for stat in ("auroc", "r", "kappa"):
        one = resample.interval(values, stat).select(F.col("point").alias(stat), F.col("lo").alias(f"{stat}_lo"), F.col("hi").alias(f"{stat}_hi"))
        out = out.join(F.broadcast(one), how="left")  # one row
    w = S.wilson(F.col("native_ok"), F.col("native_total"))
    return out.select("*", w["p"].alias("anchor"), w["lo"].alias("anchor_lo"), w["hi"].alias("anchor_hi")).withColumn("verdict", pilot_verdict())


def pilot_verdict() -> Column:
    """The metric is valid if AUROC reaches its gate; only raters who know the natives can say so."""
    return (
        F.when((F.col("n_kept") == 0) | (F.col("n_scored") < SCOREABLE_LEAST), "NO SCOREABLE PILOT")
        .when(~S.at_least(F.col("anchor"), ANCHOR_GATE), "RATER GATE FAILED")
        .when(S.at_least(F.col("auroc"), AUROC_GATE), "PASS")
        .otherwise("INCONCLUSIVE")
    )


def ab_result(answers: DataFrame, keymap: DataFrame, n_rep: int = 2000, seed: int = 4242) -> DataFrame:
    """One row: pooled trials of kept raters, how many were right with limits and exact test, and AUROC and r of the frozen margin against being right, with limits."""
    from .metrics import margins

    kept = ab_gate(ab_tallies(answers, keymap))
    trials = pooled(judged_pairs(answers, keymap), kept).join(margins(keymap), "pair_id")
    values = Tables(answers.sparkSession, "pilot").put("values", resample.item_bootstrap(trials, "margin", "correct", n_rep, seed))
    out = trials.agg(F.count("*").alias("n_scored"), F.coalesce(F.sum("correct"), F.lit(0)).alias("n_correct"))
    for stat in ("auroc", "r"):
        one = resample.interval(values, stat).select(F.col("point").alias(stat), F.col("lo").alias(f"{stat}_lo"), F.col("hi").alias(f"{stat}_hi"))
        out = out.join(F.broadcast(one), how="left")  # one row
    w = S.wilson(F.col("n_correct"), F.col("n_scored"))
    status = F.when(F.col("n_scored") < AB_TRIALS, "NO SCOREABLE PILOT").otherwise("OK")
    return out.select("*", w["p"].alias("share"), w["lo"].alias("share_lo"), w["hi"].alias("share_hi"), S.binom_two_sided(F.col("n_correct"), F.col("n_scored")).alias("p_value"), status.alias("status"))
