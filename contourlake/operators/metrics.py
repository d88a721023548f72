"""Population metrics over tbu(clip_id, tbu_idx, target, pred): counts first, ratios of counts last.

A NULL pred is an abstention. Each function takes optional key columns and
gives one result per key; everything is one partial-aggregated groupBy over
counts, so a class or clip of any size costs a row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .running import running

TONES = ("H", "M", "L")


def class_stats(tbu: DataFrame, keys: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Support, covered, correct, recall and coverage of each target class. n: the column of how many units a row stands for; without it, one."""
    of = (lambda held: F.count_if(held)) if n is None else (lambda held: F.sum(F.when(held, F.col(n)).otherwise(0)))
    return (
        tbu.where(F.col("target").isin(*TONES))
        .groupBy(*keys, "target")
        .agg(of(F.lit(True)).alias("support"), of(F.col("pred").isNotNull()).alias("covered"), of(F.col("pred") == F.col("target")).alias("correct"))
        .withColumns({"recall": S.share(F.col("correct"), F.col("covered")), "coverage": S.share(F.col("covered"), F.col("support"))})
    )


def confusion(tbu: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of n for each target and pred that occur, abstentions left out."""
    return tbu.where(F.col("target").isin(*TONES) & F.col("pred").isin(*TONES)).groupBy(*keys, "target", "pred").agg(F.count("*").alias("n"))


def cells(tbu: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n units of each target and pred, abstentions among them: all that population needs."""
    return tbu.groupBy(*keys, "target", "pred").agg(F.count("*").alias("n"))


def population(tbu: DataFrame, keys: Sequence[str] = (), n: str | None = None) -> DataFrame:
    """Balanced accuracy (mean recall over classes with covered units), micro accuracy and coverage. n as in class_stats."""
    return class_stats(tbu, keys, n).groupBy(*keys).agg(
        F.avg("recall").alias("balanced_acc"),
        S.share(F.sum("correct"), F.sum("covered")).alias("micro_acc"),
        S.share(F.sum("covered"), F.sum("support")).alias("coverage"),
        F.sum("covered").alias("n_covered"),
        F.sum("support").alias("n_tbu"),
    )


def weighted_f1(tbu: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """F1 of each class weighted by its covered units; an empty class has F1 0."""
    cells = confusion(tbu, keys)
    both = cells.select(*keys, F.explode(F.array(F.struct(F.col("target").alias("tone"), F.lit("t").alias("side")), F.struct(F.col("pred").alias("tone"), F.lit("p").alias("side")))).alias("s"), "target", "pred", "n")
    per = both.groupBy(*keys, F.col("s.tone").alias("tone")).agg(
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when((F.col("s.side") == "t") & (F.col("target") == F.col("pred")), F.col("n")).otherwise(0)).alias("hit"),
    )
    f1 = F.coalesce(S.share(2 * F.col("hit"), F.col("actual") + F.col("said")), F.lit(0.0))
    return per.groupBy(*keys).agg(F.coalesce(S.share(F.sum(f1 * F.col("actual")), F.sum("actual")), F.lit(0.0)).alias("weighted_f1"))


def pair_kappa(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = (), classes: Sequence[str] = TONES) -> DataFrame:
    """Cohen's kappa of columns a and b. Pairs of which a side is in none of the classes count in n alone: they neither agree nor are in the marginals."""
    n = F.count("*").cast("double")
    known = F.col(a).isin(*classes) & F.col(b).isin(*classes)
    agree = S.share(F.count_if(known & (F.col(a) == F.col(b))), n)
    chance = sum((S.share(F.count_if(known & (F.col(a) == c)), n) * S.share(F.count_if(known & (F.col(b) == c)), n) for c in classes), F.lit(0.0))
    out = pairs.groupBy(*keys).agg(F.count("*").alias("n"), agree.alias("agree"), chance.alias("chance"))
    return out.withColumn("kappa", F.when(F.col("n") > 0, S.kappa(F.col("agree"), F.col("chance")))).drop("agree", "chance")


def kappa_vs_target(tbu: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pair_kappa(tbu.where(F.col("pred").isNotNull()), "pred", "target", keys)


def binary_kappa(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Kappa of two 0/1 columns from their means."""
    x = pairs.select(a.cast("double").alias("a"), b.cast("double").alias("b")).agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return x.select("n", F.when(F.col("n") > 0, S.kappa(F.col("po"), pe)).alias("kappa"))


def by_subset(tbu: DataFrame, kind: str) -> DataFrame:
    """Population metrics of each kind and of ALL, in one pass of grouping sets."""
    flat = tbu.where(F.col("target").isin(*TONES)).select(F.col(kind).alias("kind"), "target", "pred")
    counts = flat.groupBy("kind", "target").agg(F.count("*").alias("support"), F.count("pred").alias("covered"), F.count_if(F.col("pred") == F.col("target")).alias("correct"))
    both = counts.groupingSets([["kind", "target"], ["target"]], "kind", "target").agg(F.sum("support").alias("support"), F.sum("covered").alias("covered"), F.sum("correct").alias("correct"), F.grouping("kind").alias("all"))
    named = both.withColumn("subset", F.when(F.col("all") == 1, "ALL").otherwise(F.col("kind")))
    return named.groupBy("subset").agg(F.avg(S.share(F.col("correct"), F.col("covered"))).alias("tone_i2"), S.share(F.sum("covered"), F.sum("support")).alias("coverage"), F.sum("covered").alias("n"))


def clip_means(clips: DataFrame, kind: str, means: Sequence[str], least: Sequence[str] = ()) -> DataFrame:
    """Of each kind and of ALL: the means of clip columns, missing values left out, and the least of some."""
    aggs = [F.avg(c).alias(c) for c in means] + [F.min(c).alias(f"{c}_least") for c in least]
    both = clips.groupingSets([[kind], []], kind).agg(*aggs, F.grouping(kind).alias("_all"))
    return both.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(kind)).alias("subset"), *means, *(f"{c}_least" for c in least))


def against(rows: DataFrame, key: str, base: str, columns: dict[str, str]) -> DataFrame:
    """rows, one per condition, with each column's difference from the base condition's under a new name."""
    own = rows.where(F.col(key) == base).select(*(F.col(c).alias(f"_{c}") for c in columns))  # one row
    out = rows.crossJoin(F.broadcast(own)).withColumns({new: F.col(c) - F.col(f"_{c}") for c, new in columns.items()})
    return out.drop(*(f"_{c}" for c in columns))


def dose_response(rows: DataFrame, dose: str, value: str, error: str, slack: float = 0.03) -> DataFrame:
    """Of a row per dose: whether the value never rises by more than the slack, its correlation with the dose, and the error's."""
    s = rows.withColumn("_next", F.lead(value).over(Window.orderBy(dose)))  # a row per dose
    x = F.col(dose).cast("double")
    return s.agg(F.count("*").alias("n"), F.bool_and(F.col("_next").isNull() | (F.col("_next") <= F.col(value) + slack)).alias("monotone"), S.pearson(x, F.col(value)).alias("r"), S.pearson(x, F.col(error)).alias("r_cer"), F.avg(error).alias("mean_cer"))


def pooled_by(tbu: DataFrame, key: str, least: int = 20) -> DataFrame:
    """tone_i2 of each key with at least so many scored units."""
    scored = tbu.where(F.col("pred").isNotNull())
    return population(scored, [key]).where(F.col("n_covered") >= least).select(key, F.col("balanced_acc").alias("tone_i2"), F.col("n_covered").alias("n"))


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks with ties at their mean. Distinct values with their counts are ranked by running totals, so ties, however many, are one row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_ties"))
    ranked = running(counts, F.col("_ties"), value, out="_before")
    return rows.join(ranked.select(value, (F.col("_before") + (F.col("_ties") + 1) / 2).alias(out)), value)


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks; NULL unless both classes occur."""
    counts = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = running(counts, F.col("n"), score).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    pos, n = F.sum("pos").cast("double"), F.sum("n").cast("double")
    u = F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2
    return ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.try_divide(u, pos * (n - pos)).alias("auroc"))


def point_biserial(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Pearson's r of a score and a 0/1 label; NULL for fewer than two rows or no spread."""
    x = rows.agg(F.count("*").alias("n"), F.stddev_pop(score).alias("sx"), F.stddev_pop(F.col(label).cast("double")).alias("sy"), S.pearson(F.col(score), F.col(label).cast("double")).alias("r"))
    return x.select("n", F.when((F.col("n") >= 2) & (F.col("sx") >= 1e-12) & (F.col("sy") >= 1e-12), F.col("r")).alias("r"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks."""
    both = average_ranks(average_ranks(rows.select(x, y), x, "_rx"), y, "_ry")
    out = both.agg(F.count("*").alias("n"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy"), S.pearson("_rx", "_ry").alias("rho"))
    return out.select("n", F.when((F.col("n") >= 2) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("rho")).alias("rho"))


def cocovered(a: DataFrame, b: DataFrame) -> DataFrame:
    """pred_a and pred_b of units that both instruments cover, from clips whose targets agree in number and order."""
    sides = a.select("clip_id", "tbu_idx", "target", "pred", F.lit(0).alias("side")).unionByName(b.select("clip_id", "tbu_idx", "target", "pred", F.lit(1).alias("side")))
    of = lambda c, k: F.max(F.when(F.col("side") == k, F.col(c)))
    pairs = sides.repartition("clip_id").groupBy("clip_id", "tbu_idx").agg(F.count("*").alias("_n"), of("target", 0).alias("target"), of("target", 1).alias("_tb"), of("pred", 0).alias("pred_a"), of("pred", 1).alias("pred_b"))
    same = F.bool_and((F.col("_n") == 2) & F.coalesce(F.col("target") == F.col("_tb"), F.lit(False))).over(Window.partitionBy("clip_id"))
    return pairs.withColumn("_same", same).where(F.col("_same") & F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull()).select("clip_id", "tbu_idx", "target", "pred_a", "pred_b")


def paired_win_rate(pairs: DataFrame, correct: str, flipped: str) -> DataFrame:
    """Share of pairs in which the correct twin scores higher, ties half, and the sign test without ties."""
    wins, losses = F.count_if(F.col(correct) > F.col(flipped)), F.count_if(F.col(correct) < F.col(flipped))
    x = pairs.where(F.col(correct).isNotNull() & F.col(flipped).isNotNull()).agg(F.count("*").alias("n"), wins.alias("wins"), losses.alias("losses"), F.avg(F.col(correct) - F.col(flipped)).alias("mean_margin"))
    return x.select("n", "wins", "losses", S.share(F.col("wins") + 0.5 * (F.col("n") - F.col("wins") - F.col("losses")), F.col("n")).alias("win_rate"), S.sign_test(F.col("wins"), F.col("losses")).alias("sign_p"), "mean_margin")


def spread(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], sample: bool) -> DataFrame:
    """Mean, deviation (sample: 0 for one row; else of the population), standard error, least and greatest of each metric per key."""
    long = rows.select(*keys, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", "value"))
    dev = F.coalesce(F.stddev_samp("value"), F.lit(0.0)) if sample else F.stddev_pop("value")
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), dev.alias("std"), (dev / F.sqrt(F.count("value").cast("double"))).alias("sem"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def band_overlap(stats: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Whether the bands mean +- std of two named runs overlap; one row, overlap NULL if a run is missing. stats: a row per run, with mean and std."""
    of = lambda name, c: F.max(F.when(F.col(key) == name, c))
    lo, hi = F.col("mean") - F.col("std"), F.col("mean") + F.col("std")
    x = stats.agg(of(a, lo).alias("la"), of(a, hi).alias("ha"), of(b, lo).alias("lb"), of(b, hi).alias("hb"))
    return x.select(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), ((F.col("la") <= F.col("hb")) & (F.col("lb") <= F.col("ha"))).alias("overlap"))


def band_overlaps(stats: DataFrame, key: str) -> DataFrame:
    """Whether the bands mean +- std overlap, of each two runs once, run_a before run_b. stats: a row per run, with mean and std."""
    a, b = (stats.select(F.col(key).alias(f"run_{s}"), (F.col("mean") - F.col("std")).alias(f"_l{s}"), (F.col("mean") + F.col("std")).alias(f"_h{s}")) for s in "ab")
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", ((F.col("_la") <= F.col("_hb")) & (F.col("_lb") <= F.col("_ha"))).alias("overlap"))


def paired_blocks(keymap: DataFrame, blocks: Sequence[str] = ("frozen", "deployed")) -> DataFrame:
    """The paired win rate of each block of scores, over keymap(is_catch, tone_i2_<block>_correct, tone_i2_<block>_flipped) without catches."""
    pairs = [F.struct(F.lit(b).alias("block"), F.col(f"tone_i2_{b}_correct").alias("c"), F.col(f"tone_i2_{b}_flipped").alias("f")) for b in blocks]
    long = keymap.where(~F.col("is_catch")).select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(F.col("c").isNotNull() & F.col("f").isNotNull())
    x = long.groupBy("block").agg(F.count("*").alias("usable"), F.count_if(F.col("c") > F.col("f")).alias("wins"), F.count_if(F.col("c") < F.col("f")).alias("losses"), F.count_if(F.col("c") == F.col("f")).alias("ties"))
    return x.select("block", "usable", "wins", "losses", "ties", S.share(F.col("wins") + 0.5 * F.col("ties"), F.col("usable")).alias("win_rate"), S.sign_test(F.col("wins"), F.col("losses")).alias("sign_p"))


def margins(keymap: DataFrame, block: str = "frozen") -> DataFrame:
    """pair_id and margin (correct less flipped) of the pairs that have both scores."""
    m = F.col(f"tone_i2_{block}_correct") - F.col(f"tone_i2_{block}_flipped")
    return keymap.where(~F.col("is_catch")).select("pair_id", m.alias("margin")).where(F.col("margin").isNotNull())


def ordered(rows: DataFrame, *, ascending: Sequence[str] = (), descending: Sequence[str] = ()) -> DataFrame:
    """rows for print: by some columns ascending, then by others descending, missing values last."""
    return rows.orderBy(*(F.col(c).asc_nulls_last() for c in ascending), *(F.col(c).desc_nulls_last() for c in descending))


def grid(*tables: DataFrame, most: int = 1 << 20) -> DataFrame:
    """All combinations of parameter tables (seeds, budgets, factors, ks), which must be at most so many."""
    n = 1
    for t in tables:
        n *= t.count()
    if n > most:
        raise ValueError(f"{n} combinations are over {most}; join by a key instead")
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)
    return out
