"""Choosing rows: holdouts, caps, budgets, shuffles, samples and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from .running import numbered, running


def usable(manifest: DataFrame, lo: float, hi: float, dur: str = "duration_sec", text: str = "text", key: str | None = None) -> DataFrame:
    """Rows with a duration in the closed band, some text and a key that is not empty."""
    out = manifest.where(F.col(dur).between(lo, hi) & (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0))
    return out if key is None else out.where(F.length(F.coalesce(F.col(key), F.lit(""))) > 0)


def first_usable(columns: Sequence[str]) -> Column:
    """The first of the columns that is neither missing nor empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def without_holdouts(rows: DataFrame, holdouts: DataFrame, text: str = "text", held: str = "text") -> DataFrame:
    """Rows whose normalised text is in no holdout."""
    keys = holdouts.select(T.norm_key(F.col(held)).alias("_key")).distinct()
    return rows.withColumn("_key", T.norm_key(F.col(text))).join(keys, "_key", "left_anti").drop("_key")


def budget_prefix(rows: DataFrame, budgets: Sequence[float], dur: str, seed: int, key: str) -> DataFrame:
    """budget and the rows of each: a prefix of one hashed order, up to and with the row that crosses it. Larger budgets hold smaller ones."""
    summed = running(rows, F.col(dur), S.hash_number(F.lit(seed), F.col(key)), key, out="_b")
    return summed.withColumn("budget", F.explode(F.array(*(F.lit(float(b)) for b in budgets)))).where(F.col("_b") < F.col("budget")).drop("_b")


def remainder(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """The rows whose key was not taken: the pool after a prefix."""
    return rows.join(taken.select(key).distinct(), key, "left_anti")


def capped(rows: DataFrame, by: str, cap: int, *order: str) -> DataFrame:
    """At most cap rows of each key, the first in the order."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    return rows.orderBy(S.hash_number(F.lit(seed), F.col(key)), key)


def sampled(rows: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows without replacement: the least hashes."""
    return shuffled(rows, seed, key).limit(k)


def dominant(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the most frequent key, the first of equals."""
    top = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(1)
    return rows.join(F.broadcast(top.select(key)), key, "left_semi")


def eligible_flips(scored: DataFrame, most: int) -> DataFrame:
    """H and L units with a window that every instrument reads right on the clean clip, at most so many per clip. scored(clip_id, tbu_idx, instrument, target, pred, t0)."""
    ok = scored.where(F.col("target").isin("H", "L") & F.col("t0").isNotNull()).groupBy("clip_id", "tbu_idx", "target").agg(F.bool_and(F.coalesce(F.col("pred") == F.col("target"), F.lit(False))).alias("ok"))
    return capped(ok.where("ok").drop("ok"), "clip_id", most, "tbu_idx")


def salience(flipped_st: Column, correct_st: Column, residual: Column, mid_ref: Column, pred: Column, expect: Column, theta_h: float = 1.0, theta_l: float = 1.0, least: float = 3.0) -> Column:
    """Struct of an edit's realised semitones, and whether it moved enough, landed in the band that was meant, was read so, and all three; missing is no."""
    moved = F.abs(flipped_st - correct_st)
    band = F.when(expect == "H", residual >= mid_ref + theta_h).otherwise(residual <= mid_ref - theta_l)
    parts = {"delta_ok": moved >= least, "band_ok": band, "pred_ok": pred == expect}
    sure = {k: F.coalesce(v, F.lit(False)) for k, v in parts.items()}
    return F.struct(moved.alias("realized_st"), *(v.alias(k) for k, v in sure.items()), (sure["delta_ok"] & sure["band_ok"] & sure["pred_ok"]).alias("passed"))


def item_ids(rows: DataFrame, seed: int, key: str, form: str = "item%02d") -> DataFrame:
    """item_id in a hashed order from 1."""
    return numbered(rows, S.hash_number(F.lit(seed), F.col(key)), key, out="_k").withColumn("item_id", F.format_string(form, F.col("_k") + 1)).drop("_k")


def round_robin(catches: DataFrame, natives: DataFrame, catch_key: str, native_key: str) -> DataFrame:
    """Each catch item with the native clip at its place modulo their number."""
    n = numbered(natives.select(native_key), native_key, out="_k")
    size = natives.agg(F.count("*").alias("_n"))  # one row
    c = numbered(catches, catch_key, out="_i").crossJoin(F.broadcast(size))
    return c.withColumn("_k", F.col("_i") % F.col("_n")).join(n, "_k").drop("_k", "_i", "_n")


def random_side(seed: int, key: Column) -> Column:
    """A or B for the correct twin."""
    return F.when(S.hash_number(F.lit(seed), key) % 2 == 0, "A").otherwise("B")


def best_by(rows: DataFrame, metric: str, tag: str) -> DataFrame:
    """The row's tag with the highest metric, of equals the tag that sorts first; rows without the metric are left out."""
    return rows.where(F.col(metric).isNotNull()).agg(F.min_by(tag, F.struct((-F.col(metric)).alias("m"), F.col(tag).alias("t"))).alias(tag), F.max(metric).alias(metric))


def first_passing(rows: DataFrame, by: str, passed: str, *order: str | Column) -> DataFrame:
    """The first row of each key, in the order, that passed; a key without one has no row."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.where(F.col(passed)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def anchored(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """Curve points with fixed anchors, columns that one side lacks being missing."""
    return points.unionByName(anchors, allowMissingColumns=True)


def kit_items(natives: DataFrame, models: DataFrame, catches: DataFrame) -> DataFrame:
    """All items of a listening kit with their kind, columns that a part lacks being missing."""
    parts = [natives.withColumns({"source": F.lit("native"), "is_catch": F.lit(False)}), models.withColumns({"source": F.lit("model"), "is_catch": F.lit(False)}), catches.withColumn("is_catch", F.lit(True))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def train_and_dev(rows: DataFrame, dev: DataFrame, largest: DataFrame, key: str) -> DataFrame:
    """What must be at hand for a sweep: the largest training set and the dev set, once each."""
    wanted = largest.select(key).unionByName(dev.select(key)).distinct()
    return rows.join(wanted, key, "left_semi")


def with_paths(rows: DataFrame, paths: DataFrame, key: str = "id") -> DataFrame:
    """rows with the local path of each, for those that have one. paths(key, path)."""
    return rows.join(paths.select(key, "path"), key)


def probe_lines(words: DataFrame, carriers: DataFrame, long_lines: DataFrame, seed: int) -> DataFrame:
    """id, kind, text: long lines in a hashed order, then each word in the carriers in turn. words(id, text), carriers(k, template), long_lines(id, text), which may be empty."""
    size = carriers.agg(F.count("*").alias("_n"))  # one row
    numbered_words = numbered(words, "id", out="_i").crossJoin(F.broadcast(size)).withColumn("k", F.col("_i") % F.col("_n"))
    filled = numbered_words.join(carriers.select(F.col("k").cast("long").alias("k"), "template"), "k").select("id", F.lit("minpair").alias("kind"), T.fill_carrier(F.col("template"), F.col("text")).alias("text"))
    long = long_lines.select("id", F.lit("long").alias("kind"), "text")
    return long.unionByName(filled).orderBy(F.when(F.col("kind") == "long", 0).otherwise(1), S.hash_number(F.lit(seed), F.col("id")), "id")
