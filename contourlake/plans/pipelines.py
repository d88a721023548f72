"""Composite pipelines: from clips, manifests or units to the tables that a study reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..leaves import backend
from ..operators import conditions, gates, metrics, probe, resample, selection, signal
from ..sources import writers
from ..storage import Tables


def scored_clips(clips: DataFrame, kind: type[backend.Backend] = backend.Backend, theta_h: float = signal.THETA_H, theta_l: float = signal.THETA_L, mids: DataFrame | None = None, trained: probe.Probe | None = None, voices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of clips(clip_id, kind, text, content): a row of measures per clip, and their units. Audio is heard once; cer, pitch, latents and voice come from the same row.

    i1 and i1_cov are accuracy and coverage of the probe, ssim the similarity to
    the voice that voices(clip_id, voice) wants; NULL without probe or voices.
    """
    pre = Tables(clips.sparkSession, "precomputed").put("clips", backend.precompute(clips, kind))
    units = signal.score_tone(backend.frames_of(pre), backend.windows_of(pre), theta_h=theta_h, theta_l=theta_l, mid_ref=mids)
    own = signal.clip_scores(units)
    info = clips.select(F.col("clip_id").cast("string"), "kind", "text")
    rows = pre.select("clip_id", "status", "method", "seconds", "hyp", "voice").join(info, "clip_id").join(own, "clip_id", "left")
    none = F.lit(None).cast("double")
    if trained is None:
        rows = rows.withColumns({"i1": none, "i1_cov": none})
    else:
        rows = rows.join(probe.probe_score(pre, trained).select("clip_id", F.col("accuracy").alias("i1"), F.col("coverage").alias("i1_cov")), "clip_id", "left")
    if voices is None:
        rows = rows.withColumn("ssim", none)
    else:
        wanted = voices.select(F.col("clip_id").cast("string"), F.col("voice").alias("_wanted"))
        rows = rows.join(wanted, "clip_id", "left").withColumn("ssim", signal.ssim(F.col("voice"), F.col("_wanted")))
    out = rows.select("clip_id", "kind", "status", "method", X.cer(F.col("text"), F.col("hyp")).alias("cer"), S.len_ratio(F.col("seconds"), F.col("text")).alias("len_ratio"), "i1", "i1_cov", "ssim", "accuracy", "coverage", "n_scored", "n_tbu")
    return out, units.join(info.select("clip_id", "kind"), "clip_id")


def eval_point(clips: DataFrame, kind: type[backend.Backend] = backend.Backend, trained: probe.Probe | None = None, voices: DataFrame | None = None) -> DataFrame:
    """Per kind and for ALL: pooled tone_i2, coverage and the means of error rate, length ratio, the probe's accuracy and coverage and the voice's similarity, of which the least, too."""
    rows, units = scored_clips(clips, kind, trained=trained, voices=voices)
    return metrics.by_subset(units, "kind").join(metrics.clip_means(rows, "kind", ["cer", "len_ratio", "i1", "i1_cov", "ssim"], ["ssim"]), "subset")


def native_anchor(units: DataFrame, n_rep: int = 1000, seed: int = 0) -> DataFrame:
    """tone_i2 of native clips with the limits of a bootstrap over clips, the number of clips and of scored units."""
    covered = units.where(F.col("pred").isNotNull())
    size = covered.agg(F.count_distinct("clip_id").alias("clips"), F.count("*").alias("n"))
    return resample.bootstrap(resample.clip_counts(covered), resample.balanced(), n_rep, seed, 0.025, 0.975).crossJoin(F.broadcast(size))


def answer_key_oracle(units: DataFrame, n_rep: int = 1000, seeds: int = 25, seed: int = 0) -> DataFrame:
    """What the meter says with the right key, the key with H and L exchanged, and shuffled keys: with predictions fixed, only the key moves.

    Each part is counted by itself, one after the other, and written as a few
    rows; so the driver never holds the plans and the running stages of all.
    """
    tables = Tables(units.sparkSession, "answers")
    units = tables.put("units", units.select("clip_id", "tbu_idx", "target", "pred"))
    own = tables.put("own", metrics.cells(units))
    moved = tables.put("moved", metrics.cells(resample.permuted_targets(units, *range(seeds)), ["seed"]))
    delta = tables.put("delta", resample.bootstrap(resample.clip_counts(units), resample.balanced() - resample.swapped_balanced(), n_rep, seed, 0.025, 0.975))
    keys = {"right": own, "swapped": resample.swap_high_low(own), "high_low": resample.only_high_low(own)}
    every = reduce(DataFrame.unionByName, (cells.select(F.lit(name).alias("key"), F.lit(0).alias("seed"), *own.columns) for name, cells in keys.items()), moved.select(F.lit("floor").alias("key"), "seed", *own.columns))
    at = lambda name: F.when(F.col("key") == name, F.col("balanced_acc"))
    found = metrics.population(every, ["key", "seed"], "n").agg(*(F.max(at(name)).alias(name) for name in keys), F.avg(at("floor")).alias("floor"), F.stddev_pop(at("floor")).alias("floor_std"))
    return found.crossJoin(F.broadcast(delta.select(F.col("point").alias("delta"), F.col("lo").alias("delta_lo"), F.col("hi").alias("delta_hi"))))  # one row each


def condition_table(frames: DataFrame, windows: DataFrame, names: Sequence[str] | None = None, base: str = "original") -> DataFrame:
    """tone_i2 under each condition and its difference from the base."""
    f, w = conditions.applied(frames, windows, names)
    units = signal.score_tone(f, w).where(F.col("pred").isNotNull())
    pop = metrics.population(units.withColumn("condition", conditions.of()), ["condition"]).select("condition", F.col("balanced_acc").alias("tone_i2"), "n_covered")
    return metrics.against(pop, "condition", base, {"tone_i2": "d_tone"})


def dataset(manifest: DataFrame, holdouts: DataFrame, hours: float, dev_hours: float, lo: float, hi: float, seed: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Training and dev rows of a manifest: usable clips without held-out texts, dev first in the hashed order, then training up to its hours."""
    good = selection.without_holdouts(selection.usable(manifest, lo, hi), holdouts)
    dev = selection.budget_prefix(good, [dev_hours * 3600], "duration_sec", seed, key).drop("budget")
    rest = selection.remainder(good, dev, key)
    return selection.budget_prefix(rest, [hours * 3600], "duration_sec", seed, key).drop("budget"), dev


def one_budget(manifest: DataFrame, holdouts: DataFrame, budget_hours: float, path: str, seed: int, lo: float = 1.0, hi: float = 20.0, epochs: int = 10, clips_per_step: float = 41.3) -> DataFrame:
    """Writes a budget's training manifest; clips, hours and steps of the training that reads it."""
    train, _ = dataset(manifest, holdouts, budget_hours, 0.0, lo, hi, seed)
    rows = train.select("id", F.col("audio_s3_key").alias("audio_path"), "text", F.lit("yo").alias("language_id"), F.col("duration_sec").alias("duration"))
    writers.training_manifest(rows, path)
    return train.agg(F.count("*").alias("clips"), (F.sum("duration_sec") / 3600).alias("hours")).withColumn("steps", S.training_steps(F.col("clips"), epochs, clips_per_step))


def select_native(manifest: DataFrame, lo: float, hi: float, per_speaker: int, n: int, seed: int, key: str = "id") -> DataFrame:
    """n usable native clips in a hashed order, at most so many of a speaker."""
    return selection.sampled(selection.capped(selection.usable(manifest, lo, hi), "speaker_id", per_speaker, S.hash_number(F.lit(seed), F.col(key)), key), n, seed, key)


def pilot_kit(natives: DataFrame, models: DataFrame, wrong: DataFrame, seed: int, labels: Sequence[str] = ("ok", "bad", "unsure")) -> tuple[DataFrame, DataFrame, str]:
    """The kit's items in a hashed order with their numbers, its withheld key as one JSON row, and the form. natives, models, wrong(clip_id, text, audio, tone_i2 ...); wrong gives the catches, whose right answer is bad."""
    items = selection.item_ids(selection.kit_items(natives, models, wrong.withColumn("catch_expected", F.lit("bad"))), seed, "clip_id")
    items = Tables(natives.sparkSession, "kit").put("items", items)
    key = writers.keymap_json(items.drop("audio"))
    return items, key, writers.form(items.select("item_id", "text", writers.data_uri(F.col("audio")).alias("audio")).orderBy("item_id"), labels, "Listening test")


def verdicts(wide: DataFrame, required: Sequence[str]) -> DataFrame:
    """The gates' checks of each instrument, with the verdict over the required ones on each row."""
    return gates.tone_gate(wide).crossJoin(F.broadcast(gates.tone_gate_verdict(wide, required)))
