"""Readers. Schemas are fixed, so nothing is inferred and unused columns are pruned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pilot import answer_rows
from ..operators.selection import first_usable

MANIFEST = "id string, text string, source string, speaker_id string, duration_sec double, audio_s3_key string"
MINIMAL_PAIRS = "carriers array<struct<template: string, gloss: string, verified: boolean>>, sets array<struct<base: string, items array<struct<text: string, tones: string, gloss: string, verified: boolean>>>>"
CALIBRATION = "theta_h double, theta_l double, mode string, late_frac double"
KEY = "clip_id string, source string, intended_text string, tone_i2 double, coverage double, n_pairs int, is_catch boolean, catch_expected string"
AB_KEY = "pair_id string, intended_text string, side_map map<string,string>, condition string, expect_pick string, flip_dir string, tone_i2_frozen_correct double, tone_i2_frozen_flipped double, tone_i2_deployed_correct double, tone_i2_deployed_flipped double, is_catch boolean, tbu_index int"


def manifest(spark: SparkSession, path: str, accept: Column | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a JSON-lines manifest that are accepted, at most so many."""
    out = spark.read.schema(MANIFEST).json(path)
    out = out if accept is None else out.where(accept)
    return out if limit is None else out.limit(limit)


def holdouts(spark: SparkSession, path: str, fields: Sequence[str] = ("eval_texts", "minimal_pairs")) -> DataFrame:
    """text of every string value, at any depth, under the given fields of a JSON file of held-out sentences, also of a field that is one string; names of fields are not values."""
    doc = spark.read.text(path, wholetext=True)
    # As a map of values kept as JSON text, strings keep their quotes.
    parts = F.from_json("value", "map<string, variant>")
    values = F.concat_ws(",", *(F.to_json(F.element_at(parts, c)) for c in fields))
    found = doc.select(F.explode(F.regexp_extract_all(values, F.lit(r'("(?:[^"\\]|\\.)*")(?!\s*:)(?=\s*([,\]}]|$))'), F.lit(1))).alias("s"))
    return found.select(F.from_json(F.concat(F.lit('{"v":'), "s", F.lit("}")), "v string")["v"].alias("text")).where("text IS NOT NULL").distinct()


def minimal_pairs(spark: SparkSession, path: str) -> DataFrame:
    """id (mp_base_j), base, text, tones (array), gloss, verified."""
    doc = spark.read.schema(MINIMAL_PAIRS.replace("items array", "items: array")).json(path, multiLine=True)
    sets = doc.select(F.explode("sets").alias("s")).select("s.base", F.posexplode("s.items").alias("j", "item"))
    return sets.select(F.format_string("mp_%s_%d", "base", "j").alias("id"), "base", "item.text", F.split("item.tones", "-").alias("tones"), "item.gloss", "item.verified")


def carriers(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(MINIMAL_PAIRS.replace("items array", "items: array")).json(path, multiLine=True)
    return doc.select(F.posexplode("carriers").alias("k", "c")).select("k", "c.*")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row, with the defaults where the file is silent."""
    c = spark.read.schema(CALIBRATION).json(path, multiLine=True)
    return c.select("theta_h", "theta_l", F.coalesce("mode", F.lit("blind")).alias("mode"), F.coalesce("late_frac", F.lit(0.5)).alias("late_frac"))


def keymap(spark: SparkSession, path: str, value: str = KEY) -> DataFrame:
    """item_id and the fields of a withheld key."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, struct<{value}>>")).alias("item_id", "v")).select("item_id", "v.*")


def keymap_lines(spark: SparkSession, path: str, value: str = KEY) -> DataFrame:
    """item_id and the fields of a key that is written as lines; also reads a key of one line."""
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string, struct<{value}>>")).alias("item_id", "v")).select("item_id", "v.*")


def answers_csv(spark: SparkSession, path: str, rater: str) -> DataFrame:
    """rater, item_id, label of a CSV with a header; rows without a key or value are left out."""
    rows = spark.read.schema("item_id string, answer string").option("header", True).csv(path)
    k, v = F.trim(F.coalesce("item_id", F.lit(""))), F.lower(F.trim(F.coalesce("answer", F.lit(""))))
    return rows.where((k != "") & (v != "")).select(F.lit(rater).alias("rater"), k.alias("item_id"), v.alias("label"))


def answers(spark: SparkSession, codes: DataFrame | None = None, files: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """All raters' answers: pasted codes(rater, code), and (rater, path) CSV files."""
    parts = [] if codes is None else [answer_rows(codes)]
    parts += [answers_csv(spark, path, rater) for rater, path in files]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def texts(spark: SparkSession, path: str, candidates: Sequence[str]) -> DataFrame:
    """A foreign Parquet table with its text under the first of the candidate columns that has one."""
    rows = spark.read.parquet(path)
    return rows.withColumn("text", first_usable([c for c in candidates if c in rows.columns]))


def top_level(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, time and size of the files of a folder, without those of folders in it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def latest(listing: DataFrame) -> DataFrame:
    """The last path in the order of names."""
    return listing.agg(F.max("path").alias("path"))


def language_map(spark: SparkSession, path: str, language: str) -> DataFrame:
    """The row of a tab-separated language table; it must be one."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    one = rows.where(F.col(rows.columns[0]) == language)
    return one.join(F.broadcast(one.agg(F.assert_true(F.count("*") == 1, F.lit(f"{language} must have one row")).alias("_ok"))))


def form_items(pages: DataFrame, html: str = "html", variable: str = "ITEMS") -> DataFrame:
    """item_id, text and audio (bytes) of the items in a generated form."""
    head = f"const {variable} = "
    raw = F.substr(F.col(html), F.locate(head, F.col(html)) + F.lit(len(head)))  # the JSON parser reads one value and leaves the rest
    item = F.explode(F.from_json(raw, "array<struct<item_id: string, text: string, audio: string>>"))
    return pages.select(item.alias("i")).select("i.item_id", "i.text", F.unbase64(F.substring_index("i.audio", ",", -1)).alias("audio"))


def reference_clip(rows: DataFrame, source: str = "bible", lo: float = 3.0, hi: float = 10.0, order: str = "pos") -> DataFrame:
    """The first row of the source in the duration band."""
    return rows.where((F.col("source") == source) & F.col("duration_sec").between(lo, hi)).orderBy(order).limit(1)


def missing_files(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def log_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike(pattern))
