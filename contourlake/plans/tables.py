"""Tone-evaluation tables bound to the driver's fixture tables.

lineitem stands for tone-bearing units (a clip is an order, flag A/N/R the
target H/M/L, quantity the reading, no discount an abstention, tax a second
instrument); events for pitch frames (a clip is a user); orders for a manifest;
embeddings for speakers; labels for judgements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import signal
from ..storage import Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place():
    """A unit's place in its clip; line numbers alone are not unique."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))


def tbu(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("tbu_idx", _place())
    tone = F.when(F.col("l_returnflag") == "A", "H").when(F.col("l_returnflag") == "N", "M").otherwise("L")
    pred = F.when(F.col("l_discount") == 0, F.lit(None).cast("string")).when(F.col("l_quantity") > 33, "H").when(F.col("l_quantity") <= 16, "L").otherwise("M")
    return li.select(F.col("l_orderkey").alias("clip_id"), "tbu_idx", tone.alias("target"), pred.alias("pred"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbu, placed once and written, for plans that read it several times."""
    return Tables(spark, "units").put("tbu", tbu(spark, sf_dir))


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("tbu_idx", _place())
    tone = F.when(F.col("l_returnflag") == "A", "H").when(F.col("l_returnflag") == "N", "M").otherwise("L")
    pred = F.when(F.col("l_tax") == 0, F.lit(None).cast("string")).when(F.col("l_tax") > 0.055, "H").when(F.col("l_tax") <= 0.025, "L").otherwise("M")
    return li.select(F.col("l_orderkey").alias("clip_id"), "tbu_idx", tone.alias("target"), pred.alias("pred"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch frames: hours since 2024 as seconds of the clip, values of 65 to 400 as Hz, others unvoiced."""
    ev = table(spark, sf_dir, "events")
    t = F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3.6e9), 6)
    rows = ev.select(F.col("user_id").alias("clip_id"), t.alias("t"), F.when(F.col("value").between(65, 400), F.col("value")).alias("f0"))
    return rows.groupBy("clip_id", "t").agg(F.max("f0").alias("f0"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six proportional windows a clip with the tones H M L H M L."""
    spans = signal.voiced_span(frames(spark, sf_dir)).where("v1 > v0")
    tones = spans.select("clip_id", F.array(*map(F.lit, "HMLHML")).alias("tones"))
    return signal.proportional_windows(spans.select("clip_id", "v0", "v1"), tones)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.unit_semitones(frames(spark, sf_dir), windows(spark, sf_dir))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind residuals, rounded, so that thresholds read them alike everywhere."""
    u = units(spark, sf_dir)
    return signal.residuals(u, signal.theil_sen(u)).withColumn("res", F.round("res", 6))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("speaker_id"), F.col("o_totalprice").alias("duration_sec"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("kind"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
