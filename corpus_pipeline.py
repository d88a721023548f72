"""A training corpus from raw documents: quality, lines, near-duplicates, leaks, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contourlake.llm import decontamination, line_dedup, packing, quality_rules, simhash
from contourlake.llm.common import Tables
from contourlake.llm.queries import tokenizer


# What the stages have in common: rows are told apart by id and text, rows that are equal in both get the same decision, a null
# text is an empty one (it fails the quality rules and goes), columns other than doc_id and text are carried along whatever
# their names, and an empty table gives an empty one.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, whole."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them have; n_chars stays that of the source."""
    return line_dedup.drop_common_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (of equal ids, the smallest hash of the text)."""
    return simhash.keep_representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the permitted lengths, with the documents in each."""
    return packing.sequences(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks), ("packed", packed)]
#: SQL expresses neither fingerprints nor alignments nor packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder before the next reads it, and goes when it has been read."""
    tables, before = Tables(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.put(name, stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
