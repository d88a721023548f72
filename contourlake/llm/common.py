"""What the training-data operators share: inputs, partition counts, folds.

Inputs. ``prepared`` turns any table with an id and a text column into three
columns of its own: ``id`` (long), ``tkey`` (a hash of the text) and ``body``
(the text's UTF-8 bytes). Extra columns, whatever their names, are left behind.
A null text is the empty text. A null id is the id ``NULL_ID`` until
``restored`` makes it null again. Rows with the same id are one document where
documents are counted, and rows that also share their text get the same result;
``(id, tkey)`` finds a row's results again.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from contourlake.storage import Tables  # noqa: F401

NULL_ID = -(1 << 63)


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tkey and body of each row; see the module's text."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    ).select("id", F.xxhash64("body").alias("tkey"), "body")


def restored(col: str = "id"):
    """The id as it was before ``prepared``."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


def squeezed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tkey, row (all columns, the text left out) and z (the text, compressed; null for null): rows that are cheap to shuffle."""
    none = F.lit(None).cast(docs.schema[text_col].dataType)
    row = F.struct(*(none.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
    text = F.col(f"`{text_col}`").cast("binary")
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit("").cast("binary"))).alias("tkey"), row.alias("row"), text.alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [None if x is None else packer.compress(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(z, pa.binary())], ["id", "tkey", "row", "z"])

    kinds = [("id", T.LongType()), ("tkey", T.LongType()), ("row", keyed.schema["row"].dataType), ("z", T.BinaryType())]
    return keyed.mapInArrow(returning(run), T.StructType([T.StructField(n, k) for n, k in kinds]))


def restored_rows(squeezed_rows: DataFrame, schema: T.StructType, text_col: str, change: Callable[[bytes, object], bytes] | None = None, by: str | None = None) -> DataFrame:
    """The rows as they were before ``squeezed``, with change(text, value of by) as their text where it is not null."""
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [None if x is None else unpacker.decompress(x) for x in b.column(1).to_pylist()]
            if change is not None:
                texts = [None if x is None else change(x, y) for x, y in zip(texts, b.column(2).to_pylist(), strict=True)]
            parts = b.column(0).flatten()
            parts[at] = pa.array([None if x is None else x.decode() for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays(parts, schema.fieldNames())

    return squeezed_rows.select("row", "z", *([by] if by else [])).mapInArrow(returning(run), schema)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all bodies of prepared documents."""
    return docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0


def partitions(spark: SparkSession, n_bytes: int, each: int = 32 << 20) -> int:
    """Partitions of about ``each`` bytes, but not fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


def return_memory() -> None:
    """Gives back what a task has freed; its worker process stays for the next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at its end the worker's free memory goes back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        return_memory()

    return task


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def crc_fold(column: str, folds: int = 5):
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def crc_fold_of(doc_id: int | None, folds: int = 5) -> int | None:
    """The same in Python; a null id is in no fold."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def dealt_join(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, by: str, parts: int = 64, hot: int = 1000) -> DataFrame:
    """rows left-joined to table, in which each key is once and ``size`` says how many of the rows have it.

    The rows of a key that has more than a thousandth of the sizes' sum, of
    which there are at most a thousand, are dealt over ``parts`` tasks by ``by``.
    """
    keys = [key] if isinstance(key, str) else key
    total = table.agg(F.sum(size)).first()[0] or 0
    heavy = table.where(F.col(size) > F.lit(total / hot)).select(*keys, F.lit(True).alias("_hot"))  # at most ``hot`` rows
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(parts))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).drop("_hot")
    right = table.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
