"""Token ids in compressed pages with one shared dictionary.

Format. Two Parquet datasets under one folder, written and committed by Spark,
so any store will do and a lost task leaves nothing behind:

* ``dictionary``: one row, hash (SHA-256, hex) and dictionary (bytes);
* ``pages``: run, first (ids of the run before this page), doc_ids, n_tokens,
  ends (offset in frames after each document), dict_hash, frames.

A document is one zstandard frame over its ids as little-endian unsigned
integers (16 bits if the vocabulary allows, else 32), compressed on its own
with the shared dictionary, so a short document is read without its neighbours:
``ends`` gives its bytes. The dictionary is trained on serialized id arrays of
at most ``sample_docs`` documents of at most ``sample_bytes`` bytes each, those
with the least hash among about four times as many. Texts are encoded where
they are read; only frames are shuffled. A run is what one task wrote, in
ascending order of ids; runs are numbered in that order, too.

Strings of the tokenizer's special tokens in a text are encoded as the library
does by default: as those tokens. A null text is the empty text: one end id. Rows with equal ids (null ids come
first) follow each other in the order of their text's hash; equal rows get the
starts of equal rows. An empty table gives no pages. Extra columns are left
behind.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, partitions, prepared, restored

PAGE_BYTES = 1 << 20
PAGE = "run long, first long, doc_ids array<long>, n_tokens array<int>, ends array<int>, dict_hash string, frames binary"
#: White space and controls beside which a text is not cut: texts that have them go to the library whole.
ODD = "[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff]|^[ \n]|[ \n]$|[ \n][ \n]|^$"
#: ASCII marks at a stretch's end, which are a pre-token of their own after a letter or digit.
MARKS = r"([0-9A-Za-zªµºÀ-ÖØ-öø-ɏ])([!-/:-@\[-`{-~]+)( |$)"
LATIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")


class Encoder:
    """Token ids of texts by the tokenizers library.

    A space or a line feed between visible characters begins a stretch that the
    library's pre-tokenizer, too, splits off, and so do marks that end one. The
    ids of a stretch are remembered and texts are put together from them; beyond
    ``most`` stretches all are forgotten, so memory is bounded. A stretch is
    named by its text without the space that begins it; one without such a
    space is marked by a zero character, unless it begins with a line feed. A
    tokenizer file with a normalizer or another pre-tokenizer, and a text with
    other white space, gets the library's ids of whole texts.
    """

    most = 200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.bpe = self.model.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.cuts = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.whole = "|".join([ODD, *(re.escape(x["content"]) for x in spec.get("added_tokens", []))])
        # How byte-level BPE shows bytes: those without a visible Latin-1 character as 256 and on, in order.
        hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
        self.shown = {b: 256 + k for k, b in enumerate(hidden)}
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.sizes = np.empty(0, self.kind), np.empty(0, np.int32)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """Ids of a space and a word of Latin letters, which are one pre-token: straight from the library's BPE."""
        as_bytes = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return [t.id for t in self.bpe.tokenize("Ġ" + as_bytes)]

    def _learn(self, words: pa.StringArray) -> np.ndarray:
        """The number of each of the distinct words; new ones get theirs. What is known is an Arrow array, a tenth of what a dict takes."""
        if len(self.known) > self.most:
            self._forget()
        found = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(found))
        if not len(new):
            return found.to_numpy().astype(np.int64)
        flat, sizes, rest, latin = array("I"), [], [], LATIN.fullmatch
        texts = new.to_pylist()
        for k, w in enumerate(texts):
            if latin(w):
                ids = self._word(w)
                flat.extend(ids)
                sizes.append(len(ids))
            else:
                rest.append(k)
        words_of = [texts[k] for k in rest]
        for ids in self.library([w if w[:1] == "\n" else w[1:] if w[:1] == "\x00" else " " + w for w in words_of]):
            flat.extend(ids)
            sizes.append(len(ids))
        latins = np.ones(len(texts), bool)
        latins[rest] = False
        order = np.r_[np.flatnonzero(latins), rest].astype(np.int64)  # in which they were learned
        numbers = np.empty(len(texts), np.int64)
        numbers[order] = np.arange(len(texts)) + len(self.known)
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        self.ids = np.concatenate([self.ids, np.frombuffer(flat, np.uintc).astype(self.kind)])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int32)])
        out = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        out[out < 0] = numbers
        return out

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array without nulls."""
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        out: list[np.ndarray] = [np.empty(0, self.kind)] * len(texts)
        for k, ids in zip(np.flatnonzero(odd).tolist(), self.library(texts.filter(pa.array(odd)).to_pylist()), strict=True):
            out[k] = np.array(ids, self.kind)
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        marked = pc.binary_join_element_wise("\x00", pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), "")
        marked = pc.replace_substring_regex(marked, MARKS, "\\1 \x00\\2\\3")
        split = pc.split_pattern(marked, " ")
        words = split.values.dictionary_encode()
        number = self._learn(words.dictionary)[words.indices.to_numpy()]
        ends = np.cumsum(self.sizes, dtype=np.int64)
        n = self.sizes[number].astype(np.int64)
        total = np.cumsum(n)
        flat = self.ids[np.arange(total[-1]) + np.repeat(ends[number] - total, n)]
        cuts = np.r_[0, total][split.offsets.to_numpy()]
        for k, lo, hi in zip(plain.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[k] = flat[lo:hi]
        return out


def stretches(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with about so many bytes in a column of strings or bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process: what a task has learned helps the next."""
    return Encoder(path)


def train_dictionary(rows: DataFrame, path: str, n_rows: int, size: int = 64 << 10, sample_docs: int = 2000, sample_bytes: int = 4096) -> bytes:
    """A dictionary from the ids of a bounded sample; empty if there is too little."""
    h = F.xxhash64("id", "tkey")
    thin = F.pmod(h, F.lit(1 << 30)) < F.lit(int(min(1.0, 4.0 * sample_docs / max(n_rows, 1)) * (1 << 30)))
    short = rows.where(thin & F.octet_length("body").between(1, sample_bytes)).select(h.alias("h"), "id", "tkey", "body")
    found = short.orderBy("h", "id", "tkey").limit(sample_docs).collect()  # sample_docs x sample_bytes at most
    samples = [x.tobytes() for x in encoder_of(path)(pa.array([bytes(r["body"]).decode() for r in found], pa.string()))]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


def codec(dictionary: bytes, level: int = 3) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def frames(rows: DataFrame, path: str, dictionary: bytes, end_id: int) -> DataFrame:
    """id, tkey, n (ids with the end) and frame of each prepared row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (packer, _) = encoder_of(path), codec(dictionary)
        end = np.array([end_id], encoder.kind).tobytes()
        for b in batches:
            for part in stretches(b, 2):
                got = encoder(part.column(2).cast(pa.string()))
                packed = [packer.compress(x.tobytes() + end) for x in got]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) + 1 for x in got], pa.int32()), pa.array(packed, pa.binary())], ["id", "tkey", "n", "frame"])
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return rows.select("id", "tkey", "body").mapInArrow(run, "id long, tkey long, n int, frame binary")


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, page_bytes: int = PAGE_BYTES) -> None:
    """Writes the token ids of docs to folder."""
    spark, rows = docs.sparkSession, prepared(docs, id_col, text_col)
    dictionary = train_dictionary(rows, path, docs.count())
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    tables = Tables(spark, "frames")
    made = tables.put("frames", frames(rows, path, dictionary, end_id).withColumn("row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first = TaskContext.get().partitionId(), 0
        ids, sizes, ends, held, n = [], [], [], [], 0

        def page():
            return pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int64()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int32())), pa.array([digest], pa.string()), pa.array([b"".join(held)], pa.binary())],
                ["run", "first", "doc_ids", "n_tokens", "ends", "dict_hash", "frames"],
            )

        for b in batches:
            for i, size, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n += len(frame)
                ids.append(i)
                sizes.append(size)
                ends.append(n)
                held.append(frame)
                if n >= page_bytes:
                    yield page()
                    first += sum(sizes)
                    ids, sizes, ends, held, n = [], [], [], [], 0
        if ids:
            yield page()

    total = made.agg(F.sum(F.octet_length("frame") + 16)).first()[0] or 0
    order = ("id", "tkey", "row")  # the row cuts even a third of all rows that are alike
    ordered = made.repartitionByRange(partitions(spark, total, 16 << 20), *order).sortWithinPartitions(*order).select("id", "n", "frame")
    ordered.mapInArrow(run, PAGE).write.option("compression", "uncompressed").parquet(f"{folder}/pages")
    tables.drop("frames")


def read(spark: SparkSession, folder: str, kind: str = "<u2", with_ids: bool = True) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in folder, and its ids as little-endian 32-bit integers."""
    pages = spark.read.schema(PAGE).parquet(f"{folder}/pages")
    held = {r["hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}  # one row
    sizes = pages.select("run", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("run").agg(F.sum("n").alias("n"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per writing task
    kinds = [("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpackers: dict[str, zstandard.ZstdDecompressor] = {}
        for b in batches:
            for x in b.to_pylist():
                unpacker = unpackers.get(x["dict_hash"]) or unpackers.setdefault(x["dict_hash"], codec(held[x["dict_hash"]])[1])
                start, lo, out = x["base"] + x["first"], 0, []
                for i, n, hi in zip(x["doc_ids"], x["n_tokens"], x["ends"], strict=True):
                    ids = np.frombuffer(unpacker.decompress(x["frames"][lo:hi]), kind).astype("<u4").tobytes()
                    if len(ids) != 4 * n:
                        raise ValueError(f"document {i} has {len(ids) // 4} ids; its page says {n}")
                    out.append((i, start, n, zlib.crc32(ids)) + (ids,) * with_ids)
                    start, lo = start + n, hi
                yield pa.RecordBatch.from_arrays([pa.array([y[k] for y in out], t) for k, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return pages.join(F.broadcast(bases), "run").mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Writes docs to the shared folder, reads them back: id_col, start, n_tokens and ids_crc32 of each row."""
    spark = docs.sparkSession
    folder = Tables(spark, "tokens").root
    write(docs, folder, path, id_col, text_col, end_id, page_bytes)
    return read(spark, folder, encoder_of(path).kind.str, with_ids=False).select(restored().alias(id_col), "start", "n_tokens", "ids_crc32")
