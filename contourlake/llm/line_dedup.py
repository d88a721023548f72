"""Line dedup: lines whose key stands in many documents go, from every document.

A line's key is the line without ASCII white space at its ends, A-Z lowered.
Rows (128-bit key hash, id, text key, position) are range-partitioned by key
and id and sorted by position, and each partition is streamed: a key's distinct
documents are counted as they come. Because the range also has the id, a key
that holds a third of all rows is cut over many partitions. What a cut leaves
open (at most the first and last key of a partition) is settled by a table of
partial counts with at most two rows a partition, so that table is broadcast.
The stream holds back rows of less than ``min_docs`` documents, never more.

The result of the operator is a compressed bitmap of kept lines per document,
not text; a document without a bitmap keeps all its lines. Null and empty texts
are one empty line, which has no key and stays. Rows that share an id count as
one document; equal rows get equal bitmaps. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, partitions, prepared, restored, restored_rows, returning, squeezed

ROW = "h1 long, h2 long, id long, tkey long, pos int, n_lines int"
#: Rows that a task sends or holds at once.
CHUNK = 100_000


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A row of key hash and place for each line whose key has min_chars code points."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("tkey", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch():
            h = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
            n = np.array(counts, np.int64)
            of = [np.repeat(np.array(x, np.int64), n) for x in (ids, keys, sizes)]
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(of[0]), pa.array(of[1]), pa.array(places, pa.int32()), pa.array(of[2].astype(np.int32))], schema=schema)

        digests, places, ids, keys, sizes, counts = [], [], [], [], [], []
        for b in batches:
            for i, t, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                lines, n = body.split(b"\n"), len(places)
                for pos, line in enumerate(lines):
                    key = line_key(line)
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        places.append(pos)
                ids.append(i)
                keys.append(t)
                sizes.append(len(lines))
                counts.append(len(places) - n)
                if len(places) >= CHUNK:
                    yield batch()
                    digests, places, ids, keys, sizes, counts = [], [], [], [], [], []
        if places:
            yield batch()

    return docs.select("id", "tkey", "body").mapInArrow(returning(run), ROW)


def _stream(min_docs: int):
    """Of a sorted partition: rows to drop (state 0), rows still open (1) and partial counts of cut keys (2, pos has the count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("tkey", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32()), ("state", pa.int32())])
        none = [np.empty(0, np.int64)] * 6

        def out(cols, state):
            return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols[:4]), pa.array(cols[4].astype(np.int32)), pa.array(cols[5].astype(np.int32)), pa.array(np.full(len(cols[0]), state, np.int32))], schema=schema)

        def count(key, n):
            return out([np.array([x]) for x in (*key, 0, 0, n, 0)], 2)

        run_key, docs, last_id, first, held = None, 0, None, True, none  # of the key that goes on
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(6)]
            key_cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            starts, ends = np.r_[0, key_cut], np.r_[key_cut, len(cols[0])]
            fresh = np.r_[True, np.diff(cols[2]) != 0]
            fresh[starts] = True
            upto = np.r_[0, np.cumsum(fresh)]
            n_docs = upto[ends] - upto[starts]
            drop = np.zeros(len(cols[0]), bool)
            for j in range(len(starts)):
                lo, hi, key = starts[j], ends[j], (cols[0][starts[j]], cols[1][starts[j]])
                edge = j == 0 or j == len(starts) - 1
                if not edge:  # begins and ends in this batch
                    drop[lo:hi] = n_docs[j] >= min_docs
                    continue
                if key != run_key:
                    if run_key is not None:
                        if first:
                            yield count(run_key, docs)
                            if len(held[0]):
                                yield out(held, 1)
                        first = False
                    run_key, docs, last_id, held = key, 0, None, none
                docs += int(n_docs[j]) - int(last_id is not None and cols[2][lo] == last_id)
                last_id = cols[2][hi - 1]
                if docs >= min_docs:
                    if len(held[0]):
                        yield out(held, 0)
                        held = none
                    drop[lo:hi] = True
                else:
                    held = [np.concatenate([h, c[lo:hi]]) for h, c in zip(held, cols, strict=True)]
            if drop.any():
                yield out([c[drop] for c in cols], 0)
        if run_key is not None:
            yield count(run_key, docs)
            if len(held[0]):
                yield out(held, 1)

    return run


def line_bitmaps(tables: Tables, docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """id, tkey, n_lines, n_dropped and bitmap (zlib of packed bits, 1: kept) of each prepared document that loses a line."""
    lines = tables.put("lines", line_rows(docs, min_chars))
    n = partitions(docs.sparkSession, 48 * lines.count())
    place = [F.col(c) for c in ("h1", "h2", "id", "tkey", "pos")]
    found = tables.put("found", lines.repartitionByRange(n, *place[:3]).sortWithinPartitions(*place).mapInArrow(returning(_stream(min_docs)), f"{ROW}, state int"))
    tables.drop("lines")
    cut = found.where("state = 2").groupBy("h1", "h2").agg(F.sum("pos").alias("docs")).where(F.col("docs") >= min_docs).select("h1", "h2")
    settled = found.where("state = 1").join(F.broadcast(cut), ["h1", "h2"], "left_semi")  # at most two rows a partition
    gone = found.where("state = 0").unionByName(settled).groupBy("id", "tkey", "n_lines").agg(F.collect_set("pos").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, n_dropped = [], []
            for n_lines, gone in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                keep = np.ones(n_lines, bool)
                keep[gone.values.to_numpy()] = False
                bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
                n_dropped.append(n_lines - int(keep.sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(n_dropped, pa.int32()), pa.array(bits, pa.binary())], ["id", "tkey", "n_lines", "n_dropped", "bitmap"])

    return gone.mapInArrow(returning(run), "id long, tkey long, n_lines int, n_dropped int, bitmap binary")


def kept_text(body: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text of the kept lines, the lines before and the lines dropped."""
    lines = body.split(b"\n")
    if bitmap is None:
        return body, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    kept = [x for x, k in zip(lines, keep, strict=True) if k]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Prepared documents with the column bitmap, null where all lines stay."""
    return docs.join(bitmaps.select("id", "tkey", "bitmap"), ["id", "tkey"], "left")


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """id_col, n_lines, n_dropped and kept_sha256 of each row."""
    rows = prepared(docs, id_col, text_col)
    bitmaps = tables_bitmaps(docs, rows, min_docs, min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_text(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in got], pa.string())],
                ["id", "n_lines", "n_dropped", "kept_sha256"],
            )

    out = with_bitmaps(rows, bitmaps).select("id", "body", "bitmap").mapInArrow(returning(run), "id long, n_lines long, n_dropped long, kept_sha256 string")
    return out.select(restored().alias(id_col), "n_lines", "n_dropped", "kept_sha256")


def tables_bitmaps(docs: DataFrame, rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """line_bitmaps as a table in the shared folder."""
    tables = Tables(docs.sparkSession, "lines")
    bitmaps = tables.put("bitmaps", line_bitmaps(tables, rows, min_docs, min_chars))
    tables.drop("found")
    return bitmaps


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with the kept lines in text_col (null stays null); all other columns as they are."""
    bitmaps = tables_bitmaps(docs, prepared(docs, id_col, text_col), min_docs, min_chars)
    # Both sides grow with the corpus, so neither is sent around, however small they are today.
    joined = squeezed(docs, id_col, text_col).join(bitmaps.select("id", "tkey", "bitmap").hint("merge"), ["id", "tkey"], "left")
    return restored_rows(joined, docs.schema, text_col, lambda text, bitmap: kept_text(text, bitmap)[0], "bitmap")
