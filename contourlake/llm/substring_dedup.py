"""Substring dedup by level-wise doubling of word windows.

A window of 50 words that two documents share begins as short windows that they
share. ``levels`` are the lengths from 13 words up, each at most twice the one
before: 13, 25, 50. A level looks at windows at the places that content alone
picks: of the windows of its length inside each full window, the one with the
least hash. Equal full windows pick equal windows, so none is missed, and only
one place in 19 (then 13) is written down. Full windows whose picked window is
in two documents or more are extended to the next level; all others are done
with. The loop ends when no candidate survives or the full length is reached;
there the survivors get a 128-bit hash. No window longer than the full length
changes what is removed (its full-length windows are repeated too), so the
doubling ends there.

The last level range-partitions (hash, id) and streams each sorted partition:
within a hash the first id is the smallest, all later ids lose the window. A
hash that holds a third of all rows is cut over many partitions; what a cut
leaves open is settled by a table with at most two rows a partition. Texts are
shuffled compressed, and only those with candidates.

Null, empty and short texts (fewer words than the window) lose nothing. Rows
that share an id are one document, so they never take words from each other;
equal rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, partitions, prepared, restored

#: Two odd multipliers of the window hashes and their inverses modulo 2**64.
BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
#: The shortest windows to begin with, in words.
LEAST = 12
#: Windows handled at once.
SLICE = 1 << 16


def levels(length: int) -> list[int]:
    """Window lengths, each at most twice the one before, up to length."""
    out = [length]
    while out[0] > 2 * LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


class WordHashes(dict):
    """Hash of a word, remembered for up to most words."""

    most = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Hashes of all windows of a word sequence, from prefix sums."""

    def __init__(self):
        self.tables = {}

    def _powers(self, which: int, n: int):
        have = self.tables.get(which)
        if have is None or len(have[0]) < n:
            n = max(n, 1 << 14)
            have = self.tables[which] = tuple(powers(b, n) for b in BASES[which])
        return have[0][:n], have[1][:n]

    def __call__(self, words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        n = len(words)
        up, down = self._powers(which, n)
        up, down = up[:n], down[:n]
        h = words if which == 0 else mixed(words)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
        return mixed((s[length:] - s[:-length]) * down[: n - length + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def picked(half: np.ndarray, span: int) -> np.ndarray:
    """For each full window the place of the least of its span shorter windows, the first of equals."""
    out = np.empty(len(half) - span + 1, np.int64)
    for lo in range(0, len(out), SLICE):
        part = half[lo : lo + SLICE + span - 1]
        view = np.lib.stride_tricks.sliding_window_view(part, span)
        out[lo : lo + len(view)] = view.argmin(axis=1) + np.arange(lo, lo + len(view))
    return out


def _hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _picks(short: np.ndarray, span: int, live: np.ndarray | None = None) -> pa.Array:
    """Distinct hashes of the windows that the (live) full windows pick."""
    at = picked(short, span)
    return np.unique(short[np.unique(at if live is None else at[live])]).view(np.int64)


def first_level(docs: DataFrame, length: int = 50) -> DataFrame:
    """id, tkey, n_words, sha (of all words) and picks (hashes of the first level's picked windows) of each prepared row."""
    small = levels(length)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, windows = WordHashes(), Windows()
        for b in batches:
            sizes, shas, picks = [], [], []
            for body in b.column(2).to_pylist():
                words = body.split()
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                picks.append(None if len(words) < length else _picks(windows(_hashed(words, known), small), length - small + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(picks, pa.list_(pa.int64()))], ["id", "tkey", "n_words", "sha", "picks"])

    return docs.select("id", "tkey", "body").mapInArrow(run, "id long, tkey long, n_words long, sha string, picks array<long>")


def zipped(docs: DataFrame) -> DataFrame:
    """id, tkey and the body, compressed, of each prepared row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packer.compress(x) for x in b.column(2).to_pylist()], pa.binary())], ["id", "tkey", "z"])

    return docs.select("id", "tkey", "body").mapInArrow(run, "id long, tkey long, z binary")


def _survivors(h: np.ndarray, live: bytes | None, repeated: np.ndarray, windows: Windows, small: int, length: int) -> np.ndarray:
    """Places of the full windows that were live and whose picked window is repeated."""
    short = windows(h, small)
    alive = np.isin(short, repeated)[picked(short, length - small + 1)]
    if live is not None:
        alive &= np.unpackbits(np.frombuffer(zstandard.decompress(live), np.uint8), count=len(alive)).view(bool)
    return np.flatnonzero(alive)


def _candidates(texts: DataFrame, small: int, length: int, use, schema: str) -> DataFrame:
    """use(id, tkey, words' hashes, survivors, windows) of each text (id, tkey, z, live, repeated) that has survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, windows, unpacker = WordHashes(), Windows(), zstandard.ZstdDecompressor()
        out: list[pa.RecordBatch] = []
        for b in batches:
            for i, t, z, live, repeated in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                h = _hashed(unpacker.decompress(z).split(), known)
                at = _survivors(h, live, repeated.values.to_numpy().view(np.uint64), windows, small, length)
                if len(at):
                    out.append(use(i, t, h, at, windows))
                if len(out) >= 100 or out and out[-1].num_rows >= SLICE:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out = []
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return texts.select("id", "tkey", "z", "live", "repeated").mapInArrow(run, schema)


def extended(texts: DataFrame, small: int, large: int, length: int = 50) -> DataFrame:
    """id, tkey, live (bits of the surviving full windows) and picks (of the next level, of these)."""

    def use(i, t, h, at, windows):
        live = np.zeros(len(h) - length + 1, bool)
        live[at] = True
        picks = _picks(windows(h, large), length - large + 1, at)
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t], pa.int64()), pa.array([zstandard.compress(np.packbits(live).tobytes(), 1)], pa.binary()), pa.array([picks], pa.list_(pa.int64()))], ["id", "tkey", "live", "picks"])

    return _candidates(texts, small, length, use, "id long, tkey long, live binary, picks array<long>")


def last_level(texts: DataFrame, small: int, length: int = 50) -> DataFrame:
    """k1, k2, id, tkey and pos of each surviving full window."""

    def use(i, t, h, at, windows):
        k = [windows(h, length, w)[at].view(np.int64) for w in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(k[0]), pa.array(k[1]), pa.array(np.full(len(at), i)), pa.array(np.full(len(at), t)), pa.array(at.astype(np.int32))], ["k1", "k2", "id", "tkey", "pos"])

    return _candidates(texts, small, length, use, "k1 long, k2 long, id long, tkey long, pos int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: windows to remove (state 0), windows of the first id of its first hash (1), first ids of its first and last hash (2)."""

    def out(cols, state):
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(np.full(len(cols[0]), state, np.int32))], ["k1", "k2", "id", "tkey", "pos", "state"])

    def note(key, least):
        return out([np.array([x], np.int64) for x in (*key, least, 0)] + [np.zeros(1, np.int32)], 2)

    key, least, first = None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(5)]
        new = np.r_[True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)]
        starts = np.flatnonzero(new)
        heads = cols[2][starts].copy()
        if key == (cols[0][0], cols[1][0]):
            heads[0] = least
        lead = np.repeat(heads, np.diff(np.r_[starts, len(new)]))
        if first is None:
            first = (cols[0][0], cols[1][0])
            yield note(first, heads[0])
        gone = cols[2] > lead
        if gone.any():
            yield out([c[gone] for c in cols], 0)
        still = ~gone & (cols[0] == first[0]) & (cols[1] == first[1])
        if still.any():
            yield out([c[still] for c in cols], 1)
        key, least = (cols[0][-1], cols[1][-1]), heads[-1]
    if key is not None and key != first:
        yield note(key, least)


def repeated_picks(tables: Tables, level: DataFrame, name: str) -> DataFrame:
    """id, tkey and repeated (those of its picks that another document has, too) of each row of a level that has any."""
    picks = level.select("id", "tkey", F.explode("picks").alias("h"))
    twice = tables.put(name, picks.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("h"))
    return picks.join(twice, "h").groupBy("id", "tkey").agg(F.collect_set("h").alias("repeated"))


def repeats(tables: Tables, docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first level of all rows; the texts with candidates, compressed; the places of windows to remove, by id and tkey."""
    steps = levels(length)
    one = tables.put("level0", first_level(docs, length))
    found = repeated_picks(tables, one, "twice0").withColumn("live", F.lit(None).cast("binary"))
    texts = tables.put("texts0", zipped(docs).join(found, ["id", "tkey"]).dropDuplicates(["id", "tkey"]))
    for k, (small, large) in enumerate(zip(steps, steps[1:-1], strict=False), 1):
        if not texts.head(1):
            break
        level = tables.put(f"level{k}", extended(texts, small, large, length))
        found = repeated_picks(tables, level, f"twice{k}").join(level.select("id", "tkey", "live"), ["id", "tkey"])
        texts = tables.put(f"texts{k}", texts.select("id", "tkey", "z").join(found, ["id", "tkey"]))
        tables.drop(f"texts{k - 1}", f"twice{k - 1}")
    rows = tables.put("rows", last_level(texts, steps[max(0, len(steps) - 2)], length))
    n = partitions(docs.sparkSession, 40 * rows.count())
    place = [F.col(c) for c in ("k1", "k2", "id", "tkey", "pos")]
    said = tables.put("said", rows.repartitionByRange(n, *place[:3]).sortWithinPartitions(*place).mapInArrow(_stream, "k1 long, k2 long, id long, tkey long, pos int, state int"))
    tables.drop("rows")
    least = said.where("state = 2").groupBy("k1", "k2").agg(F.min("id").alias("least"))
    settled = said.where("state = 1").join(F.broadcast(least), ["k1", "k2"]).where("least < id")  # at most two rows a partition
    gone = said.where("state = 0").select("id", "tkey", "pos").unionByName(settled.select("id", "tkey", "pos"))
    return one, texts, gone.groupBy("id", "tkey").agg(F.collect_set("pos").alias("gone"))


def kept_words(words: list[bytes], gone: np.ndarray, length: int) -> list[bytes]:
    """words without those in windows that start at gone."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + length, -1)
    return [w for w, c in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not c]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 and text (the kept words joined by a space; null if all stay) of each row."""
    tables = Tables(docs.sparkSession, "substrings")
    one, texts, gone = repeats(tables, prepared(docs, id_col, text_col), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, shas, kept = [], [], []
            for z, at in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                words = zstandard.decompress(z).split()
                left = kept_words(words, at.values.to_numpy().astype(np.int64), length)
                sizes.append(len(words) - len(left))
                kept.append(b" ".join(left))
                shas.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array([x.decode() for x in kept], pa.string())], ["id", "tkey", "n_removed", "new_sha", "text"])

    lost = texts.select("id", "tkey", "z").join(gone, ["id", "tkey"])
    changed = lost.mapInArrow(run, "id long, tkey long, n_removed long, new_sha string, text string")
    return one.join(changed, ["id", "tkey"], "left").select(
        restored().alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("new_sha", "sha").alias("kept_sha256"), "text"
    )
