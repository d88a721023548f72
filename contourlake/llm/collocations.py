"""Phrase collocations: exact counts of the phrases that a sketch lets through.

Texts are lower-cased (A-Z) and cut into pieces at punctuation and line breaks,
pieces into words. A phrase is two or more words in a row within a piece. All
counts are per language.

1. Shards. The words of a few MB of text of one language are written as a row:
   its vocabulary and the words' numbers, compressed. A language with most of the
   texts has most of the shards.
2. Sketch. Each word and each phrase of two falls into one of about a quarter as many
   cells as there are words. A shard sends the cells that it fills and how often,
   cut into segments of cells; a segment's counts are added up as they stream by,
   a byte a cell, and bound the counts of its phrases from above. Each shard gets
   back those of its cells that reach ``least``. Longer phrases follow in the
   same way, but only those whose pairs of words were all let through.
3. Count. A shard's candidates make an Aho-Corasick automaton, guarded by a space
   at both ends, which finds every occurrence, overlapping ones too, in the
   shard's text. Lists of them, by hash, are added up and what stays below
   ``least`` goes.
4. Score. A phrase's parts reach ``least`` too, so all counts are at hand. A part that many phrases ask for is dealt over many tasks.

The sketch only decides what is counted: whatever it lets through by chance is
dropped by its exact count, and it never holds back a phrase that reaches
``least``. Nothing is broadcast but keys of parts with a thousandth of all
requests each. A shard with its automaton is what a task holds; a text is not
cut, so one longer than a shard is one.

Null and empty texts have no words. A null language is ``und``. Every row
counts, repeated ones and those with equal ids too. An empty table gives no
rows. Extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, dealt_join, return_memory

#: Punctuation and line breaks end pieces, tabs become spaces, A-Z become small.
PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 10 + b" abcdefghijklmnopqrstuvwxyz")
#: Words of a shard, about.
SHARD = 1 << 20
#: Odd multipliers, one for each word of a phrase.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], np.uint64)
BREAK = 0


class Shape:
    """How many cells the sketch has, as a power of two, and how many of them are in a segment."""

    def __init__(self, n_words: int):
        self.cells = min(46, max(16, (n_words // 4).bit_length()))
        self.within = min(26, self.cells - 8)

    def __repr__(self) -> str:
        return f"2^{self.cells} cells in segments of 2^{self.within}"


def packed(numbers: np.ndarray) -> bytes:
    """Ascending or small numbers below 2^32, as compressed planes of bytes."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _steps(ascending: np.ndarray) -> bytes:
    return packed(np.diff(ascending, prepend=ascending.dtype.type(0)))


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.int64)


class Words(dict):
    """A number for each word, from 1; 0 is the break between pieces and -1 the empty word."""

    def __init__(self):
        super().__init__({b"\n": BREAK, b"": -1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 1
        return n


def shards(docs: DataFrame, text_col: str, lang_col: str, most: int = SHARD) -> DataFrame:
    """shard, lang, n_words, words (of number 1, 2, ...) and ids of each shard."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # by language: words, ids of each text, how many
        total, made, first = 0, 0, TaskContext.get().partitionId() << 32

        def shard(lang: str) -> pa.RecordBatch:
            words, parts, _ = held.pop(lang)
            ids = np.concatenate(parts)
            vocabulary = b"\n".join(list(words)[2:])
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([lang]), pa.array([int((ids != BREAK).sum())], pa.int64()), pa.array([zstandard.compress(vocabulary, 3)], pa.binary()), pa.array([packed(ids)], pa.binary())],
                ["shard", "lang", "n_words", "words", "ids"],
            )

        for b in batches:
            for lang, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, parts, _ = have = held.setdefault(lang, [Words(), [], 0])
                tokens = body.as_py().translate(PIECES).replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))
                ids = ids[ids >= 0]
                parts += [ids, np.array([BREAK], np.int32)]
                have[2] += len(ids)
                total += len(ids)
                if have[2] >= most or total >= 2 * most:
                    longest = max(held, key=lambda k: held[k][2])
                    total -= held[longest][2]
                    yield shard(longest)
                    made += 1
        for lang in list(held):
            yield shard(lang)
            made += 1
        return_memory()

    return rows.mapInArrow(run, "shard long, lang string, n_words long, words binary, ids binary")


class Shard:
    """Words and phrases of a shard's row."""

    def __init__(self, lang: str, words: bytes, ids: bytes):
        self.ids = unpacked(ids).astype(np.int32)
        self.words = [b"\n", *zstandard.decompress(words).split(b"\n")]
        seed = xxhash.xxh32_intdigest(lang)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def phrases(self, size: int, pairs: np.ndarray | None = None) -> np.ndarray:
        """Where phrases of so many words begin; all their pairs of words must be among those that begin at pairs."""
        n = len(self.ids) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        if pairs is None:
            is_word = self.ids != BREAK
            good = np.logical_and.reduce([is_word[k : n + k] for k in range(size)])
        else:
            let = np.zeros(len(self.ids), bool)
            let[pairs] = True
            good = np.logical_and.reduce([let[k : n + k] for k in range(size - 1)])
        return np.flatnonzero(good)

    def cells(self, at: np.ndarray, size: int, shape: Shape) -> np.ndarray:
        h = np.full(len(at), size, np.uint64) * ODD[-1]
        for k in range(size):
            h ^= h >> np.uint64(31)
            h *= ODD[k % 5]
            h += self.hashes[self.ids[at + k]]
        for turn, odd in ((29, ODD[1]), (32, ODD[0])):
            h ^= h >> np.uint64(turn)
            h *= odd
        h >>= np.uint64(64 - shape.cells)
        return h.view(np.int64)


def _asked(s: Shard, sizes: tuple[int, ...], shape: Shape, pairs: np.ndarray | None) -> np.ndarray:
    return np.concatenate([s.cells(s.phrases(n, pairs), n, shape) for n in sizes])


def _let(s: Shard, size: int, shape: Shape, let: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Where the phrases begin whose cells are let through."""
    at = s.phrases(size, pairs)
    if not len(let) or not len(at):
        return np.empty(0, np.int64)
    cells = s.cells(at, size, shape)
    k = np.minimum(np.searchsorted(let, cells), len(let) - 1)
    return at[let[k] == cells]


def _of(reply: list[dict] | None, shape: Shape) -> np.ndarray:
    """The cells of a shard's reply, ascending."""
    if not reply:
        return np.empty(0, np.int64)
    return np.concatenate([(r["segment"] << shape.within) + _places(r["cells"]) for r in sorted(reply, key=lambda r: r["segment"])])


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one by one; they are large."""
    for k in range(batch.num_rows):
        yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def filled(rows: DataFrame, sizes: tuple[int, ...], shape: Shape) -> DataFrame:
    """shard, segment, cells and counts (255 at most) of the cells that each shard fills; rows have the shards' columns and let2, the reply for words and pairs (null if these are asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _each(b):
                s = Shard(row["lang"], row["words"], row["ids"])
                pairs = None if sizes == (1, 2) else _let(s, 2, shape, _of(row["let2"], shape))
                cells, counts = np.unique(_asked(s, sizes, shape, pairs), return_counts=True)
                if not len(cells):
                    continue
                segments = cells >> shape.within
                cuts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1], True])
                low, few = cells & ((1 << shape.within) - 1), np.minimum(counts, 255).astype(np.uint8)
                out = [(int(segments[lo]), _steps(low[lo:hi]), zstandard.compress(few[lo:hi].tobytes(), 1)) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(out), pa.int64()), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary())))], ["shard", "segment", "cells", "counts"])
        return_memory()

    return rows.select("shard", "lang", "words", "ids", "let2").mapInArrow(run, "shard long, segment long, cells binary, counts binary")


def bounds(cells: DataFrame, shape: Shape, least: int, parts: int) -> DataFrame:
    """segment and cells (those that reach least) of each segment that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, at = np.zeros(1 << shape.within, np.uint8), None

        def said():
            full = np.flatnonzero(sums >= least)
            return pa.RecordBatch.from_arrays([pa.array([at] * bool(len(full)), pa.int64()), pa.array([_steps(full)] * bool(len(full)), pa.binary())], ["segment", "cells"])

        for b in batches:
            for segment, places, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if segment != at:
                    if at is not None:
                        yield said()
                    sums[:], at = 0, segment
                p = _places(places)
                sums[p] = np.minimum(sums[p].astype(np.uint16) + np.frombuffer(zstandard.decompress(counts), np.uint8), 255)
        if at is not None:
            yield said()

    dealt = cells.select("segment", "cells", "counts").repartition(parts, "segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "segment long, cells binary")


def replies(cells: DataFrame, full: DataFrame, shape: Shape, parts: int) -> DataFrame:
    """shard and let (segment and cells of the shard's that are full) of each shard that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_full, at = np.zeros(1 << shape.within, bool), None
        for b in batches:
            out = []
            for segment, shard, places in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                p = _places(places)
                if shard < 0:  # sorted before all shards
                    is_full[:], at = False, segment
                    is_full[p] = True
                elif segment == at and len(own := p[is_full[p]]):
                    out.append((shard, segment, _steps(own)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["shard", "segment", "cells"])

    both = full.select("segment", F.lit(-1).cast("long").alias("shard"), "cells").unionByName(cells.select("segment", "shard", "cells"))
    said = both.repartition(parts, "segment").sortWithinPartitions("segment", "shard").mapInArrow(run, "shard long, segment long, cells binary")
    return said.groupBy("shard").agg(F.collect_list(F.struct("segment", "cells")).alias("let"))


def candidates_of(s: Shard, at: dict[int, np.ndarray]) -> list[str]:
    """The distinct phrases that begin at the places, by size."""
    out, v = [], len(s.words)
    names = [w.decode() for w in s.words]
    for size, places in at.items():
        left = s.ids[places]
        for k in range(1, size):  # a number for each distinct beginning, so keys stay small and exact
            _, first, left = np.unique(left.astype(np.int64) * v + s.ids[places + k], return_index=True, return_inverse=True)
        if size > 1 and len(places):
            out += [" ".join([names[i] for i in row]) for row in np.stack([s.ids[places[first] + k] for k in range(size)], axis=1).tolist()]
    return out


def occurrences(s: Shard, phrases: list[str]) -> np.ndarray:
    """How often each phrase occurs in the shard."""
    if not phrases:
        return np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        automaton.add_word(f" {p} ", k)
    automaton.make_automaton()
    names = [w.decode() for w in s.words]
    text = f" {' '.join([names[i] for i in s.ids.tolist()])} "
    return np.bincount(np.fromiter((k for _, k in automaton.iter(text)), np.int64), minlength=len(phrases))


def counted(rows: DataFrame, longest: int, shape: Shape, buckets: int) -> DataFrame:
    """bucket, lang, phrases and counts (compressed lists) of each shard's candidates, by a hash of the phrase; rows have the shards' columns and let2 and let3, the replies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _each(b):
                s = Shard(row["lang"], row["words"], row["ids"])
                let = _of(row["let2"], shape)
                pairs = _let(s, 2, shape, let)
                longer = _of(row["let3"], shape)
                phrases = candidates_of(s, {2: pairs} | {n: _let(s, n, shape, longer, pairs) for n in range(3, longest + 1)})
                found, times = np.unique(s.ids[_let(s, 1, shape, let)], return_counts=True)
                lines = [s.words[k] for k in found.tolist()] + [p.encode() for p in phrases]
                counts = np.r_[times, occurrences(s, phrases)]
                place = np.fromiter((xxhash.xxh64_intdigest(x) % buckets for x in lines), np.int64, len(lines))
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.unique(place)).tolist() + [len(order)]
                out = [(int(place[order[lo]]), zstandard.compress(b"\n".join([lines[k] for k in order[lo:hi].tolist()]), 1), packed(counts[order[lo:hi]])) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([row["lang"]] * len(out), pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "lang", "phrases", "counts"])
        return_memory()

    return rows.select("lang", "words", "ids", "let2", "let3").mapInArrow(run, "bucket long, lang string, phrases binary, counts binary")


def summed(lists: DataFrame, least: int, parts: int) -> DataFrame:
    """lang, phrase, size and f of the phrases that reach least in all shards together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        at = None

        def said():
            kept = {p: n for p, n in sums.items() if n >= least}
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([at[1]] * len(kept), pa.string()), pa.array(list(kept), pa.binary()).cast(pa.string()), pa.array([p.count(b" ") + 1 for p in kept], pa.int32()), pa.array(list(kept.values()), pa.int64())], ["lang", "phrase", "size", "f"])

        for b in batches:
            for bucket, lang, phrases, counts in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if at != (bucket, lang):
                    if at is not None:
                        yield said()
                    at = (bucket, lang)
                for p, n in zip(zstandard.decompress(phrases).split(b"\n"), unpacked(counts).tolist(), strict=True):
                    sums[p] = sums.get(p, 0) + n
        if at is not None:
            yield said()

    dealt = lists.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang")
    return dealt.mapInArrow(run, "lang string, phrase string, size int, f long")


def phrase_counts(tables: Tables, docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size and f of all words and phrases of up to longest words that occur least times or more; lang and n, all words of each language."""
    if not 1 <= least <= 255 or not 2 <= longest <= 5:
        raise ValueError("least is 1 to 255 and longest 2 to 5")
    made = tables.put("shards", shards(docs, text_col, lang_col, shard_words))
    sizes = tables.put("sizes", made.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0"))
    n_words = sizes.agg(F.sum("n")).first()[0] or 0
    shape = Shape(n_words)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffles, min(1 << (shape.cells - shape.within), n_words >> 22))
    rows = made.withColumn("let2", F.lit(None).cast("array<struct<segment: long, cells: binary>>"))
    for sizes_of, name in (((1, 2), "let2"), (tuple(range(3, longest + 1)), "let3")):
        if sizes_of:
            cells = tables.put(f"cells-{name}", filled(rows, sizes_of, shape))
            full = tables.put(f"full-{name}", bounds(cells, shape, least, parts))
            reply = tables.put(name, replies(cells, full, shape, parts).withColumnRenamed("let", name))
            tables.drop(f"cells-{name}", f"full-{name}")
            rows = (made if name == "let2" else rows).join(reply, "shard", "left")
        else:
            rows = rows.withColumn(name, F.lit(None).cast("array<struct<segment: long, cells: binary>>"))
    # At most a tenth of all words are phrases that occur often; a bucket holds some 100,000 of them.
    buckets = max(shuffles, min(1 << 20, n_words // 10 >> 17))
    counts = tables.put("counts", summed(counted(rows, longest, shape, buckets), least, max(shuffles, buckets >> 3)))
    tables.drop("shards", "let2", "let3")
    return counts, sizes


def _part(words: Column, lo: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, lo, n), " ")


def scored(tables: Tables, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of each phrase, by its lowest-scoring cut."""
    phrases = counts.where(F.col("size") > 1)
    ks = F.sequence(F.lit(1), F.col("size") - 1)
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(ks).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), _part(words, F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _part(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    asked = cuts.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    sizes = asked.groupBy("lang", "part").agg(F.count("*").alias("n_asked"))
    known = tables.put("parts", sizes.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]))
    got = dealt_join(asked, known, ["lang", "part"], "n_asked", "phrase")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f"))).alias(side)
    each = got.groupBy("lang", "phrase", "a", "k").agg(of("l"), of("r"))
    # Exact beyond 64 bits: decimals of up to 27 digits.
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000BD) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))").cast("long")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return each.groupBy("lang", "phrase", "a").agg(best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def inside(counts: DataFrame) -> DataFrame:
    """lang, phrase and longer: the greatest count of a longer phrase that holds it."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda lo: _part(words, lo, n))))
    subs = counts.where(F.col("size") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
    return subs.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def top(rows: DataFrame, key: str, order: list[Column], most: int, by: str, parts: int = 64) -> DataFrame:
    """The first rows of each key, with their rank; the rows of a key are ranked in parts first, so no task sees a key with more than parts times most rows."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).where(F.col("rank") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most).drop("_part")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, most: int = 2000, share: int = 80, shard_words: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases.

    a, l and r are the counts of the phrase and of the parts before and after its
    lowest-scoring cut, n that of all words. The score is 2000000 a / (l + r),
    rounded down. A phrase inside a longer one with share percent of its count or
    more is left out.
    """
    tables = Tables(docs.sparkSession, "collocations")
    counts, sizes = phrase_counts(tables, docs, text_col, lang_col, longest, least, shard_words)
    rows = scored(tables, counts).join(inside(counts), ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = rows.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share)).drop("longer")
    first = top(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most, "phrase")
    return first.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
