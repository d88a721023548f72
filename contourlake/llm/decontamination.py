"""Benchmark decontamination by q-gram lemma filtering.

A text holds an item if a stretch of it is within the item's edit budget
(``rate`` of the item's characters). An occurrence with at most e edits shares
at least m + 1 - q (e + 1) of the item's q-grams with the text, all on
diagonals (text place minus item place) at most e apart from each other. So the
shared q-grams are counted in diagonal bands that overlap by as much; regions
that reach the bound are kept and verified by an alignment in the band.

The benchmark is a stated query set: it is read in blocks of at most
``block_chars`` characters, whose q-gram index is broadcast (about 24 bytes a
character), and each block meets every row of documents in one scan without a
shuffle. A document's q-grams first meet a bitmap; only hits meet the index.

Texts are compared lowered and with runs of white space as one space. The
budget of a short item shrinks until the bound is at least ``least`` q-grams.
Items of fewer characters than ``min_chars`` after that are looked for exactly,
between word boundaries, by one automaton over all of them; those of fewer than
``min_exact`` (a word or two, which clean texts have) only if that parameter is
lowered. Null and empty items are not looked for. A null or empty text holds
nothing. Repeated rows get equal rows; a table without rows, on either
side, gives no hits; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
RATE = 0.1
MIN_CHARS, MIN_EXACT = 24, 12
BLOCK_CHARS = 4 << 20
#: Characters of text looked up at once.
SLICE = 1 << 21
SLOT_BITS = 22


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def folded(text: str) -> np.ndarray:
    """A byte per character: equal characters have equal bytes, so the bound holds for bytes, too."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (codes ^ (codes >> 8) ^ (codes >> 16)).astype(np.uint8)


def grams(codes: np.ndarray) -> np.ndarray:
    """Each window of Q bytes as one number."""
    n = len(codes) - Q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out = (out << np.uint64(8)) | codes[k : k + n]
    return out


def budget(m: int, rate: float = RATE, least: int = 4) -> int:
    """Edits allowed in an item of m characters; less than rate if the bound would fall under least q-grams."""
    return max(0, min(int(rate * m), (m + 1 - least) // Q - 1))


def slots(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Index:
    """Items of a block: ids, normal texts, q-grams sorted with their item and place, and a bitmap of them; short: items that are looked for exactly."""

    ids: list[int]
    texts: list[str]
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    short: list[int]

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for k in self.short:
            out.add_word(self.texts[k], [*out.get(self.texts[k], []), k])
        out.make_automaton()
        return out

    def exact(self, text: str) -> Iterator[int]:
        """Short items that stand in the text between word boundaries."""
        for end, found in self.automaton.iter(text):
            start = end + 1 - len(self.texts[found[0]])
            if not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end + 1 < len(text) and text[end].isalnum() and text[end + 1].isalnum()):
                yield from found


def build(ids: list[int], texts: list[str], rate: float, min_chars: int = MIN_CHARS) -> Index:
    edits = np.array([budget(len(t), rate) for t in texts], np.int64)
    need = np.array([len(t) + 1 - Q * (e + 1) for t, e in zip(texts, edits, strict=True)], np.int64)
    parts = [grams(folded(t)) if len(t) >= min_chars else np.empty(0, np.uint64) for t in texts]
    sizes = [len(p) for p in parts]
    keys = np.concatenate([np.empty(0, np.uint64), *parts])
    item = np.repeat(np.arange(len(parts)), sizes)
    place = np.concatenate([np.empty(0, np.int64), *(np.arange(n) for n in sizes)])
    order = np.argsort(keys, kind="stable")
    bitmap = np.zeros(1 << SLOT_BITS, bool)
    bitmap[slots(keys)] = True
    return Index(ids, texts, edits, need, keys[order], item[order].astype(np.int64), place[order].astype(np.int64), bitmap, [k for k, t in enumerate(texts) if len(t) < min_chars])


def regions(index: Index, codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(document of the bounds, item, first diagonal of the band) of the bands that reach the item's bound."""
    g = grams(codes)
    at = np.flatnonzero(index.bitmap[slots(g)])
    lo, hi = (np.searchsorted(index.keys, g[at], side) for side in ("left", "right"))
    n = hi - lo
    total = int(n.sum())
    if not total:
        return []
    where = np.repeat(at, n)
    entry = np.repeat(lo, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    item, place = index.item[entry], index.place[entry]
    doc = np.searchsorted(bounds, where, "right") - 1
    edits = index.edits[item]
    width = 2 * edits + 1  # bands of twice the width of what one occurrence spans, each starting halfway in the last
    diagonal = where - bounds[doc] - place + len(codes)
    band = diagonal // width
    # Item and document in one number: sorting it with the band puts each band's hits together.
    owner = doc * len(index.texts) + item
    owner, band = np.r_[owner, owner], np.r_[band, band - 1]
    key = owner * (4 * len(codes)) + band + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.r_[0, np.flatnonzero(np.diff(key) != 0) + 1]
    last = np.r_[first[1:], len(key)]
    out = []
    for k in np.flatnonzero(last - first >= index.need[owner[order[first]] % len(index.texts)]):
        hits = order[first[k] : last[k]]
        d, i = divmod(int(owner[hits[0]]), len(index.texts))
        hits = hits % total
        if dense(diagonal[hits], place[hits], 2 * int(index.edits[i]), int(index.need[i])):
            out.append((d, i, int(band[order[first[k]]]) * (2 * int(index.edits[i]) + 1) - len(codes)))
    return out


def dense(diagonal: np.ndarray, place: np.ndarray, span: int, need: int) -> bool:
    """Whether diagonals at most span apart have need different places of the item."""
    order = np.argsort(diagonal, kind="stable")
    diagonal, place = diagonal[order], place[order]
    upto = np.searchsorted(diagonal, diagonal + span, "right")
    return any(len(np.unique(place[k : upto[k]])) >= need for k in np.flatnonzero(upto - np.arange(len(upto)) >= need))


def aligned(item: str, text: str, diagonal: int, edits: int) -> int:
    """Least edits between the item and a stretch of text on diagonals from diagonal - edits to diagonal + 5 edits + 2; edits + 1 if there are more."""
    a = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), np.uint32)
    b = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lo, width = diagonal - edits, 6 * edits + 3
    far = np.int64(edits + 1)
    # Cell k of row i is the text place lo + k + i: a match stays in its cell, an item character without a partner comes from the cell to the right.
    places = lo + np.arange(width)
    row = np.where((places >= 0) & (places <= len(b)), 0, far)
    steps = np.arange(width)
    for i, c in enumerate(a):
        at = places + i
        inside = (at >= 0) & (at < len(b))
        same = np.zeros(width, bool)
        same[inside] = b[at[inside]] == c
        new = row + ~same
        new[~inside] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(at + 1 < 0) | (at + 1 > len(b))] = far
        row = np.minimum(np.minimum.accumulate(new - steps) + steps, far)
        if row.min() >= far:
            break
    return int(row.min())


def held(index: Index, texts: list[str]) -> list[list[tuple[int, int]]]:
    """For each normal text the (item, edits) it holds."""
    out: list[dict[int, int]] = [{k: 0 for k in index.exact(t)} if index.short else {} for t in texts]
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) < SLICE):
            n += len(texts[hi]) + 1
            hi += 1
        parts = texts[lo:hi]
        bounds = np.cumsum([0] + [len(t) + 1 for t in parts])[:-1]
        for d, k, diagonal in regions(index, folded("\n".join(parts)), bounds):
            item, text, e = index.texts[k], parts[d], int(index.edits[k])
            if out[lo + d].get(k) == 0:
                continue
            found = 0 if item in text[max(0, diagonal) : max(0, diagonal) + len(item) + 4 * e + 2] else aligned(item, text, diagonal, e)
            if found <= e:
                out[lo + d][k] = min(found, out[lo + d].get(k, found))
        lo = hi
    return [sorted(x.items()) for x in out]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, min_exact: int, block_chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark's distinct items in blocks; a partition of it is in the driver's memory at a time."""
    ids, texts, n = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).distinct()
    for r in rows.toLocalIterator():
        t = normal(r["t"])
        if len(t) < max(1, min_exact):
            continue
        if texts and n + len(t) > block_chars:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(r["i"])
        texts.append(t)
        n += len(t)
    if texts:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """id_col, item_id and edits of each item that each row of docs holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    schema = "id long, item_id long, edits long"

    def scan(block):
        sent = spark.sparkContext.broadcast(build(*block, rate, min_chars))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                ids, texts = b.column(0).to_pylist(), [normal(x) for x in b.column(1).to_pylist()]
                out = [(i, index.ids[k], e) for i, found in zip(ids, held(index, texts), strict=True) for k, e in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], ["id", "item_id", "edits"])

        return rows.mapInArrow(run, schema)

    out = None
    for block in blocks(benchmark, item_col, item_text_col, min_exact, block_chars):
        out = scan(block) if out is None else out.unionByName(scan(block))
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, min_exact: int = MIN_EXACT) -> DataFrame:
    """The rows of docs, whole, that hold no item: a filter per block, without a shuffle."""
    schema, names = docs.schema, docs.columns
    spark = docs.sparkSession
    out = docs

    def scan(rows, block):
        sent = spark.sparkContext.broadcast(build(*block, rate, min_chars))
        at = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [normal(x) if x else "" for x in b.column(at).to_pylist()]
                yield b.filter(pa.array([not found for found in held(sent.value, texts)], pa.bool_()))

        return rows.mapInArrow(run, schema)

    for block in blocks(benchmark, item_col, item_text_col, min_exact, block_chars):
        out = scan(out, block)
    return out
