"""Periodic runs of words, from LZ blocks.

A run is a stretch of words with smallest period q that occurs at least three
times over (its length is at least 3 q, and at least ``least``) and that no
neighbouring word extends. Method, per document:

1. Prefix doubling gives the suffix array and, for each width 1, 2, 4, ..., the
   class of the window of that width at each place. Two places' common
   extension to the right or the left is read from the classes, widest first.
2. The longest previous factor of each place is its longer common prefix with
   the nearest smaller places before and after it in the suffix array.
3. Blocks follow: each begins where the one before ends and is as long as its
   longest previous factor (one word if there is none).
4. Main's extensions. Let P and B be the blocks before and after a border. A run
   that crosses the border or begins or ends at it, has its last word in B or
   right before the border, and has three periods, has q < (|P| + |B|) / 2: else
   P's first word has an equal stretch one period earlier that is longer than
   P. For each such q the words around the border are compared with those q
   places before and after.
5. All other runs lie inside a block, with a word to spare on both sides. They
   are copies of runs in the block's earlier occurrence; blocks are visited from
   left to right and runs are found there by the place where they begin.

A document's words stay together in a task; many short documents are handled at
once, as numpy arrays in which each ends with a mark of its own. Memory is
about 100 bytes a word of the documents handled at once (``GROUP`` words, or one
document if it is longer).

Null and empty texts have no words and no runs. Rows are independent of each
other: equal rows and rows with equal ids get equal results, extra columns are
left behind, an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, prepared, restored

#: Words handled at once, about.
GROUP = 1 << 17
#: Rounds of pointer jumping before the rest is done one by one.
JUMPS = 24

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Suffixes:
    """Suffix array of symbols, and classes of their windows of 1, 2, 4, ... symbols. The last symbol occurs once."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sa = np.argsort(symbols, kind="stable")
        s = symbols[self.sa]
        new = np.r_[True, s[1:] != s[:-1]]
        rank = np.empty(n, np.int32)
        rank[self.sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.classes = [rank]
        while len(open_slots := np.flatnonzero(~(new & np.r_[new[1:], True]))):
            at = self.sa[open_slots]  # windows that occur again; none of them holds a mark
            key = (rank[at].astype(np.int64) << 32) | rank[at + (1 << (len(self.classes) - 1))]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            first = np.r_[True, key[1:] != key[:-1]]
            self.sa[open_slots], new[open_slots] = at, first
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(first, open_slots, 0))
            self.classes.append(rank)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and j on are equal."""
        out, live, top = np.zeros(len(i), np.int64), np.arange(len(i)), []
        for c in self.classes:
            live = live[c[i[live]] == c[j[live]]]
            if not len(live):
                break
            top.append(live)
        for k in reversed(range(len(top))):
            live = top[k]
            out[live] += (self.classes[k][i[live] + out[live]] == self.classes[k][j[live] + out[live]]).astype(np.int64) << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and j are equal; i < j."""
        out, live, top = np.zeros(len(i), np.int64), np.arange(len(i)), []
        for k, c in enumerate(self.classes):
            live = live[i[live] >= 1 << k]
            live = live[c[i[live] - (1 << k)] == c[j[live] - (1 << k)]]
            if not len(live):
                break
            top.append(live)
        for k in reversed(range(len(top))):
            live = top[k]
            live = live[i[live] - out[live] >= 1 << k]
            back = out[live] + (1 << k)
            out[live] += (self.classes[k][i[live] - back] == self.classes[k][j[live] - back]).astype(np.int64) << k
        return out


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each slot the nearest one before it with a smaller value, or -1."""
    left = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero((left >= 0) & (values[left] > values))
    for _ in range(JUMPS):
        if not len(todo):
            return left
        left[todo] = left[left[todo]]  # all slots that are passed over hold larger values
        to = left[todo]
        todo = todo[(to >= 0) & (values[to] > values[todo])]
    for slot in todo.tolist():
        to = left[slot]
        while to >= 0 and values[to] > values[slot]:
            to = left[to]
        left[slot] = to
    return left


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest factor at each place that also begins at an earlier place, and that place."""
    n = len(s.sa)
    group = s.classes[0][s.sa].astype(np.int64) * n  # suffixes with another first symbol have nothing in common: the search ends at them
    sides = (smaller_before(s.sa + group), n - 1 - smaller_before((s.sa - group)[::-1])[::-1])
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for side in sides:
        has = np.flatnonzero((side >= 0) & (side < n))
        at, other = s.sa[has], s.sa[side[has]]
        common = s.right(at, other)
        better = common > length[at]
        length[at[better]], source[at[better]] = common[better], other[better]
    return length, source


def blocks_of(length: np.ndarray) -> np.ndarray:
    """Where the blocks begin."""
    steps, out, at, n = np.maximum(length, 1).tolist(), [], 0, len(length)
    while at < n:
        out.append(at)
        at += steps[at]
    return np.array(out, np.int64)


def crossing(s: Suffixes, starts: np.ndarray, least: int) -> set[tuple[int, int, int]]:
    """start, end and period of runs that touch a border of blocks; the period is the least of a stretch."""
    n = len(s.sa)
    ends = np.r_[starts[1:], n]
    most = (ends[1:] - starts[:-1] - 1) // 2
    border = np.repeat(starts[1:], most)
    q = np.arange(len(border)) - np.repeat(np.cumsum(most) - most, most) + 1
    c, found = s.classes[0], {}
    for i, j, p in ((border - q, border, q), (border, border + q, q)):
        ok = np.flatnonzero((i >= 0) & (j < n))
        i, j, p = i[ok], j[ok], p[ok]
        near = np.flatnonzero((c[i] == c[j]) | ((i > 0) & (c[i - 1] == c[j - 1])))
        i, j, p = i[near], j[near], p[near]
        back, on = s.left(i, j), s.right(i, j)
        good = np.flatnonzero(back + on + p >= np.maximum(least, 3 * p))
        for run in zip((i - back)[good].tolist(), (j + on)[good].tolist(), p[good].tolist(), strict=True):
            found[run[:2]] = min(run[2], found.get(run[:2], run[2]))
    return {(a, b, p) for (a, b), p in found.items()}


def copied(runs: set[tuple[int, int, int]], starts: np.ndarray, source: np.ndarray, n: int, least: int) -> list[tuple[int, int, int]]:
    """runs, sorted, with those inside blocks, from the blocks' earlier occurrences."""
    have, by_start = set(runs), sorted(runs)
    if not have:
        return by_start
    ends = np.r_[starts[1:], n]
    long = np.flatnonzero(ends - starts >= least + 2)
    for s, e, p in zip(starts[long].tolist(), ends[long].tolist(), source[starts[long]].tolist(), strict=True):
        shift, limit = s - p, p + e - s
        k, todo = bisect_left(by_start, (p + 1,)), []
        while k < len(by_start) and by_start[k][0] < limit:
            todo.append(by_start[k])
            k += 1
        while todo:
            a, b, q = todo.pop()
            if p < a and b < limit and (new := (a + shift, b + shift, q)) not in have:
                have.add(new)
                insort(by_start, new)
                todo.append(new)  # the block may overlap its earlier occurrence
    return by_start


def runs_of(symbols: np.ndarray, least: int = 24) -> list[tuple[int, int, int]]:
    """start, end and period of all runs of the symbols, by start; the last symbol is a mark that occurs once."""
    s = Suffixes(symbols)
    length, source = previous_factors(s)
    starts = blocks_of(length)
    return copied(crossing(s, starts, least), starts, source, len(symbols), least)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by a space, without those in a run after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for a, b, q in runs:
        edge[a + q] += 1
        edge[b] -= 1
    return b" ".join(w for w, k in zip(words, np.cumsum(edge).tolist(), strict=False) if not k)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, rewrite: Rewrite | None = None) -> DataFrame:
    """id_col, n_words, runs (start, length, period; by start, then period) and collapsed of each row.

    Words are numbered from 0. ``collapsed`` is the words, joined by a space,
    that no run holds after its first period. ``rewrite(id, words)`` may change
    the words before they are searched.
    """

    def searched(words_of: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
        number, parts, at = Numbers(), [], [0]
        for k, words in enumerate(words_of):
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            parts += [ids | k << 32, np.array([k << 32 | 0xFFFFFFFF])]
            at.append(at[-1] + len(words) + 1)
        found, k = runs_of(np.concatenate(parts), least), 0
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            first = k
            while k < len(found) and found[k][0] < hi:
                k += 1
            yield [(a - lo, b - lo, q) for a, b, q in found[first:k]]

    def answer(ids: list[int], words_of: list[list[bytes]]) -> pa.RecordBatch:
        runs, kept = [], []
        for words, found in zip(words_of, searched(words_of), strict=True):
            kept.append(_kept(words, found) if found else b" ".join(words))
            runs.append([{"start": a, "length": b - a, "period": q} for a, b, q in found])
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words_of], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words_of, n = [], [], 0
        for b in batches:
            for i, body in zip(b.column(0), b.column(1), strict=True):
                i, words = i.as_py(), body.as_py().split()
                if rewrite is not None:
                    words = rewrite(None if i == NULL_ID else i, words)
                if ids and n + len(words) > GROUP:
                    yield answer(ids, words_of)
                    ids, words_of, n = [], [], 0
                ids.append(i)
                words_of.append(words)
                n += len(words) + 1
        if ids:
            yield answer(ids, words_of)
        pa.default_memory_pool().release_unused()

    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    found = prepared(docs, id_col, text_col).select("id", "body").mapInArrow(run, schema)
    return found.select(restored().alias(id_col), "n_words", "runs", "collapsed")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_runs, the run of the greatest exact exponent (the first of equals) and SHA-256 digests of what ``find`` gives."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    greater = lambda r, best: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda best, r: F.when(greater(r, best), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("_best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("_best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
