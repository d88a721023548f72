"""Best-fit packing into sequences of several permitted lengths.

Items of equal length are alike, so best-fit decreasing is run on the histogram
of lengths: state and steps are bounded by the largest capacity, whatever the
number of documents, and thousands of bins that look the same are filled in one
step. The plan is exact: it puts items where item-by-item best-fit decreasing
would put them. If no open bin has room, the size is opened that costs least a
token: ``cost(c) = c + overhead`` over what a bin of that size can hold of the
items still to come. At the end each bin is downsized to the smallest permitted
length that holds its contents.

Items then find their bins by their rank among items of their length. The task
that cuts a document numbers its own items of each length; counts by task and
length, summed over the tasks before, turn that into a rank, so neither texts
nor ids are sorted, and no length, even one that holds a third of all rows, is
gathered in a task. Items of equal length so take places in the order in which
they were written. The counts go to the tasks if they are at most
``MOST_COUNTS``, else they meet the items in a shuffled join; the plan is
bounded by the capacity.

A document's items are its token ids, by the tokenizer that the token output
uses, and one end id. More ids than the largest capacity are cut into full
pieces and a rest; nothing is dropped. ``pack`` gives each item's place,
``sequences`` the bins with their contents, which a bin's capacity bounds. A
null or empty text is the end id alone. Rows with equal ids are packed one by
one. An empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, prepared, restored, returning
from .token_output import codec, encoder_of, stretches, train_dictionary

CAPACITIES = (256, 512, 1024, 2048)
OVERHEAD = 16
#: Counts by task and length up to which they are broadcast: some 64 MB.
MOST_COUNTS = 1 << 21
ITEM = ["id", "piece", "length", "task", "nth", "ids"]


@dataclass
class Plan:
    """Segments (length, from rank, items, first bin, items a bin, offset in the bin), by length descending and rank; spans (first bin, bins, capacity, tokens)."""

    segments: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD) -> Plan:
    """Best-fit decreasing of histogram[length] items of each length."""
    caps = sorted(set(capacities))
    out, open_bins, rooms, made = Plan(), {}, [], 0  # open_bins: (first, bins, opened size) by room left; rooms: the rooms, ascending
    left = sum(n * k for n, k in histogram.items())
    lengths = sorted((n for n, k in histogram.items() if k), reverse=True)

    def give_back(room: int, first: int, bins: int, size: int) -> None:
        if room not in open_bins:
            bisect.insort(rooms, room)
            open_bins[room] = []
        heapq.heappush(open_bins[room], (first, bins, size))

    for at, n in enumerate(lengths):
        count, rank = histogram[n], 0
        smaller = at + 1 < len(lengths)
        while rank < count:
            k = bisect.bisect_left(rooms, n)
            if k < len(rooms):
                room = rooms[k]
                first, bins, size = heapq.heappop(open_bins[room])
                if not open_bins[room]:
                    del open_bins[room], rooms[k]
            else:
                items = count - rank
                holds = {c: min(left, c if smaller else c // n * n, left if smaller else items * n) for c in caps if c >= n}
                size = min(holds, key=lambda c: ((c + overhead) / holds[c], c))
                first, bins, room = made, max(1, items // (size // n)), size
                made += bins
            each = room // n
            full = min(bins, (count - rank) // each)
            if full:
                out.segments.append((n, rank, full * each, first, each, size - room))
                rank += full * each
                left -= full * each * n
                give_back(room - each * n, first, full, size)
            if full < bins and rank < count:  # the last items of this length share a bin
                rest = count - rank
                out.segments.append((n, rank, rest, first + full, rest, size - room))
                rank, left = count, left - rest * n
                give_back(room - rest * n, first + full, 1, size)
                full += 1
            if full < bins:
                give_back(room, first + full, bins - full, size)
    for room, found in open_bins.items():
        for first, bins, size in found:
            if size > room:
                out.spans.append((first, bins, next(c for c in caps if c >= size - room), size - room))
    out.spans.sort()
    return out


def items(docs: DataFrame, largest: int, path: str, end_id: int, dictionary: bytes | None) -> DataFrame:
    """id, piece, length, task, nth (of the task's items of this length) and, if there is a dictionary, ids (serialized, compressed with it) of the items of prepared rows."""
    with_ids = dictionary is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, task = encoder_of(path), codec(dictionary or b"", 9)[0], TaskContext.get().partitionId()
        end, seen = np.array([end_id], encoder.kind), np.zeros(largest + 1, np.int64)
        for b in batches:
            for part in stretches(b, 2):
                got = encoder(part.column(2).cast(pa.string()))
                sizes = np.array([len(x) + 1 for x in got], np.int64)
                pieces = -(-sizes // largest)
                row = np.repeat(np.arange(len(got)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(largest, sizes[row] - piece * largest)
                order = np.argsort(length, kind="stable")
                first = np.r_[0, np.flatnonzero(np.diff(length[order])) + 1]
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) + seen[length[order]]
                seen += np.bincount(length, minlength=largest + 1)
                cols = [part.column(0).take(pa.array(row)), pa.array(piece), pa.array(length.astype(np.int32)), pa.array(np.full(len(row), task, np.int32)), pa.array(nth)]
                if with_ids:
                    whole = [np.concatenate([x, end]) for x in got]
                    cols.append(pa.array([packer.compress(whole[r][k * largest : (k + 1) * largest].tobytes()) for r, k in zip(row.tolist(), piece.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ITEM[: len(cols)])

    return docs.select("id", "tkey", "body").mapInArrow(returning(run), "id long, piece long, length int, task int, nth long" + ", ids binary" * with_ids)


def placed_items(docs: DataFrame, path: str, id_col: str, text_col: str, capacities: Sequence[int], overhead: float, end_id: int, dictionary: bytes | None = None) -> DataFrame:
    """id, piece, length, bin_id, bin_capacity, bin_offset (and ids, if there is a dictionary) of each item of docs."""
    spark, with_ids = docs.sparkSession, dictionary is not None
    tables = Tables(spark, "packing")
    found = tables.put("items", items(prepared(docs, id_col, text_col), max(capacities), path, end_id, dictionary))
    counts = tables.put("counts", found.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most the largest capacity
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    before = tables.put("before", counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    before = F.broadcast(before) if before.count() <= MOST_COUNTS else before
    longer, total = {}, 0
    for length in sorted(histogram, reverse=True):
        longer[length], total = total, total + histogram[length]
    sent = spark.sparkContext.broadcast((plan(histogram, capacities, overhead), longer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, longer = sent.value
        seg = np.array(p.segments, np.int64).reshape(-1, 6)
        span = np.array(p.spans, np.int64).reshape(-1, 4)
        starts = np.array([longer[x] for x in seg[:, 0]], np.int64) + seg[:, 1]  # in the order of all items
        base = np.zeros(max(longer, default=0) + 1, np.int64)
        base[list(longer)] = list(longer.values())
        for b in batches:
            if not b.num_rows:
                continue
            length, nth, earlier = (b.column(k).to_numpy() for k in (2, 3, 4))
            place = base[length] + earlier + nth
            s = np.searchsorted(starts, place, "right") - 1
            at = place - starts[s]
            bins = seg[s, 3] + at // seg[s, 4]
            offset = seg[s, 5] + at % seg[s, 4] * length
            size = span[np.searchsorted(span[:, 0], bins, "right") - 1, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bins), pa.array(size.astype(np.int32)), pa.array(offset.astype(np.int32)), *b.columns[5:]], ["id", "piece", "length", "bin_id", "bin_capacity", "bin_offset", "ids"][: b.num_columns + 1])

    schema = "id long, piece long, length int, bin_id long, bin_capacity int, bin_offset int" + ", ids binary" * with_ids
    return found.join(before, ["task", "length"]).select("id", "piece", "length", "nth", "before", *["ids"] * with_ids).mapInArrow(returning(run), schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, end_id: int = 0) -> DataFrame:
    """id_col, piece, length, bin_id, bin_capacity, bin_offset of each item of docs."""
    out = placed_items(docs, path, id_col, text_col, capacities, overhead, end_id)
    return out.select(restored().alias(id_col), "piece", "length", "bin_id", "bin_capacity", "bin_offset")


def sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, end_id: int = 0) -> DataFrame:
    """bin_id, bin_capacity, doc_ids, offsets (where each document's piece begins) and ids (all token ids, in order) of each bin."""
    kind = encoder_of(path).kind.str
    dictionary = train_dictionary(prepared(docs, id_col, text_col), path, docs.count())
    found = placed_items(docs, path, id_col, text_col, capacities, overhead, end_id, dictionary)
    bins = found.groupBy("bin_id", "bin_capacity").agg(F.sort_array(F.collect_list(F.struct("bin_offset", restored().alias("id"), "ids"))).alias("held"))  # at most the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpacker = codec(dictionary)
        for b in batches:
            held = [[x.values() for x in h] for h in b.column(2).to_pylist()]
            offsets, docs, packed = ([[list(x)[k] for x in h] for h in held] for k in range(3))
            ids = [np.concatenate([np.frombuffer(unpacker.decompress(x), kind) for x in p]).astype(np.int32) for p in packed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(docs, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))], ["bin_id", "bin_capacity", "doc_ids", "offsets", "ids"])

    return bins.mapInArrow(returning(run), "bin_id long, bin_capacity int, doc_ids array<long>, offsets array<int>, ids array<int>")
