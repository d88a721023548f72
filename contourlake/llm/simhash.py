"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is 1 if it is set in over half of the hashes of the text's
word shingles: the first 64 bits come from XXH64 (seed 42), each further 64
from a mix of it. Two documents are linked if their fingerprints differ in at
most ``max_bits`` bits. A ``Shape`` cuts a fingerprint into segments, each with
a table; a pair is looked at if a segment of one lies in the Hamming ball of
radius 1 around the other's, and its complete distance is verified.

* ``EXACT``: 64 bits, two segments of 32 and at most three bits. One of the
  segments differs in one bit at most, so every link is found.
* ``shape_for(n, similarity)``: two sets of shingles of Jaccard similarity j
  differ in each bit with probability acos(2j / (1 + j)) / pi. The most bits
  are those expected at the similarity; segments grow with the logarithm of n,
  so random matches stay rare, and there are as many tables as it takes to miss
  no more than ``LOST`` of the pairs right at the threshold. With 512 bits the
  similarity that a fingerprint states has a standard error of 0.036 at 0.8.

What keeps it in bounds:

* Only distinct fingerprints are indexed: a group of exact copies, however
  large, is one entry.
* A segment's table is dealt out by either half of the segment, since of two
  halves one is equal within the ball; the ball of the other half is enumerated
  inside the task. That is two rows per table instead of one per ball member.
* Groups of near copies are first taken in from pivots, then only what is
  outside the largest group looks the others up. n fingerprints of a group give
  n - 1 edges; pairs are never listed.
* A half whose rows are cut over range partitions meets again in one task if it
  has at most ``BLOCK`` rows. Of a larger one the pivots of the pieces are
  linked, then what is outside its largest component meets all pieces, in blocks
  of bounded size.
* Components come from alternating star contractions; each round is written to
  the shared folder.

Null and empty texts have the fingerprint zero and are linked like others. A
null id is smaller than any other. A repeated row is in the component of its
twin. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, partitions, prepared, restored, restored_rows, returning, squeezed

SEED = 42
#: A doc's shingles are hashed and summed this many at a time, or fewer for wide fingerprints.
SLICE = 1 << 16
#: Share of the pairs right at the threshold that no table shows.
LOST = 0.005
#: Fingerprints of a half that meet in a task where the half was cut.
BLOCK = 1 << 14
#: Pairs whose distance is computed at once.
PAIRS = 1 << 20
#: Rows of a half up to which all its pairs are looked at in turn.
SMALL = 24


@dataclass(frozen=True)
class Shape:
    """Fingerprints of so many bits; tables of so many segments of so many (an even number of) bits; the most bits in which linked ones differ."""

    bits: int
    segment: int
    tables: int
    max_bits: int


EXACT = Shape(64, 32, 2, 3)


def shape_for(n: int, similarity: float) -> Shape:
    """A shape for n documents and a Jaccard similarity of their shingles; see the module's text."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    segment = max(16, 2 * math.ceil((math.log2(max(n, 2)) - 4) / 2))
    seen = (1 - p) ** segment + segment * p * (1 - p) ** (segment - 1)
    tables = math.ceil(math.log(LOST) / math.log(1 - seen)) if p else 1
    bits = max(512, -(-tables * segment // 64) * 64)
    return Shape(bits, segment, tables, int(bits * p))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash derived from h; h itself for 0."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the rows of words have each bit, from bit 0 of the first word on; bytes count up to 255 rows at a time."""
    ones = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(ones, np.arange(0, len(h), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), -1).sum(axis=0, dtype=np.int64)


def fingerprint(body: bytes, shingle: int = 3, bits: int = 64) -> bytes:
    """SimHash of the ASCII-lowered words' shingles, highest bit first; fewer words: the whole sequence; none: zero."""
    words = body.lower().split()
    if not words:
        return bytes(bits // 8)
    n = max(1, len(words) - shingle + 1)
    sums = np.zeros(bits, np.int64)
    step = max(1, SLICE * 64 // bits)
    for at in range(0, n, step):
        part = words[at : at + step + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        sums += set_bits(np.stack([mixed(h, k) for k in range(bits // 64)], axis=1))
    return np.packbits((sums * 2 > n).reshape(-1, 64)[:, ::-1]).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, bits: int = 64) -> DataFrame:
    """id, tkey and fp (the fingerprint's bytes) of each prepared row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(x, shingle, bits) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.binary())], ["id", "tkey", "fp"])

    return docs.select("id", "tkey", "body").mapInArrow(returning(run), "id long, tkey long, fp binary")


def as_words(column: pa.Array, bits: int) -> np.ndarray:
    """A row of 64-bit words for each fingerprint."""
    size = bits // 8
    at = column.offset * size  # all have the same size
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * size, at).view(np.uint64).reshape(len(column), -1) if len(column) else np.empty((0, size // 8), np.uint64)


def table_rows(fps: DataFrame, shape: Shape) -> DataFrame:
    """key (table, which half, the half's value), rest (the other half) and fp: two rows for each fingerprint and table."""
    half = shape.segment // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.arange(2 * shape.tables, dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                column = b.column(0).slice(lo, 4096)
                n = len(column)
                bits = np.unpackbits(as_words(column, shape.bits).view(np.uint8), axis=1)[:, : shape.tables * shape.segment]
                value = bits.reshape(n, 2 * shape.tables, half) @ (1 << np.arange(half - 1, -1, -1, dtype=np.int32))
                key = names << 32 | value
                rest = value[:, names ^ 1].astype(np.int32)
                of = column.take(pa.array(np.repeat(np.arange(n), len(names))))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(rest.ravel()), of], ["key", "rest", "fp"])

    return fps.select("fp").mapInArrow(returning(run), "key long, rest int, fp binary")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def taken_in(words: np.ndarray, max_bits: int, tries: int = 16) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges from pivots that take in much of what is left, and each row's pivot (itself where none did)."""
    edges, pivot, left = [], np.arange(len(words)), np.arange(len(words))
    for k in range(tries):
        if len(left) < 8:
            break
        p = left[(2 * k + 1) * len(left) // (2 * tries)]
        near = distance(words[left], words[p]) <= max_bits
        if near.sum() > max(4, len(left) // 16):
            pivot[left[near]] = p
            edges += [(p, x) for x in left[near] if x != p]
            left = left[~near]
    return edges, pivot


def looked_up(words: np.ndarray, rest: np.ndarray, queries: np.ndarray, group: np.ndarray, half: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs of different groups within the ball of the rest and within max_bits."""
    order = np.argsort(rest, kind="stable")
    ranked = rest[order]
    for ball in (0, *(1 << k for k in range(half))):
        lo, hi = (np.searchsorted(ranked, rest[queries] ^ ball, side) for side in ("left", "right"))
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(queries):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = (hi - lo)[at:upto]
            q = np.repeat(queries[at:upto], n)
            x = order[np.arange(len(q)) + np.repeat(lo[at:upto] - (np.cumsum(n) - n), n)]
            apart = group[q] != group[x]
            q, x = q[apart], x[apart]
            near = distance(words[q], words[x]) <= max_bits
            yield q[near], x[near]
            at = upto


def merging(pairs: Iterator[tuple[np.ndarray, np.ndarray]], group: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join groups not joined before: no cycle."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    out = []
    for q, x in pairs:
        for i, j in zip(q.tolist(), x.tolist(), strict=True):
            a, b = find(int(group[i])), find(int(group[j]))
            if a != b:
                root[a] = b
                out.append((i, j))
    return out


def linked(words: np.ndarray, rest: np.ndarray, half: int, max_bits: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that connect whatever of a table's half is within the ball and max_bits, and each row's pivot."""
    edges, pivot = taken_in(words, max_bits)
    names, sizes = np.unique(pivot, return_counts=True)
    queries = np.flatnonzero(pivot != names[sizes.argmax()]) if sizes.max() > 1 else np.arange(len(rest))
    return edges + merging(looked_up(words, rest, queries, pivot, half, max_bits), pivot), pivot


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Columns of stretches of whole groups (rows with equal first n_keys columns), and where the groups begin and the last one ends."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        held = now if held is None else pa.concat_tables([held, now])
        keys = [held.column(k).to_numpy() for k in range(n_keys)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(cuts):
            yield [c.chunk(0) for c in held.slice(0, int(cuts[-1])).combine_chunks().columns], np.r_[0, cuts]
            held = held.slice(int(cuts[-1]))
    if held is not None:
        yield [c.chunk(0) for c in held.combine_chunks().columns], np.array([0, held.num_rows])


def small_pairs(words: np.ndarray, bounds: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect whatever is within max_bits in each group of at most SMALL rows: all rows against the next, the one after it and so on."""
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    live = sizes[of] <= SMALL
    found = []
    for lag in range(1, min(SMALL, int(sizes[sizes <= SMALL].max(initial=1)))):
        at = np.flatnonzero(live[:-lag] & (of[lag:] == of[:-lag]))
        near = at[distance(words[at], words[at + lag]) <= max_bits]
        found.append((near, near + lag))
    return merging(iter(found), np.arange(len(words)))


EDGE = "key long, n long, a binary, b binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["key", "n", "a", "b"])


def links(tables: Tables, fps: DataFrame, shape: Shape) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct fps that the shape's tables show."""
    half, spark = shape.segment // 2, fps.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges; of the first and the last key, which may go on in other partitions, the rows and the pivots."""

        def end(key, fp, pivot):
            own = np.unique(pivot[pivot != np.arange(len(fp))])
            return [(key, len(fp), None, None)] + [(key, None, fp[int(p)].as_py(), None) for p in own]

        first, last = True, None
        for (key, rest, fp), bounds in groups(batches, 1):
            words, rests = as_words(fp, shape.bits), rest.to_numpy()
            edges, sizes, pivot = small_pairs(words, bounds, shape.max_bits), np.diff(bounds), np.arange(len(fp))
            for g in np.flatnonzero(sizes > SMALL):
                lo, hi = bounds[g], bounds[g + 1]
                found, own = linked(words[lo:hi], rests[lo:hi], half, shape.max_bits)
                edges += [(lo + i, lo + j) for i, j in found]
                pivot[lo:hi] = lo + own
            rows = [(None, None, fp[int(i)].as_py(), fp[int(j)].as_py()) for i, j in edges]
            whole = [(key[int(lo)].as_py(), fp.slice(lo, hi - lo), pivot[lo:hi] - lo) for lo, hi in ((bounds[0], bounds[1]), (bounds[-2], bounds[-1]))]
            if first:
                rows += end(*whole[0])
            if not first or len(sizes) > 1:
                last = whole[1]
            first = False
            yield _batch(rows)
        yield _batch(end(*last) if last else [])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges between a block's rows outside the largest component (role 0) and all of another block."""
        for (_, _, _, role, rest, fp, comp), bounds in groups(batches, 3):
            words, rests, roles = as_words(fp, shape.bits), rest.to_numpy(), role.to_numpy()
            names = np.unique(np.array(comp.to_pylist(), object), return_inverse=True)[1]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                queries = np.flatnonzero(roles[lo:hi] == 0)
                if len(queries) and len(queries) < hi - lo:
                    found = merging(looked_up(words[lo:hi], rests[lo:hi], queries, names[lo:hi], half, shape.max_bits), names[lo:hi])
                    yield _batch([(None, None, fp[lo + i].as_py(), fp[lo + j].as_py()) for i, j in found])

    rows = table_rows(fps, shape)
    n = partitions(spark, fps.count() * 2 * shape.tables * (shape.bits // 8 + 40))
    said = tables.put("pieces", rows.repartitionByRange(n, "key", "fp").sortWithinPartitions("key", "fp").mapInArrow(pieces, EDGE))
    edges = said.where("b IS NOT NULL").select("a", "b")
    cut = said.where("n IS NOT NULL").groupBy("key").agg(F.count("*").alias("pieces"), F.sum("n").alias("n")).where("pieces > 1")
    cut = tables.put("cut", cut.select("key", "n"))  # two keys a partition at most
    whole = rows.join(F.broadcast(cut.where(F.col("n") <= BLOCK).select("key")), "key", "left_semi").repartition("key").sortWithinPartitions("key", "fp")
    edges = tables.put("edges0", edges.unionByName(whole.mapInArrow(pieces, EDGE).where("b IS NOT NULL").select("a", "b")))
    cut = cut.where(F.col("n") > BLOCK)
    if not cut.head(1):
        return edges
    pivots = said.where("n IS NULL AND b IS NULL").select("key", F.lit(0).alias("rest"), F.col("a").alias("fp")).join(F.broadcast(cut), "key", "left_semi").distinct()
    among = pivots.repartition("key").sortWithinPartitions("key").mapInArrow(pieces, EDGE)
    edges = tables.put("edges1", edges.unionByName(among.where("b IS NOT NULL").select("a", "b")))
    comps = components(tables.below("pieces_components"), edges)
    hot = tables.put("hot", rows.join(F.broadcast(cut), "key").join(comps, F.col("fp") == comps.node, "left").select("key", "n", "rest", "fp", F.coalesce("root", "fp").alias("comp")))
    largest = hot.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), (F.sum("c") - F.max("c")).alias("m"))
    placed = hot.join(F.broadcast(largest), "key").where("m > 0")
    of_all, of_others = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("m") / BLOCK).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    own = lambda k: F.pmod(F.xxhash64("fp"), k).cast("int")
    cols = ("key", "block", "other", "role", "rest", "fp", "comp")
    table = placed.withColumn("block", own(of_all)).withColumn("other", every(of_others)).withColumn("role", F.lit(1)).select(*cols)
    asking = placed.where("comp != top").withColumn("other", own(of_others)).withColumn("block", every(of_all)).withColumn("role", F.lit(0)).select(*cols)
    both = table.unionByName(asking).repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "role", "fp")
    return tables.put("edges2", edges.unionByName(both.mapInArrow(met, EDGE).select("a", "b")))


def components(tables: Tables, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and root (the smallest node it reaches) for each node of the edges, by alternating large and small stars.

    A node's smallest neighbour is a pre-aggregated minimum in a table of its
    own, so a hub's edges are split like any skewed join's.
    """
    stars = tables.put("stars0", edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for k in range(1, most_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = tables.put(f"large{k}", both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = tables.put(f"stars{k}", small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        tables.drop(f"large{k}", f"stars{k - 1}")
        state = tuple(after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
        stars = after
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")


def classes(tables: Tables, rows: DataFrame, shingle: int = 3, shape: Shape = EXACT) -> DataFrame:
    """id, tkey, fp, root (a fingerprint that names the component) and component (its smallest id) of each prepared row."""
    fps, part = tables.put("fps", fingerprints(rows, shingle, shape.bits)), tables.below("links")
    reps = part.put("reps", fps.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(part, links(part, reps.select("fp"), shape))
    rooted = part.put("rooted", reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    labels = tables.put("labels", rooted.join(least, "root").select("fp", "root", "component"))
    tables.drop("links")
    return fps.join(labels, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, shape: Shape = EXACT) -> DataFrame:
    """id_col, fp (bytes) and component_id (the smallest id reachable over links) of each row."""
    found = classes(Tables(docs.sparkSession, "simhash"), prepared(docs, id_col, text_col), shingle, shape)
    return found.select(restored().alias(id_col), "fp", restored("component").alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs, whole, of each component of documents whose fingerprints state the similarity or more: the one with the smallest id, then the smallest hash of its text, then the least other columns, as JSON."""
    tables = Tables(docs.sparkSession, "simhash")
    found = classes(tables, prepared(docs, id_col, text_col), shingle, shape_for(docs.count(), similarity))
    first = tables.put("first", found.groupBy("root").agg(F.min(F.struct("id", "tkey")).alias("_k")).select("_k.id", "_k.tkey"))
    tables.drop("fps", "labels")
    kept = squeezed(docs, id_col, text_col).join(first, ["id", "tkey"], "left_semi")
    one = kept.groupBy("id", "tkey").agg(F.min_by(F.struct("row", "z"), F.to_json("row")).alias("v")).select("v.row", "v.z")
    return restored_rows(one, docs.schema, text_col)
