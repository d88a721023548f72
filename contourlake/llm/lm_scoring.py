"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision, in each context of up to
five bytes, keeps counts of zeros and ones and a Krichevsky-Trofimov estimate.
A context's weighted probability is half its own estimate's and half the
product of its longer contexts', from the deepest up; what share its own
estimate has earned is its weight in prediction. A text's score mixes the
estimates of all depths by these weights, gives the code length per byte, and
needs no smoothing: an unseen context says one half. Beside it stands a word
unigram baseline.

Both models are tables of the whole training corpus, cut into shards by a hash
of the word or by the two bytes before the predicted one (so all contexts of at
least that depth meet in one shard; the 65,535 nodes above them are broadcast).
No model is gathered whole anywhere:

1. Each task counts words and six-byte runs of its training rows and sends
   one compressed pack of keys and counts per shard; shards merge them, at most
   ``MERGED_AT_ONCE`` in a task.
2. Documents are dealt into blocks of about ``block_bytes`` by a hash of the id
   and the text. A block asks each shard, in one pack, for its distinct words
   and runs; the shards answer with counts and log probabilities.
3. The block scores its documents from the answers.

A hot word is one entry in a pack, not a row per use. Shards grow in number with
the corpus, one for each ``SHARD_BYTES`` of training text, up to ``MOST_SHARDS``:
from there on a shard grows as the distinct words and runs do, far slower than
the text. A shard answers at most ``BLOCKS_AT_ONCE`` blocks in a task.

Texts are lowered A-Z. A null or empty text is the end alone. A null id is not
held out and not learned from. With nothing to learn from, counts are zero.
Repeated rows get equal rows; an empty table gives none; extra columns are left
behind.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Tables, crc_fold, prepared, restored, text_bytes

DEPTH = 5
END = 0xFF  # in no UTF-8 text: ends a text and fills the context before it
BLOCK_BYTES = 12 << 20
BLOCKS_AT_ONCE = 1024
SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 16 << 20, 64, 4096
#: Packs of a shard that are merged at once.
MERGED_AT_ONCE = 1024
#: Bytes whose runs are counted at once.
SLICE = 1 << 21
HALF = math.log(0.5)
_STEPS = np.array([math.lgamma(n + 0.5) for n in range(64)]), np.array([math.lgamma(n + 1.0) for n in range(64)])


def lgamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log Gamma of n + 1/2 or of n + 1, for whole n >= 0."""
    out = _STEPS[0 if half else 1][np.minimum(n, 63)]
    far = n > 63
    x = n[far] + (0.5 if half else 1.0)
    out[far] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(zeros, True) + lgamma(ones, True) - math.log(math.pi) - lgamma(zeros + ones, False)


def runs(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The DEPTH bytes before and each byte of the texts and their ends, as one number, and where each text's runs begin."""
    pad = bytes([END]) * DEPTH
    buffer = np.frombuffer(b"".join(x for b in bodies for x in (pad, b, pad[:1])), np.uint8)
    n = len(buffer) - DEPTH
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(DEPTH + 1):
        out = (out << np.uint64(8)) | buffer[k : k + n]
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    own = np.ones(len(out), bool)
    ends = np.cumsum(sizes + DEPTH)[:-1] - DEPTH  # where the next text's filling is predicted
    own[(ends[:, None] + np.arange(DEPTH)).ravel()] = False
    return out[own], np.r_[0, np.cumsum(sizes)]


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    return x[first], np.diff(np.r_[first, len(x)])


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def chunks(bodies: list[bytes]) -> Iterator[list[bytes]]:
    """bodies, in stretches of about SLICE bytes."""
    part, n = [], 0
    for b in bodies:
        part.append(b)
        n += len(b) + DEPTH + 1
        if n >= SLICE:
            yield part
            part, n = [], 0
    if part:
        yield part


class Packs:
    """Keys by shard as compressed bytes: words for shards under words, runs above."""

    def __init__(self, words: int, runs: int):
        self.words, self.runs = words, runs

    def by_word(self, words) -> dict[int, list[bytes]]:
        out: dict[int, list[bytes]] = {}
        for w in sorted(words):
            out.setdefault(xxhash.xxh64_intdigest(w, 7) % self.words, []).append(w)
        return out

    def by_run(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places of its keys)."""
        pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
        shard = (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(self.runs)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cut):
            if len(part):
                yield self.words + int(shard[part[0]]), part

    @staticmethod
    def words_out(words: list[bytes]) -> bytes:
        return zstandard.compress(b" ".join(words), 3)

    @staticmethod
    def words_in(pack: bytes) -> list[bytes]:
        return zstandard.decompress(pack).split(b" ")

    @staticmethod
    def runs_out(keys: np.ndarray) -> bytes:
        return zstandard.compress(np.diff(keys, prepend=np.uint64(0)).tobytes(), 3)

    @staticmethod
    def runs_in(pack: bytes) -> np.ndarray:
        return np.cumsum(np.frombuffer(zstandard.decompress(pack), np.uint64), dtype=np.uint64)

    @staticmethod
    def values_out(values: np.ndarray) -> bytes:
        return zstandard.compress(values.tobytes(), 3)

    @staticmethod
    def values_in(pack: bytes, kind=np.int64) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(pack), kind)


class Tree:
    """The nodes of a shard: contexts of 2 to DEPTH bytes, each with the bits of the byte so far."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        byte, context = keys & np.uint64(0xFF), keys & ~np.uint64(0xFF)
        node = np.concatenate([context | (np.uint64(1 << k) | byte >> np.uint64(8 - k)) for k in range(8)])
        bit = np.concatenate([byte >> np.uint64(7 - k) & np.uint64(1) for k in range(8)]).astype(bool)
        n = np.tile(counts, 8)
        nodes, zeros, ones = summed(node, np.where(bit, 0, n), np.where(bit, n, 0))
        weighted = estimate(zeros, ones)
        self.levels = {DEPTH: (nodes, (ones + 0.5) / (zeros + ones + 1), np.ones(len(nodes)))}
        for depth in range(DEPTH - 1, 1, -1):
            nodes, zeros, ones, below = summed(nodes & np.uint64((1 << 8 * (depth + 1)) - 1), zeros, ones, weighted)
            own = HALF + estimate(zeros, ones)
            weighted = np.logaddexp(own, HALF + below)
            self.levels[depth] = (nodes, (ones + 0.5) / (zeros + ones + 1), np.exp(own - weighted))
        self.top = (nodes, zeros, ones, weighted)

    def log10(self, keys: np.ndarray, above: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of each run's last byte after the bytes before. above: estimates and weights of depth 1 (by byte and node) and 0."""
        byte, context = keys & np.uint64(0xFF), keys & ~np.uint64(0xFF)
        out = np.zeros(len(keys))
        for k in range(8):
            node = np.uint64(1 << k) | byte >> np.uint64(8 - k)
            p = np.full(len(keys), 0.5)
            for depth in range(DEPTH, 1, -1):
                nodes, own, weight = self.levels[depth]
                if not len(nodes):
                    continue
                want = (context | node) & np.uint64((1 << 8 * (depth + 1)) - 1)
                at = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)
                hit = nodes[at] == want
                p = np.where(hit, weight[at] * own[at] + (1 - weight[at]) * p, p)
            last, j = (context >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64), node.astype(np.int64)
            p = above[1][last, j] * above[0][last, j] + (1 - above[1][last, j]) * p
            p = above[3][j] * above[2][j] + (1 - above[3][j]) * p
            out += np.log10(np.where(byte >> np.uint64(7 - k) & np.uint64(1), p, 1 - p))
        return out


def upper(rows: list[tuple[int, int, int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Estimates and weights of the nodes of depth 1 and 0, from (last byte, node, zeros, ones, log weighted product of depth 2)."""
    zeros, ones, below = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
    for last, node, z, o, lw in rows:
        zeros[last, node], ones[last, node], below[last, node] = z, o, lw
    own = HALF + estimate(zeros.ravel(), ones.ravel()).reshape(zeros.shape)
    weighted = np.logaddexp(own, HALF + below)
    z0, o0, b0 = zeros.sum(axis=0), ones.sum(axis=0), weighted.sum(axis=0)
    own0 = HALF + estimate(z0, o0)
    return (ones + 0.5) / (zeros + ones + 1), np.exp(own - weighted), (o0 + 0.5) / (z0 + o0 + 1), np.exp(own0 - np.logaddexp(own0, HALF + b0))


def _count_task(packs: Packs):
    """Packs of the words and runs of the texts that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            keys, values = summed(*(np.concatenate([x[k] for x in found]) for k in (0, 1)))
            rows = [(s, Packs.words_out(ws), Packs.values_out(np.array([words[w] for w in ws], np.int64))) for s, ws in packs.by_word(words).items()]
            rows += [(s, Packs.runs_out(keys[at]), Packs.values_out(values[at].astype(np.int64))) for s, at in packs.by_run(keys)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([task] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["shard", "part", "keys", "counts"])

        words, found, task = Counter(), [], TaskContext.get().partitionId()
        for b in batches:
            for part in chunks(b.column(0).to_pylist()):
                part = [x.lower() for x in part]
                for x in part:
                    words.update(x.split())
                words[b""] += len(part)
                found.append(counted(runs(part)[0]))
                if len(found) == 16:
                    found = [summed(*(np.concatenate([x[k] for x in found]) for k in (0, 1)))]
                if len(words) > 400_000:
                    yield flush()
                    words, found = Counter(), []
        if found:
            yield flush()

    return run


def _merge(packs: Packs):
    """One pack of the keys and counts of a group of a shard's packs."""

    def run(group: pa.Table) -> pa.Table:
        shard, part = (group.column(c)[0].as_py() for c in ("shard", "part"))
        keys, counts = group.column("keys").to_pylist(), [Packs.values_in(x) for x in group.column("counts").to_pylist()]
        if shard < packs.words:
            merged: Counter = Counter()
            for k, c in zip(keys, counts, strict=True):
                for w, n in zip(Packs.words_in(k), c.tolist(), strict=True):
                    merged[w] += n
            ws = sorted(merged)
            out = Packs.words_out(ws), np.array([merged[w] for w in ws], np.int64)
        else:
            k, n = summed(np.concatenate([Packs.runs_in(x) for x in keys]), np.concatenate(counts))
            out = Packs.runs_out(k), n
        return pa.table({"shard": pa.array([shard], pa.int32()), "part": [part], "keys": pa.array([out[0]], pa.binary()), "counts": pa.array([Packs.values_out(out[1])], pa.binary()), "total": [int(out[1].sum())], "distinct": [len(out[1])]})

    return run


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth 2 nodes of run shards, summed over the byte before the last."""
    for b in batches:
        for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            nodes, zeros, ones, weighted = Tree(Packs.runs_in(keys), Packs.values_in(counts)).top
            nodes, zeros, ones, weighted = summed(nodes & np.uint64(0xFFFF), zeros, ones, weighted)
            yield pa.RecordBatch.from_arrays([pa.array((nodes >> np.uint64(8)).astype(np.int32)), pa.array((nodes & np.uint64(0xFF)).astype(np.int32)), pa.array(zeros), pa.array(ones), pa.array(weighted)], ["last", "node", "zeros", "ones", "weighted"])


def _requests(packs: Packs):
    """A pack of distinct words or runs for each shard that a block needs."""

    def run(group: pa.Table) -> pa.Table:
        words, found = {b""}, [np.empty(0, np.uint64)]
        for part in chunks(group.column("body").to_pylist()):
            part = [x.lower() for x in part]
            for x in part:
                words.update(x.split())
            found.append(counted(runs(part)[0])[0])
        keys = counted(np.concatenate(found))[0]
        rows = [(s, Packs.words_out(ws)) for s, ws in packs.by_word(words).items()] + [(s, Packs.runs_out(keys[at])) for s, at in packs.by_run(keys)]
        block = group.column("block")[0].as_py()
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([block // BLOCKS_AT_ONCE] * len(rows), pa.int64()), "block": pa.array([block] * len(rows), pa.int64()), "asked": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _answers(packs: Packs, above):
    """Counts of the asked words, or log10 probabilities of the asked runs."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "asked": pa.array([], pa.binary()), "said": pa.array([], pa.binary())})
        shard = asked.column("shard")[0].as_py()
        keys, counts = (held.column(k)[0].as_py() if held.num_rows else None for k in ("keys", "counts"))
        said = []
        if shard < packs.words:
            known = dict(zip(Packs.words_in(keys), Packs.values_in(counts).tolist(), strict=True)) if keys is not None else {}
            for pack in asked.column("asked").to_pylist():
                said.append(Packs.values_out(np.array([known.get(w, 0) for w in Packs.words_in(pack)], np.int64)))
        else:
            none = np.empty(0, np.uint64), np.empty(0, np.int64)
            tree = Tree(*((Packs.runs_in(keys), Packs.values_in(counts)) if keys is not None else none))
            for pack in asked.column("asked").to_pylist():
                said.append(Packs.values_out(tree.log10(Packs.runs_in(pack), above.value)))
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "asked": asked.column("asked"), "said": pa.array(said, pa.binary())})

    return run


def _scores(packs: Packs, total: int, distinct: int):
    """Scores of a block's documents from its answers."""
    norm = math.log10(total + 0.5 * (distinct + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        count, keys, logs = {}, [], []
        for shard, asked, said in zip(*(answers.column(k).to_pylist() for k in ("shard", "asked", "said")), strict=True):
            if shard < packs.words:
                count.update(zip(Packs.words_in(asked), Packs.values_in(said).tolist(), strict=True))
            else:
                keys.append(Packs.runs_in(asked))
                logs.append(Packs.values_in(said, np.float64))
        index, logs = pd.Index(np.concatenate(keys)) if keys else None, np.concatenate(logs) if logs else None
        out, end = [], count.get(b"", 0)
        for part in chunks(docs.column("body").to_pylist()):
            part = [x.lower() for x in part]
            key, starts = runs(part)
            score = np.add.reduceat(logs[index.get_indexer(key)], starts[:-1])
            for x, s in zip(part, score.tolist(), strict=True):
                words = x.split()
                c = np.fromiter(map(count.__getitem__, words), np.int64, len(words))
                base = float(np.log10(c + 0.5).sum()) + math.log10(end + 0.5) - (len(c) + 1) * norm
                out.append((len(c) + 1, int((c > 0).sum()) + (end > 0), base, s, -s * math.log2(10) / (len(x) + 1)))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")
        return pa.table({"id": docs.column("id"), **{m: pa.array([r[k] for r in out], t) for k, (m, t) in enumerate(zip(names, kinds, strict=True))}})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shards: int | None = None) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte of each row."""
    spark = docs.sparkSession
    tables = Tables(spark, "lm")
    rows = prepared(docs, id_col, text_col)
    size = text_bytes(rows)
    blocks = max(1, -(-size // block_bytes))
    shards = shards or max(LEAST_SHARDS, min(MOST_SHARDS, -(-size // SHARD_BYTES)))
    packs = Packs(max(16, shards // 4), shards)
    learned = rows.where((F.col("id") != NULL_ID) & (crc_fold("id") != 1)).select("body")
    sent = learned.mapInArrow(_count_task(packs), "shard int, part long, keys binary, counts binary")
    merged, tasks = "shard int, part long, keys binary, counts binary, total long, distinct long", 4 * blocks  # tasks: of three MB or more
    while tasks > MERGED_AT_ONCE:  # packs of neighbouring tasks meet first, so that no shard's packs are too many for a task
        sent = sent.withColumn("part", F.floor(F.col("part") / MERGED_AT_ONCE)).groupBy("shard", "part").applyInArrow(_merge(packs), merged)
        tasks = -(-tasks // MERGED_AT_ONCE)
    counts = tables.put("counts", sent.groupBy("shard").applyInArrow(_merge(packs), merged))
    tokens = counts.where(F.col("shard") < packs.words).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tops = counts.where(F.col("shard") >= packs.words).select("keys", "counts").mapInArrow(_tops, "last int, node int, zeros long, ones long, weighted double")
    tops = tops.groupBy("last", "node").agg(*(F.sum(c) for c in ("zeros", "ones", "weighted"))).collect()  # at most 256 x 255 rows
    above = spark.sparkContext.broadcast(upper([tuple(r) for r in tops]))

    dealt = rows.select("id", "body", F.pmod(F.xxhash64("id", "tkey"), F.lit(blocks)).alias("block"))
    asked = dealt.groupBy("block").applyInArrow(_requests(packs), "shard int, part long, block long, asked binary")
    parts = F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_AT_ONCE)).cast("array<long>")
    held = counts.select("shard", F.explode(parts).alias("part"), "keys", "counts")
    said = asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(_answers(packs, above), "block long, shard int, asked binary, said binary")
    schema = "id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    scored = dealt.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_scores(packs, tokens[0], tokens[1]), schema)
    return scored.select(
        restored().alias(id_col),
        F.coalesce((F.col("id") != NULL_ID) & (crc_fold("id") == 1), F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", F.lit(tokens[0]).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte",
    )
