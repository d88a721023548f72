"""Draws with replacement of any number of kinds, for all replicates of a bootstrap.

Kinds are the leaves of a binary tree over their keys' bits. A node's draws
split binomially between its two sides, by their weights, with a generator that
is seeded by the node; the leaves' draws together are then an exact multinomial.
As the tree is that of the keys and not of the tasks, it can be cut anywhere:
here into groups, subtrees of some ``PER`` kinds. A group walks down from the
root to itself, over one split a level, whose weights a small table has (two
rows a group), and then splits its own kinds. So no task holds more than its
group, nothing is collected, and results depend neither on the number of groups
nor on how rows are laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Tables

#: Kinds of a group, about.
PER = 1024

#: Columns of what a group's kinds amount to in each replicate, from their arrays and their draws (kinds by replicates).
Use = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def _of(seed: int, bit: int, prefix: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, bit, prefix])))


def reached(seed: int, n_rep: int, own: int, group: int, depth: int, path: list[dict]) -> np.ndarray:
    """How many draws reach a group in each replicate."""
    n = np.full(n_rep, path[0]["all"] if path else own, np.int64)
    for p in path:
        is_right = group >> (depth - 1 - p["level"]) & 1
        if 0 < p["left"] < p["all"]:
            left = _of(seed, p["bit"], p["prefix"]).binomial(n, p["left"] / p["all"])
            n = n - left if is_right else left
    return n


def split(seed: int, keys: np.ndarray, weights: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The draws of each of a group's kinds, by ascending key, in each replicate."""
    out, sums = np.zeros((len(keys), len(n)), np.int64), np.r_[0, np.cumsum(weights)]
    todo = [(0, len(keys), n)]
    while todo:
        lo, hi, n = todo.pop()
        if hi - lo == 1:
            out[lo] = n
            continue
        first, bit = int(keys[lo]), int(keys[lo] ^ keys[hi - 1]).bit_length() - 1
        if bit < 0:  # kinds whose hashes are equal
            out[lo:hi] = _of(seed, 63, first).multinomial(n, weights[lo:hi] / weights[lo:hi].sum()).T
            continue
        prefix = first >> (bit + 1)
        mid = lo + int(np.searchsorted(keys[lo:hi], (2 * prefix + 1) << bit))
        left = _of(seed, bit, prefix).binomial(n, (sums[mid] - sums[lo]) / (sums[hi] - sums[lo]))
        todo += [(lo, mid, left), (mid, hi, n - left)]
    return out


def _paths(groups: DataFrame, depth: int, bits: int) -> DataFrame:
    """g and path: for each level above a group the split there (bit, prefix) and the weights of its left side and of both."""
    at = lambda level: F.expr(f"shiftright(g, {depth} - {level})")
    nodes = groups.select("w", "g", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).select("w", "level", at("level").alias("prefix")).groupBy("level", "prefix").agg(F.sum("w").alias("all"))
    asked = groups.select("g", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")).select("g", "level", at("level").alias("prefix"))
    lefts = nodes.where("level > 0 and prefix % 2 = 0").select((F.col("level") - 1).alias("level"), F.expr("prefix div 2").alias("prefix"), F.col("all").alias("left"))
    both = asked.join(nodes, ["level", "prefix"]).join(lefts, ["level", "prefix"], "left")
    step = F.struct("level", (F.lit(bits - 1) - F.col("level")).alias("bit"), "prefix", F.coalesce("left", F.lit(0).cast("long")).alias("left"), "all")
    return both.groupBy("g").agg(F.sort_array(F.collect_list(step)).alias("path"))


def drawn(kinds: DataFrame, bits: int, n_rep: int, seed: int, schema: str, use: Use) -> DataFrame:
    """g, rep and the columns of schema: what ``use`` makes of each group of kinds(key, w, ...) in each replicate; rep -1 is the sample itself.

    key: a number below 2 to the power bits, the kind's leaf; groups are ordered
    like their keys. w: how often the kind occurs. kinds are read more than once.
    """
    n_kinds = kinds.count()
    depth = min(bits, max(0, (n_kinds - 1) // PER).bit_length())
    fields = [f.name for f in kinds.schema.fields]
    placed = kinds.withColumn("g", F.shiftrightunsigned("key", bits - depth) if bits > depth else F.col("key"))
    packed = placed.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("key", *(c for c in fields if c != "key")))).alias("items"))
    if depth:
        packed = packed.join(_paths(placed.groupBy("g").agg(F.sum("w").alias("w")), depth, bits), "g")
    else:
        packed = packed.withColumn("path", F.lit(None).cast("array<struct<level: int, bit: int, prefix: long, left: long, all: long>>"))
    names = [c.split()[0] for c in schema.split(", ")]
    reps = pa.array(np.arange(-1, n_rep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, items, path in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                table = items.values
                columns = {c: table.field(c).to_numpy(zero_copy_only=False) for c in fields}
                w = columns["w"].astype(np.int64)
                n = reached(seed, n_rep, int(w.sum()), g, depth, path or [])
                found = use(columns, np.concatenate([w[:, None], split(seed, columns["key"], w, n)], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), g)), reps, *(pa.array(found[c]) for c in names)], ["g", "rep", *names])

    return packed.select("g", "items", "path").mapInArrow(run, f"g long, rep long, {schema}")


def kinds_of(rows: DataFrame, names: list[str], tables: Tables) -> DataFrame:
    """key (62 bits of a hash), w and the columns of each distinct row, written."""
    found = rows.groupBy(*names).agg(F.count("*").alias("w"))
    return tables.put("kinds", found.select(F.shiftrightunsigned(F.xxhash64(*names), 2).alias("key"), "w", *names))
