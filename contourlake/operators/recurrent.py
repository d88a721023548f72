"""Training of the recurrent probe: gradient descent over the cluster.

Segments are dealt once, by a hash of their key, into mini-batches (folders of
one table) and, within a batch, into chunks of some hundred segments (rows of
it). A step reads its batch's folder only. Each task runs back-propagation
through time over its chunks with the weights of one broadcast and returns one
gradient; gradients are added in a tree of ``FAN`` at a time, so the driver sees
at most ``FAN`` of them, each as large as the probe. The driver holds the
weights and Adam's two moments and nothing else.

The loss is the cross entropy with classes weighted N / (3 count), divided by
the weights' sum. After each epoch the probe predicts the held-out segments; the
epoch with the best weighted F1 is the result. With ``state`` set, each epoch's
state is a row of a table there, and a run that is started again goes on after
the last of them and ends with the same probe.

Chunks do not depend on partitions, so results differ between clusters only by
the order of sums. Segments that are null or without a class are left out;
equal segments all count. A training table without segments is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Tables
from . import metrics
from .probe import CLASSES, Probe, predicted

FAN = 8
#: Segments of a chunk, about, and padded frames that a task steps through at once.
CHUNK, FRAMES = 256, 8192
PARTS = "loss double, weight double, n long, gradient array<double>"
STATE = "epoch int, step long, weights array<double>, first array<double>, second array<double>, best array<double>, best_f1 double, history string"


@dataclass(frozen=True)
class Layout:
    """Sizes of a probe, and its arrays as stretches of one vector."""

    width: int
    hidden: int

    def shapes(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"input": (4 * h, self.width), "hidden": (4 * h, h), "bias": (4 * h,), "weight": (len(CLASSES), h), "offset": (len(CLASSES),)}

    def arrays(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            out[name] = vector[at : at + n].reshape(shape)
            at += n
        return out

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())

    def start(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of the hidden size."""
        return np.random.default_rng(seed).uniform(-1, 1, self.size()) / np.sqrt(self.hidden)

    def probe(self, vector: np.ndarray, meta: dict[str, str]) -> Probe:
        a = self.arrays(np.array(vector))
        return Probe(a["weight"], a["offset"], {k: a[k] for k in ("input", "hidden", "bias")}, dict(meta))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gradient(layout: Layout, vector: np.ndarray, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted loss of padded segments (segments, frames, width) and its gradient, both summed."""
    a, h = layout.arrays(vector), layout.hidden
    n, steps = x.shape[:2]
    zero = np.zeros((n, h))
    gates, cells, states, total = [], [zero], [zero], zero
    for t in range(steps):
        live = (t < sizes)[:, None]
        z = x[:, t] @ a["input"].T + states[-1] @ a["hidden"].T + a["bias"]
        i, f, g, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), np.tanh(z[:, 2 * h : 3 * h]), _sigmoid(z[:, 3 * h :])
        cell = np.where(live, f * cells[-1] + i * g, cells[-1])
        state = np.where(live, o * np.tanh(cell), states[-1])
        total = total + np.where(live, state, 0)
        gates.append((i, f, g, o))
        cells.append(cell)
        states.append(state)
    pooled = total / sizes[:, None]
    logits = pooled @ a["weight"].T + a["offset"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    rows = np.arange(n)
    loss = float(-(weights * np.log(np.maximum(p[rows, labels], 1e-300))).sum())
    d = p.copy()
    d[rows, labels] -= 1
    d *= weights[:, None]
    out = np.zeros(layout.size())
    to = layout.arrays(out)
    to["weight"] += d.T @ pooled
    to["offset"] += d.sum(axis=0)
    each = d @ a["weight"] / sizes[:, None]
    d_state, d_cell = zero, zero
    for t in reversed(range(steps)):
        live = (t < sizes)[:, None]
        i, f, g, o = gates[t]
        bent = np.tanh(cells[t + 1])
        dh = np.where(live, each + d_state, 0)
        dc = np.where(live, dh * o * (1 - bent * bent) + d_cell, 0)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cells[t] * f * (1 - f), dc * i * (1 - g * g), dh * bent * o * (1 - o)], axis=1)
        to["input"] += dz.T @ x[:, t]
        to["hidden"] += dz.T @ states[t]
        to["bias"] += dz.sum(axis=0)
        d_state, d_cell = dz @ a["hidden"], dc * f
    return loss, out


def _padded(frames: np.ndarray, sizes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of segments and their padded frames, those of like length together, of bounded size."""
    ends, order = np.cumsum(sizes), np.argsort(sizes, kind="stable")[::-1]
    lo = 0
    while lo < len(order):
        longest = int(sizes[order[lo]])
        rows = order[lo : lo + max(1, FRAMES // longest)]
        x = np.zeros((len(rows), longest, width))
        for k, r in enumerate(rows.tolist()):
            x[k, : sizes[r]] = frames[ends[r] - sizes[r] : ends[r]]
        yield rows, x
        lo += len(rows)


def dealt(tables: Tables, segments: DataFrame, n_batches: int, n: int, seed: int) -> DataFrame:
    """batch, chunk and items (key, label, segment, by key) of segments(clip_id, tbu_idx, target, segment), in a folder per batch."""
    label = (F.array_position(F.array(*map(F.lit, CLASSES)), F.col("target")) - 1).cast("int")
    key = F.xxhash64(F.lit(seed), "clip_id", "tbu_idx")
    chunks = max(1, -(-n // (n_batches * CHUNK)))
    rows = segments.select(key.alias("key"), label.alias("label"), F.transform("segment", lambda f: f.cast("array<float>")).alias("segment"))
    place = (F.pmod("key", F.lit(n_batches)).cast("int").alias("batch"), F.pmod(F.floor(F.col("key") / n_batches), F.lit(chunks)).cast("int").alias("chunk"))
    packed = rows.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("key", "label", "segment"))).alias("items"))
    packed.write.partitionBy("batch").parquet(f"{tables.root}/chunks")
    return tables.spark.read.schema(packed.schema).parquet(f"{tables.root}/chunks")


def step(chunks: DataFrame, layout: Layout, vector, class_weights: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Loss and weight of the chunks' segments, and the summed gradient; vector is the broadcast of the weights."""

    def part(loss: float, weight: float, n: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([weight]), pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["loss", "weight", "n", "gradient"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, weight, n = np.zeros(layout.size()), 0.0, 0.0, 0
        for b in batches:
            for items in b.column(0):
                flat = items.values
                labels = flat.field("label").to_numpy()
                segments = flat.field("segment")
                sizes = segments.value_lengths().to_numpy()
                frames = segments.flatten().flatten().to_numpy().reshape(-1, layout.width)
                w = class_weights[labels]
                for rows, x in _padded(frames, sizes, layout.width):
                    one, g = gradient(layout, vector.value, x, sizes[rows], labels[rows], w[rows])
                    loss, total = loss + one, total + g
                weight, n = weight + float(w.sum()), n + len(labels)
        if n:
            yield part(loss, weight, n, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, weight, n = np.zeros(layout.size()), 0.0, 0.0, 0
        for b in batches:
            for k in range(b.num_rows):
                loss, weight, n = loss + b.column(0)[k].as_py(), weight + b.column(1)[k].as_py(), n + b.column(2)[k].as_py()
                total = total + b.column(3)[k].values.to_numpy()
        if n:
            yield part(loss, weight, n, total)

    parts = chunks.select("items").mapInArrow(run, PARTS)
    left = parts.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(add, PARTS)
    rows = parts.toArrow()  # FAN rows at most
    got = [b for b in add(iter(rows.to_batches()))]
    if not got:
        return 0.0, 0.0, np.zeros(layout.size())
    return got[0].column(0)[0].as_py(), got[0].column(1)[0].as_py(), got[0].column(3)[0].values.to_numpy()


def _saved(spark: SparkSession, state: str | None):
    """The last epoch's row of a state table, if there is one."""
    if state is None:
        return None
    try:
        return spark.read.schema(STATE).parquet(state).orderBy(F.desc("epoch")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return None
        raise


def train(train_rows: DataFrame, dev_rows: DataFrame, hidden: int = 128, epochs: int = 8, batch: int = 256, rate: float = 1e-3, seed: int = 0, state: str | None = None, meta: dict[str, str] | None = None) -> tuple[Probe, float, list[dict[str, float]]]:
    """The recurrent probe of the epoch with the best weighted F1 on dev_rows, that F1, and epoch, loss and dev_f1 of each epoch.

    Rows are segments(clip_id, tbu_idx, target, segment). batch: segments a step, about.
    """
    spark = train_rows.sparkSession
    live = train_rows.where(F.col("segment").isNotNull() & (F.size("segment") > 0) & F.col("target").isin(*CLASSES))
    counts = {r["target"]: (r["n"], r["width"]) for r in live.groupBy("target").agg(F.count("*").alias("n"), F.max(F.size(F.get("segment", F.lit(0)))).alias("width")).collect()}  # three rows
    if not counts:
        raise ValueError("no segments to train on")
    n, width = sum(c for c, _ in counts.values()), max(w for _, w in counts.values())
    class_weights = np.array([n / (len(CLASSES) * counts[c][0]) if c in counts else 0.0 for c in CLASSES])
    layout, n_batches = Layout(width, hidden), max(1, -(-n // batch))
    tables = Tables(spark, "probe")
    chunks = dealt(tables, live, n_batches, n, seed)
    was = _saved(spark, state)
    if was is None:
        weights, first, second = layout.start(seed), np.zeros(layout.size()), np.zeros(layout.size())
        begin, k, best, best_f1, history = 0, 0, weights, -1.0, []
    else:
        weights, first, second, best = (np.array(was[c]) for c in ("weights", "first", "second", "best"))
        begin, k, best_f1, history = was["epoch"] + 1, was["step"], was["best_f1"], json.loads(was["history"])
    for epoch in range(begin, epochs):
        losses = weight_sum = 0.0
        for b in np.random.default_rng([seed, epoch]).permutation(n_batches).tolist():
            sent = spark.sparkContext.broadcast(weights)
            loss, weight, g = step(chunks.where(F.col("batch") == b), layout, sent, class_weights)
            sent.destroy()
            if not weight:
                continue
            k += 1
            losses, weight_sum, g = losses + loss, weight_sum + weight, g / weight
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            weights = weights - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        f1 = metrics.weighted_f1(predicted(dev_rows, layout.probe(weights, {}))).first()["weighted_f1"]
        history.append({"epoch": epoch, "loss": losses / weight_sum, "dev_f1": f1})
        if (f1 or 0.0) > best_f1:
            best, best_f1 = weights, f1 or 0.0
        if state is not None:
            row = (epoch, k, *(v.tolist() for v in (weights, first, second, best)), best_f1, json.dumps(history))
            spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(state)
    tables.drop("chunks")
    return layout.probe(best, dict(meta or {})), best_f1, history
