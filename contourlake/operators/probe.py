"""Scoring by a learned probe over a speech model's latents.

Segments are the latent frames of a unit's window. A probe pools a segment to
one vector, by the mean of its frames or of an LSTM's outputs over them, and
maps it to a class. Training is Spark's multinomial logistic regression over
pooled segments, with classes weighted N / (3 count), of several penalties the
one with the best weighted F1 on held-out segments. Weights are a small table
of named arrays, so any store that Spark writes holds them; a probe with LSTM
weights trained elsewhere is read and applied the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..leaves.backend import segment
from . import metrics

CLASSES = ("L", "M", "H")
ARRAY = "name string, shape array<int>, values array<double>"


@dataclass
class Probe:
    """head: weight (3 x features) and bias; lstm: weights in input, forget, cell, output order, or none; meta: what it was trained on."""

    weight: np.ndarray
    bias: np.ndarray
    lstm: dict[str, np.ndarray] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)

    def pooled(self, segments: Sequence[np.ndarray]) -> np.ndarray:
        """A vector for each segment; all of them step together, ended ones keep their state."""
        if not self.lstm:
            return np.stack([s.mean(axis=0) for s in segments])
        sizes = np.array([len(s) for s in segments])
        x = np.zeros((len(segments), sizes.max(), segments[0].shape[1]))
        for k, s in enumerate(segments):
            x[k, : len(s)] = s
        w, u, b = self.lstm["input"], self.lstm["hidden"], self.lstm["bias"]
        h = c = total = np.zeros((len(segments), u.shape[1]))
        for t in range(x.shape[1]):
            i, f, g, o = np.split(x[:, t] @ w.T + h @ u.T + b, 4, axis=1)
            new_c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
            new_h = _sigmoid(o) * np.tanh(new_c)
            live = (t < sizes)[:, None]
            c, h = np.where(live, new_c, c), np.where(live, new_h, h)
            total = total + np.where(live, new_h, 0)
        return total / sizes[:, None]

    def predict(self, segments: Sequence[np.ndarray], at_once: int = 512) -> list[str]:
        out: list[str] = []
        for lo in range(0, len(segments), at_once):
            out += [CLASSES[k] for k in (self.pooled(segments[lo : lo + at_once]) @ self.weight.T + self.bias).argmax(axis=1)]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def unit_segments(pre: DataFrame, hop: float = 0.02, least: int = 2) -> DataFrame:
    """clip_id, tbu_idx, target and segment (NULL if the unit is not aligned or its window too short) of precomputed clips with latents."""
    w = F.col("latent_width")
    n = F.expr("size(latents) div latent_width").cast("int")
    unit = pre.select("clip_id", "latents", "latent_width", F.posexplode(F.arrays_zip("targets", "t0", "t1")).alias("tbu_idx", "u"))
    first = F.greatest(F.lit(0), F.floor(F.col("u.t0") / hop).cast("int"))
    last = F.least(n, F.ceil(F.col("u.t1") / hop).cast("int"))
    some = F.col("latents").isNotNull() & F.col("u.t0").isNotNull() & F.col("u.t1").isNotNull() & (last - first >= least)
    return unit.select("clip_id", "tbu_idx", F.col("u.targets").alias("target"), F.when(some, F.transform(F.sequence(first, last - 1), lambda k: F.slice("latents", k * w + 1, w))).alias("segment"))


def pooled_features(segments: DataFrame) -> DataFrame:
    """segments with features: the mean of a segment's frames."""
    size = F.size("segment").cast("double")
    width = F.size(F.get("segment", F.lit(0)))
    total = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.aggregate("segment", F.lit(0.0), lambda a, x: a + F.get(x, k).cast("double")) / size)
    return segments.withColumn("features", F.when(F.col("segment").isNotNull(), total))


def train(train_rows: DataFrame, dev_rows: DataFrame, penalties: Sequence[float] = (0.0, 0.01, 0.1), iterations: int = 50, meta: dict[str, str] | None = None) -> tuple[Probe, list[tuple[float, float]]]:
    """The probe of segments(target, segment) with the best weighted F1 on dev_rows, and (penalty, F1) of each tried."""
    label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("target")).cast("double") - 1
    rows = pooled_features(train_rows.where(F.col("segment").isNotNull() & F.col("target").isin(*CLASSES))).select(label.alias("label"), array_to_vector("features").alias("features"))
    counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}  # three rows
    total = sum(counts.values())
    weight = F.element_at(F.create_map(*(F.lit(x) for k, c in counts.items() for x in (k, total / (len(CLASSES) * c)))), F.col("label").cast("int"))
    rows = rows.withColumn("weight", weight)
    best, tried = None, []
    for penalty in penalties:
        m = LogisticRegression(family="multinomial", regParam=penalty, maxIter=iterations, weightCol="weight").fit(rows)
        probe = Probe(np.full((len(CLASSES), m.numFeatures), 0.0), np.full(len(CLASSES), -1e9), {}, dict(meta or {}))
        k = m.coefficientMatrix.numRows
        probe.weight[:k], probe.bias[:k] = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
        f1 = metrics.weighted_f1(predicted(dev_rows, probe)).first()["weighted_f1"]
        tried.append((penalty, f1))
        if best is None or f1 > best[0]:
            best = f1, probe
    return best[1], tried


def predicted(segments: DataFrame, probe: Probe) -> DataFrame:
    """clip_id, tbu_idx, target and pred of segments; a unit without a segment abstains. The probe, a few arrays, goes with the code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            live = b.segment.notna().to_numpy()
            pred = np.full(len(b), None, object)
            found = [np.stack([np.asarray(f, float) for f in s]) for s in b.segment[live]]
            if found:
                pred[live] = probe.predict(found)
            yield b[["clip_id", "tbu_idx", "target"]].assign(pred=pred)

    return segments.select(F.col("clip_id").cast("string"), F.col("tbu_idx").cast("int"), "target", "segment").mapInPandas(run, "clip_id string, tbu_idx int, target string, pred string")


def probe_score(pre: DataFrame, probe: Probe) -> DataFrame:
    """accuracy, coverage, n_scored, n_tbu and method of each precomputed clip. Only aligned clips are scored; others are probe-abstain."""
    tbu = predicted(unit_segments(pre.where("method = 'forced-align'")), probe)
    scores = tbu.groupBy("clip_id").agg(F.count_if(F.col("pred") == F.col("target")).alias("hit"), F.count("pred").alias("n_scored"))
    every = pre.select("clip_id", F.size("targets").alias("n_tbu"), ((F.col("method") == "forced-align") & F.col("latents").isNotNull()).alias("heard"))
    out = every.join(scores, "clip_id", "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    return out.select("clip_id", S.share(F.col("hit"), F.col("n_scored")).alias("accuracy"), F.coalesce(S.share(F.col("n_scored"), F.col("n_tbu")), F.lit(0.0)).alias("coverage"), "n_scored", "n_tbu", F.when(F.col("heard"), "probe").otherwise("probe-abstain").alias("method"))


def save(spark: SparkSession, probe: Probe, path: str) -> None:
    """One row per array, and one per entry of meta."""
    arrays = {"weight": probe.weight, "bias": probe.bias, **{f"lstm.{k}": v for k, v in probe.lstm.items()}}
    rows = [(name, list(a.shape), [float(v) for v in a.ravel()]) for name, a in arrays.items()]
    rows += [(f"meta.{k}={v}", [], []) for k, v in probe.meta.items()]
    spark.createDataFrame(rows, ARRAY).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Probe:
    rows = spark.read.schema(ARRAY).parquet(path).collect()  # a probe's few arrays
    arrays = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows if not r["name"].startswith("meta.")}
    meta = dict(r["name"].removeprefix("meta.").split("=", 1) for r in rows if r["name"].startswith("meta."))
    return Probe(arrays["weight"], arrays["bias"], {k.removeprefix("lstm."): v for k, v in arrays.items() if k.startswith("lstm.")}, meta)


__all__ = ["CLASSES", "Probe", "load", "pooled_features", "predicted", "probe_score", "save", "segment", "train", "unit_segments"]
