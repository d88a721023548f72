"""Opt-in sketches of a manifest: mergeable, stored per part, never a default.

A part's sketches are a row: one of quantiles (KLL) for each number column and
one of distinct values (HyperLogLog) for each key column. Parts are merged
without their rows, so a manifest that grows by parts is summed up again by
reading a few kilobytes a part. Exact results stay those of ``selection``,
``metrics`` and ``resample``.

Bounds, for the default sizes: a quantile's rank is off by 1.65 % of all rows at
most (with 99 % confidence, k = 200), and a distinct count by three standard
errors of 1.04 / sqrt(2 ** 12), 5 %. Missing values are left out of both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, LG = 200, 12
#: What the bounds say for these sizes: of ranks, and relative of counts.
RANK_ERROR, COUNT_ERROR = 0.0165, 3 * 1.04 / (1 << LG) ** 0.5


def sketched(rows: DataFrame, numbers: Sequence[str], keys: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """A row of sketches for each part: n, q_<number> and d_<key>."""
    quantiles = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(K)).alias(f"q_{c}") for c in numbers]
    distinct = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG)).alias(f"d_{c}") for c in keys]
    return rows.groupBy(*parts).agg(F.count("*").alias("n"), *quantiles, *distinct)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of several parts, or of the same part from several runs, as one row."""
    quantiles = [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.startswith("q_")]
    distinct = [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.startswith("d_")]
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *quantiles, *distinct)


def store(sketches: DataFrame, path: str, part: str) -> None:
    """Adds parts' sketches to those at path; a part that is there already is replaced."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def approximate(sketches: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """approx_<key> counts and approx_<number>_<percent> quantiles of sketches."""
    number = [F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(float(q)))).alias(f"approx_{c[2:]}_{round(100 * q)}") for c in sketches.columns if c.startswith("q_") for q in quantiles]
    distinct = [F.hll_sketch_estimate(c).alias(f"approx_{c[2:]}") for c in sketches.columns if c.startswith("d_")]
    others = [c for c in sketches.columns if not c.startswith(("q_", "d_"))]
    return sketches.select(*others, *distinct, *number)
