"""Running totals over an order of all rows, without one task that sees them all.

Rows are range-partitioned and written with their partition's number; each
partition is summed on its own, and the totals of the partitions before, a row
each, are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Tables


def running(rows: DataFrame, amount: Column, *order: str | Column, out: str = "before") -> DataFrame:
    """rows with the sum of the amounts of all rows before, in an ascending order that should leave no ties."""
    spark = rows.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.withColumns({f"_o{k}": c for k, c in enumerate(keys)}).withColumn("_a", amount)
    names = [f"_o{k}" for k in range(len(keys))]
    ranged = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *names)
    placed = Tables(spark, "running").put("rows", ranged.withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_p").agg(F.sum("_a").alias("_s"))
    zero = F.lit(0).cast(placed.schema["_a"].dataType)
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("_b"))
    joined = placed.withColumn("_w", F.coalesce(F.sum("_a").over(own), zero)).join(F.broadcast(before), "_p")  # a row per partition
    return joined.withColumn(out, F.col("_w") + F.col("_b")).drop("_p", "_a", "_w", "_b", *names)


def numbered(rows: DataFrame, *order: str | Column, out: str = "k") -> DataFrame:
    """rows with their place in the order, from 0."""
    return running(rows, F.lit(1).cast("long"), *order, out=out)


def keyed_running(rows: DataFrame, amount: Column, keys: Sequence[str], value: str) -> DataFrame:
    """rows, which differ in (keys, value), with before, the amounts of the key's rows of smaller value, and n, those of all its rows.

    Rows are range-partitioned by keys and value, so a key with any share of them
    is cut over partitions; each stretch of a key in a partition is summed on its
    own. Only keys that lie in several partitions, fewer than there are borders,
    need the totals of their other stretches.
    """
    spark = rows.sparkSession
    ranged = rows.withColumn("_a", amount).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, value)
    placed = Tables(spark, "keyed").put("rows", ranged.withColumn("_p", F.spark_partition_id()))
    sums = placed.groupBy("_p", *keys).agg(F.sum("_a").alias("_s"))
    key = Window.partitionBy(*keys)
    stretches = sums.withColumns({"_b": F.coalesce(F.sum("_s").over(key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")), "_n": F.sum("_s").over(key), "_c": F.count("*").over(key)})
    cut = stretches.where("_c > 1").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col("_p").alias("_q"), "_b", "_n")  # two rows a border at most
    own = Window.partitionBy("_p", *keys)
    summed = placed.withColumns({"_w": F.coalesce(F.sum("_a").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")), "_t": F.sum("_a").over(own)})
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    joined = summed.join(F.broadcast(cut), same, "left")
    return joined.select(*rows.columns, (F.col("_w") + F.coalesce("_b", F.lit(0))).alias("before"), F.coalesce("_n", "_t").alias("n"))
