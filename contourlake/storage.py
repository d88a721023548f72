"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode, a temporary folder that becomes the session's."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="contourlake-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def required(spark: SparkSession, *names: str) -> dict[str, str]:
    """Settings that a job cannot do without, such as a store's; all that are missing are named at once. Values are the session's, never the code's."""
    found = {n: spark.conf.get(n, None) for n in names}
    if missing := [n for n, v in found.items() if not v]:
        raise ValueError(f"set {', '.join(missing)}")
    return found


class Tables:
    """Tables of one run. Written tables cut the lineage: what a lost executor held is read again, not computed again.

    ``put`` writes a DataFrame and reads it back; ``drop`` deletes tables that
    no later plan reads. Tables that the returned DataFrame still reads stay.
    Spark sends a table whose files are small through the driver to be joined,
    but files say little of rows: keys that repeat take hardly any room in them.
    ``put_large`` is for tables that grow with the input: joins shuffle them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/contourlake/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_large(self, name: str, df: DataFrame) -> DataFrame:
        return self.put(name, df).hint("merge")

    def below(self, name: str) -> Tables:
        """Tables of a part of the run, in a folder of their own."""
        out = Tables.__new__(Tables)
        out.spark, out.root = self.spark, f"{self.root}/{name}"
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
