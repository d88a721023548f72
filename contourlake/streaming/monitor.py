"""Online tone monitor: an extension on the event stream.

State is bounded by the watermark: a session or window that the watermark has
passed is emitted once and dropped, and later rows for it are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOICED_LO, VOICED_HI = 65.0, 400.0


def voiced(value):
    return F.when(value.between(VOICED_LO, VOICED_HI), value)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Frames, voiced share and mean pitch of each user's sessions."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    s = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.count(voiced(F.col("value"))).alias("n_voiced"), F.avg(voiced(F.col("value"))).alias("mean_f0"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_voiced", F.round("mean_f0", 6).alias("mean_f0"))


def rates(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and voiced share of each type in tumbling or sliding windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count(voiced(F.col("value"))).alias("n_voiced"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "n_voiced")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what the available input settles, exactly once, and stops."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
