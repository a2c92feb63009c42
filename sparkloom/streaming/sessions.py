"""Extension: blocks of a live message stream by session windows.

The batch operator's count limit and its handling of unreadable times have no
counterpart in session windows; messages without a time are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(messages: DataFrame, key: str, ts: str = "ts", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Per ``key`` and session: first and last time and number of messages; a session closes ``late`` after its gap."""
    timed = messages.withColumn("__ts", F.col(ts).cast("timestamp")).filter("__ts IS NOT NULL").withWatermark("__ts", late)
    out = timed.groupBy(F.col(key), F.session_window("__ts", gap).alias("w")).agg(F.count("*").alias("n_messages"), F.min("__ts").alias("start_ts"), F.max("__ts").alias("end_ts"))
    return out.drop("w")
