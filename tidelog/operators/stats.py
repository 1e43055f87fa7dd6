"""Heartbeats: the latest of every host, live hosts and the cluster's total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import percent_full

#: A host not heard of for so long is gone.
TIMEOUT_NS = 30 * 60 * 10**9


def latest(beats: DataFrame, arrival: str = "seq") -> DataFrame:
    """The newest heartbeat of each address; of equally new ones the first to arrive."""
    columns = [c for c in beats.columns if c not in ("addr", arrival)]
    best = F.max_by(F.struct(*columns), F.struct("ts", -F.col(arrival)))
    return beats.groupBy("addr").agg(best.alias("_s")).select("addr", *[f"_s.{c}" for c in columns])


def live(latest_beats: DataFrame, now: int, timeout: int = TIMEOUT_NS) -> DataFrame:
    return latest_beats.where(F.lit(now) - F.col("ts") < timeout)


def with_total(hosts: DataFrame) -> DataFrame:
    """addr, size, limit, pct of every host and of all, as ``Total``; a limit of 0 has no percentage, a total limit of 0 has 0."""
    rows = hosts.select("addr", "size", "limit", percent_full(F.col("size"), F.col("limit")).alias("pct"))
    total = hosts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("limit"), F.lit(0)).alias("limit"))
    total = total.select(F.lit("Total").alias("addr"), "size", "limit", F.coalesce(percent_full(F.col("size"), F.col("limit")), F.lit(0.0)).alias("pct"))
    return rows.unionByName(total)
