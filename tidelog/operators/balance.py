"""Transfers from overloaded hosts to those with room."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transfers(hosts: DataFrame, active: DataFrame | None = None, next_id: int = 1) -> DataFrame:
    """id, from_addr, to_addr, amount for hosts (addr, size, limit).

    The most loaded host above 1 gives to the least loaded below 1, the next
    to the next, ties by address.  Both orders are monotone, so pairing equal
    ranks is the whole plan.  Hosts of a transfer in ``active`` (from_addr,
    to_addr) sit out.  A limit of 0 counts as an endless load, or as none for
    an empty host, which then neither gives nor takes.
    """
    free = hosts
    if active is not None:
        busy = active.select(F.col("from_addr").alias("addr")).unionByName(active.select(F.col("to_addr").alias("addr")))
        free = hosts.join(busy, "addr", "left_anti")
    load = F.when(F.col("limit") == 0, F.when(F.col("size") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))).otherwise(
        F.try_divide(F.col("size").cast("double"), F.col("limit").cast("double"))
    )
    loaded = free.withColumn("_load", load)
    # a row per overloaded host, and per host with room: the windows sort hosts, not entries
    gives = loaded.where("_load > 1").withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_load"), F.desc("addr"))))
    takes = loaded.where("_load < 1").withColumn("_rank", F.row_number().over(Window.orderBy("_load", "addr")))
    g = gives.select("_rank", F.col("addr").alias("from_addr"), F.col("size").alias("_gs"), F.col("limit").alias("_gl"))
    t = takes.select("_rank", F.col("addr").alias("to_addr"), F.col("size").alias("_ts"), F.col("limit").alias("_tl"))
    amount = F.least(F.expr("_gs - _gl div 2"), F.expr("_tl - _ts"))
    return g.join(t, "_rank").select((F.col("_rank") + F.lit(next_id - 1)).cast("long").alias("id"), "from_addr", "to_addr", amount.cast("long").alias("amount"))


def running(started: DataFrame, done: DataFrame) -> DataFrame:
    """Transfers (id, ...) that no host has reported as its last (last_transfer_id)."""
    return started.join(done.select(F.col("last_transfer_id").alias("id")), "id", "left_anti")


def upsert(hosts: DataFrame, updates: DataFrame, arrival: str = "seq") -> DataFrame:
    """Hosts with the last update of each address applied."""
    last = updates.groupBy("addr").agg(F.max_by(F.struct("size", "limit"), arrival).alias("_u")).select("addr", "_u.size", "_u.limit")
    return hosts.join(last, "addr", "left_anti").select("addr", "size", "limit").unionByName(last)


def remove(hosts: DataFrame, gone: DataFrame) -> DataFrame:
    return hosts.join(gone.select("addr"), "addr", "left_anti")


def oldest_chunk(chunks: DataFrame, budget: int, now_hour: int) -> DataFrame:
    """The next chunk to move, of chunks (source, hour, size): at most one row.

    Only a source's oldest hour may move, if it lies before the current hour
    and is smaller than the budget; of those, the oldest, then by source.
    """
    first = chunks.groupBy("source").agg(F.min_by(F.struct("hour", "size"), "hour").alias("_c")).select("source", "_c.hour", "_c.size")
    return first.where((F.col("hour") < now_hour) & (F.col("size") < budget)).orderBy("hour", "source").limit(1)
