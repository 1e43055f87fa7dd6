"""Streams of entries and heartbeats."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.functions.timing import as_timestamp, hour_floor
from tidelog.operators.balance import transfers
from tidelog.operators.stats import TIMEOUT_NS
from tidelog.schema import HOUR_NS, LOG, STAT, TRANSFER
from tidelog.sources.store import LogStore


def entry_stream(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Entries from JSON files that appear below a path."""
    schema = LOG.simpleString()[7:-1].replace(":", " ") + (f", {extra}" if extra else "")
    return spark.readStream.schema(schema).json(path)


def heartbeat_stream(spark: SparkSession, path: str) -> DataFrame:
    """Heartbeats from JSON files that appear below a path."""
    return spark.readStream.schema(STAT).json(path)


def heartbeats_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """Heartbeats from any stream of JSON records, such as a socket's or a queue's; what is none is left out."""
    read = lines.select(F.from_json(F.col(column).cast("string"), STAT).alias("_b"))
    return read.select("_b.*").where("addr is not null and ts is not null")


def heartbeat_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Heartbeats that a server writes to a socket, one JSON record to a line."""
    return heartbeats_of(spark.readStream.format("socket").option("host", host).option("port", port).load())


def ingest(entries: DataFrame, store: LogStore, checkpoint: str, arrival: str | None = None, **trigger) -> StreamingQuery:
    """Append every micro-batch to a store."""

    def write(batch: DataFrame, _: int) -> None:
        store.append(batch, arrival)

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drop_late(entries: DataFrame, arrival: str = "seq", keep_for: str | None = None) -> DataFrame:
    """ts, severity, source, message, ``arrival`` without entries behind an earlier arrival of their source and hour.

    The state of a file is one number, the largest time accepted.  Built-in
    watermarks cannot say this: they are global and have a delay.  With
    ``keep_for``, entries that much older than the newest time seen are late
    too, and the number of a file whose hour is that old is forgotten.
    """
    columns = ["ts", "severity", "source", "message", arrival]
    out = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in columns)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(arrival, kind="stable")
        ends = (int(key[1]) + HOUR_NS) // 10**6
        if keep_for is not None and state.getCurrentWatermarkMs() >= ends:
            return  # the file is closed
        bound = state.get[0] if state.exists else 0
        before = rows["ts"].cummax().shift(1, fill_value=bound).clip(lower=bound)
        state.update((max(bound, int(rows["ts"].max())),))
        if keep_for is not None:
            state.setTimeoutTimestamp(ends)
        yield rows.loc[rows["ts"] >= before, columns]

    keyed = entries.select(*columns).withColumn("_hour", hour_floor(F.col("ts")))
    if keep_for is not None:
        keyed = keyed.withColumn("_time", as_timestamp(F.col("ts"))).withWatermark("_time", keep_for)
    timer = GroupStateTimeout.NoTimeout if keep_for is None else GroupStateTimeout.EventTimeTimeout
    return keyed.groupBy("source", "_hour").applyInPandasWithState(keep, out, "bound long", "append", timer)


def drop_repeated(entries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Without entries delivered again within a delay."""
    timed = entries.withColumn("_time", as_timestamp(F.col("ts"))).withWatermark("_time", delay)
    return timed.dropDuplicatesWithinWatermark(["ts", "source", "message"]).drop("_time")


def hourly(entries: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """source, hour_start, entries in tumbling hours."""
    timed = entries.withColumn("_time", as_timestamp(F.col("ts"))).withWatermark("_time", delay)
    counted = timed.groupBy("source", F.window("_time", "1 hour")).agg(F.count(F.lit(1)).alias("entries"))
    return counted.select("source", (F.unix_micros("window.start") * 1000).alias("hour_start"), "entries")


def latest_beats(beats: DataFrame, arrival: str = "seq", timeout_ms: int | None = TIMEOUT_NS // 10**6) -> DataFrame:
    """addr, ts, size, limit, last_transfer_id, live: an update per address with news, and one when it has been silent for too long.

    Without a timeout no host ever goes.  A stream with one has always one
    more batch to run, so it is no use with ``availableNow``.
    """
    names = ["addr", "ts", "size", "limit", "last_transfer_id", "live"]
    out = "addr string, ts long, size long, limit long, last_transfer_id long, live boolean"

    def newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *held, False)], columns=names)
            return
        rows = pd.concat(list(batches)).sort_values(["ts", arrival], ascending=[False, True])
        best = rows.iloc[0]
        if not state.exists or int(best["ts"]) > state.get[0]:
            state.update(tuple(int(best[c]) for c in names[1:5]))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], *state.get, True)], columns=names)

    timer = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    if "last_transfer_id" not in beats.columns:
        beats = beats.withColumn("last_transfer_id", F.lit(0).cast("long"))
    known = beats.withColumn("last_transfer_id", F.coalesce("last_transfer_id", F.lit(0).cast("long")))
    return known.groupBy("addr").applyInPandasWithState(newest, out, "ts long, size long, limit long, last_transfer_id long", "update", timer)


class Planner:
    """Hosts, running transfers and the next id: a row per host, and half as many transfers at most."""

    def __init__(self, next_id: int = 1):
        self.hosts: dict[str, tuple[int, int, int]] = {}
        self.running: dict[int, tuple[str, str, int]] = {}
        self.next_id = next_id

    def hear(self, rows: Iterable[Row]) -> None:
        """Heartbeats (addr, size, limit, last_transfer_id, live): a host's new last transfer is complete."""
        for r in rows:
            before = self.hosts.get(r["addr"])
            if before and before[2] != r["last_transfer_id"]:
                self.running.pop(r["last_transfer_id"], None)
            if r["live"]:
                self.hosts[r["addr"]] = (r["size"], r["limit"], r["last_transfer_id"])
            else:
                self.hosts.pop(r["addr"], None)

    def plan(self, spark: SparkSession) -> DataFrame:
        """New transfers among hosts that are in none; they run from now on."""
        rows = [(a, s, m) for a, (s, m, _) in sorted(self.hosts.items())]
        hosts = spark.createDataFrame(rows, "addr string, size long, limit long")
        active = spark.createDataFrame([(i, *t) for i, t in self.running.items()], TRANSFER)
        found = [tuple(r) for r in transfers(hosts, active, self.next_id).orderBy("id").collect()]
        for ident, giver, taker, amount in found:
            self.running[ident] = (giver, taker, amount)
            self.next_id = ident + 1
        return spark.createDataFrame(found, TRANSFER)


def plan_transfers(hosts: DataFrame, checkpoint: str, sink: Callable[[DataFrame], object], planner: Planner | None = None, **trigger) -> StreamingQuery:
    """Hand ``sink`` the new transfers that follow from all hosts, after every micro-batch of ``latest_beats``.

    The driver holds a row per host and per running transfer; after a restart
    it learns the hosts again from their next heartbeats.  ``planner`` may
    bring running transfers and the next id along.
    """
    known = planner or Planner()

    def write(batch: DataFrame, _: int) -> None:
        known.hear(batch.select("addr", "size", "limit", "last_transfer_id", "live").collect())
        sink(known.plan(batch.sparkSession))

    return hosts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
