"""A log store: a Parquet table partitioned by source and span of time."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import entry_size_of, message_size, source_key, source_of
from tidelog.functions.patterns import matches
from tidelog.functions.timing import floor_hour, hour_floor
from tidelog.operators.coverage import hours
from tidelog.operators.merge import merge, without_late
from tidelog.plans.query import LogQuery, any_of, per_query
from tidelog.schema import FILE, HOUR_NS, LOG

#: Rows of a file at most; a full span of a busy source is several files.
MOST_ROWS = 5_000_000
DAY_NS = 24 * HOUR_NS


class LogStore:
    """Entries below one path.

    The source stands in the partition value alone, so a pattern on the
    source is a filter on partitions, and every query also filters the spans
    it touches.  A span is a day; for sources that fill files within an hour
    it may be an hour.  What is kept, dropped and moved is always an hour.
    Files are sorted by time; their statistics skip what lies outside.
    """

    def __init__(self, spark: SparkSession, path: str, span: int = DAY_NS):
        if span <= 0 or span % HOUR_NS:
            raise ValueError("a span is a number of hours")
        self.spark, self.path, self.span = spark, path.rstrip("/"), span

    def _floor(self, ts: int) -> int:
        return ts - ts % self.span

    # -- files ---------------------------------------------------------------

    def _fs(self, path: str | None = None):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path or self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self) -> bool:
        fs, at = self._fs()
        return fs.exists(at) and any(s.isDirectory() for s in fs.listStatus(at))

    def _partitions(self, keys: Iterable[str] | None = None) -> list[tuple[str, int, str]]:
        """Key, start of the span and path of every partition (metadata only)."""
        if not self.exists():
            return []
        # Spark's own discovery, which lists many folders as a job and reads no file
        leaf = self.spark.read.schema(FILE).parquet(self.path)._jdf.queryExecution().analyzed().collectLeaves().head()
        parts = leaf.relation().location().partitionSpec().partitions()
        wanted = None if keys is None else set(keys)
        found = []
        for i in range(parts.size()):
            part = parts.apply(i)
            key = part.values().getUTF8String(0).toString()
            if wanted is None or key in wanted:
                found.append((key, part.values().getLong(1), part.path().toString()))
        return found

    # -- writing -------------------------------------------------------------

    def append(self, entries: DataFrame, arrival: str | None = None, now: int | None = None) -> None:
        """Add entries (ts, severity, source, message).

        A time of 0 becomes ``now``; severities wrap to 0 to 255.  With
        ``arrival``, entries late within this batch or behind what the store
        holds of their hour are dropped, as a file that only grows would.
        """
        at = now if now is not None else time.time_ns()
        rows = entries.select(
            F.when(F.col("ts") == 0, F.lit(at)).otherwise(F.col("ts")).cast("long").alias("ts"),
            F.pmod(F.col("severity"), F.lit(256)).cast("int").alias("severity"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.coalesce("message", F.lit("")).alias("message"),
            *([F.col(arrival).alias("_arrival")] if arrival else []),
        )
        if arrival:
            rows = without_late(rows.withColumn("hour", hour_floor(F.col("ts"))), "_arrival")
            if self.exists():
                spans = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
                near = self.table().where(F.col("span").between(self._floor(spans["a"] or 0), self._floor(spans["b"] or 0)))  # partitions of the batch's time alone
                bound = near.groupBy(source_key(F.col("source")).alias("_k"), F.col("hour").alias("_h")).agg(F.max("ts").alias("_max"))
                rows = rows.withColumn("_key", source_key(F.col("source")))
                rows = rows.join(bound, (F.col("_key") == F.col("_k")) & (F.col("hour") == F.col("_h")), "left").where("ts >= coalesce(_max, ts)")
        self._write(rows, "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        start = F.col("ts") - F.pmod(F.col("ts"), F.lit(self.span))
        files = rows.select("ts", "severity", "message", message_size(F.col("message")).alias("stored"), source_key(F.col("source")).alias("source_key"), start.alias("span"))
        # rebalancing splits a span that is too large for one task, which repartitioning by key would not
        dealt = files.hint("rebalance", "source_key", "span").sortWithinPartitions("source_key", "span", "ts")
        dealt.write.partitionBy("source_key", "span").option("maxRecordsPerFile", MOST_ROWS).option("partitionOverwriteMode", "dynamic").mode(mode).parquet(self.path)

    # -- reading -------------------------------------------------------------

    def table(self) -> DataFrame:
        """ts, severity, source, message, stored, hour, span of everything, from a fresh listing."""
        if not self.exists():
            files = self.spark.createDataFrame([], FILE)
        else:
            files = self.spark.read.schema(FILE).parquet(self.path)
        return files.select("ts", "severity", source_of(F.col("source_key")).alias("source"), "message", "stored", hour_floor(F.col("ts")).alias("hour"), "span")

    def _within(self, queries: Iterable[LogQuery]) -> Column:
        """Spans that any query may touch, and times between the first and the last that any asks for."""
        live = [q for q in queries if not q.empty]
        if not live:
            return F.lit(False)
        start, end = min(q.start for q in live), max(q.end for q in live)
        return F.col("span").between(self._floor(start), self._floor(end)) & F.col("ts").between(start, end)

    def scan(self, query: LogQuery) -> DataFrame:
        """Entries of one query, duplicates included."""
        return self.table().where(self._within([query]) & query.predicate()).select("ts", "severity", "source", "message")

    def read(self, *queries: LogQuery, dedup: str | bool = "set", sort: bool = False) -> DataFrame:
        """Entries that any query selects, in one scan; no query selects nothing."""
        table = self.table().where(self._within(queries))
        found = per_query(table, queries) if dedup is False else table.where(any_of(queries))
        return merge([found.select("ts", "severity", "source", "message")], dedup, sort)

    def size(self) -> DataFrame:
        """source, entries, bytes as an append-only file would take them, long messages deflated."""
        return self.table().groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum(entry_size_of(F.col("source"), F.col("stored"))).alias("bytes"))

    def coverage(self) -> DataFrame:
        """source, hour of all entries."""
        return hours(self.table())

    # -- lifecycle -----------------------------------------------------------

    def truncate(self, limit: int, source: str = "") -> int:
        """Drop the hour of ``limit`` and all before it, of matching sources; the number of partitions touched.

        Whole spans go without being read; the span of ``limit`` is rewritten.
        """
        stop = floor_hour(limit) + HOUR_NS
        every = self._partitions()
        keys = self.spark.createDataFrame(sorted({(p[0],) for p in every}), "k string")
        wanted = {r["k"] for r in keys.where(matches(source_of(F.col("k")), source)).collect()}
        before = [p for p in every if p[0] in wanted and p[1] < stop]
        gone = [p for p in before if p[1] + self.span <= stop]
        partly = [p for p in before if p[1] + self.span > stop]
        for key, start, _ in partly:
            self._rewrite(key, start, F.col("ts") >= stop)
        return self._drop(gone) + len(partly)

    def _rewrite(self, key: str, start: int, keep: Column) -> None:
        """Replace one partition by those of its entries that stay; staged first, for it is read meanwhile."""
        rows = self.table().where((F.col("span") == start) & (source_key(F.col("source")) == key) & keep)
        self._replace(rows.select("ts", "severity", "source", "message"), key, start)

    def _replace(self, rows: DataFrame, key: str, start: int) -> None:
        """Write a partition's new rows beside the store, then put them in its place.

        If the first step fails, the partition is as it was; if the second
        does, the copy is whole and stays, and ``recover`` puts it in place.
        """
        stage = f"{self.path}.staged/{uuid.uuid4().hex}/start={start}/key={key.encode().hex()}"
        rows.write.parquet(stage)
        self._promote(stage, key, start)

    def _promote(self, stage: str, key: str, start: int) -> None:
        staged = self.spark.read.schema(LOG).parquet(stage)
        if staged.isEmpty():
            self._drop([p for p in self._partitions([key]) if p[1] == start])
        else:
            self._write(staged, "overwrite")  # of this partition alone
        fs, at = self._fs(stage)
        fs.delete(at.getParent().getParent(), True)

    def recover(self) -> int:
        """Finish or undo what a stopped writer left; for the store's owner, before it writes.  Returns the partitions put in place.

        A copy that was written to its end takes its partition's place, others are removed.
        """
        fs, base = self._fs(f"{self.path}.staged")
        if not fs.exists(base):
            return 0
        done = 0
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for part in fs.globStatus(path(base, "*/start=*/key=*")):
            at = part.getPath()
            if fs.exists(path(at, "_SUCCESS")):
                start = int(at.getParent().getName().split("=", 1)[1])
                self._promote(at.toString(), bytes.fromhex(at.getName().split("=", 1)[1]).decode(), start)
                done += 1
        fs.delete(base, True)
        return done

    def _key(self, source: str) -> str:
        return self.spark.range(1).select(source_key(F.lit(source)).alias("k")).first()["k"]

    def _drop(self, partitions: list[tuple[str, int, str]]) -> int:
        for _, _, path in partitions:
            fs, at = self._fs(path)
            parent = at.getParent()
            fs.delete(at, True)
            if not fs.listStatus(parent):
                fs.delete(parent, True)
        return len(partitions)

    def chunks(self) -> DataFrame:
        """source, hour, size (bytes of entries) of every hour; reads no message."""
        return self.table().groupBy("source", "hour").agg(F.sum(entry_size_of(F.col("source"), F.col("stored"))).alias("size"))

    def next_chunks(self, budget: int, now: int | None = None) -> Iterator[tuple[str, int, int]]:
        """Source, hour and size of the chunks that move, one after the other, while the budget lasts.

        Only a source's oldest hour may move, if it lies before the current
        hour and is smaller than what is left; of those, the oldest, then by
        source.  The budget only shrinks, so a source whose oldest hour does
        not fit is out for good, and one pass over all chunks in order makes
        the whole choice.
        """
        limit, out = floor_hour(now if now is not None else time.time_ns()), set()
        for r in self.chunks().where(F.col("hour") < limit).orderBy("hour", "source").toLocalIterator():
            if budget <= 0:
                return
            if r["source"] not in out:
                if r["size"] < budget:
                    budget -= r["size"]
                    yield r["source"], r["hour"], r["size"]
                else:
                    out.add(r["source"])

    def next_chunk(self, budget: int, now: int | None = None) -> tuple[str, int, int] | None:
        """Source, hour and size of the chunk that moves next."""
        return next(self.next_chunks(budget, now), None)

    def chunk(self, source: str, hour: int) -> DataFrame:
        table = self.table().where((F.col("span") == self._floor(hour)) & F.col("ts").between(hour, hour + HOUR_NS - 1) & (F.col("source") == source))
        return table.select("ts", "severity", "source", "message")

    def accept(self, source: str, hour: int, entries: DataFrame) -> None:
        """Merge entries into a chunk; doing it again changes nothing."""
        self._accept(source, self._floor(hour), [hour], entries)

    def _accept(self, source: str, start: int, hours_: list[int], entries: DataFrame) -> None:
        """Merge entries into hours of one partition, which is rewritten once."""
        own = entries.where((F.col("source") == source) & hour_floor(F.col("ts")).isin(hours_)).select("ts", "severity", "source", "message")
        span = self.table().where((F.col("span") == start) & (F.col("source") == source))
        columns = ["ts", "severity", "source", "message"]
        there, rest = span.where(F.col("hour").isin(hours_)).select(*columns), span.where(~F.col("hour").isin(hours_)).select(*columns)
        self._replace(merge([merge([own, there]), rest], dedup=False), self._key(source), start)

    def delete_chunk(self, source: str, hour: int) -> None:
        """Drop one hour of a source and nothing else."""
        self._delete(source, self._floor(hour), [hour])

    def _delete(self, source: str, start: int, hours_: list[int]) -> None:
        self._rewrite(self._key(source), start, ~hour_floor(F.col("ts")).isin(hours_))

    def transfer(self, to: LogStore, budget: int, now: int | None = None) -> list[tuple[str, int, int]]:
        """Move oldest chunks while the budget lasts; what was moved.

        Hours of one partition move together: it is read and rewritten once on
        either side.  They are given before they are deleted, so that a
        transfer that stops between leaves entries twice and loses none.
        """
        moved = list(self.next_chunks(budget, now))
        groups: dict[tuple[str, int], list[int]] = {}
        for source, hour, _ in moved:
            groups.setdefault((source, self._floor(hour)), []).append(hour)
        for (source, start), found in groups.items():
            own = self.table().where((F.col("span") == start) & (F.col("source") == source) & F.col("hour").isin(found)).select("ts", "severity", "source", "message")
            by_span: dict[int, list[int]] = {}
            for hour in found:
                by_span.setdefault(to._floor(hour), []).append(hour)
            for there, hours_ in by_span.items():
                to._accept(source, there, hours_, own)
            self._delete(source, start, found)
        return moved

    def compact(self, source: str, hour: int) -> None:
        """Rewrite a chunk's files as few, without changing its entries but for duplicates."""
        self.accept(source, hour, self.chunk(source, hour))
