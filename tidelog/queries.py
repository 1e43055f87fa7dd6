"""The registered log queries and their SQL.

``events`` is read as a log of four hosts: its time in nanoseconds, its value
as severity, its type as source, its properties as message, its user as host.
``documents`` is a second log, for the codec and sizes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import codec, text, timing
from tidelog.functions.patterns import matches
from tidelog.operators import access, balance, coverage, merge, stats
from tidelog.plans.query import LogQuery, any_of, parse_queries, per_query, query_json, query_table
from tidelog.schema import STAT
from tidelog.service import Service
from tidelog.sources.federation import Federation
from tidelog.sources.frames import from_internal, parse_entries, read_entries, to_internal, until_empty
from tidelog.sources.store import LogStore
from tidelog.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

START = 1_704_067_200_000_000_000  # 2024-01-01, UTC
DAY = 24 * timing.HOUR_NS
HOSTS = ("log0", "log1", "log2", "log3")
FIRST = LogQuery(START, START + 15 * DAY, 0, 60, "error|purchase")
SECOND = LogQuery(START + 10 * DAY, START + 25 * DAY, 20, 255, "^(error|click)$")
LIMIT = START + 10 * DAY + 5 * timing.HOUR_NS + 17

_LOG = """log AS (
  SELECT epoch_us(ts) * 1000 AS ts, CAST(floor(value) AS INT) & 255 AS severity, event_type AS source, props AS message,
         'log' || (user_id % 4) AS addr, event_id AS seq, value FROM events)"""
_HOUR = "(ts - ((ts % 3600000000000) + 3600000000000) % 3600000000000)"
_SECOND_SQL = f"ts BETWEEN {SECOND.start} AND {SECOND.end} AND severity BETWEEN 20 AND 255 AND regexp_matches(source, '^(error|click)$')"
_FIRST_SQL = f"ts BETWEEN {FIRST.start} AND {FIRST.end} AND severity BETWEEN 0 AND 60 AND regexp_matches(source, 'error|purchase')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, severity, source, message, addr, seq, value."""
    return table(spark, sf_dir, "events").select(
        timing.from_timestamp(F.col("ts")).alias("ts"),
        F.floor("value").cast("int").bitwiseAND(255).alias("severity"),
        F.col("event_type").alias("source"),
        F.col("props").alias("message"),
        F.concat(F.lit("log"), (F.col("user_id") % 4).cast("string")).alias("addr"),
        F.col("event_id").alias("seq"),
        "value",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("ts", "severity", "source", "message")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, removed when the JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# -- reading ------------------------------------------------------------------


@register("read_range_sev_src", f"WITH {_LOG} SELECT ts, severity, source, message FROM log WHERE {_FIRST_SQL}")
def read_range_sev_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where(FIRST.predicate())


@register("read_degenerate", f"WITH {_LOG} SELECT ts, severity, source, message FROM log WHERE false")
def read_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range without extent, severities upside down and a pattern that is none: nothing."""
    bad = [LogQuery(START, START), LogQuery(START, START + DAY, 9, 3), LogQuery(START, START + DAY, source="a++(")]
    return entries(spark, sf_dir).where(any_of(bad))


@register(
    "read_multi_query_merge",
    f"WITH {_LOG} SELECT ts, source, message, min(severity) AS severity FROM log WHERE ({_FIRST_SQL}) OR ({_SECOND_SQL}) GROUP BY ts, source, message",
)
def read_multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping queries, merged in order of time without duplicates."""
    return merge.merge([per_query(entries(spark, sf_dir), [FIRST, SECOND])], sort=True)


@register("read_one_scan", ORACLES["read_multi_query_merge"])
def read_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one scan, the queries' predicates joined by or."""
    return merge.merge([entries(spark, sf_dir).where(any_of([FIRST, SECOND]))])


@register("read_all_copies", f"WITH {_LOG} SELECT ts, severity, source, message FROM log WHERE {_FIRST_SQL} UNION ALL SELECT ts, severity, source, message FROM log WHERE {_SECOND_SQL}")
def read_all_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge([per_query(entries(spark, sf_dir), [FIRST, SECOND])], dedup=False)


_ASKED = f"(VALUES ({START}, {START + DAY}, 0, 255, 'error'), ({START + DAY}, {START + 3 * DAY}, 10, 40, ''), ({START + 2 * DAY}, {START + 2 * DAY}, 0, 255, ''), ({START + 4 * DAY}, {START + 5 * DAY}, 0, 255, '[[:alpha:]]{{5}}$'))"


@register(
    "read_query_table",
    f"""WITH {_LOG}, q(s, e, lo, hi, p) AS (SELECT * FROM {_ASKED})
    SELECT ts, severity, source, message FROM log WHERE EXISTS (
      SELECT 1 FROM q WHERE s < e AND lo <= hi AND ts BETWEEN s AND e AND severity BETWEEN lo AND hi AND (p = '' OR regexp_matches(source, p)))""",
)
def read_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that are rows: a semi join on their hours."""
    rows = [(START, START + DAY, 0, 255, "error"), (START + DAY, START + 3 * DAY, 10, 40, ""), (START + 2 * DAY, START + 2 * DAY, 0, 255, "")]
    rows += [(START + 4 * DAY, START + 5 * DAY, 0, 255, "[[:alpha:]]{5}$"), (START, START + 30 * DAY, 0, 255, "a++("), (START, START + 30 * DAY, 0, 255, "(?=x)")]
    asked = spark.createDataFrame(rows, "start long, end long, min_severity int, max_severity int, source string")
    return query_table(entries(spark, sf_dir), asked)


@register(
    "federated_read",
    f"WITH {_LOG} SELECT ts, source, message, min(severity) AS severity FROM log WHERE {_FIRST_SQL} GROUP BY ts, source, message",
)
def federated_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query on the stores of four hosts, each pruned on its own, merged over all."""
    return _hosts(spark, sf_dir).read(FIRST)


@register(
    "merge_adjacent",
    f"""WITH {_LOG}, twice AS (SELECT ts, severity, source, message FROM log UNION ALL SELECT ts, severity, source, message FROM log WHERE severity < 50),
    marked AS (SELECT *, lag(source) OVER w AS ls, lag(message) OVER w AS lm FROM twice WINDOW w AS (PARTITION BY ts ORDER BY severity, source, message))
    SELECT ts, severity, source, message FROM marked WHERE NOT (ls IS NOT NULL AND ls = source AND lm = message)""",
)
def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = entries(spark, sf_dir)
    return merge.merge([log, log.where("severity < 50")], dedup="adjacent")


def _hosts(spark: SparkSession, sf_dir: str) -> Federation:
    """A store per host, filled with its entries; so few a day that a partition takes ten days."""
    log = event_log(spark, sf_dir)
    return Federation({a: _filled(spark, log.where(F.col("addr") == a), 10 * DAY) for a in HOSTS})


@register("internal_read", f"WITH {_LOG} SELECT severity AS \"Sev\", source AS \"Src\", 0 AS \"Enc\", message AS \"Msg\", ts AS \"Ts\" FROM log WHERE {_SECOND_SQL}")
def internal_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire's projection: encoded messages, as text."""
    return to_internal(entries(spark, sf_dir).where(SECOND.predicate()))


@register("internal_back", "SELECT doc_id AS ts, 7 AS severity, source, coalesce(text, '') AS message FROM documents")
def internal_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long messages sent from one log to another, and back as entries."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ts"), F.lit(7).alias("severity"), "source", F.coalesce("text", F.lit("")).alias("message"))
    return from_internal(to_internal(d))


@register(
    "query_records",
    f"""SELECT * FROM (VALUES ({START}::BIGINT, {START + DAY}::BIGINT, 0, 255, 'error'), (0::BIGINT, {DAY}::BIGINT, 3, 9, '')) v(start, "end", min_severity, max_severity, source)""",
)
def query_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as records and back; fields may be absent, and what is no record is left out."""
    asked = spark.createDataFrame([(START, START + DAY, 0, 255, "error")], "start long, end long, min_severity int, max_severity int, source string")
    plain = spark.createDataFrame([(f'{{"To":{DAY},"MinSev":3,"MaxSev":9,"Other":[1]}}',), ("no record",), ("[1]",)], "value string")
    return parse_queries(query_json(asked).unionByName(plain))


# -- writing and stores --------------------------------------------------------


def _filled(spark: SparkSession, log: DataFrame, span: int = DAY, **options) -> LogStore:
    store = LogStore(spark, work_dir(spark), span)
    store.append(log, **options)
    return store


@register("store_read", f"WITH {_LOG} SELECT ts, severity, source, message FROM log WHERE {_FIRST_SQL}")
def store_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a partitioned store, read back by source and hour partitions."""
    return _filled(spark, entries(spark, sf_dir)).scan(FIRST)


@register(
    "late_drop",
    f"""WITH {_LOG}, m AS (SELECT *, {_HOUR} AS hour, max(ts) OVER (PARTITION BY source, {_HOUR} ORDER BY value, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM log)
    SELECT ts, severity, source, message, seq FROM m WHERE ts >= greatest(coalesce(bound, 0), 0)""",
)
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that arrive in order of value: what is behind its file is dropped."""
    log = event_log(spark, sf_dir).withColumn("hour", timing.hour_floor(F.col("ts"))).withColumn("arrival", F.struct("value", "seq"))
    return merge.without_late(log, "arrival").select("ts", "severity", "source", "message", "seq")


@register(
    "store_size_by_source",
    f"WITH {_LOG} SELECT source, count(*) AS entries, CAST(sum(35 + strlen(source) + strlen(message)) AS BIGINT) AS bytes FROM log GROUP BY source",
)
def store_size_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = entries(spark, sf_dir)
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum(codec.entry_size(F.col("source"), F.col("message"))).alias("bytes"))


@register("hourly_partitions", f"WITH {_LOG} SELECT DISTINCT source, {_HOUR} AS hour FROM log")
def hourly_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.hours(entries(spark, sf_dir))


@register("truncate_keep", f"WITH {_LOG} SELECT ts, severity, source, message FROM log WHERE NOT (regexp_matches(source, 'err') AND {_HOUR} <= {timing.floor_hour(LIMIT)})")
def truncate_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store without the hours up to a limit, of the sources that match."""
    store = _filled(spark, entries(spark, sf_dir))
    store.truncate(LIMIT, "err")
    return store.table().select("ts", "severity", "source", "message")


@register(
    "oldest_chunk",
    f"""WITH {_LOG}, c AS (SELECT source, {_HOUR} AS hour, CAST(sum(35 + strlen(source) + strlen(message)) AS BIGINT) AS size FROM log GROUP BY 1, 2),
    f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY hour) = 1)
    SELECT source, hour, size FROM f WHERE size < 1000000 ORDER BY hour, source LIMIT 1""",
)
def oldest_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = entries(spark, sf_dir).withColumn("hour", timing.hour_floor(F.col("ts")))
    chunks = log.groupBy("source", "hour").agg(F.sum(codec.entry_size(F.col("source"), F.col("message"))).alias("size"))
    return balance.oldest_chunk(chunks, 1_000_000, START + 400 * DAY)


@register("chunk_accept", f"WITH {_LOG} SELECT ts, source, message, min(severity) AS severity FROM log GROUP BY ts, source, message")
def chunk_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's first hour, given to a store that has it in part, twice: the second time changes nothing."""
    log = entries(spark, sf_dir).withColumn("hour", timing.hour_floor(F.col("ts")))
    firsts = {r["source"]: r["h"] for r in log.groupBy("source").agg(F.min("hour").alias("h")).collect()}  # five sources
    first = F.min("hour").over(Window.partitionBy("source"))
    parted = log.withColumn("inside", F.col("hour") == first)
    store = _filled(spark, merge.merge([parted.where("not inside or severity % 2 = 0").select("ts", "severity", "source", "message")]))
    chunks = parted.where("inside").select("ts", "severity", "source", "message")
    for _ in range(2):
        for source, hour in firsts.items():
            store.accept(source, hour, chunks)
    return store.table().select("ts", "severity", "source", "message")


@register("transfer_keeps_all", f"WITH {_LOG} SELECT ts, source, message, min(severity) AS severity FROM log GROUP BY ts, source, message")
def transfer_keeps_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest chunks moved to a second store: both together hold what the first held."""
    hosts = Federation({"a": _filled(spark, entries(spark, sf_dir)), "b": LogStore(spark, work_dir(spark))})
    sizes = hosts.stores["a"].size().agg(F.sum("bytes").alias("n")).first()["n"] or 0
    hosts.stores["a"].transfer(hosts.stores["b"], max(1, sizes // 50), START + 400 * DAY)
    return hosts.read(LogQuery(START - DAY, START + 400 * DAY))


@register(
    "transfer_chunks",
    f"""WITH RECURSIVE {_LOG}, c AS (SELECT source, {_HOUR} AS hour, CAST(sum(35 + strlen(source) + strlen(message)) AS BIGINT) AS size FROM log GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (ORDER BY hour, source) AS r FROM c),
    step AS (SELECT 0::BIGINT AS r, 30000::BIGINT AS budget, []::VARCHAR[] AS gone, NULL::VARCHAR AS source, NULL::BIGINT AS hour, NULL::BIGINT AS size, false AS moves
      UNION ALL SELECT o.r, CASE WHEN t THEN step.budget - o.size ELSE step.budget END,
        CASE WHEN step.budget > 0 AND o.size >= step.budget AND NOT list_contains(step.gone, o.source) THEN list_append(step.gone, o.source) ELSE step.gone END, o.source, o.hour, o.size, t
      FROM step JOIN o ON o.r = step.r + 1, LATERAL (SELECT step.budget > 0 AND o.size < step.budget AND NOT list_contains(step.gone, o.source) AS t) WHERE step.budget > 0)
    SELECT source, hour, size FROM step WHERE moves""",
)
def transfer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that move while a budget lasts, each a source's oldest that is left."""
    store = _filled(spark, entries(spark, sf_dir))
    return spark.createDataFrame(list(store.next_chunks(30_000, START + 400 * DAY)), "source string, hour long, size long")


@register(
    "fanout_truncate",
    f"WITH {_LOG} SELECT ts, source, message, min(severity) AS severity FROM log WHERE NOT (regexp_matches(source, 'err|click') AND {_HOUR} <= {timing.floor_hour(LIMIT)}) GROUP BY ts, source, message",
)
def fanout_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit given as a distance from now, for two patterns, on every host of a federation."""
    service = Service(spark, _hosts(spark, sf_dir))
    service.truncate(("admin", "admin"), "-1h30m", "err, click", now=LIMIT + 90 * 60 * 10**9)
    return service.logs.read(LogQuery(START - DAY, START + 400 * DAY))


@register("each_log", f"WITH {_LOG} SELECT addr, count(*) AS entries FROM log GROUP BY addr")
def each_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action on every host's store."""
    hosts, found = _hosts(spark, sf_dir), []
    hosts.for_each(lambda store: found.append(store.size().agg(F.sum("entries").alias("entries"))))
    return merge.merge([f.select(F.lit(a).alias("addr"), "entries") for a, f in zip(hosts.stores, found, strict=True)], dedup=False)


@register("stat_of_log", f"""WITH {_LOG} SELECT '' AS addr, CAST(sum(35 + strlen(source) + strlen(message)) AS BIGINT) AS size, 5000::BIGINT AS "limit" FROM log""")
def stat_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a single log says of itself."""
    people = access.users(spark, [("op", ["instance"], "key")])
    return Service(spark, _filled(spark, entries(spark, sf_dir)), people, 5000).stat(("op", "key"))


@register("store_recovery", f"WITH {_LOG} SELECT ts, severity, source, message FROM log WHERE NOT (source = 'error' AND {_HOUR} = (SELECT min({_HOUR}) FROM log WHERE source = 'error'))")
def store_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer stopped twice: between the two steps of a rewrite, whose copy is put in place, and within the first, whose copy is removed."""
    log = entries(spark, sf_dir)
    store = _filled(spark, log)
    hour = log.where("source = 'error'").agg(F.min(timing.hour_floor(F.col("ts"))).alias("h")).first()["h"] or 0
    day, key = hour - hour % DAY, store._key("error")
    copy = log.where((F.col("source") == "error") & (F.col("ts") >= day) & (F.col("ts") < day + DAY))
    whole, torn = (f"{store.path}.staged/{name}/start={day}/key={key.encode().hex()}" for name in ("whole", "torn"))
    copy.where(timing.hour_floor(F.col("ts")) != hour).write.parquet(whole)
    copy.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(torn)
    LogStore(spark, store.path).recover()
    return store.table().select("ts", "severity", "source", "message")


# -- coverage --------------------------------------------------------------------

_ISLANDS = """SELECT source, min(hour) AS seg_start, max(hour) + 3600000000000 AS seg_end, count(*) AS hours
  FROM (SELECT *, hour - 3600000000000 * row_number() OVER (PARTITION BY source ORDER BY hour) AS run FROM c) GROUP BY source, run"""


@register("coverage_segments", f"WITH {_LOG}, c AS (SELECT DISTINCT source, {_HOUR} AS hour FROM log) {_ISLANDS}")
def coverage_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.segments(coverage.hours(entries(spark, sf_dir)))


@register("coverage_insert", f"WITH {_LOG}, c AS (SELECT DISTINCT source, {_HOUR} AS hour FROM log WHERE severity < 80) {_ISLANDS}")
def coverage_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = entries(spark, sf_dir)
    return coverage.segments(coverage.insert(coverage.hours(log.where("severity < 40")), log.where("severity between 30 and 79")))


@register(
    "coverage_delete",
    f"WITH {_LOG}, c AS (SELECT DISTINCT source, {_HOUR} AS hour FROM log EXCEPT SELECT source, {_HOUR} FROM log WHERE severity > 95) {_ISLANDS}",
)
def coverage_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = entries(spark, sf_dir)
    return coverage.segments(coverage.delete(coverage.hours(log), log.where("severity > 95")))


@register("coverage_truncate", f"WITH {_LOG}, c AS (SELECT DISTINCT source, {_HOUR} AS hour FROM log WHERE {_HOUR} > {timing.floor_hour(LIMIT)}) {_ISLANDS}")
def coverage_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.segments(coverage.truncate(coverage.hours(entries(spark, sf_dir)), LIMIT))


@register("coverage_bounds", f'WITH {_LOG} SELECT source, min({_HOUR}) AS "start", max({_HOUR}) + 3600000000000 AS "end", count(DISTINCT {_HOUR}) AS hours FROM log GROUP BY source')
def coverage_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.bounds(coverage.hours(entries(spark, sf_dir)))


@register("covered_reads", f"WITH {_LOG}, c AS (SELECT DISTINCT source, {_HOUR} AS hour FROM log WHERE severity > 90) SELECT ts, severity, source, message FROM log WHERE (source, {_HOUR}) IN (SELECT source, hour FROM c)")
def covered_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the hours that a coverage names; others are skipped."""
    log = entries(spark, sf_dir)
    return log.withColumn("hour", timing.hour_floor(F.col("ts"))).join(coverage.hours(log.where("severity > 90")), ["source", "hour"], "left_semi").drop("hour")


@register(
    "segment_overlaps",
    f"""WITH {_LOG}, c AS (SELECT DISTINCT source, {_HOUR} AS hour FROM log), s AS ({_ISLANDS})
    SELECT source, seg_start, seg_end, NOT (seg_end - 1 < {LIMIT} OR {LIMIT + DAY} < seg_start) AS touches FROM s""",
)
def segment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = coverage.segments(coverage.hours(entries(spark, sf_dir)))
    return s.select("source", "seg_start", "seg_end", coverage.overlaps(F.col("seg_start"), F.col("seg_end") - 1, F.lit(LIMIT), F.lit(LIMIT + DAY)).alias("touches"))


# -- heartbeats and balancing -------------------------------------------------------

_BEATS = f"""{_LOG}, beats AS (SELECT ts, 'h' || (seq % 12) AS addr, (severity + 1) * 10 AS size, CAST(100 * ((seq % 12) % 9) AS BIGINT) AS "limit", seq FROM log),
latest AS (SELECT addr, ts, size, "limit" FROM beats QUALIFY row_number() OVER (PARTITION BY addr ORDER BY ts DESC, seq) = 1)"""
_RANKED = """ranked AS (SELECT *, CASE WHEN "limit" = 0 THEN CASE WHEN size > 0 THEN 'Infinity'::DOUBLE ELSE 1 END ELSE size::DOUBLE / "limit" END AS load FROM free),
g AS (SELECT *, row_number() OVER (ORDER BY load DESC, addr DESC) AS r FROM ranked WHERE load > 1),
t AS (SELECT *, row_number() OVER (ORDER BY load, addr) AS r FROM ranked WHERE load < 1)"""


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats of twelve hosts, one of them with a limit of 0."""
    host = F.col("seq") % 12
    return event_log(spark, sf_dir).select(
        "ts", F.concat(F.lit("h"), host.cast("string")).alias("addr"), ((F.col("severity") + 1) * 10).cast("long").alias("size"), (F.lit(100) * (host % 9)).cast("long").alias("limit"), "seq"
    )


@register("latest_stat", f'WITH {_BEATS} SELECT addr, ts, CAST(size AS BIGINT) AS size, "limit" FROM latest')
def latest_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest(beats(spark, sf_dir))


@register("live_members", f"WITH {_BEATS}, n AS (SELECT max(ts) AS now FROM beats) SELECT addr, ts FROM latest, n WHERE now - ts < 600000000000")
def live_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_beats = beats(spark, sf_dir)
    now = all_beats.agg(F.max("ts").alias("now")).first()["now"]
    return stats.live(stats.latest(all_beats), now or 0, 600 * 10**9).select("addr", "ts")


@register(
    "cluster_total",
    f"""WITH {_BEATS} SELECT addr, CAST(size AS BIGINT) AS size, "limit", CASE WHEN "limit" = 0 THEN NULL ELSE size::DOUBLE * 100 / "limit" END AS pct FROM latest
    UNION ALL SELECT 'Total', CAST(sum(size) AS BIGINT), CAST(sum("limit") AS BIGINT), sum(size)::DOUBLE * 100 / sum("limit")::DOUBLE FROM latest""",
)
def cluster_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_total(stats.latest(beats(spark, sf_dir)))


@register(
    "balancer_transfers",
    f"""WITH {_BEATS}, free AS (SELECT * FROM latest), {_RANKED}
    SELECT g.r AS id, g.addr AS from_addr, t.addr AS to_addr, CAST(least(g.size - g."limit" // 2, t."limit" - t.size) AS BIGINT) AS amount FROM g JOIN t USING (r)""",
)
def balancer_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.transfers(stats.latest(beats(spark, sf_dir)))


@register(
    "balancer_with_active",
    f"""WITH {_BEATS}, free AS (SELECT * FROM latest WHERE addr NOT IN ('h1', 'h8')), {_RANKED}
    SELECT g.r + 6 AS id, g.addr AS from_addr, t.addr AS to_addr, CAST(least(g.size - g."limit" // 2, t."limit" - t.size) AS BIGINT) AS amount FROM g JOIN t USING (r)""",
)
def balancer_with_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = spark.createDataFrame([(6, "h1", "h8", 5)], "id long, from_addr string, to_addr string, amount long")
    return balance.transfers(stats.latest(beats(spark, sf_dir)), active, next_id=7)


@register(
    "balancer_completed",
    f"""WITH {_BEATS}, free AS (SELECT * FROM latest WHERE addr NOT IN ('h1', 'h8')), {_RANKED}
    SELECT g.r + 7 AS id, g.addr AS from_addr, t.addr AS to_addr, CAST(least(g.size - g."limit" // 2, t."limit" - t.size) AS BIGINT) AS amount FROM g JOIN t USING (r)""",
)
def balancer_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two transfers one was reported complete: its hosts take part again."""
    started = spark.createDataFrame([(6, "h1", "h8", 5), (7, "h2", "h3", 5)], "id long, from_addr string, to_addr string, amount long")
    done = spark.createDataFrame([("h2", 7), ("h1", 4)], "addr string, last_transfer_id long")
    return balance.transfers(stats.latest(beats(spark, sf_dir)), balance.running(started, done), next_id=8)


@register("host_updates", f"""WITH {_BEATS}, u AS (SELECT addr, size + 1 AS size, "limit" FROM latest WHERE addr < 'h2')
    SELECT addr, CAST(size AS BIGINT) AS size, "limit" FROM latest WHERE addr NOT IN (SELECT addr FROM u) AND addr <> 'h9' UNION ALL SELECT addr, CAST(size AS BIGINT), "limit" FROM u""")
def host_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = stats.latest(beats(spark, sf_dir)).select("addr", "size", "limit")
    updates = hosts.where("addr < 'h2'").select("addr", (F.col("size") + 1).alias("size"), "limit", F.lit(1).alias("seq"))
    return balance.remove(balance.upsert(hosts, updates), spark.createDataFrame([("h9",)], "addr string"))


# -- codecs, names and text ----------------------------------------------------------


@register("encode_flag", "SELECT doc_id, CASE WHEN strlen(text) > 512 THEN 1 ELSE 0 END AS encoding FROM documents")
def encode_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", codec.encoding(F.col("text")).alias("encoding"))


@register("codec_roundtrip", "SELECT doc_id, text AS message, CASE WHEN strlen(text) > 512 THEN true ELSE false END AS packed FROM documents")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, put into transport text, taken out and decoded."""
    d = table(spark, sf_dir, "documents").select("doc_id", codec.encoding(F.col("text")).alias("enc"), codec.encode(F.col("text")).alias("stored"))
    sent = d.select("doc_id", "enc", codec.to_transport(F.col("stored"), F.col("enc")).alias("sent"))
    return sent.select("doc_id", codec.decode(codec.from_transport(F.col("sent"), F.col("enc")), F.col("enc")).alias("message"), (F.col("enc") == 1).alias("packed"))


@register(
    "source_keys",
    "SELECT DISTINCT source, 's_' || translate(to_base64(encode(source)), '+/', '-_') AS source_key, source AS back FROM (SELECT event_type AS source FROM events UNION ALL SELECT source FROM documents UNION ALL SELECT p_name FROM part)",
)
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        table(spark, sf_dir, "events").select(F.col("event_type").alias("source"))
        .unionByName(table(spark, sf_dir, "documents").select("source"))
        .unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("source")))
        .distinct()
    )
    keyed = names.withColumn("source_key", codec.source_key(F.col("source")))
    return keyed.withColumn("back", codec.source_of(F.col("source_key")))


@register(
    "hour_names",
    f"WITH {_LOG} SELECT DISTINCT strftime(make_timestamp({_HOUR} // 1000), '%Y.%m.%d.%H') AS name, {_HOUR} AS hour_start, {_HOUR} + 3599999999999 AS hour_end FROM log",
)
def hour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = entries(spark, sf_dir).select(timing.hour_name(F.col("ts")).alias("name")).distinct()
    span = named.withColumn("_r", timing.hour_range(F.col("name")))
    return span.select("name", F.col("_r.start").alias("hour_start"), F.col("_r.end").alias("hour_end"))


@register("format_entries", f"WITH {_LOG} SELECT seq, strftime(make_timestamp(ts // 1000), '%Y-%m-%d %H:%M:%S') || ' ' || source || ' ' || severity || ' ' || message AS line FROM log")
def format_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("seq", text.format_entry(F.col("ts"), F.col("source"), F.col("severity"), F.col("message")).alias("line"))


@register("format_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN n || 'b' WHEN n < 1048576 THEN (n // 1024) || 'Kb' ELSE (n // 1048576) || 'Mb' END AS size FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents)")
def format_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.format_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@register("percent_full", "SELECT c_custkey, c_acctbal * 100 / nullif(c_nationkey, 0) AS pct FROM customer")
def percent_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.percent_full(F.col("c_acctbal"), F.col("c_nationkey")).alias("pct"))


@register("usage_lines", f"""WITH {_BEATS}, s AS (SELECT addr, CAST(size AS BIGINT) AS n, "limit" AS m FROM latest)
    SELECT addr || ' ' || CASE WHEN n < 1024 THEN n || 'b' ELSE (n // 1024) || 'Kb' END || '/' || CASE WHEN m < 1024 THEN m || 'b' ELSE (m // 1024) || 'Kb' END || ' '
      || CASE WHEN m = 0 THEN '-' ELSE printf('%.2f%%', n::DOUBLE * 100 / m) END AS line FROM s""")
def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = stats.latest(beats(spark, sf_dir))
    return hosts.select(text.format_usage(F.col("addr"), F.col("size"), F.col("limit")).alias("line"))


@register("fingerprints", "SELECT doc_id, md5(text) AS digest FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(codec.fingerprint(F.col("text")))).alias("digest"))


@register(
    "file_ids",
    f"""WITH {_LOG}, h AS (SELECT DISTINCT source, strftime(make_timestamp({_HOUR} // 1000), '%Y.%m.%d.%H') AS hour FROM log)
    SELECT translate(to_base64(encode(source)), '+/', '-_') || '/' || hour AS id, source, hour FROM h UNION ALL SELECT '%%%/a/b', '', 'a/b'""",
)
def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files, made and taken apart; one whose directory is no source's name."""
    log = entries(spark, sf_dir)
    ids = log.select(codec.file_id(F.col("source"), timing.hour_name(F.col("ts"))).alias("id")).distinct()
    ids = ids.unionByName(spark.createDataFrame([("%%%/a/b",)], "id string"))
    return ids.select("id", codec.source_of_file(F.col("id")).alias("source"), codec.hour_of_file(F.col("id")).alias("hour"))


@register(
    "durations",
    """SELECT * FROM (VALUES ('-1.5h', -5400000000000), ('2h45m', 9900000000000), ('300ms', 300000000), ('1us', 1000), ('-2µs', -2000), ('+7ns', 7), ('0', 0), ('.5s', 500000000),
    ('1h1m1s1ms1us1ns', 3661001001001)) v(text, ns)""",
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["-1.5h", "2h45m", "300ms", "1us", "-2µs", "+7ns", "0", ".5s", "1h1m1s1ms1us1ns"]
    return spark.createDataFrame([(t, timing.parse_duration(t)) for t in texts], "text string, ns long")


@register(
    "base_ranges",
    f"""SELECT * FROM (VALUES ('2024-01-01 00:00:00', '24h', {START}, {START + DAY}), ('2024-01-02 00:00:00', '-24h', {START}, {START + DAY}),
    ('2023-12-31 23:59:59', '0', {START - 10**9}, {START - 10**9})) v(base, range, start, "end")""",
)
def base_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals of a base and a signed distance."""
    given = [("2024-01-01 00:00:00", "24h"), ("2024-01-02 00:00:00", "-24h"), ("2023-12-31 23:59:59", "0")]
    return spark.createDataFrame([(b, r, *timing.interval(timing.parse_base(b), timing.parse_duration(r))) for b, r in given], "base string, range string, start long, end long")


@register(
    "comma_lists",
    """SELECT * FROM (VALUES ('a, b ,c', 0, 'a'), ('a, b ,c', 1, 'b'), ('a, b ,c', 2, 'c'), ('x{1,2}', 0, 'x{1'), ('x{1,2}', 1, '2}'), ('one', 0, 'one'), (',', 0, ''), (',', 1, '')) v(text, nth, item)""",
)
def comma_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, i, x) for t in ("a, b ,c", "x{1,2}", "one", "", ",") for i, x in enumerate(text.split_list(t))], "text string, nth int, item string")


@register("frames_roundtrip", f"WITH {_LOG} SELECT severity, source, message, count(*) AS n FROM log GROUP BY ALL")
def frames_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as records between NULs in files, and an empty record after them, read again."""
    base = work_dir(spark)
    made = entries(spark, sf_dir).select(text.entry_json(F.col("ts"), F.col("source"), F.col("severity"), F.col("message")).alias("value"))
    made.unionByName(spark.createDataFrame([("",)], "value string")).write.option("lineSep", "\0").text(base)
    return read_entries(spark, base, framed=True).groupBy("severity", "source", "message").agg(F.count(F.lit(1)).alias("n"))


@register("json_roundtrip", f"WITH {_LOG} SELECT severity, source, message, count(*) AS n FROM log GROUP BY ALL")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as JSON lines, parsed again."""
    lines = entries(spark, sf_dir).select(text.entry_json(F.col("ts"), F.col("source"), F.col("severity"), F.col("message")).alias("value"))
    return parse_entries(lines).groupBy("severity", "source", "message").agg(F.count(F.lit(1)).alias("n"))


@register(
    "json_lines",
    """SELECT * FROM (VALUES (1, 'a', 'x'), (0, 'a', 'only lower'), (3, 'é', 'ä')) v(severity, source, message)""",
)
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every kind: cases of keys, absent keys, wrong types, no JSON, and the end at an empty line."""
    lines = [
        '{"Sev":1,"Src":"a","Msg":"x"}', '{"src":"a","msg":"only lower"}', '{"SEV":3,"SRC":"é","Msg":"ä","Other":[1]}', '{"Sev":"1","Src":"a","Msg":"x"}',
        '{"Sev":1.5,"Src":"a","Msg":"x"}', '{"Sev":1,"Src":"","Msg":"x"}', "[1]", "no json", "", '{"Sev":9,"Src":"behind","Msg":"the end"}',
    ]
    return parse_entries(until_empty(spark.createDataFrame(list(enumerate(lines)), "nth long, value string"), "nth"))


@register("source_patterns", r"""SELECT p_partkey, regexp_matches(p_name, '^[[:alpha:]]') AS alpha, regexp_matches(p_name, 'a.b|(?P<e>e$)') AS named, regexp_matches(p_name, '(?i)[^a-m\s]{3}') AS many, false AS none, true AS "all" FROM part""")
def source_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", matches(name, "^[[:alpha:]]").alias("alpha"), matches(name, "a.b|(?P<e>e$)").alias("named"), matches(name, r"(?i)[^a-m\s]{3}").alias("many"),
        matches(name, "a(?=b)").alias("none"), matches(name, "").alias("all"),
    )


# -- access ------------------------------------------------------------------------------

#: What every role may do, written out; fixed values.
_MATRIX = """
  ('reader', 'read', true), ('reader', 'write', false), ('reader', 'iread', false), ('reader', 'transfer', false), ('reader', 'accept', false),
  ('reader', 'truncate', false), ('reader', 'stat', false), ('reader', 'user', false), ('reader', 'pass', true),
  ('writer', 'read', false), ('writer', 'write', true), ('writer', 'iread', false), ('writer', 'transfer', false), ('writer', 'accept', false),
  ('writer', 'truncate', false), ('writer', 'stat', false), ('writer', 'user', false), ('writer', 'pass', true),
  ('admin', 'read', true), ('admin', 'write', false), ('admin', 'iread', false), ('admin', 'transfer', false), ('admin', 'accept', false),
  ('admin', 'truncate', true), ('admin', 'stat', true), ('admin', 'user', true), ('admin', 'pass', true),
  ('instance', 'read', true), ('instance', 'write', true), ('instance', 'iread', true), ('instance', 'transfer', true), ('instance', 'accept', true),
  ('instance', 'truncate', true), ('instance', 'stat', true), ('instance', 'user', true), ('instance', 'pass', true)"""


@register("acl_matrix", f"SELECT * FROM (VALUES {_MATRIX}) v(role, action, allowed)")
def acl_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, a = access.roles(spark), access.actions(spark)
    pairs = r.join(F.broadcast(a), F.lit(True))  # four roles, nine actions
    return pairs.select("role", "action", (F.col("permissions").bitwiseAND(F.col("bit")) != 0).alias("allowed"))


@register(
    "acl_decisions",
    """SELECT * FROM (VALUES ('ann', 'pw', 'read', true), ('ann', 'no', 'read', false), ('ann', '', 'read', false), ('ann', 'pw', 'write', true), ('ann', 'pw', 'stat', false),
    ('all', '', 'read', true), ('all', '', 'pass', false), ('all', 'x', 'read', false), ('bob', '', 'read', false), ('admin', 'admin', 'truncate', true),
    ('admin', 'admin', 'accept', false), ('admin', 'admin', 'other', true)) v("user", password, action, allowed)""",
)
def acl_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = access.users(spark, [("ann", ["reader", "writer", "nobody"], "pw"), ("all", ["reader"], ""), ("admin", ["admin"], "admin")])
    asked = [
        ("ann", "pw", "read"), ("ann", "no", "read"), ("ann", "", "read"), ("ann", "pw", "write"), ("ann", "pw", "stat"), ("all", "", "read"), ("all", "", "pass"),
        ("all", "x", "read"), ("bob", "", "read"), ("admin", "admin", "truncate"), ("admin", "admin", "accept"), ("admin", "admin", "other"),
    ]
    return access.decide(spark, spark.createDataFrame(asked, "user string, password string, action string"), people)


@register(
    "user_edits",
    """SELECT * FROM (VALUES ('admin', 8, true), ('all', 1, false), ('new', 3, true), ('op', 16, false)) v("user", roles, has_password)""",
)
def user_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles set, unknown ones ignored; passwords set and taken away; users deleted, but for the two that stay."""
    people = access.users(spark, [("admin", ["admin"], "admin"), ("all", [], ""), ("op", ["instance"], "key"), ("old", ["reader"], "x")])
    people = access.set_roles(access.set_roles(people, "all", ["reader"]), "new", ["reader", "writer", "nobody"])
    people = access.set_password(access.set_password(people, "new", "pw"), "op", "")
    people = access.delete_user(access.delete_user(access.delete_user(people, "old"), "admin"), "all")
    return people.select("user", "roles", F.col("password_hash").isNotNull().alias("has_password"))


# -- streams -------------------------------------------------------------------------------


def _through(spark: SparkSession, rows: DataFrame, files: int, order: str, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Rows as a stream of JSON files in their order, a file per micro-batch, through a transformation."""
    base = work_dir(spark)
    cuts = [None, *rows.approxQuantile(order, [i / files for i in range(1, files)], 0.0), None]
    for low, high in zip(cuts, cuts[1:], strict=False):  # one after the other: a stream takes files by age
        own = rows.where((F.lit(True) if low is None else F.col(order) > low) & (F.lit(True) if high is None else F.col(order) <= high))
        own.repartition(1).write.mode("append").json(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    writer = transform(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register(
    "stream_late_drop",
    f"""WITH {_LOG},
    m AS (SELECT *, max(ts) OVER (PARTITION BY source, {_HOUR} ORDER BY (seq * 7919) % 10007, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM log)
    SELECT ts, severity, source, message, (seq * 7919) % 10007 * 1000000 + seq AS seq FROM m WHERE ts >= greatest(coalesce(bound, 0), 0)""",
)
def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that arrive out of order, over several micro-batches."""
    return _late_dropped(spark, event_log(spark, sf_dir))


def _late_dropped(spark: SparkSession, log: DataFrame) -> DataFrame:
    mixed = log.select("ts", "severity", "source", "message", (F.col("seq") * 7919 % 10007 * 1_000_000 + F.col("seq")).alias("seq"))
    return _through(spark, mixed, 3, "seq", ingest.drop_late)


@register("stream_dedup", f"WITH {_LOG} SELECT DISTINCT ts, severity, source, message FROM log")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry delivered twice."""
    return _delivered_once(spark, entries(spark, sf_dir))


def _delivered_once(spark: SparkSession, log: DataFrame) -> DataFrame:
    return _through(spark, log.unionByName(log), 2, "ts", lambda s: ingest.drop_repeated(s, "30 days"))


@register(
    "stream_latest_beats",
    f'WITH {_BEATS} SELECT addr, ts, CAST(size AS BIGINT) AS size, "limit" FROM latest',
)
def stream_latest_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all micro-batches is the batch result."""
    got = _through(spark, beats(spark, sf_dir), 3, "seq", lambda s: ingest.latest_beats(s, timeout_ms=None), "update").where("live")
    return got.groupBy("addr").agg(F.max_by(F.struct("ts", "size", "limit"), "batch").alias("_s")).select("addr", "_s.ts", "_s.size", "_s.limit")


@register("stream_ingest", f"WITH {_LOG} SELECT ts, severity, source, message FROM log")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files appended to a store, then read from it."""
    return _ingested(spark, entries(spark, sf_dir))


def _ingested(spark: SparkSession, log: DataFrame) -> DataFrame:
    base = work_dir(spark)
    log.repartition(2).write.json(f"{base}/in")
    store = LogStore(spark, f"{base}/store")
    ingest.ingest(ingest.entry_stream(spark, f"{base}/in"), store, f"{base}/state").awaitTermination()
    return store.table().select("ts", "severity", "source", "message")


@register(
    "stream_hourly",
    f"""WITH {_LOG}, d AS (SELECT *, {_HOUR} AS hour_start FROM log), w AS (SELECT max(ts) AS t FROM d)
    SELECT source, hour_start, count(*) AS entries FROM d, w WHERE hour_start + 3600000000000 <= t GROUP BY ALL""",
)
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours that the watermark has passed."""
    return _through(spark, entries(spark, sf_dir), 2, "ts", ingest.hourly)


@register(
    "stream_rebalance",
    """SELECT * FROM (VALUES (0, 1, 'h6', 'h1', 8), (0, 2, 'h5', 'h2', 7), (0, 3, 'h4', 'h3', 6), (1, 4, 'h6', 'h1', 10)) v(batch, id, from_addr, to_addr, amount)""",
)
def stream_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers planned after every micro-batch: hosts of running ones sit out until the giver reports its transfer as its last."""
    base = work_dir(spark)
    first = [(1, f"h{i}", s, 10, 0) for i, s in enumerate((1, 2, 3, 11, 12, 13), 1)]
    second = [(2, "h6", 15, 10, 1), (2, "h1", 0, 10, 0), (2, "h5", 30, 10, 0), (2, "h2", 0, 10, 0)]
    for rows in (first, second):
        spark.createDataFrame(rows, STAT).repartition(1).write.mode("append").json(f"{base}/in")
    beats_ = spark.readStream.schema(STAT).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    plans: list[tuple] = []
    batches = iter(range(1 << 30))

    def sink(plan: DataFrame) -> None:
        batch = next(batches)
        plans.extend((batch, *r) for r in plan.collect())

    ingest.plan_transfers(ingest.latest_beats(beats_, "ts", timeout_ms=None), f"{base}/state", sink).awaitTermination()
    return spark.createDataFrame(plans, "batch int, id int, from_addr string, to_addr string, amount int")
