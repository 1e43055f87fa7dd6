"""Streams against the batch result."""

import json
import socketserver
import threading
import time

from tidelog.schema import STAT
from tidelog.streaming.ingest import drop_late, heartbeat_socket, heartbeat_stream, latest_beats, plan_transfers


def test_transfers_from_heartbeats(spark, tmp_path):
    """Hosts heard of in earlier batches take part in later plans."""
    first = [(1, "a", 13, 10, 0), (1, "b", 1, 10, 0), (2, "b", 2, 10, 0)]
    second = [(3, "c", 15, 10, 0), (2, "a", 99, 0, 0), (3, "d", 1, 10, 0), (1, "b", 50, 10, 0)]
    for rows in (first, second):
        spark.createDataFrame(rows, STAT).repartition(1).write.mode("append").json(str(tmp_path / "in"))
    plans = []
    beats = heartbeat_stream(spark, str(tmp_path / "in"))
    hosts = latest_beats(beats, "ts", timeout_ms=None)
    plan_transfers(hosts, str(tmp_path / "state"), lambda p: plans.append(sorted(map(tuple, p.collect())))).awaitTermination()
    # with limit 0, a's load is endless; b's older heartbeat changes nothing
    assert plans[-1] == [(1, "a", "d", 9), (2, "c", "b", 8)]


def waited(query, until, seconds=90):
    end = time.time() + seconds
    while not until() and time.time() < end and query.isActive:
        time.sleep(0.2)
    found = until()
    query.stop()
    if query.exception():
        raise query.exception()
    return found


def test_hosts_that_fall_silent(spark, tmp_path):
    """A host is told once more, as gone, when it has been silent for the timeout."""
    spark.createDataFrame([(1, "a", 5, 10, 3), (1, "b", 6, 10, 0)], STAT).write.json(str(tmp_path / "in"))
    seen = []
    hosts = latest_beats(heartbeat_stream(spark, str(tmp_path / "in")), "ts", timeout_ms=500)
    query = hosts.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    assert waited(query, lambda: sum(not r[-1] for r in seen) == 2)
    assert sorted(seen) == sorted([("a", 1, 5, 10, 3, True), ("b", 1, 6, 10, 0, True), ("a", 1, 5, 10, 3, False), ("b", 1, 6, 10, 0, False)])


def test_heartbeats_from_a_socket(spark, tmp_path):
    lines = [json.dumps({"ts": 1, "addr": "a", "size": 5, "limit": 10, "last_transfer_id": 0}), "no record", json.dumps({"ts": 2, "addr": "a", "size": 7, "limit": 10, "last_transfer_id": 1})]

    class Hosts(socketserver.StreamRequestHandler):
        def handle(self):
            self.wfile.write("".join(x + "\n" for x in lines).encode())
            time.sleep(30)

    server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Hosts)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    seen = []
    beats = heartbeat_socket(spark, *server.server_address)
    query = beats.writeStream.foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).start()
    assert waited(query, lambda: len(seen) >= 2)
    server.shutdown()
    assert sorted(seen) == [(1, "a", 5, 10, 0), (2, "a", 7, 10, 1)]


def test_late_entries_with_files_that_close(spark, tmp_path):
    """An hour's number is kept until times of a day later have come; then its entries are late."""
    hour, schema = 3_600_000_000_000, "ts long, severity int, source string, message string, seq long"
    batches = [[(10, 1, "s", "a", 1), (5, 1, "s", "late", 2)], [(7, 1, "s", "late", 3), (12, 1, "s", "b", 4), (40 * hour, 1, "s", "c", 5)], [(40 * hour + 1, 1, "s", "d", 6)], [(13, 1, "s", "closed", 7), (41 * hour, 1, "s", "e", 8)]]
    for rows in batches:
        spark.createDataFrame([(1000 * hour + r[0], *r[1:]) for r in rows], schema).repartition(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for name, keep_for, want in (("open", None, [1, 4, 5, 6, 7, 8]), ("closing", "1 day", [1, 4, 5, 6, 8])):
        query = drop_late(stream, keep_for=keep_for).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / name)).collect()) == want
