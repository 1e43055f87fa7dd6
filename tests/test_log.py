"""Queries, merge, coverage, balancing, access, stores, federations and frames."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidelog.functions.codec import deflate
from tidelog.operators import access, balance, coverage, merge, stats
from tidelog.plans.query import LogQuery, any_of, per_query, query_table
from tidelog.schema import HOUR_NS
from tidelog.service import Refused, Service
from tidelog.sources.federation import Federation
from tidelog.sources.frames import from_internal, parse_entries, read_entries, read_frames, until_empty
from tidelog.sources.store import LogStore
from tidelog.streaming.ingest import Planner

H = HOUR_NS


def log(spark, rows):
    return spark.createDataFrame(rows, "ts long, severity int, source string, message string")


def rows(df):
    return sorted(tuple(r) for r in df.select("ts", "severity", "source", "message").collect())


@pytest.mark.parametrize(("query", "n"), [
    (LogQuery(-1, 96, 1, 1, "Test"), 96), (LogQuery(96, 384, 1, 1, "Test"), 97), (LogQuery(32, 160, 1, 1), 129), (LogQuery(32, 160, 1, 1, "X"), 0), (LogQuery(32, 160, 0, 0, "Test"), 0),
    (LogQuery(32, 32), 0), (LogQuery(0, 9, 5, 4), 0), (LogQuery(0, 200, source="("), 0),
])
def test_ranges(spark, query, n):
    entries = log(spark, [(i, 1, "Test", f"Message{i}") for i in range(1, 193)])
    assert entries.where(query.predicate()).count() == n


def test_query_lists(spark):
    entries = log(spark, [(i, i % 3, f"s{i % 2}", "m") for i in range(1, 50)])
    a, b = LogQuery(1, 20), LogQuery(10, 30, 1, 2, "1$")
    assert entries.where(any_of([])).count() == 0
    assert per_query(entries, []).count() == 0
    both = entries.where(any_of([a, b]))
    assert rows(merge.merge([per_query(entries, [a, b])])) == rows(both)
    asked = spark.createDataFrame([(1, 20, 0, 255, ""), (10, 30, 1, 2, "1$"), (5, 5, 0, 9, "")], "start long, end long, min_severity int, max_severity int, source string")
    assert rows(query_table(entries, asked)) == rows(both)


def test_merge(spark):
    one = [(i, 1, "src1", "m") for i in range(10)]
    two = [(i, 1, "src2", "m") for i in range(10)]
    got = merge.merge([log(spark, one), log(spark, one), log(spark, two)], sort=True)
    assert got.count() == 20
    assert [r["ts"] for r in got.collect()] == sorted(2 * list(range(10)))
    assert merge.merge([log(spark, one), log(spark, one)], dedup=False).count() == 20
    assert rows(merge.merge([log(spark, [(1, 5, "a", "m")]), log(spark, [(1, 2, "a", "m")])])) == [(1, 2, "a", "m")]
    pair = [(1, 0, "a", "m"), (1, 0, "b", "m")]
    assert merge.merge([log(spark, pair), log(spark, pair)], dedup="adjacent").count() == 2
    with pytest.raises(ValueError):
        merge.merge([])
    with pytest.raises(ValueError):
        merge.merge([log(spark, one)], dedup="some")


entry = st.tuples(st.integers(0, 5), st.integers(0, 3), st.sampled_from("ab"), st.sampled_from("xy"))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(entry, max_size=8), b=st.lists(entry, max_size=8))
def test_merge_is_a_set_operation(spark, a, b):
    x, y = log(spark, a), log(spark, b)
    once = merge.merge([x, y])
    assert rows(once) == rows(merge.merge([y, x])) == rows(merge.merge([once, once, y]))


def test_late(spark):
    arrived = [(1, 5, "a", 0), (2, 4, "a", 0), (3, 5, "a", 0), (4, 9, "a", 0), (5, 8, "a", 0), (6, 1, "b", 0), (7, -3, "b", -1)]
    d = spark.createDataFrame(arrived, "seq long, ts long, source string, hour long")
    assert sorted(r["seq"] for r in merge.without_late(d, "seq").collect()) == [1, 3, 4, 6]


def hours(spark, found):
    return spark.createDataFrame([("s", h * H) for h in found], "source string, hour long")


def spans(df):
    return sorted((r["seg_start"] // H, r["seg_end"] // H) for r in coverage.segments(df).collect())


def test_coverage(spark):
    points = spark.createDataFrame([("s", h * H + 17) for h in (0, 0, 2, 1, 4, -1, -3)], "source string, ts long")
    covered = coverage.insert(hours(spark, []), points)
    assert spans(covered) == [(-3, -2), (-1, 3), (4, 5)]
    assert spans(coverage.truncate(covered, 1 * H)) == [(2, 3), (4, 5)]
    assert spans(coverage.delete(covered, spark.createDataFrame([("s", 1 * H + 5)], "source string, ts long"))) == [(-3, -2), (-1, 1), (2, 3), (4, 5)]
    assert tuple(coverage.bounds(covered).first())[1:] == (-3 * H, 5 * H, 6)
    minutes = spark.createDataFrame([("s", m * 60 * 10**9) for m in range(60)], "source string, ts long")
    assert spans(coverage.hours(minutes)) == [(0, 1)]
    assert coverage.segments(hours(spark, [])).count() == 0


def test_overlaps(spark):
    cases = [(0, 1, 1, 2, True), (0, 1, 2, 3, False), (2, 3, 0, 1, False), (0, 9, 3, 4, True), (3, 4, 0, 9, True)]
    d = spark.createDataFrame(cases, "a int, b int, c int, d int, want boolean")
    assert d.where(coverage.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("want")).count() == 0


def test_transfers(spark):
    hosts = spark.createDataFrame([(f"h{i}", s, 10) for i, s in enumerate((1, 2, 3, 11, 12, 13), 1)], "addr string, size long, limit long")
    plan = balance.transfers(hosts)
    assert sorted(tuple(r) for r in plan.collect()) == [(1, "h6", "h1", 8), (2, "h5", "h2", 7), (3, "h4", "h3", 6)]
    assert balance.transfers(hosts, plan).count() == 0
    updated = balance.upsert(hosts, spark.createDataFrame([("h6", 5, 10, 1), ("h7", 99, 10, 1), ("h7", 30, 10, 2)], "addr string, size long, limit long, seq int"))
    assert [(r["from_addr"], r["to_addr"]) for r in balance.transfers(updated, next_id=4).orderBy("id").collect()] == [("h7", "h1"), ("h5", "h2"), ("h4", "h3")]
    empty = spark.createDataFrame([("a", 0, 0), ("b", 3, 0)], "addr string, size long, limit long")
    assert balance.transfers(empty).count() == 0
    chunks = spark.createDataFrame([("a", 0, 50), ("a", H, 5), ("b", H, 20), ("c", 9 * H, 1)], "source string, hour long, size long")
    assert tuple(balance.oldest_chunk(chunks, 100, 9 * H).first()) == ("a", 0, 50)
    assert tuple(balance.oldest_chunk(chunks, 50, 9 * H).first()) == ("b", H, 20)
    assert balance.oldest_chunk(chunks, 20, 9 * H).count() == 0


def test_stats(spark):
    beats = spark.createDataFrame([("a", 1, 5, 10, 1), ("a", 3, 6, 10, 2), ("a", 3, 7, 10, 3), ("b", 2, 1, 0, 4)], "addr string, ts long, size long, limit long, seq long")
    latest = stats.latest(beats)
    assert sorted((r["addr"], r["size"]) for r in latest.collect()) == [("a", 6), ("b", 1)]
    assert [r["addr"] for r in stats.live(latest, 12, 10).collect()] == ["a"]
    total = {r["addr"]: (r["size"], r["limit"], r["pct"]) for r in stats.with_total(latest).collect()}
    assert total == {"a": (6, 10, 60.0), "b": (1, 0, None), "Total": (7, 10, 70.0)}
    assert stats.with_total(latest.where("false")).collect()[0]["pct"] == 0.0


def test_access(spark):
    people = access.users(spark, [("admin", ["admin"], "admin"), ("all", [], ""), ("i", ["instance"], "k")])
    people = access.set_roles(people, "new", ["reader", "nobody"])
    people = access.set_password(access.set_password(people, "new", "pw"), "i", "")
    people = access.delete_user(access.delete_user(people, "admin"), "nobody")
    asked = [("new", "pw", "read", True), ("new", "", "read", False), ("new", "pw", "write", False), ("i", "", "accept", True), ("i", "k", "accept", False),
             ("admin", "admin", "user", True), ("all", "", "read", False), ("ghost", "", "read", False), ("all", "", "unknown", True)]
    got = access.decide(spark, spark.createDataFrame(asked, "user string, password string, action string, want boolean"), people)
    assert got.where("allowed <> want").count() == 0
    assert got.count() == len(asked)


@pytest.mark.parametrize("span", [H, 24 * H])
def test_store(spark, tmp_path, span):
    store = LogStore(spark, str(tmp_path / "s"), span)
    assert store.read(LogQuery(0, 10 * H)).count() == 0
    first = [(h * H + i, i, f"src{h % 3}", "Message Сообщение") for h in range(6) for i in range(1, 4)]
    store.append(log(spark, first))
    store.append(log(spark, [(30 * H, 300, "", "wraps"), (0, 1, "src9", "now")]), now=40 * H)
    assert rows(store.table()) == sorted([*first, (30 * H, 44, "", "wraps"), (40 * H, 1, "src9", "now")])
    assert store.read(LogQuery(0, 3 * H, source="src[01]")).count() == 6
    plan = store.scan(LogQuery(0, 3 * H, source="src0"))._jdf.queryExecution().executedPlan().toString()
    partition = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "span" in partition and "source_key" in partition
    assert {r["source"]: r["entries"] for r in store.size().collect()} == {"src0": 6, "src1": 6, "src2": 6, "": 1, "src9": 1}
    store.truncate(3 * H + 5, "src")
    assert rows(store.table()) == sorted([*[r for r in first if r[0] >= 4 * H], (30 * H, 44, "", "wraps"), (40 * H, 1, "src9", "now")])
    store.delete_chunk("src1", 4 * H)
    store.delete_chunk("src1", 4 * H)
    assert sorted(r["hour"] // H for r in store.coverage().collect()) == [5, 30, 40]


def test_truncation_takes_the_limits_hour(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    store.append(log(spark, [(h * H + 5, 1, "src1", "m") for h in range(1, 33)]))
    store.truncate(17 * H + 5)
    assert store.table().count() == 15


def test_late_entries_of_a_store(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    d = spark.createDataFrame([(1, 10, 0, "a", "x"), (2, 9, 0, "a", "late"), (3, 11, 0, "a", "y")], "seq long, ts long, severity int, source string, message string")
    store.append(d, arrival="seq")
    store.append(d.where("seq < 2").withColumn("ts", F.lit(4).cast("long")), arrival="seq")
    assert [r[0] for r in rows(store.table())] == [10, 11]


def test_transfer(spark, tmp_path):
    a, b = LogStore(spark, str(tmp_path / "a")), LogStore(spark, str(tmp_path / "b"))
    data = [(h * H + i * 60 * 10**9, 1, f"s{k}", "m") for k in range(2) for h in range(1, 3) for i in range(3)]
    a.append(log(spark, data))
    b.append(log(spark, data[:2]))
    hosts = Federation({"a": a, "b": b})
    moved = a.transfer(b, 10**6, now=50 * H)
    assert len(moved) == 4 and a.table().count() == 0
    assert rows(b.table()) == sorted(data)
    b.accept("s0", H, log(spark, data))
    assert rows(hosts.read(LogQuery(0, 100 * H))) == sorted(data)
    assert hosts.read(LogQuery(0, 100 * H), with_addr=True).select("addr").distinct().count() == 1
    got = {r["addr"]: r["size"] for r in hosts.stats({"a": 5}).collect()}
    assert got == {"a": 0, "b": len(data) * (35 + 2 + 1)}
    hosts.truncate(50 * H)
    assert hosts.read(LogQuery(0, 100 * H)).count() == 0
    with pytest.raises(ValueError):
        Federation({}).read(LogQuery(0, 1))


def test_frames(spark, tmp_path):
    (tmp_path / "f").write_bytes(b'{"Sev":1,"Src":"a","Msg":"x"}\0\0{"sev":null,"src":"b","msg":"y"}\0')
    frames = read_frames(spark, str(tmp_path / "f"))
    assert [r["value"] == "" for r in frames.collect()] == [False, True, False]
    assert sorted(tuple(r) for r in parse_entries(frames).collect()) == [(0, "b", "y"), (1, "a", "x")]
    bad = ['{"Sev":"1","Src":"a","Msg":"x"}', '{"Sev":1.5,"Src":"a","Msg":"x"}', '{"Src":"a"}', "[1]", "1", "{", '{"Src":7,"Msg":"x"}']
    assert parse_entries(spark.createDataFrame([(x,) for x in bad], "value string")).count() == 0
    d = spark.createDataFrame([(1, "a"), (2, ""), (3, "b"), (4, "")], "n int, value string")
    assert [r["value"] for r in until_empty(d, "n").collect()] == ["a"]
    assert until_empty(d.where("n = 3"), "n").count() == 1


def test_patterns_that_are_rows(spark):
    entries = log(spark, [(5, 1, "Test", "m"), (6, 1, "tea", "m")])
    schema = "start long, end long, min_severity int, max_severity int, source string"
    asked = lambda *patterns: spark.createDataFrame([(0, 9, 0, 9, p) for p in patterns], schema)
    assert query_table(entries, asked("(", "a++(", "(?=T)", None)).count() == 0
    assert [r[0] for r in rows(query_table(entries, asked("(", "(?i)^te", "^T")))] == [5, 6]
    assert [r[0] for r in rows(query_table(entries, asked("[[:upper:]]")))] == [5]


def test_sizes_are_those_of_stored_messages(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    long = "Long message" * 512
    store.append(log(spark, [(1, 1, "src", long), (2, 1, "src", "x" * 512)]))
    want = 2 * (35 + 3) + len(deflate(long.encode())) + 512
    assert [r["bytes"] for r in store.size().collect()] == [want] and [r["size"] for r in store.chunks().collect()] == [want]
    store.delete_chunk("src", H)
    assert [r["bytes"] for r in store.size().collect()] == [want]


def test_recovery(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "s"))
    data = [(h * H + 1, 1, "a b/c", "m") for h in range(4)] + [(30 * H, 1, "a b/c", "m")]
    store.append(log(spark, data))
    assert store.recover() == 0
    # the second step of a rewrite fails: the copy stays, and takes the partition's place later
    with monkeypatch.context() as m:
        m.setattr(LogStore, "_write", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.delete_chunk("a b/c", 2 * H)
    assert rows(store.table()) == sorted(data)
    assert LogStore(spark, store.path).recover() == 1
    assert rows(store.table()) == sorted(r for r in data if r[0] // H != 2)
    # the first step fails: what there is of the copy goes
    (tmp_path / "s.staged" / "x" / "start=0" / "key=00").mkdir(parents=True)
    assert store.recover() == 0 and not (tmp_path / "s.staged").exists()
    assert rows(store.table()) == sorted(r for r in data if r[0] // H != 2)


def test_chunks_that_move(spark, tmp_path):
    """Against a choice made anew after every move."""
    store = LogStore(spark, str(tmp_path / "s"))
    data = [(h * H + i, 1, f"s{k}", "x" * ((h * 7 + k * 11) % 40)) for k in range(3) for h in range(1, 9) for i in range(1 + (h + k) % 3)]
    store.append(log(spark, data))
    sizes = {(r["source"], r["hour"]): r["size"] for r in store.chunks().collect()}
    for budget in (0, 60, 150, 400, 10**6):
        left, chunks, want = budget, dict(sizes), []
        while left > 0:
            first = {s: min(h for t, h in chunks if t == s) for s in {s for s, _ in chunks}}
            fits = sorted((h, s) for s, h in first.items() if h < 8 * H and chunks[s, h] < left)
            if not fits:
                break
            h, s = fits[0]
            want.append((s, h, chunks[s, h]))
            left -= chunks.pop((s, h))
        assert list(store.next_chunks(budget, 8 * H + 5)) == want
    with pytest.raises(StopIteration):
        next(store.next_chunks(0, 8 * H))


def test_service(spark, tmp_path):
    admin, op = ("admin", "admin"), ("op", "key")
    people = access.users(spark, [("admin", ["admin"], "admin"), ("op", ["instance"], "key"), ("all", [], "")])
    logs = {a: Service(spark, LogStore(spark, str(tmp_path / a)), people, 1000) for a in "ab"}
    hub = Service(spark, Federation({a: s.logs for a, s in logs.items()}), people, {"a": 1000, "b": 500})
    data = [(h * H + 5, 3, f"s{h % 2}", "Long message" * (60 * (h % 2) + 1)) for h in range(1, 7)]
    logs["a"].write(op, log(spark, data))
    for call in (lambda: logs["a"].write(admin, log(spark, data)), lambda: hub.read(("all", ""), LogQuery(0, 9 * H)), lambda: hub.user(op[:1] + ("no",), "x"), lambda: hub.stat(("ghost", ""))):
        with pytest.raises(Refused):
            call()
    with pytest.raises(TypeError):
        hub.write(op, log(spark, data))
    sent = logs["a"].internal_read(op, LogQuery(0, 9 * H))
    assert {r["Enc"] for r in sent.collect()} == {0, 1} and rows(from_internal(sent)) == sorted(data)
    assert logs["b"].accept(op, "s1", H, sent) and rows(logs["b"].logs.table()) == [data[0]]
    assert [(r["addr"], r["limit"]) for r in hub.stat(admin).orderBy("addr").collect()] == [("a", 1000), ("b", 500)]
    assert [(r["addr"], r["limit"]) for r in logs["b"].stat(admin).collect()] == [("", 1000)]
    moved = logs["a"].transfer(op, 7, logs["b"], 10**6, op, now=100 * H)
    assert len(moved) == 6 and logs["a"].heartbeat("a", 1).first()["last_transfer_id"] == 7
    assert [r["ts"] for r in hub.read(admin, LogQuery(0, 9 * H)).collect()] == [r[0] for r in data]
    for zero in ("0", 0, "0s"):
        with pytest.raises(ValueError):
            hub.truncate(admin, zero)
    assert hub.truncate(admin, "-1h", " s0 ,nothing", now=5 * H) == 4 * H
    assert rows(hub.read(admin, LogQuery(0, 9 * H))) == sorted(r for r in data if r[2] == "s1" or r[0] > 5 * H)
    hub.user(admin, "new", ["reader"], "pw")
    hub.password(("new", "pw"), "other")
    assert hub.read(("new", "other"), LogQuery(0, 9 * H)).count() == 4
    hub.user(admin, "new", delete=True)
    with pytest.raises(Refused):
        hub.read(("new", "other"), LogQuery(0, 9 * H))


def test_files_of_entries(spark, tmp_path):
    (tmp_path / "lines").write_text('{"Sev":1,"Src":"a","Msg":"x"}\n\nno\n{"src":"b","msg":"y"}\n')
    assert sorted(tuple(r) for r in read_entries(spark, str(tmp_path / "lines")).collect()) == [(0, "b", "y"), (1, "a", "x")]


def test_planner(spark):
    """A transfer runs until its giver reports it; ids go on."""
    beat = lambda a, s, m, last, live=True: Row(addr=a, size=s, limit=m, last_transfer_id=last, live=live)
    p = Planner()
    p.hear([beat(f"h{i}", s, 10, 0) for i, s in enumerate((1, 2, 3, 11, 12, 13), 1)])
    assert [tuple(r) for r in p.plan(spark).collect()] == [(1, "h6", "h1", 8), (2, "h5", "h2", 7), (3, "h4", "h3", 6)]
    p.hear([beat("h6", 30, 10, 0), beat("h1", 0, 10, 0)])
    assert p.plan(spark).count() == 0
    p.hear([beat("h5", 40, 10, 2)])
    assert [tuple(r) for r in p.plan(spark).collect()] == [(4, "h5", "h2", 8)]
    p.hear([beat("h3", 1, 10, 0, live=False), beat("h4", 50, 10, 3)])
    assert p.plan(spark).count() == 0 and set(p.running) == {1, 4}
