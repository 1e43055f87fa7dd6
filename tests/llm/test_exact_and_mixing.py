"""Exact dedup and mixing against plain versions."""

import hashlib
import math
import re
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.mixing import first_words, mix, mixed_rows, targets

SCHEMA = "doc_id long, text string, source string, keep_id string, size long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        seen = False
        for m in sorted(members, key=lambda m: (m[0], m[1], m[2] or 0)):
            kept = m[2] == best[2] and not seen
            seen |= kept
            out.append((m[2], best[2], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [
    (1, "a b", "s"), (2, "ab ", "s"), (3, "a  b", "t"), (3, "a  b", "t"), (4, None, None), (5, "", "s"), (6, " \t\n", "s"), (-7, "ab", "s"), (8, "x y", "s"), (9, "xy", "s"),
    (None, "lonely", "s"), (None, "a\nb ", "s"), (10, "é" * 5000, "s"), (11, "é" * 2500 + "\n" + "é" * 2500, "s"), (12, "tie", "s"), (13, "t ie", "s"), (14, "ti e", "s"),
]


def test_dedup(spark):
    d = docs(spark, CASES)
    got = exact_dedup(d)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_dedup(CASES)


def test_dedup_tells_contents_apart(spark):
    """A digest with three values: contents decide."""
    d = docs(spark, CASES)
    got = exact_dedup(d, digest=lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3)), salts=5)
    want = [r[:4] for r in plain_dedup(CASES)]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(want, key=str)


def test_dedup_carries_rows(spark):
    d = docs(spark, CASES)
    got = exact_dedup(d, carry=True)
    assert set(got.columns) == {"doc_id", "keep_id", "group_size", "kept", "text_sha256", "text", "source", "size"}
    assert got.where("kept").count() == len({r[4] for r in plain_dedup(CASES)})
    assert got.where("doc_id = 8").first()["text"] == "x y"


def test_dedup_of_nothing_and_of_one_group(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    many = exact_dedup(docs(spark, [(i, "same", "s") for i in range(300)]))
    assert many.where("kept").collect()[0]["doc_id"] == 0 and many.where("group_size = 300").count() == 300


def test_dedup_keeps_clashing_names_apart(spark):
    rows = [(1, "a b", "own", 1, "own"), (2, "ab", "own", 2, "own"), (2, "ab", "own", 2, "own"), (None, "c", "own", 3, "own")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _id string, `x.y` int, _norm string")
    for digest in ({}, {"digest": lambda c: F.length(c).cast("string")}):  # with a weak one, contents share digests
        got = exact_dedup(d, carry=True, **digest)
        assert {"_id", "x.y", "_norm"} <= set(got.columns) and {(r["_id"], r["_norm"]) for r in got.collect()} == {("own", "own")}
        assert sorted((r["x.y"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()) == [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, None, 1, True)]


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """By repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap, got, left, free = {s: most * sizes[s] for s in names}, dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        part = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            got[s] += part * w[s]
            if got[s] >= cap[s]:
                left += got[s] - cap[s]
                got[s] = cap[s]
                free.discard(s)
    return got


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "Z", "é", "\U0001f600", "", None]), st.integers(0, 1000), min_size=1))
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def corpus():
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7 + 1)) + (" ###" if i % 3 == 0 else ""), "abc"[i % 3]) for i in range(200)]
    return [*rows, (500, None, "a"), (501, "one two", None), (502, "", "b"), (503, "only  one\nhere", "lone"), (7, rows[7][1], "b")]


def test_mix(spark):
    d = docs(spark, corpus())
    got = mix(d, buckets=8).collect()
    assert len(got) == len(corpus())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(d.repartition(3), buckets=8).collect()), key=str)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    want = plain_targets({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert math.isclose(rs[0]["target"], want[s], abs_tol=1e-6)
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= 0.5
        assert all(r["epochs"] * r["size"] <= r["taken"] <= 2 * r["size"] for r in rs)
        assert sum(0 < r["part"] < r["size"] for r in rs) <= 1
    assert mix(docs(spark, [])).count() == 0


def test_mixed_rows(spark):
    d = docs(spark, corpus())
    plan, rows = mix(d).collect(), mixed_rows(d)
    assert rows.columns == d.columns
    words = sum(len((r["text"] or "").split()) for r in rows.collect())
    assert words == sum(r["taken"] for r in plan)
    one = spark.createDataFrame([("  a b\n\tc  d ",)], "t string")
    assert [one.select(first_words(F.col("t"), F.lit(n)).alias("x")).first()["x"] for n in (1, 3)] == ["  a", "  a b\n\tc"]


def test_mixed_rows_with_repeats_and_clashes(spark):
    """A repeated id with different texts, sources or other columns: every row takes its own share."""
    rows = [(i, f"t{i} a b c", "s", "o", 1) for i in range(30)] + [(5, "other text of five", "s", "o", 1), (5, "t5 a b c", "s", "p", 2), (5, "t5 a b c", "z", "q", 3), (None, "n n n", None, None, 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string, `_id.x` int").withColumn("size", F.lit("own")).withColumn("_hash", F.lit("own"))
    plan, got = mix(d).collect(), mixed_rows(d)
    assert got.schema.names == d.schema.names and {(r["size"], r["_hash"]) for r in got.collect()} == {("own", "own")}
    taken = defaultdict(int)
    for r in got.collect():
        taken[r["doc_id"], r["source"]] += len(r["text"].split())
    want = defaultdict(int)
    for r in plan:
        want[r["doc_id"], r["source"]] += r["taken"]
    assert taken == {k: v for k, v in want.items() if v}
    assert sorted(map(str, got.collect())) == sorted(map(str, mixed_rows(d.repartition(3)).collect()))
    assert mixed_rows(d.where("false")).count() == 0
