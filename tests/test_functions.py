"""Time, patterns, codecs, text."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import codec, text, timing
from tidelog.functions.patterns import matches, to_java
from tidelog.schema import HOUR_NS


@pytest.mark.parametrize(
    ("written", "ns"),
    [("300ms", 3 * 10**8), ("-1.5h", -5_400 * 10**9), ("2h45m", 9_900 * 10**9), ("1us", 1000), ("1µs", 1000), ("0", 0), ("+5s", 5 * 10**9), (".5s", 5 * 10**8)],
)
def test_durations(written, ns):
    assert timing.parse_duration(written) == ns


@pytest.mark.parametrize("bad", ["", "5", "h", "1d", "1h 2m", "-"])
def test_bad_durations(bad):
    with pytest.raises(ValueError):
        timing.parse_duration(bad)


def test_interval():
    assert timing.interval(100, -30) == (70, 100)
    assert timing.interval(100, 30) == (100, 130)
    assert timing.parse_base("1970-01-01 01:00:00") == HOUR_NS


def test_layouts():
    assert timing.layout_pattern("2006-01-02 15:04:05") == "yyyy-MM-dd HH:mm:ss"
    assert timing.layout_pattern("Jan 02 at 03:04PM") == "MMM dd' at 'hh:mma"
    assert timing.layout_pattern("15:04:05.000") == "HH:mm:ss.SSS"


def test_hours(spark):
    rows = [(0,), (-1,), (HOUR_NS,), (HOUR_NS - 1,), (1_704_067_200_123_456_789,)]
    got = spark.createDataFrame(rows, "ts long").select("ts", timing.hour_floor(F.col("ts")).alias("h"), timing.hour_name(F.col("ts")).alias("n")).collect()
    assert {r["ts"]: r["h"] for r in got} == {t: t - t % HOUR_NS for (t,) in rows}
    assert {r["ts"]: r["n"] for r in got}[-1] == "1969.12.31.23"
    span = spark.createDataFrame([("1970.01.01.01",), ("rubbish",)], "n string").select("n", timing.hour_range(F.col("n")).alias("r")).collect()
    assert {r["n"]: tuple(r["r"]) for r in span} == {"1970.01.01.01": (HOUR_NS, 2 * HOUR_NS - 1), "rubbish": (-(1 << 63), (1 << 63) - 1)}


def test_patterns(spark):
    cases = [
        ("[[:alpha:]]", ":", False), ("a$", "a\n", False), ("a.b", "a\rb", True), ("(?P<n>a)", "a", True), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False),
        (r"\pL", "é", True), ("(?i)ABC", "xabcx", True), ("x{,2}", "x{,2}", True), ("[a&&b]", "&", True), (r"\s", "\x0b", False), ("[[]", "[", True),
        (r"(?m)^b$", "a\nb\nc", True), ("src.", "src1", True), ("", "", True), (r"\p{Greek}", "α", True), (r"\101", "A", True), ("^$", "", True), ("[^[:space:]]", " ", False),
    ]
    for pattern, value, want in cases:
        got = spark.createDataFrame([(value,)], "s string").select(matches(F.col("s"), pattern).alias("m")).first()["m"]
        assert got is want, (pattern, value)


@pytest.mark.parametrize("bad", ["a(?=b)", "a++", r"(a)\1", r"\Z", "(", ")", "a**", "[", "[a", "x{1001}", r"\8", "(?<!a)", "a{2}{3}", "*", r"\C", "(?>a)", "[[:nope:]]"])
def test_rejected_patterns(bad):
    assert to_java(bad) is None


def test_codec(spark):
    rows = [("a" * 512,), ("a" * 513,), ("Long message" * 512,), ("",), ("é" * 257,), (None,)]
    d = spark.createDataFrame(rows, "m string").withColumn("e", codec.encoding(F.col("m"))).withColumn("s", codec.encode(F.col("m")))
    d = d.withColumn("t", codec.to_transport(F.col("s"), F.col("e")))
    got = d.select("m", "e", codec.decode(codec.from_transport(F.col("t"), F.col("e")), F.col("e")).alias("b")).collect()
    assert all(r["m"] == r["b"] for r in got)
    assert [r["e"] for r in got] == [0, 1, 1, 0, 1, 0]
    broken = spark.createDataFrame([("%%%", 1)], "t string, e int").select(codec.from_transport(F.col("t"), F.col("e")).alias("b")).first()["b"]
    assert bytes(broken) == b""


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000))
def test_deflate_round_trip(raw):
    assert codec.inflate(codec.deflate(raw)) == raw


def test_source_keys(spark):
    names = ["", "a", "a/b=c d", "Quelle ü", "~~~???", "0"]
    got = spark.createDataFrame([(n,) for n in names], "s string").select("s", codec.source_key(F.col("s")).alias("k")).withColumn("b", codec.source_of(F.col("k"))).collect()
    assert all(r["s"] == r["b"] and r["k"].startswith("s_") and re.fullmatch(r"[\w=-]+", r["k"]) for r in got)


def test_sizes_and_lists(spark):
    got = spark.createDataFrame([(1023,), (1024,), (1 << 20,), (5 * (1 << 20) + 7,)], "n long").select(text.format_size(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in got] == ["1023b", "1Kb", "1Mb", "5Mb"]
    assert text.split_list("a, b ,c") == ["a", "b", "c"]
    assert spark.range(1).select(text.percent_full(F.lit(1), F.lit(0)).alias("p")).first()["p"] is None


@given(st.binary(min_size=1, max_size=30_000), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_damage_ends_a_stream(raw, at):
    """What comes before the damage stays."""
    stored = codec.deflate(raw)
    assert codec.inflate(stored) == raw
    at %= len(stored)
    assert raw.startswith(codec.inflate(stored[:at]))
    whole = codec.deflate(raw) + codec.deflate(raw)
    assert codec.inflate(whole + b"\xff" * 20)[: 2 * len(raw)] == raw + raw


def test_file_names(spark):
    d = spark.createDataFrame([("a/b ü",), ("",)], "s string")
    got = d.select("s", codec.file_id(F.col("s"), F.lit("2024.01.01.05")).alias("id")).select("s", "id", codec.source_of_file(F.col("id")).alias("back"), codec.hour_of_file(F.col("id")).alias("h"))
    assert all(r["back"] == r["s"] and r["h"] == "2024.01.01.05" and r["id"].count("/") == 1 for r in got.collect())


def test_usage(spark):
    d = spark.createDataFrame([("a", 1536, 4096), ("b", 7, 0), ("c", 3 << 20, 2 << 20)], "addr string, size long, limit long")
    assert [r[0] for r in d.select(text.format_usage(F.col("addr"), F.col("size"), F.col("limit"))).collect()] == ["a 1Kb/4Kb 37.50%", "b 7b/0b -", "c 3Mb/2Mb 150.00%"]
