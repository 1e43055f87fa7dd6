"""Archives: round trips, damage and what is salvaged."""

import base64
import hashlib
import random
import time
import zlib

import pytest

from tidelog.llm.warc import digest, parse, read_archives, record, salvage, write_archives

PAGES = [(3, "http://a/\n", "same"), (1, "http://b", "same"), (2, None, None), (9, "u", ""), (4, "u", "é\r\n\r\nWARC/1.1\r\nnot a record" * 3), (5, "u", "x" * 50_000), (7, "u", "ab")]
SCHEMA = "page_id long, url string, html string, payload int"


def bare(record_id):
    """Without what keeps repeated ids apart."""
    return record_id and record_id.partition(".")[0]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], SCHEMA).repartition(2)
    write_archives(pages, str(tmp_path / "w"), archive_bytes=2000, compress=compress)
    got = {bare(r["record_id"]): r for r in read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(PAGES)
    for i, url, html in PAGES:
        raw = (html or "").encode()
        r = got[f"urn:page:{i}"]
        first = min(p[0] for p in PAGES if (p[2] or "") == (html or ""))
        assert r["gap_reason"] is None
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], bare(r["refers_to"])) == (("response", None) if i == first else ("revisit", f"urn:page:{first}"))
        assert r["payload"] is None if i != first else bytes(r["payload"]) == raw
        assert r["target_uri"] == (url.replace("\n", "%0A") if url else None)


def test_least_size(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc", 0), (2, "u", "abc", 0), (3, "u", "abcdef", 0), (4, "u", "abcdef", 0)], SCHEMA)
    write_archives(pages, str(tmp_path / "w"), least=5)
    got = {bare(r["record_id"])[-1]: r["record_type"] for r in read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_empty(spark, tmp_path):
    write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert read_archives(spark, str(tmp_path / "w")).count() == 0


def archive(compress):
    rng = random.Random(1)
    records = [record(f"urn:{i}", rng.randbytes(rng.randint(0, 3000)), "u") for i in range(12)]
    return [zlib.compress(r, 6, 31) if compress else r for r in records]


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = archive(compress)
    clean = list(salvage(b"".join(parts)))
    assert [x.head["warc-record-id"] for x in clean] == [f"<urn:{i}>" for i in range(12)]
    rng = random.Random(2)
    for _ in range(150):
        hurt, k = list(parts), rng.randrange(12)
        kind = rng.choice(["flip", "cut", "junk", "lead"])
        if kind == "flip":
            at = rng.randrange(len(hurt[k]))
            hurt[k] = hurt[k][:at] + bytes([hurt[k][at] ^ (1 << rng.randrange(8))]) + hurt[k][at + 1 :]
        elif kind == "cut":
            hurt[k] = hurt[k][: rng.randrange(len(hurt[k]))]
        else:
            hurt[k] = b"WARC/1.1\r\n\x1f\x8b\x08junk" + (hurt[k] if kind == "lead" else b"")
        raw = b"".join(hurt)
        found = list(salvage(raw))
        ids = [x.head["warc-record-id"] for x in found if x.head]
        assert set(ids) >= {f"<urn:{i}>" for i in range(12) if i != k or kind == "lead"}
        assert sum(x.length for x in found) == len(raw)
        assert all(x.reason for x in found if x.head is None)
        # a record that comes through is intact, its header's harmless bytes aside
        for x in found:
            if x.head and "warc-block-digest" in x.head and x.head["warc-block-digest"].startswith("sha1:"):
                assert x.head["warc-block-digest"][5:] == digest(x.payload)


def test_folded_header_and_checks():
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nX: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    head, block, end = parse(raw)
    assert head["x"] == "a b" and block == b"hi" and end == len(raw)
    assert [x.reason for x in salvage(raw.replace(b": 2", b": 3"))] == ["block length"]
    assert [x.reason for x in salvage(b"nothing here")] == ["version line"]
    assert list(salvage(b"")) == []


def test_repeats_nulls_and_clashes(spark, tmp_path):
    rows = [(1, "same"), (1, "same"), (2, "same"), (None, "same"), (None, "alone"), (None, "alone"), (5, None), (5, "")]
    schema = "page_id long, html string, _first int, sha int, url string, `a.b` int, `at` struct<`x y`: int>"
    pages = spark.createDataFrame([(i, t, 1, 2, None, 3, (4,)) for i, t in rows], schema)
    write_archives(pages, str(tmp_path / "w"))
    got = read_archives(spark, str(tmp_path / "w")).collect()
    ids = [r["record_id"] for r in got]
    assert len(set(ids)) == len(rows) and all(r["gap_reason"] is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r["payload_digest"], []).append(r)
    for same, least in (("same", "urn:page:1"), ("alone", "urn:page:"), ("", "urn:page:5")):
        mine = by[digest(same.encode())]
        original = [r for r in mine if r["record_type"] == "response"]
        assert [bare(r["record_id"]) for r in original] == [least]
        assert {r["refers_to"] for r in mine if r["record_type"] == "revisit"} == {original[0]["record_id"]}


def test_inside_members():
    records = [record(f"urn:{i}", bytes([65 + i]) * 500, "u") for i in range(4)]
    broken = records[1].replace(b"BBBB", b"BxBB", 1)
    tail = zlib.compress(record("urn:tail", b"t"), 6, 31)
    whole = zlib.compress(b"".join([records[0], broken, *records[2:]]), 6, 31)
    found = list(salvage(whole + tail))
    assert [x.head and x.head["warc-record-id"] for x in found] == ["<urn:0>", None, "<urn:2>", "<urn:3>", "<urn:tail>"]
    assert found[1].reason == "block digest" and found[1].payload == broken
    assert sum(x.length for x in found) == len(whole + tail)
    # a checksum that fails, and a member that is cut: what can be proven comes through, and the bytes are logged
    noise = random.Random(3).randbytes(20_000)
    member = zlib.compress(b"".join(records) + record("urn:noise", noise), 6, 31)
    for hurt in (member[:-8] + b"12345678", member[:-3000]):
        found = list(salvage(hurt + tail))
        ids = [x.head["warc-record-id"] for x in found if x.head]
        assert ids[:4] == [f"<urn:{i}>" for i in range(4)] and ids[-1] == "<urn:tail>"
        assert sum(x.length for x in found) == len(hurt + tail)
        assert [x.reason for x in found if x.head is None and x.length]


def test_reading_is_linear():
    rng = random.Random(5)
    made = b"".join(zlib.compress(record(f"urn:{i}", rng.randbytes(3000)), 1, 31) for i in range(300))

    def seconds(times):
        raw, best = made * times, 1e9
        for _ in range(3):
            began = time.process_time()
            assert sum(1 for x in salvage(raw) if x.head) == 300 * times
            best = min(best, time.process_time() - began)
        return best

    assert seconds(32) < 3 * 32 * max(seconds(1), 1e-3)
