"""Packing and token counts: exact round trips against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm.packing import SumOfSquares, pack
from tidelog.llm.queries import op1_packing
from tidelog.llm.token_counts import CountTree, count_with_edits, pre_tokens, revision
from tidelog.llm.tokens import encoder, vocabulary_path

PARTS = ["a", "b", " ", "  ", "\n", "\n\n", " \t", "1", "22", "'s", "'", "!", "é", "ß", " ", "x'll", "中", "word", "\x1f", "\x85", "　", "Foo", "...", "🙂", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def text(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_ids(reference):
    rng = random.Random(1)
    tool = encoder(vocabulary_path())
    for _ in range(400):
        t = text(rng, rng.randint(0, 200))
        assert np.frombuffer(tool.encode(t), "<u4").tolist() == reference(t)


def test_added_tokens(spark, tmp_path):
    """The registered query's ids are those of the tokenizer as it comes."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    texts = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a<|endoftext|", *("".join(rng.choice([*PARTS, "<|endoftext|>"]) for _ in range(rng.randint(0, 120))) for _ in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op1_packing(spark, str(tmp_path)).where("start = 0 and length = doc_tokens").collect()}
    assert len(got) > 50
    for i, r in got.items():
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_level_choice():
    """The level that makes the sum of squares smallest, by trying all."""
    rng, packer, size = random.Random(2), SumOfSquares(16), 16
    levels = defaultdict(int)
    for _ in range(500):
        n = rng.randint(1, size - 1)
        cost = {}
        for h in [0, *[k for k, c in levels.items() if c and k + n <= size]]:
            after = dict(levels)
            if h:
                after[h] -= 1
            if h + n < size:
                after[h + n] = after.get(h + n, 0) + 1
            cost[h] = sum(c * c for c in after.values())
        packer.place((0, 0, n, n, b""))
        after = {k: len(v) for k, v in packer.windows.items() if v}
        assert sum(c * c for c in after.values()) == min(cost.values())
        levels = defaultdict(int, after)


def test_pack(spark, reference):
    rng = random.Random(3)
    rows = [(i, text(rng, rng.randint(0, 120)), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "word " * 3000, "x"), (None, "null id", "x"), (5, "again", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(2)
    got = pack(d, size=256).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids").collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for i, t, _ in rows:
        want[i].append([*reference(t or ""), 1])
    assert sorted((str(k[0]), k[1]) for k in by_doc) == sorted((str(i), len(x)) for i, xs in want.items() for x in xs)
    for (i, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == next(x for x in want[i] if len(x) == n)
        assert [r["start"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
    short = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces[:-1]]]).tolist()
        total = sum(r["length"] for r in pieces)
        assert total <= 256
        short += total < 256
    assert short <= 2  # one for each task
    assert pack(d.where("false")).count() == 0


def test_small_open_limit(spark):
    d = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(300)], "doc_id long, text string").coalesce(1)
    got = pack(d, size=64, most_open=2)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 64").count() == 0
    assert got.agg(F.sum("length")).first()[0] == pack(d, size=64).agg(F.sum("length")).first()[0]


def test_edits(reference):
    rng = random.Random(4)
    tool = pre_tokens(vocabulary_path())
    for _ in range(300):
        t = text(rng, rng.randint(0, 300))
        tree = CountTree(t, tool)
        for _ in range(4):
            a = rng.randint(0, len(t) + 2)
            b, new = a + rng.choice([0, 0, 1, 3, 60]), text(rng, rng.choice([0, 1, 4, 50]))
            tree.edit(a, b, new)
            a = min(a, len(t))
            t = t[:a] + new + t[max(a, min(b, len(t))) :]
            assert tree.text() == t and tree.n_chars == len(t) and tree.n_tokens == len(reference(t))


def test_edits_touch_little():
    tree = CountTree("some words and more of them. " * 5000, pre_tokens(vocabulary_path()))
    tree.edit(70_000, 70_004, "other")
    assert 0 < tree.encoded < 10


def test_counts(spark, reference):
    rows = [(1, "hello  world\n", "a"), (2, None, "b"), (3, "", "c"), (None, "x y", "d"), (1, "hello  world\n", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    e = d.withColumn("edits", F.when(F.col("doc_id") == 1, F.expr("array(named_struct('start', 0L, 'stop', 5L, 'replacement', 'good bye'), null)")))
    got = sorted(map(tuple, count_with_edits(e, "edits").drop("n_encoded").collect()), key=str)
    bye = len(reference("good bye  world\n"))
    assert got == sorted([(1, 4, len(reference(rows[0][1])), 1, bye, 16)] * 2 + [(2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (None, 2, 2, 0, 2, 3)], key=str)
    assert count_with_edits(revision(d.where("false")), "edits").count() == 0
    assert count_with_edits(revision(d), "edits").where("n_edits = 3").count() == 5
