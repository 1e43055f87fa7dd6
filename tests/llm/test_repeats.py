"""Near copies, repeated byte strings, components and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm.graph import components
from tidelog.llm.ngram_join import _trie_stars, nearest, ngrams, prefix_length, similar, without_near_copies
from tidelog.llm.shingles import shingles
from tidelog.llm import suffix_dedup
from tidelog.llm.suffix_dedup import anchors, intervals, is_repeat, maximal_repeats, reaches, remove_repeats, repeat_groups


def plain_components(edges):
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingle_hashes():
    texts = ["a b c d e f", " a  b\nc d e", "a b", "", " \t", "b a", "x" * 5000 + " y", "é ü a b c d e"]
    hashes, at, words = shingles(texts, 5)
    sets = [set(hashes[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    want = [ngrams(t.encode().split(), 5) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    assert words.tolist() == [len(t.encode().split()) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_prefix_length():
    assert prefix_length(0.8, 16, 6, 0.9995) == 4
    assert prefix_length(0.8, 16, 6, 0.99) == 6


def test_nearest():
    assert [nearest(g, 0.8) for g in (1, 2, 3, 4, 5, 9, 64, 1000)] == [1.0, 1.0, 1.0, 0.8, 0.8, 0.8, 0.8, 0.8]
    assert nearest(2, 0.6) == 2 / 3 and nearest(3, 0.7) == 0.75


def test_trie_meets_what_shares_a_prefix():
    """With every signature likely, the stars join exactly what meets below the prefix that either text asks for."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(2, 25))
        labels = rng.integers(0, 2, (n, 5)).astype(np.uint32)
        labels = labels[np.lexsort(labels.T[::-1])]
        stops = rng.choice([2, 3, 5], n)
        got = plain_components([*_trie_stars(labels, np.zeros((n, 4), np.uint32), stops, 4), *((i, i) for i in range(n))])
        shared = lambda i, j, own=labels: int((own[i] == own[j]).cumprod().sum())
        want = plain_components([(i, j) for i in range(n) for j in range(i + 1) if i == j or shared(i, j) >= max(stops[i], stops[j])])
        same = lambda root: {frozenset(i for i in root if root[i] == r) for r in root.values()}
        assert same(got) == same(want)


def near_corpus():
    rng = random.Random(2)
    rows = []
    for g in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 3, 8])):
                own[rng.randrange(len(own))] = f"edit{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own), g))
    return [*rows, (500, "a b", 0), (501, "a\nb ", 0), (502, None, 0), (503, "", 0), (504, " ", 0), (None, rows[0][1], 0), (3, rows[3][1], 0), (600, "very long " * 4000, 0), (601, "very long " * 4001, 0)]


def plain_links(rows):
    sets = [ngrams((t or "").encode().split(), 5) for _, t, _ in rows]
    links, edges = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                edges.append((j, i))
    root = plain_components(edges)
    ids = defaultdict(list)
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            ids[root.get(i, i)].append(k)
    return [(k, min(ids[root.get(i, i)], default=None) if sets[i] else k, links[i]) for i, (k, _, _) in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"block": 3, "block_ngrams": 150}])
def test_similar(spark, options):
    rows = near_corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = similar(d, **options)
    assert sorted(map(str, got.select("doc_id", "class_id", "n_links").collect())) == sorted(
        f"Row(doc_id={a}, class_id={b}, n_links={c})" for a, b, c in plain_links(rows)
    )


def test_rows_that_stay(spark):
    """Rows are chosen, not ids: repeated ids, texts without words, clashing names."""
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (None, b + " x"), (7, None), (7, ""), (8, " "), (None, "alone and by itself here")]
    d = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], "doc_id long, text string, row string, `_c0.x` string")
    got = without_near_copies(d)
    assert got.columns == d.columns and got.schema == d.schema
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, [(1, a), (2, b), (7, None), (7, ""), (8, " "), (None, rows[-1][1])]))
    assert without_near_copies(d.where("false")).count() == 0


def test_recall_at_the_threshold(spark):
    """600 pairs of similarity 0.802 (89 of 111 n-grams): at least 0.9 of them, by design 0.9995, are linked."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-11] + [f"v{rng.randint(0, 10**9)}" for _ in range(11)]))]
    got = similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("doc_id % 2 = 1 and class_id = doc_id - 1 and n_links = 1").count() >= 598
    assert got.where("class_id <> doc_id - doc_id % 2").count() <= 2


def test_similar_of_nothing(spark):
    assert similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intervals():
    assert sorted(intervals([2, 5, 5, 0, 3])) == [(0, 0, 5), (2, 0, 3), (3, 4, 5), (5, 1, 3)]
    assert list(intervals([])) == []


@pytest.mark.parametrize("segment", [1 << 20, 37])
def test_anchors_cover_every_string(monkeypatch, segment):
    """Every string of 40 bytes, or 9 words at least 7 of them whole, holds an anchor with its gram, the same wherever it stands."""
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", segment)
    rng = random.Random(3)
    raws = [bytes(rng.choices(b"abcdefgh   ", k=n)) for n in (16, 17, 39, 40, 41, 700, 0)] + [b"ab" * 100, b" " * 90, b"x" * 300 + b" a b c d e f g h i j k " + b"y" * 300 + b" z", b"a " * 200]
    raws += [raws[5][100:400], b"q" + raws[9][250:400]]
    places = defaultdict(set)
    for i, at, hashes in anchors(raws, 40, 9, 10, 3):
        places[i] |= set(zip(at.tolist(), hashes.tolist(), strict=True))
    shared = defaultdict(list)
    for i, raw in enumerate(raws):
        for start in range(len(raw)):
            for stop in range(start + 17, len(raw) + 1):
                if is_repeat(b"", raw[start:stop], 40, 9):
                    # the shortest that counts from here; longer ones hold its anchors
                    own = {(p - start, g) for p, g in places[i] if start <= p < stop}
                    assert own
                    shared[raw[start:stop]].append(own)
                    break
    for sets in shared.values():
        assert set.intersection(*sets)


def repeat_corpus():
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, period = some(60), "xyz" * 50
    rows = [(i, some(rng.randint(0, 90)) + (passage[rng.randint(0, 9) : rng.randint(35, 60)] if i % 2 else "") + some(rng.randint(0, 60)), "s") for i in range(60)]
    rows += [(100, period, "s"), (101, "ab" + period + "q", "s"), (102, rows[5][1], "s"), (103, rows[5][1], "s"), (104, None, "s"), (105, "", "s"), (6, rows[6][1], "s"), (None, rows[7][1] + "!", "s")]
    rows += [(200 + i, some(20) + f"{i} the a of to in is at {i}" + some(15), "s") for i in range(8)] + [(300 + i, "so it is as of an ox", "s") for i in range(2)]
    return [*rows, (106, some(20) + rows[9][1] + rows[9][1], "s")]


def plain_repeats(rows, length):
    raws = [(t or "").encode() for _, t, _ in rows]
    count = defaultdict(int)
    for raw in raws:
        for i in range(len(raw) - length + 1):
            count[raw[i : i + length]] += 1
    out = []
    for (k, _, _), raw in zip(rows, raws, strict=True):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate([[0], gone[: len(raw)].astype(int)])) == 1).sum()) if raw else 0
        out.append((k, len(raw), int(gone[: len(raw)].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain_passages(rows, length, words):
    """Runs of bytes covered by strings that start elsewhere too and have so many bytes or words."""
    raws = [(t or "").encode() for _, t, _ in rows]
    suffixes = sorted((raw[i:], k, i) for k, raw in enumerate(raws) for i in range(len(raw)))
    same = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    near = [0, *(same(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)), 0]
    gone = [np.zeros(len(raw) + 2, int) for raw in raws]
    for at, (suffix, k, i) in enumerate(suffixes):
        longest = max(near[at], near[at + 1])
        if longest >= length or len(suffix[:longest].split()) >= words:
            gone[k][i + 1 : i + 1 + longest] = 1
    return sorted(((rows[k][0], int((np.diff(g) == 1).sum())) for k, g in enumerate(gone)), key=str)


@pytest.mark.parametrize("options", [{}, {"gram": 40}, {"most": 1}, {"most": 3, "drawn": 1}, {"gram_words": 1, "most": 6}])
def test_remove_repeats(spark, monkeypatch, options):
    options = dict(options)
    monkeypatch.setattr(suffix_dedup, "_DRAWN", options.pop("drawn", 40))  # with few, some groups get no path in a round
    rows = repeat_corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumns({"g": F.lit(1), "a": F.lit("x"), "copies": F.lit(2)})
    got = remove_repeats(d, length=40, **{"gram": 10, "words": 7, "gram_words": 3, **options}).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == plain_repeats(rows, 40)
    assert sorted(((r["doc_id"], r["n_passages"]) for r in got), key=str) == plain_passages(rows, 40, 7)
    assert any(r["n_passages"] and not r["n_removed"] for r in got)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def plain_groups(raws, length, words):
    """Maximal repeats with all their places: strings whose places differ on the left and on the right."""
    count = defaultdict(set)
    for k, raw in enumerate(raws):
        for i in range(len(raw)):
            for j in range(i + 1, len(raw) + 1):
                count[raw[i:j]].add((k, i))
    out = set()
    for s, places in count.items():
        before = {raws[k][i - 1 : i] if i else (k, i) for k, i in places}
        behind = {raws[k][i + len(s) : i + len(s) + 1] or (k, i) for k, i in places}
        if len(places) > 1 and len(before) > 1 and len(behind) > 1 and is_repeat(b"", s, length, words):
            out |= {(hashlib.sha256(s).hexdigest(), len(s), k, i) for k, i in places}
    return out


def test_reaches_are_those_of_maximal_repeats():
    rng = random.Random(7)
    for _ in range(300):
        base = [rng.choice(b"abc  ") for _ in range(40)]

        def context(base=base):
            own = [x if rng.random() < 0.93 else rng.choice(b"abc ") for x in base]
            return bytes(own[: rng.randint(0, 20)]), b"ab" + bytes(own[20 : rng.randint(20, 40)])

        kinds = sorted({context() for _ in range(rng.randint(1, 12))}, key=lambda c: (c[1], c[0]))
        several = [rng.random() < 0.2 for _ in kinds]
        want = np.zeros((2, len(kinds), 2), int)
        for e, d, who in maximal_repeats(kinds, several, 20, 6):
            want[: 2 if e + d >= 20 else 1, who] = np.maximum(want[: 2 if e + d >= 20 else 1, who], (e, d))
        assert (reaches(kinds, several, 20, 6) == want).all()


def test_repeat_groups(spark):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcde  ") for _ in range(n))
    shared = some(34)
    texts = [some(rng.randint(1, 9)) + shared[rng.choice([0, 4]) : rng.choice([30, 34])] + some(rng.randint(1, 9)) for _ in range(14)] + [some(70), some(3)]
    rows = list(enumerate(texts))
    got = repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), length=60, words=6, gram=6, gram_words=2)
    want = plain_groups([t.encode() for t in texts], 60, 6)
    assert len({w[0] for w in want}) > 3
    assert {tuple(r) for r in got.select("repeat", "n_bytes", "doc_id", "start").collect()} == want
    # taken apart along paths, every occurrence is still found, under repeats that are whole strings
    split = repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), length=60, words=6, gram=6, gram_words=2, most=2).collect()
    assert {r["doc_id"] for r in split} == {w[2] for w in want}
    assert all(hashlib.sha256(texts[r["doc_id"]].encode()[r["start"] :][: r["n_bytes"]]).hexdigest() == r["repeat"] for r in split)


def test_remove_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(5)
    words = lambda n: [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(n)]
    rows = [(i, " ".join(words(40)) + ".", "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ", 1), "en", "s1", 0) for i in range(5)]
    rows += [(200 + i, rows[10 + i][1][:-1] + " extra.", "en", "s2", 0) for i in range(5)]
    rows += [(300 + i, "\n".join(" | ".join(words(9)) for _ in range(3)), "en", "s3", 0) for i in range(30)] + [(400, "too short", "en", "s1", 0), (401, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kept", "keep_id", "size", "_size", "_id", "class_id", "n_words", "target", "start"):  # names that operators use
        docs = docs.withColumn(name, F.lit("own"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(300 + i, 0, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [f for _, f in p.STAGES] == [p.quality_rules, p.without_copies, p.without_near_copies, p.mixed, p.packed]
    at, seen = docs, []
    for i, (_, stage) in enumerate(p.STAGES[:-1]):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        at = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert at.columns == docs.columns and at.where("kept <> 'own' or _size <> 'own' or n_words <> 'own' or _id <> 'own'").count() == 0
        seen.append({r["doc_id"] for r in at.collect()})
    assert seen[0] == {*range(60), *range(100, 105), *range(200, 205)}
    assert seen[1] == {*range(5, 60), *range(100, 105), *range(200, 205)}  # more blanks: the copy is longer
    assert seen[2] == {*range(5, 60), *range(100, 105)}
    assert seen[3] <= seen[2]
    pieces = p.run(spark, str(tmp_path))
    tokens = pieces.agg(F.sum("length")).first()[0]
    again = p.packed(spark, at, str(tmp_path))
    assert tokens == again.agg(F.sum("length")).first()[0]
    assert {r["doc_id"] for r in pieces.collect()} == seen[3]
    total = sum(len(re.findall(r"\S+", r["text"])) for r in at.collect())
    kept = sum(len(re.findall(r"\S+", t)) for i, t, *_ in rows if i in seen[2])
    assert abs(total - 1.5 * kept) <= 2
