"""Language identification, language-model scoring and quality rules."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import langid, lm, quality

SYLLABLES = {"xx": "th er on an re he in ed nd".split(), "yy": "sch ein ich ung der ü ß ge".split(), "zz": "ció ñ que lla ar os".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(5)
    return [(i, sentence(rng, lang, rng.randint(3, 40)), lang, "x") for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*corpus(), (900, None, "xx", "x"), (901, "12 34 !!", None, "x"), (902, "", "yy", "x"), (None, "ther on", None, "x")], "doc_id long, text string, lang string, score string")


def test_languages(spark, docs):
    d = docs.withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    model = langid.train(d.where("not held_out"))
    got = {r["doc_id"]: r for r in langid.predict(d, model, extra=("held_out",)).collect()}
    truth = {i: lang for i, _, lang, _ in corpus()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[None]["lang_pred"] == "xx" and 0.5 < got[None]["score"] <= 1
    nothing = langid.train(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_language_rows(spark):
    """Copies weigh once, a language of one long text is learned, and names may clash."""
    rows = [(i, sentence(random.Random(i), "xx", 60), "xx") for i in range(40)] + [(100 + i, sentence(random.Random(99), "yy", 3000), "yy") for i in range(30)]
    d = spark.createDataFrame([(*r, "own", "own", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, draw string, `a b` int")
    model = langid.train(d, sample_bytes=500)
    assert model.langs == ["xx", "yy"]
    texts = [r[1].encode() for r in rows[::7]]
    assert np.array_equal(model.lengths(texts), langid.train(d.unionAll(d), sample_bytes=500).lengths(texts))
    got = langid.predict(d, model, extra=("lang_pred", "a b"))
    assert got.columns == ["doc_id", "a b", "lang_pred", "score"]
    assert all(r["lang_pred"] == ("xx" if r["doc_id"] < 100 else "yy") for r in got.collect())


def test_code_lengths():
    """Against a direct walk from the longest context down, with exclusion."""
    texts = {"a": ["abracadabra abra", "cadabra bar"], "b": ["banana band", "bandana nab"]}
    order, counts = 2, Counter()
    for lang, own in texts.items():
        for t in own:
            v = [0] * order + [x + 1 for x in t.encode()]
            for i in range(order, len(v)):
                key = 0
                for s in v[i - order : i + 1]:
                    key = key << 9 | s
                counts[lang, key] += 1
    model = langid.Ppm([(lang, k, n) for (lang, k), n in counts.items()], order)

    def walk(lang, context, byte):
        seen = Counter()
        for t in texts[lang]:
            v = (0,) * order + tuple(x + 1 for x in t.encode())
            for i in range(order, len(v)):
                if not context or v[i - len(context) : i] == context:
                    seen[v[i]] += 1
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            left = 1 if kinds < 256 else 0
            return seen[byte] / (total + kinds * left)
        if not context:
            lower, rest = 1 / 256, (256 - kinds) / 256
        else:
            lower, rest = walk(lang, context[1:], byte), sum(walk(lang, context[1:], s) for s in range(1, 257) if s not in seen)
        return lower if not total else kinds / (total + kinds) * lower / rest

    for t in ("abra", "nab", "zoo", "drab band"):
        v = (0,) * order + tuple(x + 1 for x in t.encode())
        bits = model.lengths([b"", t.encode()])[1]
        for k, lang in enumerate(model.langs):
            want = -sum(math.log2(walk(lang, v[i - order : i], v[i])) for i in range(order, len(v)))
            assert math.isclose(bits[k], want, rel_tol=1e-4)


def test_long_texts_in_chunks(docs, monkeypatch):
    model = langid.train(docs)
    raw = (corpus()[0][1] * 20).encode()
    whole = model.lengths([raw, raw[:100]])
    monkeypatch.setattr(langid, "_CHUNK", 37)
    monkeypatch.setattr(langid, "_BATCH", 50)
    assert np.allclose(model.lengths([raw, raw[:100]]), whole)


def plain_base(rows, train):
    counts = Counter()
    for i, t in rows:
        if train(i):
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        out[i] = (len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in w))
    return out


def test_lm(spark, docs):
    d = lm.train_rows(docs.where("doc_id is not null"))
    got = {r["doc_id"]: r for r in lm.score(d, "_train", hot_words=100, hot_grams=300).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    want = plain_base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    assert set(got) == set(want)
    for i, w in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == w[:3]
        assert math.isclose(got[i]["base_score"], w[3], rel_tol=1e-9)
        assert got[i]["score"] < 0
    # what is learned from contexts holds for texts that were not learned from
    held = [i for i in want if zlib.crc32(str(i).encode()) % 7 == 2]
    flat = {r["doc_id"]: r["score"] for r in lm.score(d, "_train", depth=1).collect()}
    assert sum(got[i]["score"] for i in held) > 0.9 * sum(flat[i] for i in held)
    assert lm.score(d.where("false"), "_train").count() == 0
    untrained = lm.score(d.withColumn("_train", F.lit(False)), "_train").where("doc_id = 900").first()
    assert (untrained["n_tokens"], untrained["n_known"], untrained["base_score"]) == (1, 0, 0.0)


def plain_scores(rows, train, depth, least, nats):
    """Counts, divergence, smoothing and longest kept suffix, one symbol after the other, from the definition."""

    def past(t):
        raw = b" ".join((t or "").encode().lower().split())
        return [0] * depth + [x + 1 for x in raw] + [257]

    follow: dict[tuple, Counter] = {}
    for i, t in rows:
        if train(i):
            v = past(t)
            for at in range(depth, len(v)):
                for k in range(depth + 1):
                    follow.setdefault(tuple(v[at - k : at]), Counter())[v[at]] += 1

    def p(context, x):
        own = follow.get(context, Counter())
        below = p(context[1:], x) if context else 1 / 257
        return (own[x] + len(own) * below) / (sum(own.values()) + len(own)) if own else below

    kept = {()} if () in follow else set()
    for c, own in follow.items():
        gain = sum(n * math.log(p(c, x) / (p(c[1:], x) if c else 1 / 257)) for x, n in own.items())
        if sum(own.values()) >= least and gain >= nats:
            kept |= {c[k:] for k in range(len(c) + 1)}
    out = {}
    for i, t in rows:
        v, total = past(t), 0.0
        for at in range(depth, len(v)):
            longest = next((c for k in range(depth, -1, -1) if (c := tuple(v[at - k : at])) in kept), None)
            total += math.log10(1 / 257 if longest is None else p(longest, v[at]))
        out[i] = total
    return out, len(kept)


def test_scores_by_definition(spark, docs):
    """For any bounds, with everything broadcast and with next to nothing broadcast, in one branch table or many."""
    part = docs.where("doc_id is not null and (doc_id < 60 or doc_id >= 900)")
    d = lm.train_rows(part)
    rows = [(r["doc_id"], r["text"]) for r in part.collect()]
    learnt = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    base = plain_base(rows, learnt)
    for least, nats, depth, options in (
        (8, 1.0, 5, {}),
        (2, 0.0, 4, {"hot_grams": 50, "hot_words": 10, "bucket_grams": 40}),
        (20, 12.0, 3, {"hot_grams": 0, "hot_words": 0, "bucket_grams": 10}),
        (2, 1.0, 2, {"hot_grams": 30, "bucket_grams": 10}),
    ):
        got = {r["doc_id"]: r for r in lm.score(d, "_train", depth=depth, least=least, nats=nats, **options).collect()}
        want, kept = plain_scores(rows, learnt, depth, least, nats)
        assert set(got) == set(want) and kept > 3
        for i, w in want.items():
            assert math.isclose(got[i]["score"], w, rel_tol=1e-9)
            assert math.isclose(got[i]["base_score"], base[i][3], rel_tol=1e-9)
            assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == base[i][:3]


def test_lm_rows(spark):
    """Repeated and null ids, long words, clashing names: every row is scored for itself."""
    long = "w" * 200
    rows = [(1, f"a b {long}", 5), (1, f"a b {long}", 6), (1, "other", 7), (None, None, 8), (None, f"a {long} {long}", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, gram int").withColumn("row", F.lit("x")).withColumn("_train", F.lit(True))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in lm.score(d, "_train").collect())
    assert got == [(0, 1, 1), (0, 4, 4), (1, 2, 2), (1, 4, 4), (1, 4, 4)]
    n, v, c = 15, 5, {"a": 3, long: 4}
    want = sum(math.log10((x + 1) / (n + v + 1)) for x in (c["a"], c[long], c[long], 5))
    assert math.isclose(next(r["base_score"] for r in lm.score(d, "_train").collect() if r["doc_id"] is None and r["n_tokens"] == 4), want)


def test_tree_grows_with_the_corpus(spark):
    """What is learned from rare contexts stays, however much other text there is."""
    rare = [(i, "qxjzk vwqxz", True) for i in range(20)]
    other = [(1000 + i, sentence(random.Random(i), "xx", 500), True) for i in range(400)]
    scores = []
    for rows in (rare, rare + other):
        d = spark.createDataFrame([*rows, (1, "qxjzk vwqxz", False)], "doc_id long, text string, _train boolean")
        scores.append(lm.score(d, "_train").where("doc_id = 1").agg(F.max("score")).first()[0])
    assert scores[1] > scores[0] - 5


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_counts():
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a ", "b ", "cc ", "\n", "é#", "\t", "|", "\x0b", "\x85", "　"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for t in [*texts, None, "", " \n ", "a b c d e f " * 50, "x " * 9]:
        c = quality.count(t)
        assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words) == plain_counts(t)
        assert c.failed == (c.n_words < 10 or 100 * c.n_repeat_words > 20 * c.n_words)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(7)
    for _ in range(40):
        field = quality.LineField(rng.normal(size=(2, quality.N_FEATURES)), rng.normal(size=(2, 2)))
        rows = rng.normal(size=(rng.integers(1, 7), quality.N_FEATURES))

        def value(labels, rows=rows, field=field):
            unit = rows @ field.weights.T
            return sum(unit[i, y] for i, y in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))

        every = [[(k >> i) & 1 for i in range(len(rows))] for k in range(1 << len(rows))]
        assert math.isclose(value(field.viterbi(rows).tolist()), max(map(value, every)))
        labels = np.array(every[-1])
        _, _, loglik = field.gradient(rows[None], labels[None], np.array([len(rows)]), np.ones(1))
        assert math.isclose(loglik, value(labels.tolist()) - math.log(sum(math.exp(value(e)) for e in every)), abs_tol=1e-9)
    assert field.viterbi(rows[:0]).size == 0


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: "\n".join(sentence(rng, "xx", 12) + "." for _ in range(3))
    bad = lambda: "\n".join(" | ".join(sentence(rng, "xx", 1) for _ in range(12)) for _ in range(3))
    rows = [(i, good() if i % 2 else bad(), 1) for i in range(120)] + [(200, None, 1), (201, "", 1), (202, good() + "\n" + bad().split("\n")[0], 1), (3, good(), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(61, None, 0), (999, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, quality.train(docs, labels))
    assert got.columns[:2] == ["doc_id", "text"] and got.count() == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[i] == bool(i % 2) for i in range(120))
    assert kept[202] and not kept[200] and not kept[201]
    # a line of boilerplate in a good text is told from its neighbours
    model = quality.train(docs, labels)
    mixed = next(t for i, t, _ in rows if i == 202)
    f, words = quality.features([x for x in mixed.split("\n")], [False] * 4)
    assert model.viterbi(f).tolist() == [1, 1, 1, 0] and 0 < got.where("doc_id = 202").first()["content_share"] < 1
    untrained = quality.judge(docs, quality.train(docs, labels.where("false")))
    assert untrained.where("not base_failed and not kept").count() == 0
    assert quality.judge(docs.where("false"), quality.LineField()).count() == 0


def test_quality_rows(spark):
    """Repeated ids, labels that disagree, and columns whose names clash or need quoting."""
    rows = [(1, "a b c d e f g h i j k. " * 2, (1,), "x"), (1, None, None, "y"), (None, "!! | | | | |", (2,), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` struct<`x y`: int>, kept string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, quality.train(docs, labels))
    assert got.schema["a.b"].dataType == docs.schema["a.b"].dataType and got.count() == 3
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got.collect()) == [(0, 6, False), (1, 0, False), (1, 22, False)]


def test_runs_of_long_texts():
    """A text of many lines trains as runs of neighbours: every line counts."""
    rng = np.random.default_rng(9)
    good, bad = rng.normal(1, 0.1, (200, quality.N_FEATURES)), rng.normal(-1, 0.1, (200, quality.N_FEATURES))
    good[150:] = bad[:50]  # the last quarter is boilerplate
    field = quality.LineField().fit([(good, np.ones(200, int), 1), (bad, np.ones(200, int), 0)])
    assert field.viterbi(good).tolist() == [1] * 150 + [0] * 50
