"""Language identification by prediction by partial matching (PPM).

For every language, a tree of byte contexts up to ``order`` bytes holds
frozen counts.  A byte's probability comes from the longest context that the
language has seen; an escape (method C, with exclusion) leads to the next
shorter one, and from the empty context to equal shares of 256 bytes.  The
code length of a text, in bits, is the sum over its bytes, and the language
with the shortest code wins.

With frozen counts, escaping from a context multiplies by one number, whatever
the byte: the escape's share over what the shorter context leaves to unseen
bytes.  So a language is two sparse tables per length, code lengths of seen
bytes and of escapes, built where its counts are.  Texts are scored by the
batch: each different run of ``order + 1`` bytes is looked up once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import columns

ORDER = 3
#: Bound of the training sample: about so many bytes of text per language.
SAMPLE_BYTES = 6 << 20
UNDETERMINED = "und"
_BITS = 9  # a byte + 1, or 0 before the start of a text
_CHUNK = 1 << 20
_BATCH = 1 << 19
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _segments(raw: bytes, order: int) -> Iterator[np.ndarray]:
    """Byte values + 1 of a text in chunks, each with the ``order`` values before it."""
    for start in range(0, len(raw), _CHUNK):
        part = np.frombuffer(raw, np.uint8, count=min(_CHUNK + min(order, start), len(raw) - max(0, start - order)), offset=max(0, start - order))
        yield np.concatenate([np.zeros(order - min(order, start), np.int64), part.astype(np.int64) + 1])


def _grams(values: np.ndarray, order: int) -> np.ndarray:
    """Each byte behind its context, packed into an integer."""
    n = values.size - order
    packed = np.zeros(n, np.int64)
    for i in range(order + 1):
        packed = (packed << _BITS) | values[i : i + n]
    return packed


class GramCounts:
    """Sums of equal integers, merged whenever the buffer is full."""

    def __init__(self, most: int = 1 << 22):
        self.most, self.parts, self.weights, self.held = most, [], [], 0

    def add(self, grams: np.ndarray) -> None:
        self.parts.append(grams)
        self.weights.append(None)
        self.held += grams.size
        if self.held > self.most:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = [p for p, w in zip(self.parts, self.weights, strict=True) if w is None]
        old = [(p, w) for p, w in zip(self.parts, self.weights, strict=True) if w is not None]
        if fresh:
            keys, n = np.unique(np.concatenate(fresh), return_counts=True)
            old.append((keys, n))
        if len(old) > 1:
            keys, at = np.unique(np.concatenate([k for k, _ in old]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([w for _, w in old])).astype(np.int64)
        else:
            keys, n = old[0]
        # as long as there are many distinct grams, merge when as many new ones have come
        self.parts, self.weights, self.held = [keys], [n], 0
        self.most = max(self.most, 2 * keys.size)
        return keys, n


def count_grams(sample: DataFrame, order: int) -> DataFrame:
    """lang, text -> lang, gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, GramCounts] = {}
        for batch in batches:
            for lang, text in columns(batch, "lang", "text"):
                for values in _segments(text.encode(), order):
                    by_lang.setdefault(lang, GramCounts()).add(_grams(values, order))
        for lang, counts in by_lang.items():
            keys, n = counts.merge()
            for i in range(0, keys.size, 1 << 16):
                k, m = keys[i : i + (1 << 16)], n[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k.size, pa.string()), pa.array(k), pa.array(m)], schema=_GRAMS)

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _low(k: int) -> int:
    return (1 << (_BITS * k)) - 1


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether they hold what is wanted."""
    if not keys.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return at, keys[at] == wanted


class Level:
    """Contexts of one length: bits of the bytes seen after them, and of their escapes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, shorter: Level | None, k: int):
        """keys: sorted contexts with a byte; n: how often."""
        self.keys = keys
        self.contexts, first = np.unique(keys >> _BITS, return_index=True)
        kinds = np.diff(np.append(first, keys.size))
        owner = np.repeat(np.arange(self.contexts.size), kinds)
        up = np.full(keys.size, 1 / 256) if shorter is None else np.exp2(-shorter.bits[_find(shorter.keys, keys & _low(k))[0]])
        total = np.add.reduceat(n, first) if n.size else n
        left = 1 - np.bincount(owner, weights=up, minlength=self.contexts.size)  # of the shorter context's probability, for bytes not seen here
        escapes = np.where(left > 1e-9, kinds, 0)
        self.bits = -np.log2(n / (total + escapes)[owner])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(escapes > 0, -np.log2(kinds / (total + kinds) / left), 60.0)


class Tree:
    """One language's contexts up to ``order`` bytes."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int = ORDER):
        """grams: each byte behind its ``order`` predecessors, packed; n: how often."""
        self.order, self.levels = order, []
        for k in range(order + 1):
            keys, at = np.unique(grams & _low(k + 1), return_inverse=True)
            count = np.bincount(at, weights=n, minlength=keys.size)
            self.levels.append(Level(keys, count, self.levels[-1] if k else None, k))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of bytes behind their predecessors."""
        total, left = np.zeros(grams.size), np.arange(grams.size)
        for k in range(self.order, -1, -1):
            level, own = self.levels[k], grams[left] & _low(k + 1)
            at, hit = _find(level.keys, own)
            total[left[hit]] += level.bits[at[hit]]
            left, own = left[~hit], own[~hit]
            at, hit = _find(level.contexts, own >> _BITS)
            total[left[hit]] += level.escape[at[hit]]
        total[left] += 8
        return total


class Ppm:
    """Frozen context trees of all languages; their size is that of the bounded sample."""

    def __init__(self, counts: list[tuple[str, int, int]] | dict[str, Tree], order: int = ORDER):
        self.order = order
        if isinstance(counts, dict):
            self.trees = dict(sorted(counts.items()))
        else:
            by = {}
            for lang, gram, n in counts:
                by.setdefault(lang, []).append((gram, n))
            self.trees = {lang: Tree(*np.array(sorted(own), np.int64).T, order) for lang, own in sorted(by.items())}
        self.langs = list(self.trees)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each language's tree takes for each text."""
        total = np.zeros((len(texts), len(self.langs)))
        held, owner, size = [], [], 0

        def add() -> None:
            of = np.repeat(owner, [h.size for h in held])
            at, grams = pd.factorize(np.concatenate(held))
            for k, tree in enumerate(self.trees.values()):
                total[:, k] += np.bincount(of, weights=tree.bits(grams)[at], minlength=len(texts))

        for i, raw in enumerate(texts):
            for values in _segments(raw, self.order):
                held.append(_grams(values, self.order))
                owner.append(i)
                size += held[-1].size
                if size > _BATCH:
                    add()
                    held, owner, size = [], [], 0
        if size:
            add()
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        known = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if known:
            bits = self.lengths([texts[i].encode() for i in known])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for i, k, x in zip(known, best.tolist(), share.tolist(), strict=True):
                out[i] = self.langs[k], x
        return out


def train(labelled: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Ppm:
    """Trees from a bounded sample of ``lang, text`` rows, about ``sample_bytes`` per language.

    Every different text of a language counts once.  Texts are drawn by a hash
    of the text; that with the smallest hash is always drawn, so that no
    language comes away empty.  Null languages and texts are left out; repeated
    rows, their order and other columns do not matter; of an empty table the
    model knows no language.
    """
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    known = labelled.where("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text")).withColumn("draw", draw)
    different = known.groupBy("lang", "draw", F.octet_length("text").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    share = different.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest(F.lit(1), F.sum("n"))).alias("share"), F.min("draw").alias("least"))
    shares = known.sparkSession.createDataFrame(share.collect(), "lang string, share double, least double")  # a row per language
    sample = known.join(F.broadcast(shares), "lang").where((F.col("draw") < F.col("share")) | (F.col("draw") == F.col("least"))).dropDuplicates(["lang", "draw", "text"])

    def plant(key: tuple, counts: pa.Table) -> pa.Table:
        tree = Tree(counts.column("gram").to_numpy(), counts.column("n").to_numpy(), order)
        return pa.table({"lang": [key[0].as_py()], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    planted = count_grams(sample, order).groupBy("lang").applyInArrow(plant, "lang string, tree binary").collect()  # a row per language
    return Ppm({r["lang"]: pickle.loads(r["tree"]) for r in planted}, order)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def predict(docs: DataFrame, model: Ppm, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id, ``extra`` columns, lang_pred, score; one row per row, whole texts.

    A text that is null or has no letter, or a model without languages, gives
    ``und`` and score 0.  The score is the winner's share of probability
    among the languages, equal before seeing the text; of languages with equal
    code lengths the first by name wins.  Ids may be null or repeated; rows are
    judged one by one; an empty table gives no rows.  Of ``extra``, columns
    named ``lang_pred`` and ``score`` are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the bounded samples' different runs of bytes
    keep = [id_col, *(c for c in extra if c not in ("lang_pred", "score"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches:
            found, held, size = [], [], 0
            for (text,) in columns(batch, "_text"):
                held.append(text)
                size += len(text or "")
                if size > _BATCH:
                    found += ppm.predict(held)
                    held, size = [], 0
            found += ppm.predict(held)
            names, scores = [f[0] for f in found], [f[1] for f in found]
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(f"_k{i}" for i in range(len(keep))), "lang_pred", "score"])

    named = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = T.StructType([T.StructField(f"_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]).add("lang_pred", "string").add("score", "double")
    found = named.mapInArrow(run, schema)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
