"""Language-model scoring with a probabilistic suffix tree (PST).

The model reads a text as bytes: its words, A-Z in lower case, with one blank
between words and an end symbol.  Training counts every symbol behind its
last ``depth`` symbols over all training texts.  A context enters the tree

* if it occurs at least ``LEAST`` times;
* and if its next-symbol distribution diverges from that of the next shorter
  context: count times Kullback-Leibler divergence of at least ``NATS``, or a
  longer context does.

Both bounds are absolute, so the tree grows with the corpus.  Distributions
are smoothed towards the next shorter context (Witten-Bell); a symbol is
scored after the longest suffix of its past that the tree holds.

The tree is split by the last three symbols of a context into branches, which
are dealt into buckets; what is shorter is bounded by the alphabet and is
broadcast.  Beside the tree stands an add-one unigram model over words.

Texts are never shuffled.  One pass counts words and grams (a symbol behind
its ``depth`` predecessors).  The most frequent words and grams, at most
``HOT_WORDS`` and ``HOT_GRAMS`` of them, are broadcast with their counts and
probabilities, and a second pass sums up what they tell of each text.  What a
text holds beside them is written out, a row per text and word or gram; these
rows are joined with the other words' counts and ask the branches, and their
sums are added to the text's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, staged
from tidelog.llm.langid import GramCounts, held_out

DEPTH = 5
LEAST, NATS = 8, 1.0
HOT_WORDS, HOT_GRAMS = 1 << 19, 1 << 21
#: A broadcast word has so many bytes at most.
WORD_BYTES = 64
BUCKET_GRAMS = 1 << 16
_BITS, _END = 9, 257  # symbols: 0 before the start, byte + 1, end
_MASK = (1 << _BITS) - 1
_HELD = 1 << 19


def canonical(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return (text or "").encode().lower().split()


def symbols(words: list[bytes], depth: int) -> np.ndarray:
    """The text as symbols, behind ``depth`` start symbols and before the end."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    out = np.zeros(depth + raw.size + 1, np.int16)
    out[depth:-1] = raw
    out[depth:-1] += 1
    out[-1] = _END
    return out


def count_all(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """text -> gram, word, n: counts of all grams (word null) and words (gram null)."""

    def grams_out(counts: GramCounts) -> Iterator[pa.RecordBatch]:
        keys, n = counts.merge()
        for i in range(0, keys.size, 1 << 16):
            k = pa.array(keys[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([k, pa.nulls(len(k), pa.binary()), pa.array(n[i : i + (1 << 16)])], names=["gram", "word", "n"])

    def words_out(words: Counter) -> Iterator[pa.RecordBatch]:
        items = list(words.items())
        for i in range(0, len(items), 1 << 16):
            w, n = zip(*items[i : i + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], names=["gram", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words, held, size = GramCounts(), Counter(), [], 0
        for batch in batches:
            for (text,) in columns(batch, "text"):
                w = canonical(text)
                words.update(w)
                held.append(symbols(w, depth))
                size += held[-1].size
                if size > _HELD:
                    counts.add(_packed(held, depth))
                    held, size = [], 0
                if len(words) > _HELD:  # counts of a part are added up behind the shuffle
                    yield from words_out(words)
                    words = Counter()
                if counts.most > 8 * _HELD:
                    yield from grams_out(counts)
                    counts = GramCounts()
        if held:
            counts.add(_packed(held, depth))
        yield from words_out(words)
        yield from grams_out(counts)

    rows = texts.select("text").mapInArrow(run, "gram long, word binary, n long")
    return rows.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _packed(held: list[np.ndarray], depth: int) -> np.ndarray:
    """Every symbol of texts given as ``symbols`` behind its ``depth`` predecessors, in order."""
    s = np.concatenate(held).astype(np.int64)
    n = s.size - depth
    packed = np.zeros(n, np.int64)
    for i in range(depth + 1):
        packed = (packed << _BITS) | s[i : i + n]
    return packed[s[depth:] > 0]  # what crosses into the next text ends in a start symbol


def _low(k: int) -> int:
    return (1 << (_BITS * k)) - 1


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether they hold what is wanted."""
    if not keys.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return at, keys[at] == wanted


class Level:
    """All contexts of k symbols, with what follows them, in one part of the tree."""

    def __init__(self, k: int, grams: np.ndarray, n: np.ndarray, up: np.ndarray, least: float, nats: float):
        """grams: sorted, with counts n; up: their symbols' probabilities after the next shorter context."""
        self.k, self.grams, self.n = k, grams, n
        self.contexts, first, self.kinds = np.unique(grams >> _BITS, return_index=True, return_counts=True)
        owner = np.repeat(np.arange(self.contexts.size), self.kinds)
        self.total = np.add.reduceat(n, first) if n.size else n
        self.p = (n + self.kinds[owner] * up) / (self.total + self.kinds)[owner]
        gain = np.bincount(owner, weights=n * np.log(self.p / up), minlength=self.contexts.size)
        self.kept = (self.total >= least) & ((gain >= nats) | (k == 0))


def _levels(grams: np.ndarray, n: np.ndarray, first: int, depth: int, up, least: float, nats: float) -> list[Level]:
    """Levels ``first`` to ``depth`` from the grams of ``depth`` symbols before one; up: probabilities below ``first``."""
    by_k = {depth: (grams, n.astype(np.float64))}
    for k in range(depth - 1, first - 1, -1):
        longer, m = by_k[k + 1]
        keys, at = np.unique(longer & _low(k + 1), return_inverse=True)
        by_k[k] = keys, np.bincount(at, weights=m, minlength=keys.size)
    levels: list[Level] = []
    for k in range(first, depth + 1):
        keys, m = by_k[k]
        below = levels[-1].p[np.searchsorted(levels[-1].grams, keys & _low(k))] if levels else up(keys)
        levels.append(Level(k, keys, m, below, least, nats))
    for longer, shorter in zip(levels[:0:-1], levels[-2::-1], strict=True):  # shorter contexts of what is kept
        _keep(shorter, longer.contexts[longer.kept] & _low(shorter.k))
    return levels


def _keep(level: Level, contexts: np.ndarray) -> None:
    at, hit = _find(level.contexts, contexts)
    level.kept[at[hit]] = True


def _chances(levels: list[Level], grams: np.ndarray, p: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities after the longest kept context; alive: where all shorter ones are kept."""
    for level in levels:
        own = grams & _low(level.k + 1)
        at, hit = _find(level.contexts, own >> _BITS)
        alive = alive & hit
        if alive.any():
            alive[alive] = level.kept[at[alive]]
            at, own = at[alive], own[alive]
            spot, seen = _find(level.grams, own)
            n = np.where(seen, level.n[spot], 0.0)
            p = p.copy()
            p[alive] = (n + level.kinds[at] * p[alive]) / (level.total[at] + level.kinds[at])
    return p, alive


class Crown:
    """The contexts of fewer than ``split`` symbols; their number is bounded by the alphabet."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, split: int, least: float, nats: float):
        order = np.argsort(grams)
        self.levels = _levels(grams[order], n[order], 0, split - 1, lambda g: np.full(g.size, 1 / 257), least, nats)

    def up(self, grams: np.ndarray) -> np.ndarray:
        """Of grams seen in training: probabilities after the longest context here, kept or not."""
        top = self.levels[-1]
        return top.p[np.searchsorted(top.grams, grams & _low(top.k + 1))]

    def keep(self, contexts: np.ndarray) -> None:
        """Longer contexts of these are kept."""
        _keep(self.levels[-1], contexts)
        for longer, shorter in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            _keep(shorter, longer.contexts[longer.kept] & _low(shorter.k))

    def chances(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _chances(self.levels, grams, np.full(grams.size, 1 / 257), np.ones(grams.size, bool))


def _bucket(grams: np.ndarray, split: int, buckets: int) -> np.ndarray:
    """By the last ``split`` symbols of the context."""
    mixed = ((grams >> _BITS) & _low(split)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _branch(part: pa.Table, split: int, depth: int, crown: Crown, least: float, nats: float) -> list[Level]:
    grams, n = part.column("gram").to_numpy(), part.column("n").to_numpy()
    order = np.argsort(grams)
    return _levels(grams[order], n[order], split, depth, crown.up, least, nats)


class Tree:
    """The branches of the tree, as a table of buckets, below a broadcast crown."""

    def __init__(self, grams: DataFrame, depth: int = DEPTH, least: float = LEAST, nats: float = NATS, bucket_grams: int = BUCKET_GRAMS):
        """grams: gram, n."""
        self.depth, self.least, self.nats, self.split = depth, least, nats, min(3, depth)
        self.session, split = grams.sparkSession, self.split
        short = grams.groupBy(F.col("gram").bitwiseAND(_low(split)).alias("gram")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
        short = short.toArrow()  # bounded by the alphabet
        self.buckets = max(1, -(-int(short.column("kinds").to_numpy().sum()) // bucket_grams))
        crown = Crown(short.column("gram").to_numpy(), short.column("n").to_numpy(), split, least, nats)
        self.parts = self._placed(grams.select("gram", "n"), "gram long, n long").groupBy("bucket")
        told = self.session.sparkContext.broadcast(crown)

        def kept(part: pa.Table) -> pa.Table:
            low = _branch(part, split, depth, told.value, least, nats)[0]
            return pa.table({"context": pa.array(np.unique(low.contexts[low.kept] & _low(split - 1)))})

        crown.keep(self.parts.applyInArrow(kept, "context long").distinct().toArrow().column("context").to_numpy())  # bounded by the alphabet
        self.crown = self.session.sparkContext.broadcast(crown)

    def _placed(self, rows: DataFrame, schema: str) -> DataFrame:
        split, buckets = self.split, self.buckets

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of = pa.array(_bucket(b.column("gram").to_numpy(), split, buckets))
                yield pa.RecordBatch.from_arrays([of, *b.columns], names=["bucket", *b.schema.names])

        return rows.mapInArrow(place, f"bucket long, {schema}")

    def often(self, bound: int) -> DataFrame:
        """gram, logp (log10) of training grams with a count of ``bound`` or more."""
        split, depth, least, nats, whole = self.split, self.depth, self.least, self.nats, self.crown

        def tell(part: pa.Table) -> pa.Table:
            levels = _branch(part, split, depth, whole.value, least, nats)
            g = levels[-1].grams[levels[-1].n >= bound]
            return pa.table({"gram": pa.array(g), "logp": pa.array(np.log10(_chances(levels, g, *whole.value.chances(g))[0]))})

        return self.parts.applyInArrow(tell, "gram long, logp double")

    def ask(self, grams: DataFrame) -> DataFrame:
        """gram -> gram, logp (log10), for different grams, seen in training or not."""
        split, depth, least, nats, whole = self.split, self.depth, self.least, self.nats, self.crown

        def tell(part: pa.Table, asked: pa.Table) -> pa.Table:
            levels = _branch(part, split, depth, whole.value, least, nats)
            g = asked.column("gram").to_numpy()
            return pa.table({"gram": pa.array(g), "logp": pa.array(np.log10(_chances(levels, g, *whole.value.chances(g))[0]))})

        return self.parts.cogroup(self._placed(grams.select("gram"), "gram long").groupBy("bucket")).applyInArrow(tell, "gram long, logp double")


def _bound(counts: DataFrame, most: int) -> int:
    """The smallest power of two so that at most ``most`` rows have that ``n`` or more."""
    by = {r["e"]: r["rows"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # 64 rows
    e = max(by, default=0) + 1
    while e > 0 and by.get(e - 1, 0) <= most:
        e -= 1
        most -= by.get(e, 0)
    return 1 << e


def _packed_table(rows: DataFrame) -> bytes:
    """A bounded table as an Arrow stream."""
    found, sink = rows.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    return sink.getvalue().to_pybytes()


def score(
    docs: DataFrame,
    training: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    least: float = LEAST,
    nats: float = NATS,
    hot_words: int = HOT_WORDS,
    hot_grams: int = HOT_GRAMS,
    bucket_grams: int = BUCKET_GRAMS,
) -> DataFrame:
    """Scores of all rows; ``training``: a boolean column, the rows to learn from.

    Returns id, n_tokens, n_known, train_tokens, base_score, score.  A null or
    empty text is the end token alone.  Ids may be null or repeated: every row
    is scored for itself.  Other columns are ignored, whatever their names; an
    empty table gives no rows.  Without training rows the unigram model knows
    nothing (N = V = 0) and the tree is uniform.  ``hot_words``, ``hot_grams``
    and ``bucket_grams`` change the plan, not the result.
    """
    named = lambda c: F.col(f"`{c}`")
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(training), F.lit(False)).alias("train"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    session = docs.sparkSession
    counts = staged(count_all(rows.where("train"), depth), "lm-counts")
    grams, words = counts.where("gram is not null").select("gram", "n"), counts.where("word is not null").select("word", F.col("n").alias("c"))
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("kinds")).first()
    ends = rows.where("train").count()
    tokens, kinds = facts["tokens"] + ends, facts["kinds"] + (1 if ends else 0)

    brief = words.where(F.octet_length("word") <= WORD_BYTES)
    word_bound = _bound(brief.select(F.col("c").alias("n")), hot_words)
    hot = session.sparkContext.broadcast(_packed_table(brief.where(F.col("c") >= word_bound)))  # at most hot_words of WORD_BYTES
    tree = Tree(grams, depth, least, nats, bucket_grams)
    table = session.sparkContext.broadcast(_packed_table(tree.often(_bound(grams, hot_grams))))  # at most hot_grams
    log_ends, floor = math.log10(ends + 1), math.log10(tokens + kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, grams = (pa.ipc.open_stream(x.value).read_all() for x in (hot, table))
        get = dict(zip(words.column("word").to_pylist(), np.log10(words.column("c").to_numpy() + 1.0).tolist(), strict=True)).get
        index, logp = pd.Index(grams.column("gram").to_numpy()), np.append(grams.column("logp").to_numpy(), 0.0)  # place -1 adds nothing
        del words, grams
        row = TaskContext.get().partitionId() << 40
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            packed = _packed([h[4] for h in held], depth)
            sizes = np.array([h[4].size - depth for h in held])
            at = index.get_indexer(packed)
            first = np.cumsum([0, *sizes[:-1]])
            sums = np.add.reduceat(logp[at], first)
            r = row - len(held)
            nothing = pa.nulls(len(held), pa.binary())
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [longs(range(r, row)), pa.array([h[0] for h in held], kind), longs([h[1] for h in held]), longs([h[2] for h in held])]
                + [pa.array([h[3] for h in held], pa.float64()), pa.array(sums), nothing, pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64())],
                names=NAMES,
            )
            other = np.flatnonzero(at < 0)
            for of, more, none in ((rest[0], rest[1], pa.binary()), (None, None, None)):
                if of is None:  # grams, those of one text counted
                    which = np.repeat(np.arange(r, row), sizes)[other]
                    pair = np.lexsort((packed[other], which))
                    which, gram = which[pair], packed[other][pair]
                    new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (gram[1:] != gram[:-1])][: which.size])
                    of, word, n = which[new], pa.nulls(new.size, pa.binary()), np.diff(np.r_[new, which.size])
                    gram = pa.array(gram[new])
                else:
                    word, n, gram = pa.array(more, none), rest[2], pa.nulls(len(of), pa.int64())
                empty = [pa.nulls(len(of), t) for t in (kind, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                if len(of):
                    yield pa.RecordBatch.from_arrays([longs(of), *empty, word, gram, longs(n)], names=NAMES)

        held, rest, size = [], ([], [], []), 0
        for batch in batches:
            kind = batch.schema.field("id").type
            for ident, text in columns(batch, "id", "text"):
                w = canonical(text)
                of = list(map(get, w))
                left = [x for x, y in zip(w, of, strict=True) if y is None]
                total = math.fsum(y for y in of if y is not None) if left else math.fsum(of)
                held.append((ident, len(w) + 1, len(w) - len(left) + (ends > 0), total + log_ends - (len(w) + 1) * floor, symbols(w, depth)))
                for x, n in Counter(left).items():
                    rest[0].append(row)
                    rest[1].append(x)
                    rest[2].append(n)
                row += 1
                size += held[-1][4].size
                if size > _HELD:
                    yield from flush()
                    held, rest, size = [], ([], [], []), 0
        if held:
            yield from flush()

    id_kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {id_kind}, n_tokens long, n_known long, base_score double, score double, word binary, gram long, n long"
    found = staged(rows.select("id", "text").mapInArrow(run, schema), "lm-rows")
    # words and grams beside the broadcast ones; unknown words add nothing
    rare = words.where((F.col("c") < word_bound) | (F.octet_length("word") > WORD_BYTES))
    of_words = found.where("word is not null").join(rare, "word").select("row", F.col("n").alias("known"), (F.col("n") * F.log10(F.col("c") + 1)).alias("base"), F.lit(0.0).alias("tree"))
    asked = found.where("gram is not null").select("row", "gram", "n")
    answers = tree.ask(asked.select("gram").distinct())
    of_grams = asked.join(answers, "gram").select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * F.col("logp")).alias("tree"))
    sums = of_words.unionByName(of_grams).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "base", "tree")])
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return (
        found.where("n_tokens is not null")
        .join(sums, "row", "left")
        .select(F.col("id").alias(id_col), "n_tokens", plus("n_known", "known"), F.lit(tokens).cast("long").alias("train_tokens"), plus("base_score", "base"), plus("score", "tree"))
    )


NAMES = ["row", "id", "n_tokens", "n_known", "base_score", "score", "word", "gram", "n"]


def train_rows(docs: DataFrame, id_col: str = "doc_id", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """``docs`` with ``held_out`` and its opposite ``_train``."""
    return docs.withColumn("held_out", held_out(F.col(id_col), modulus, remainder)).withColumn("_train", ~F.col("held_out"))
