"""Similarity join on word n-grams: a MinHash LSH forest with exact verification.

1. Every text gets a label of ``depth`` MinHash values in each of ``trees``
   trees.  Texts with the same words are one class from here on.
2. The labels of a tree, sorted, are a prefix trie: what shares a prefix lies
   together, and the common prefixes of neighbours tell the trie's nodes.  A
   text starts at its full label and is matched with ever shorter prefixes
   until a pair as far apart as its own pairs can be meets in some tree with
   the target recall.  How far that is depends on the text: one of three
   n-grams has no pair at 0.8 but equal ones, and stops at the full label.  No
   text goes below the prefix that the threshold itself asks for; by that one
   the tries are dealt out.  A node with more than ``block`` texts is dealt
   into blocks, and every two blocks meet in one group.
3. In a node, signatures tell which members may be similar; what hangs
   together there becomes edges to one member, at most one per member.
4. Components of those edges are verified on the words themselves: shared
   n-grams are counted block by block, every pair of texts in a component is
   held against the threshold, and every text gets its number of links.
   Pairs are counted where they are found and never written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import columns, staged
from tidelog.llm.graph import components
from tidelog.llm.shingles import shingles

WINDOW = 5
SIMILARITY = 0.8
TREES = 16
DEPTH = 6
RECALL = 0.9995
#: Texts in a block of a large bucket, and n-grams in a block of a large component.
BLOCK = 4096
BLOCK_NGRAMS = 100_000
#: Share of equal signature values from which a pair is verified; at the threshold a pair falls below it by five standard deviations.
LIKELY = 0.75
_CHUNK = 1 << 16


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which pairs of that similarity meet in some tree with the target recall."""
    length = depth
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


@cache
def nearest(grams: int, similarity: float) -> float:
    """The smallest similarity, at the threshold or above, that two different sets can have, one of them of at most ``grams`` elements."""
    limit, best = Fraction(similarity).limit_denominator(10**6), Fraction(1)
    if grams >= 64:
        return float(limit)
    for size in range(1, grams + 1):
        for more in range(size):
            for less in range(size):
                found = Fraction(size - less, size + more)
                if limit <= found:
                    best = min(best, found)
    return float(best)


class Signer:
    """MinHash values of many texts, as big-endian 32-bit integers, tree by tree."""

    def __init__(self, values: int, seed: int = 5):
        random = np.random.default_rng(seed)
        self.times = random.integers(0, 1 << 63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = random.integers(0, 1 << 63, values, dtype=np.uint64)

    def sign(self, texts: list[str], window: int) -> tuple[list[bytes | None], np.ndarray]:
        hashes, at, words = shingles(texts, window)
        some = np.flatnonzero(np.diff(at))
        out: list[bytes | None] = [None] * len(texts)
        if some.size:
            mins = np.empty((self.times.size, some.size), np.uint64)
            for i, (m, p) in enumerate(zip(self.times, self.plus, strict=True)):
                mins[i] = np.minimum.reduceat(hashes * m + p, at[some])
            packed = (mins >> np.uint64(32)).astype(">u4").T
            for row, k in zip(np.ascontiguousarray(packed), some.tolist(), strict=True):
                out[k] = row.tobytes()
        return out, words


_SIGNED = T.StructType().add("_id", "long").add("row", "long").add("key", "binary").add("words", "long").add("labels", "binary")


def sign(docs: DataFrame, id_col: str, text_col: str, window: int, trees: int, depth: int, carry: bool = False) -> DataFrame:
    """_id, row (a number of its own), key (of the words), words, labels (null without words); ``carry``: and the columns of ``docs``, as _c0, _c1, ..."""
    values = trees * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        signer, row = Signer(values), TaskContext.get().partitionId() << 40

        def of(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            labels, words = signer.sign(texts, window)
            keys = [hashlib.blake2b(b" ".join(t.encode().split()), digest_size=16).digest() for t in texts]
            made = [part.column(0), pa.array(range(row, row + len(texts)), pa.int64()), pa.array(keys, pa.binary()), pa.array(words.tolist(), pa.int64()), pa.array(labels, pa.binary())]
            return pa.RecordBatch.from_arrays([*made, *part.columns[2:]], names=[*_SIGNED.names, *part.schema.names[2:]])

        for batch in batches:
            start, texts, size = 0, [], 0
            for (text,) in columns(batch, "_text"):
                texts.append(text or "")
                size += len(texts[-1])
                if size > 4 * _CHUNK:
                    yield of(batch.slice(start, len(texts)), texts)
                    row, start, texts, size = row + len(texts), start + len(texts), [], 0
            if texts:
                yield of(batch.slice(start), texts)
                row += len(texts)

    named = [F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")]
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)] if carry else []
    fields = [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(docs.columns)] if carry else []
    return docs.select(*named, *kept).mapInArrow(run, T.StructType(_SIGNED.fields + fields))


def _by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Runs of rows with one value in the first column, which is sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in columns(batch, *names):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _likely_stars(signatures: np.ndarray, least: int) -> list[int]:
    """For every row the first row of its part, rows with ``least`` equal values being joined."""
    first = [-1] * len(signatures)
    left = np.arange(len(signatures))
    while left.size:
        pivot, queue, left = int(left[0]), [int(left[0])], left[1:]
        first[pivot] = pivot
        while queue and left.size:
            near = (signatures[left] == signatures[queue.pop()]).sum(1) >= least
            for i in left[near].tolist():
                first[i] = pivot
                queue.append(i)
            left = left[~near]
    return first


def _trie_stars(labels: np.ndarray, signatures: np.ndarray, stops: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Pairs (member, first of its part) from one part of a trie; ``labels`` are sorted, ``stops`` the shortest prefix of each."""
    shared = (labels[1:] == labels[:-1]).cumprod(1).sum(1)
    for stop in sorted(set(stops.tolist()), reverse=True):  # from full labels up
        edges = np.flatnonzero(np.concatenate([[True], shared < stop, [True]]))
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = np.arange(first, last)[stops[first:last] <= stop]
            if own.size > 1 and (stops[own] == stop).any():
                for i, to in enumerate(_likely_stars(signatures[own], least)):
                    if i != to:
                        yield int(own[i]), int(own[to])


def _blocks(members: DataFrame, group: str, n_blocks: Column, key: str = "key") -> DataFrame:
    """Members of a group with several blocks go to one place for each two blocks; adds ``place``, ``lo``, ``hi``, ``block``."""
    own = members.withColumn("_n", n_blocks).withColumn("block", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.expr("sequence(0, cast(_n as int) - 1)")))
    dealt = dealt.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other"))
    return dealt.withColumn("place", F.xxhash64(group, "lo", "hi")).drop("_n", "_other")


def _shared_counts(sets: list[np.ndarray], n_values: int) -> np.ndarray:
    """Sizes of all intersections; ``sets`` hold numbers below ``n_values``."""
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    values = np.concatenate(sets)
    often = np.bincount(values, minlength=n_values) > 1
    column = np.cumsum(often) - 1
    inside = often[values]
    owner, column = owner[inside], column[values[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        used = np.flatnonzero(part.any(1))
        part = part[used]
        total[np.ix_(used, used)] += part @ part.T
    return total


def ngrams(words: list[bytes], window: int) -> set[tuple[bytes, ...]]:
    if len(words) < window:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(window)), strict=False))


def verify(texts: list[str], blocks: list[int], lo: int, hi: int, weights: list[int], window: int, similarity: float) -> tuple[np.ndarray, list[int]]:
    """Weighted links of every text within its place, and the first text of its part.

    With two blocks, only pairs across them count: those within a block have a
    place of their own.
    """
    number: dict[tuple[bytes, ...], int] = {}
    sets = [np.array([number.setdefault(g, len(number)) for g in ngrams(t.encode().split(), window)], np.int64) for t in texts]
    sizes = np.array([s.size for s in sets], np.int64)
    shared = _shared_counts(sets, len(number)) if len(sets) > 1 else np.zeros((len(sets), len(sets)), np.float32)
    # shared / (sum of sizes - shared) >= similarity, in integers
    limit = Fraction(similarity).limit_denominator(10**6)
    near = shared.astype(np.int64) * (limit.numerator + limit.denominator) >= limit.numerator * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(near, False)
    if lo != hi:
        side = np.array(blocks) == lo
        near &= side[:, None] != side[None, :]
    links = near @ np.array(weights, float)
    first = [-1] * len(texts)
    for start in range(len(texts)):
        if first[start] < 0:
            first[start], queue = start, [start]
            while queue:
                for j in np.flatnonzero(near[queue.pop()]).tolist():
                    if first[j] < 0:
                        first[j] = start
                        queue.append(j)
    return links, first


def _forest_edges(classes: DataFrame, window: int, similarity: float, trees: int, depth: int, recall: float, block: int, least: int) -> DataFrame:
    """a, b: keys of classes that may be similar, as stars."""
    length = prefix_length(similarity, trees, depth, recall)
    stops = [prefix_length(nearest(g, similarity), trees, depth, recall) for g in range(1, 65)]
    in_trees = classes.select("key", "words", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "labels").select(
        F.expr(f"xxhash64(tree, substring(labels, tree * {4 * depth} + 1, {4 * length}))").alias("bucket"), "tree", "key", "words"
    )
    shared = in_trees.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = in_trees.join(shared, "bucket").join(classes.select("key", "labels"), "key")
    members = members.withColumn("label", F.expr(f"substring(labels, tree * {4 * depth} + 1, {4 * depth})"))
    dealt = _blocks(members, "bucket", F.ceil(F.col("m") / F.lit(block))).select("place", "label", "key", "labels", "words")

    def likely_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in _by_group(batches, ["place", "label", "key", "labels", "words"]):
            if len(rows) < 2:
                continue
            table = lambda k: np.frombuffer(b"".join(r[k] for r in rows), ">u4").reshape(len(rows), -1).astype(np.uint32)  # noqa: B023, E731
            stop = np.array([stops[min(64, max(1, r[4] - window + 1)) - 1] for r in rows])
            for i, to in _trie_stars(table(1), table(3), stop, least):
                a.append(rows[i][2])
                b.append(rows[to][2])
            if len(a) > _CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return dealt.repartition("place").sortWithinPartitions("place", "label").mapInArrow(likely_edges, "a binary, b binary")


def _links(out: list[tuple]) -> pa.RecordBatch:
    k, n, r = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.binary())], names=["key", "links", "a"])


def _facts(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, window: int, similarity: float, trees: int, depth: int, recall: float, block: int, block_ngrams: int, likely) -> DataFrame:
    """key, class_id, stay (the row that stands for the class), copies, links, for every key with words."""
    stands = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "row"))
    classes = signed.where("words > 0").groupBy("key", "labels").agg(stands.alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("words").alias("words"))
    classes = staged(classes, "classes")
    maybe = components(_forest_edges(classes, window, similarity, trees, depth, recall, block, int(likely(similarity) * trees * depth)))

    sized = maybe.join(classes.select(F.col("key").alias("node"), F.col("rep.id").alias("id"), "copies", "words"), "node")
    sums = sized.groupBy("root").agg(F.sum("words").alias("all_words"), F.count(F.lit(1)).alias("all_texts"))
    wanted = sized.join(sums, "root").select(F.col("node").alias("key"), "root", "id", "copies", "all_words", "all_texts")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("id")))
    n_blocks = F.greatest(F.ceil(F.col("all_words") / F.lit(block_ngrams)), F.ceil(F.col("all_texts") / F.lit(block)))
    places = _blocks(found, "root", n_blocks).select("place", "key", "block", "lo", "hi", "copies", "text")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _by_group(batches, ["place", "key", "block", "lo", "hi", "copies", "text"]):
            # a row stands for its class if its words are the class's; ids may be repeated
            own = {}
            for r in rows:
                if r[6] is not None and hashlib.blake2b(b" ".join(r[6].encode().split()), digest_size=16).digest() == r[1]:
                    own.setdefault(r[1], r)
            rows = list(own.values())
            if len(rows) > 1:
                links, first = verify([r[6] for r in rows], [r[2] for r in rows], rows[0][3], rows[0][4], [r[5] for r in rows], window, similarity)
                out.extend((rows[i][1], int(links[i]), rows[first[i]][1]) for i in range(len(rows)))
            if len(out) > _CHUNK:
                yield _links(out)
                out = []
        yield _links(out)

    checked = staged(places.repartition("place").sortWithinPartitions("place").mapInArrow(verified, "key binary, links long, a binary"), "links")
    roots = components(checked.select("a", F.col("key").alias("b")))
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "rep", "copies").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").join(links, "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("rep").alias("first"))
    return named.join(least, "root").select("key", F.col("first.id").alias("class_id"), F.col("first.row").alias("stay"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
    block_ngrams: int = BLOCK_NGRAMS,
    likely: Callable[[float], float] = lambda s: LIKELY * s,
) -> DataFrame:
    """id, class_id, copies, n_links for every row of ``docs``.

    Two texts are linked when the Jaccard similarity of their sets of
    ``window`` words (a shorter text: all its words) is at least
    ``similarity``.  ``class_id`` is the smallest id that links reach, copies
    included; ``copies`` counts the rows with the same words; ``n_links``
    counts linked rows, copies among them.  A text without words, null or
    empty, links to nothing: its class is its own id, its copies 1.  Ids are
    integers; a null id takes part, but is no class id unless its class has no
    other.  Repeated rows are copies.  Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    signed = staged(sign(docs, id_col, text_col, window, trees, depth), "signatures")
    facts = _facts(docs, signed, id_col, text_col, window, similarity, trees, depth, recall, block, block_ngrams, likely)
    facts = facts.select("key", "class_id", F.col("copies").alias("_copies"), (F.col("copies") - 1 + F.col("links")).alias("_links"))
    out = signed.select("_id", "key", "words").join(facts, "key", "left")
    empty = F.col("words") == 0
    return out.select(
        F.col("_id").alias(id_col),
        F.when(empty, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(1)).otherwise(F.col("_copies")).cast("long").alias("copies"),
        F.when(empty, F.lit(0)).otherwise(F.col("_links")).cast("long").alias("n_links"),
    )


def without_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    block: int = BLOCK,
    block_ngrams: int = BLOCK_NGRAMS,
    likely: Callable[[float], float] = lambda s: LIKELY * s,
) -> DataFrame:
    """Of every class of ``similar`` one row, with all columns: that of the smallest id (nulls last).

    Of rows with that id, the first read stays.  Texts without words all stay.
    Rows are told apart as rows, not by their ids, which may be repeated.
    """
    signed = staged(sign(docs, id_col, text_col, window, trees, depth, carry=True), "signatures")
    facts = _facts(docs, signed, id_col, text_col, window, similarity, trees, depth, recall, block, block_ngrams, likely)
    stay = facts.select(F.col("stay").alias("row")).distinct()
    kept = signed.where("words > 0").join(stay, "row", "left_semi").unionByName(signed.where("words = 0"), allowMissingColumns=True)
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
