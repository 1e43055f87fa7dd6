"""Edit-aware token counts.

A document's pre-tokens (the pieces that byte-level BPE never merges across)
stand in runs of ``RUN``, the leaves of a balanced tree whose nodes hold sums
of characters, pre-tokens and tokens.  An edit replaces a span of characters:

* the tree finds the runs that the span touches, by character sums;
* their text, edited, is cut into pre-tokens again, with boundary context on
  either side; context is added until the cut agrees with the old one, so
  that nothing outside the region can change;
* only pre-tokens that are new there are encoded; runs are replaced and the
  sums on the paths to the root are updated.

The count of the document is then the root's sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import columns
from tidelog.llm.tokens import MOST_CACHED, encoder, vocabulary_path

RUN = 32
Edit = tuple  # (start, stop, new text), in characters


class PreTokens:
    """Cuts texts into pre-tokens and counts their tokens, with a cache of bounded size."""

    def __init__(self, path: str):
        import public_tokenizers

        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.encode = encoder(path).encoding.encode_ordinary
        self.cache: dict[str, int] = {}

    def counts(self, pieces: Sequence[str]) -> list[int]:
        get = self.cache.get
        found = list(map(get, pieces))
        if None in found:
            if len(self.cache) > MOST_CACHED:
                self.cache.clear()
            for i, (piece, n) in enumerate(zip(pieces, found, strict=True)):
                if n is None:
                    found[i] = self.cache[piece] = len(self.encode(piece))
        return found


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


class Leaf:
    """A run of pre-tokens."""

    __slots__ = ("chars", "counts", "pieces", "tokens")

    def __init__(self, pieces: list[str], counts: list[int]):
        self.pieces, self.counts = pieces, counts
        self.chars, self.tokens = sum(map(len, pieces)), sum(counts)


class CountTree:
    """Segment tree of a document's runs; leaves may be replaced by any number of leaves."""

    def __init__(self, text: str, tool: PreTokens):
        self.tool = tool
        pieces = tool.cut(text)
        counts = tool.counts(pieces)
        self.encoded = 0  # pre-tokens encoded by edits so far
        self._plant([Leaf(pieces[i : i + RUN], counts[i : i + RUN]) for i in range(0, len(pieces), RUN)])

    def _plant(self, leaves: list[Leaf]) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = leaf.chars, leaf.tokens
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        return min(node - self.size, max(0, len(self.leaves) - 1)), before

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf.pieces)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters [start, stop), cut off at the text's ends, by ``new``."""
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        if not self.leaves:
            self._replace(0, 0, self.tool.cut(new))
            return
        first, _ = self._find(max(0, start - 1))
        last, _ = self._find(min(stop, self.n_chars - 1))
        first, last = max(0, first - 1), min(len(self.leaves) - 1, last + 1)
        while True:
            before = self._before(first)
            old = [p for leaf in self.leaves[first : last + 1] for p in leaf.pieces]
            text = "".join(old)
            cut = self.tool.cut(text[: start - before] + new + text[stop - before :])
            # the region stands for itself if its outer pre-tokens came out as before, or lie at an end of the text
            left = first == 0 or (bool(cut) and cut[0] == old[0] and start - before > len(old[0]))
            right = last == len(self.leaves) - 1 or (len(cut) > 1 and cut[-2:] == old[-2:] and len(text) - (stop - before) > len(old[-1]) + len(old[-2]))
            if left and right:
                self._replace(first, last + 1, cut)
                return
            first, last = (first if left else max(0, first - 1)), (last if right else min(len(self.leaves) - 1, last + 1))

    def _before(self, leaf: int) -> int:
        """Characters before a leaf."""
        node, total = self.size + leaf, 0
        while node > 1:
            if node & 1:
                total += self.chars[node - 1]
            node >>= 1
        return total

    def _replace(self, first: int, stop: int, pieces: list[str]) -> None:
        gone = Counter(p for leaf in self.leaves[first:stop] for p in leaf.pieces)
        self.encoded += sum((Counter(pieces) - gone).values())
        counts = self.tool.counts(pieces)
        n = stop - first
        step = max(1, -(-len(pieces) // n)) if n and -(-len(pieces) // n) <= 2 * RUN else RUN
        leaves = [Leaf(pieces[i : i + step], counts[i : i + step]) for i in range(0, len(pieces), step)]
        if n and len(leaves) <= n:  # as many leaves as before: only paths to the root change
            leaves += [Leaf([], []) for _ in range(n - len(leaves))]
            self.leaves[first:stop] = leaves
            nodes = set()
            for i, leaf in enumerate(leaves, self.size + first):
                self.chars[i], self.tokens[i] = leaf.chars, leaf.tokens
                nodes.add(i >> 1)
            while nodes - {0}:
                for node in nodes - {0}:
                    self._sum(node)
                nodes = {node >> 1 for node in nodes}
        else:
            self._plant([x for x in [*self.leaves[:first], *leaves, *self.leaves[stop:]] if x.pieces])


def count_with_edits(docs: DataFrame, edits_col: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """id, n_pretokens, n_tokens, n_edits, n_tokens_after, n_chars_after, n_encoded for every row.

    ``edits_col``: an array of structs (start long, stop long, replacement
    string), applied one after the other, each to what the one before left;
    spans are cut off at the text's ends.  Null texts are empty, null arrays
    and null edits are left out, a null replacement is empty.  ``n_encoded``
    counts the pre-tokens that edits encoded.  Ids may be null or repeated:
    rows are counted one by one.  Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    path = tokenizer or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pre_tokens(path)
        for batch in batches:
            rows = []
            for text, edits in columns(batch, "_text", "_edits"):
                tree = CountTree(text or "", tool)
                pieces, tokens, done = sum(len(x.pieces) for x in tree.leaves), tree.n_tokens, 0
                for e in edits or []:
                    if e is not None and e["start"] is not None and e["stop"] is not None:
                        tree.edit(e["start"], e["stop"], e["replacement"] or "")
                        done += 1
                rows.append((pieces, tokens, done, tree.n_tokens, tree.n_chars, tree.encoded))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["_id", *NAMES])

    own = lambda c: F.col(f"`{c}`")
    named = docs.select(own(id_col).alias("_id"), own(text_col).cast("string").alias("_text"), own(edits_col).cast("array<struct<start:bigint,stop:bigint,replacement:string>>").alias("_edits"))
    out = named.mapInArrow(run, T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in NAMES)]))
    return out.withColumnRenamed("_id", id_col)


NAMES = ["n_pretokens", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_encoded"]


def revision(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``edits``: a fixed revision of every document, drawn from a hash of its id.

    A mark is put in at one place, some characters go at a second and a few
    are replaced at a third.
    """
    size = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    place = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), size + 1)
    edit = lambda at, n, new: F.struct(at.cast("long").alias("start"), (at + n).cast("long").alias("stop"), F.lit(new).alias("replacement"))
    return docs.withColumn("edits", F.array(edit(place(1), 0, " [sic]"), edit(place(2), 7, ""), edit(place(3), 4, "'s new\n\n")))
