"""Repeated byte strings by common-prefix interval trees.

A repeat is a byte string that starts at two places, in one text or two, and
has ``length`` bytes or ``words`` words.  Its suffixes need not all be sorted:
they are sampled at anchors, so that both places hold the same one.

* In every ``words - 2`` neighbouring words (a repeat's ends may cut a word),
  the gram of ``GRAM_WORDS`` words with the smallest hash (the last of equals).
* Where ``length`` bytes hold fewer whole words, the gram of ``GRAM`` bytes with
  the smallest hash among them too.

Only anchors whose gram starts at a second place matter.  For each such gram
its suffixes are sorted, with the common prefixes of neighbours: a sparse
enhanced suffix array.  A stack scan gives the intervals of the common-prefix
tree.  What stands on the left of an interval's suffixes is put in order and
scanned in the same way: an interval whose suffixes all have one left extension
is extended as a whole, and each place where left extensions differ gives a
maximal repeat, with all its occurrences.

A gram with more than ``most`` contexts is not sorted in one task.  Its tree is
taken apart along the path of one context, of some drawn at random the one that
shares most with the others: every context is compared with it, and contexts
that leave its path at the same depth by the same byte, to the left or to the
right, form a group of their own, which is treated in the same way.  Any two
contexts either share more than the path tells, and then a group, or what the
path tells is all they share.

Equal texts are one class: as a whole, they are repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import columns, staged
from tidelog.llm.shingles import BLANK, mix, prefix_sums

LENGTH = 400
WORDS = 51
GRAM, GRAM_WORDS = 100, 16
#: Contexts of a gram that are sorted in one task.
MOST = 150
_SEGMENT = 1 << 20
_PLACE_BITS = 24
_AHEAD = rb"(?:[ \t\n\x0b\x0c\r]*+[^ \t\n\x0b\x0c\r]++){%d}"
_NEXT_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
_FAR = 1 << 60
_DRAWN = 40
_PATH = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("places", pa.list_(pa.int64())), ("left", pa.binary()), ("right", pa.binary())])


def _winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes its least, with its place in the lower bits; of equals, the last."""
    n = hashes.size
    low = np.uint64((1 << _PLACE_BITS) - 1)
    ranked = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))
    blocks = -(-n // width)
    padded = np.full(blocks * width, ~np.uint64(0), np.uint64)
    padded[:n] = ranked
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    return np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])


def _places(least: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << _PLACE_BITS) - 1)
    return (low - (np.unique(least) & low)).astype(np.int64)


def _batched(pieces: list[tuple], size: int = _SEGMENT // 2) -> Iterator[list[tuple]]:
    """Runs of pieces, whose last item is bytes, of about ``size`` bytes."""
    group, held = [], 0
    for p in pieces:
        if group and held + len(p[-1]) > size:
            yield group
            group, held = [], 0
        group.append(p)
        held += len(p[-1])
    if group:
        yield group


def byte_anchors(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces (text, start, bytes) of at least ``length`` bytes: text, places in it, hashes of the grams there."""
    width = length - gram + 1
    for group in _batched(pieces):
        raw = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
        sums, down = prefix_sums(raw)
        n = raw.size - gram + 1
        hashes = mix((sums[gram:] - sums[:n]) * down[:n])
        least, first = _winnow(hashes, width), 0
        for i, start, piece in group:
            where = _places(least[first : first + len(piece) - length + 1])
            yield i, where - first + start, hashes[where].view(np.int64)
            first += len(piece)


def _cut(raw: bytes, words: int) -> Iterator[tuple[int, bytes, int]]:
    """start, bytes and own bytes of a long text's pieces, cut at blanks; behind its own bytes a piece has ``words`` more words."""
    start, ahead = 0, re.compile(_AHEAD % (words + 1))
    while start < len(raw):
        cut = _NEXT_BLANK.search(raw, start + _SEGMENT) if start + _SEGMENT < len(raw) else None
        stop = cut.start() if cut else len(raw)
        more = ahead.match(raw, stop)
        yield start, raw[start : more.end() + 1 if more else len(raw)], stop - start
        start = stop


def anchors(raws: list[bytes], length: int = LENGTH, words: int = WORDS, gram: int = GRAM, gram_words: int = GRAM_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For a batch of texts: number of the text, places and gram hashes of its anchors.

    Grams of words hash their words alone: what stands between them is compared later.
    """
    pieces = [(i, start, own, part) for i, raw in enumerate(raws) if len(raw) >= min(length, 2 * words - 1) for start, part, own in _cut(raw, words)]
    inner, thin = words - 2, []
    width = inner - gram_words + 1
    for group in _batched(pieces):
        raw = np.frombuffer(b"\n".join([*(p[3] for p in group), b""]), np.uint8)
        offset = np.cumsum([0, *(len(p[3]) + 1 for p in group)])
        solid = ~BLANK[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], solid]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        sums, down = prefix_sums(raw)
        hashed = mix((sums[stops] - sums[starts]) * down[starts])
        n = starts.size - gram_words + 1
        grams = np.zeros(max(0, n), np.uint64)
        for k in range(gram_words if n > 0 else 0):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + n]
        grams = mix(grams)
        least = _winnow(grams, width) if n >= width else grams[:0]
        at = np.searchsorted(starts, offset)
        last = np.repeat(at[1:] - 1, np.diff(at))
        every = np.arange(starts.size)
        home = np.repeat(offset[:-1], np.diff(at))
        # the ``length`` bytes from p have word i as their first whole word, for p from ``low`` to ``high``
        low = np.where(every > np.repeat(at[:-1], np.diff(at)), np.concatenate([[0], starts[:-1]]), home)
        ahead = np.where(every + inner - 1 <= last, stops[np.minimum(every + inner - 1, starts.size - 1)], _FAR) if starts.size else every
        high = np.minimum(starts - 1, ahead - length)
        few = np.flatnonzero(high >= low)
        owner = np.repeat(np.arange(len(group)), np.diff(at))[few]
        for k, (i, start, own, part) in enumerate(group):
            f, count = at[k], at[k + 1] - at[k]
            if count >= inner:
                where = _places(least[f : f + count - inner + 1])
                yield i, starts[where] - offset[k] + start, grams[where].view(np.int64)
            stop = min(own - 1, len(raws[i]) - start - length) if start + own < len(raws[i]) else len(raws[i]) - start - length
            mine = few[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]
            spans = [(a, b) for a, b in zip((low[mine] - offset[k]).tolist(), (high[mine] - offset[k]).tolist(), strict=True) if a <= stop]
            spans.append((int(starts[at[k + 1] - 1] - offset[k]) if count else 0, stop))
            a = b = -2
            for x, y in [*spans, (_FAR, _FAR)]:
                if x > b + 1:
                    if b >= a >= 0 and a <= stop:
                        thin.append((i, start + a, start + min(b, stop)))
                    a = x
                b = max(b, y)
    parts = [(i, x, raws[i][x : min(x + _SEGMENT, b + 1) + length - 1]) for i, a, b in thin for x in range(a, b + 1, _SEGMENT)]
    yield from byte_anchors(parts, length, gram)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """Depth, first and last suffix of every interval; ``shared[i]``: common prefix of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


class RangeMin:
    """Minima over ranges of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= values.size:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of [a, b), not empty."""
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(a.size, np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][a[own]], self.levels[k][b[own] - (1 << k)])
        return out


Context = tuple[bytes, bytes]  # read away from the anchor to the left, and from its gram on to the right


def is_repeat(left: bytes, right: bytes, length: int, words: int) -> bool:
    """Whether a shared string counts; words that its ends cut are words."""
    return len(left) + len(right) >= length or (len(left) + len(right) >= 2 * words - 1 and len((left[::-1] + right).split()) >= words)


def maximal_repeats(kinds: list[Context], several: list[bool], length: int = LENGTH, words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray]]:
    """left extent, right extent and occurrences (numbers in ``kinds``) of the maximal repeats around one gram.

    ``kinds`` are different contexts in order of (right, left); ``several``
    tells which of them stand at more than one place.
    """
    m = len(kinds)
    for i, (a, b) in enumerate(kinds):
        if several[i] and is_repeat(a, b, length, words):
            yield len(a), len(b), np.array([i])
    if m < 2:
        return
    shared = [common(kinds[i][1], kinds[i + 1][1]) for i in range(m - 1)]
    order = np.array(sorted(range(m), key=lambda i: kinds[i][0]))
    beside = np.array([common(kinds[order[i]][0], kinds[order[i + 1]][0]) for i in range(m - 1)], np.int64)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    left, right = RangeMin(beside), RangeMin(np.array(shared, np.int64))
    for depth, first, last in intervals(shared):
        at = np.sort(rank[first : last + 1])
        near = left(at[:-1], at[1:])
        tail = kinds[first][1][:depth]
        need = max(0, min(length - depth, 2 * (words - len(tail.split())) - 1))
        far = np.flatnonzero(np.diff(np.concatenate([[False], near >= need, [False]]).astype(np.int8)))
        for x, y in zip(far[::2].tolist(), far[1::2].tolist(), strict=True):
            for extent, i, j in intervals(near[x:y].tolist()):  # here left extensions differ
                who = order[at[x + i : x + j + 1]]
                low, high = who.min(), who.max()
                if right(low[None], high[None])[0] == depth and is_repeat(kinds[who[0]][0][:extent], tail, length, words):
                    yield extent, depth, np.sort(who)


def _word_counts(texts: list[bytes]) -> np.ndarray:
    """Words in the first 0, 1, 2, ... bytes of every text; one that is cut is a word."""
    width = max(map(len, texts), default=0)
    raw = np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(len(texts), width)
    solid = ~BLANK[raw]
    begins = solid.copy()
    begins[:, 1:] &= ~solid[:, :-1]
    return np.concatenate([np.zeros((len(texts), 1), np.int32), np.cumsum(begins, 1, dtype=np.int32)], 1)


def reaches(kinds: list[Context], several: list[bool], length: int = LENGTH, words: int = WORDS) -> np.ndarray:
    """How far ``maximal_repeats`` reach from each context, to the left and to the right: of all, and of those of ``length`` bytes.

    The same scan, but of an interval's left extensions only the longest of
    each context is looked at.
    """
    m = len(kinds)
    reach = np.zeros((2, m, 2), np.int64)
    for i in (i for i in range(m) if several[i]):
        a, b = kinds[i]
        if is_repeat(a, b, length, words):
            reach[: 2 if len(a) + len(b) >= length else 1, i] = len(a), len(b)
    if m < 2:
        return reach
    shared = [common(kinds[i][1], kinds[i + 1][1]) for i in range(m - 1)]
    if m == 2:
        extent = common(kinds[0][0], kinds[1][0])
        if is_repeat(kinds[0][0][:extent], kinds[0][1][: shared[0]], length, words):
            found = np.array([extent, shared[0]])
            reach[: 2 if found.sum() >= length else 1] = np.maximum(reach[: 2 if found.sum() >= length else 1], found)
        return reach
    order = np.array(sorted(range(m), key=lambda i: kinds[i][0]))
    beside = np.array([common(kinds[order[i]][0], kinds[order[i + 1]][0]) for i in range(m - 1)], np.int64)
    if beside.max() + max(shared) < min(length, 2 * words - 1):
        return reach
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    left = RangeMin(beside)
    of_left, of_right = _word_counts([k[0] for k in kinds]), _word_counts([k[1] for k in kinds])
    blank = [bool(BLANK[k[0][0]]) if k[0] else True for k in kinds]
    at_anchor = np.array([not x and not BLANK[k[1][0]] for x, k in zip(blank, kinds, strict=True)], np.int32)  # a word on both sides is one
    for depth, first, last in intervals(shared):
        tail = int(of_right[first, depth])
        need = max(0, min(length - depth, 2 * (words - tail) - 1))
        if last - first + 1 == m:
            at, near = order, beside
        else:
            at = np.sort(rank[first : last + 1])
            near = left(at[:-1], at[1:])
            at = order[at]
        if near.max() < need:
            continue
        extent = np.maximum(np.concatenate([near, [0]]), np.concatenate([[0], near]))
        inside = np.flatnonzero(extent >= need)
        at, extent = at[inside], extent[inside]
        long = extent + depth >= length
        enough = long | (of_left[at, extent] + tail - at_anchor[at] * (extent > 0) >= words)
        for k, which in enumerate((enough, long)):
            if which.any():
                who = at[which]
                reach[k, who, 0] = np.maximum(reach[k, who, 0], extent[which])
                reach[k, who, 1] = np.maximum(reach[k, who, 1], depth)
    return reach


ROW = "g long, a long, b long, places array<long>, alone boolean, left binary, right binary"
SPAN = "a long, b long, start long, stop long, whole boolean"


class Spans:
    """What is repeated, as spans of texts; ``whole``: ``length`` bytes or more."""

    def __init__(self, length: int):
        self.length, self.rows = length, []

    def add(self, a: int, b: int, places: list[int], left: int, right: int, whole: bool) -> None:
        self.rows.extend((a, b, at - left, at + right, whole) for at in places)

    def take(self) -> pa.RecordBatch:
        c = list(zip(*self.rows, strict=True)) if self.rows else [()] * 5
        self.rows = []
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.bool_())], names=["a", "b", "start", "stop", "whole"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[Context, list[tuple]]]:
    """For rows in order of g: per group the rows of each context."""
    of, own = None, {}
    for batch in batches:
        for g, a, b, places, alone, left, right in columns(batch, "g", "a", "b", "places", "alone", "left", "right"):
            if g != of:
                if own:
                    yield own
                of, own = g, {}
            own.setdefault((left, right), []).append((a, b, places, alone))
    if own:
        yield own


def tree_spans(batches: Iterator[pa.RecordBatch], length: int, words: int, every: bool = False) -> Iterator[pa.RecordBatch]:
    """Spans of all groups: how far repeats reach from every context.

    ``every``: all occurrences of all maximal repeats, those in texts with copies too.
    """
    out = Spans(length)
    for own in _groups(batches):
        kinds = sorted(own, key=lambda c: (c[1], c[0]))
        several = [sum(len(r[2]) for r in own[c]) > 1 for c in kinds]
        if every:
            for extent, depth, who in maximal_repeats(kinds, several, length, words):
                for i in who.tolist():
                    for a, b, places, _ in own[kinds[i]]:
                        out.add(a, b, places, extent, depth, extent + depth >= length)
                if len(out.rows) > 1 << 15:
                    yield out.take()
            continue
        reach = reaches(kinds, several, length, words)
        for i in np.flatnonzero(reach[0].any(1)).tolist():
            wide, whole = reach[0, i].tolist(), reach[1, i].tolist()
            for a, b, places, alone in own[kinds[i]]:
                if alone:
                    if wide != whole:
                        out.add(a, b, places, *wide, False)
                    if any(whole):
                        out.add(a, b, places, *whole, True)
        if len(out.rows) > 1 << 15:
            yield out.take()
    yield out.take()


def _branch(g: int, side: bytes, depth: int, byte: int) -> int:
    return xxhash.xxh64_intdigest(g.to_bytes(8, "little", signed=True) + side + depth.to_bytes(4, "little") + bytes([byte])) - (1 << 63)


def along_paths(batches: Iterator[pa.RecordBatch], length: int, words: int, every: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows with their group's path -> spans (g null) and rows of the branches; ``every``: spans of texts with copies too."""
    out, held, size = Spans(length), [], 0
    paths: dict[int, dict] = {}
    names = [*(x.split()[0] for x in ROW.split(", ")), "start", "stop", "whole"]

    def spans() -> pa.RecordBatch:
        s = out.take()
        n = s.num_rows
        none = [pa.nulls(n, t) for t in (pa.list_(pa.int64()), pa.bool_(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), s.column(0), s.column(1), *none, *s.columns[2:]], names=names)

    def branches() -> pa.RecordBatch:
        c = list(zip(*held, strict=True)) if held else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.binary(), pa.binary())
        n = len(held)
        held.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(c, kinds, strict=True)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())], names=names)

    def tell(path: dict) -> None:
        for whole in (False, True):
            if path[whole][1]:
                out.add(*path["row"], *path[whole], whole)

    for batch in batches:
        for g, a, b, places, alone, left, right, path in columns(batch, "g", "a", "b", "places", "alone", "left", "right", "path"):
            if path is None:  # none was drawn
                held.append((g, a, b, places, alone, left, right))
                size += len(left) + len(right)
                continue
            if len(places) > 1 and (alone or every) and is_repeat(left, right, length, words):
                out.add(a, b, places, len(left), len(right), len(left) + len(right) >= length)
            own = paths.get(g) or paths.setdefault(g, {"row": (path["a"], path["b"], path["places"]), False: [0, 0], True: [0, 0]})
            self_row = (a, b, places[0]) == (path["a"], path["b"], path["places"][0])
            if self_row:
                continue
            x, y = common(left, path["left"]), common(right, path["right"])
            if is_repeat(left[:x], right[:y], length, words):
                if alone or every:
                    out.add(a, b, places, x, y, x + y >= length)
                for whole in (False, True) if x + y >= length else (False,):
                    own[whole] = [max(own[whole][0], x), max(own[whole][1], y)]
            if x < len(left):  # what shares more on the right than the path tells is in a branch on the right
                held.append((_branch(g, b"l", x, left[x]), a, b, places, alone, left, right[:y]))
                size += len(left) + y
            if y < len(right):
                held.append((_branch(g, b"r", y, right[y]), a, b, places, alone, left, right))
                size += len(left) + len(right)
            if size > 4 << 20:
                yield branches()
                size = 0
            if len(out.rows) > 1 << 15:
                yield spans()
        if len(paths) > 4096:
            for path in paths.values():
                tell(path)
            paths.clear()
    for path in paths.values():
        tell(path)
    yield branches()
    yield spans()


def _lists(column: pa.ListArray, *names: str) -> Iterator[tuple]:
    """Of a column of lists of structs: the number of each list, and its fields as arrays."""
    offsets, values = column.offsets.to_numpy(), column.values
    fields = [values.field(n).to_numpy(zero_copy_only=False) for n in names]
    for i in range(len(column)):
        x, y = int(offsets[i]), int(offsets[i + 1])
        yield (i, *(f[x:y] for f in fields))


def contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of ROW for texts with marks; the places that one text has in one context, as in a periodic text, share a row."""
    held: dict[tuple, list[int]] = {}
    size = 0

    def take() -> pa.RecordBatch:
        g, a, b, alone, left, right = zip(*held, strict=True) if held else ((),) * 6
        arrays = [pa.array(x, pa.int64()) for x in (g, a, b)] + [pa.array(list(held.values()), pa.list_(pa.int64())), pa.array(alone, pa.bool_())]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.binary()) for x in (left, right))], names=[x.split()[0] for x in ROW.split(", ")])

    for batch in batches:
        for i, g_all, at_all in _lists(batch.column(4), "g", "at"):
            a, b, copies, text = (batch.column(k)[i].as_py() for k in range(4))
            raw = text.encode()
            order = np.lexsort((g_all, at_all))
            for g, at in zip(g_all[order].tolist(), at_all[order].tolist(), strict=True):
                left, right = raw[max(0, at - length) : at][::-1], raw[at : at + length]
                places = held.setdefault((g, a, b, copies == 1, left, right), [])
                size += 8 if places else len(left) + len(right)
                places.append(at)
                if size > 4 << 20:
                    yield take()
                    held.clear()
                    size = 0
    yield take()


class Repeats:
    """The rows of ``docs``, their classes of equal texts, and the contexts of repeated grams in groups that fit a task."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, length: int, words: int, gram: int, gram_words: int, most: int, every: bool = False):
        if not 0 < gram <= length or not 0 < gram_words <= words - 2:
            raise ValueError("grams must fit into length and words - 2")
        self.length, self.words, self.every = length, words, every
        least = min(length, 2 * words - 1)
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        half = lambda at: F.expr(f"cast(conv(substring(sha256, {at}, 16), 16, -10) as bigint)")
        base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("n_bytes"))
        self.base = base.withColumn("a", half(1)).withColumn("b", half(17))
        enough = self.base.where(F.col("n_bytes") >= least)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    rows = list(columns(whole.slice(start, 1024), "a", "b", "text"))
                    got = list(anchors([r[2].encode() for r in rows], length, words, gram, gram_words))
                    if got:
                        owner = np.repeat([g[0] for g in got], [g[1].size for g in got])
                        a, b = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                        arrays = [pa.array(np.concatenate([g[2] for g in got])), pa.array(a[owner]), pa.array(b[owner]), pa.array(np.concatenate([g[1] for g in got]))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["g", "a", "b", "at"])

        marks = staged(enough.select("a", "b", "text").mapInArrow(find, "g long, a long, b long, at long"), "anchors")
        # copies have the same a, b and place: they are one occurrence
        several = marks.groupBy("g").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("a", "b", "at") for f in (F.min, F.max)])
        several = staged(several.where("a_min < a_max or b_min < b_max or at_min < at_max").select("g"), "repeated-grams")
        lists = marks.join(several, "g").groupBy("a", "b").agg(F.collect_set(F.struct("g", "at")).alias("marks"))
        self.classes = enough.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
        wanted = lists.join(self.classes, ["a", "b"]).select(F.col("a").alias("wa"), F.col("b").alias("wb"), "rep", "copies", "marks")
        # one text of each class; with the id in the key, copies are dealt out evenly
        texts = enough.select("id", "a", "b", "text").join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")))
        self.texts = staged(texts.select("a", "b", "copies", "text", "marks"), "repeat-texts")
        rows = staged(self.texts.mapInArrow(lambda b: contexts(b, length), ROW), "contexts")
        sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.max(F.size("places")).alias("p")).where("m > 1 or p > 1")
        self.groups: list[DataFrame] = []
        self.spans: list[DataFrame] = []
        while True:
            sizes = staged(sizes.select("g", "m"), "group-sizes")
            large = sizes.where(F.col("m") > most)
            self.groups.append(rows.join(sizes.where(F.col("m") <= most).select("g"), "g", "left_semi"))
            if large.isEmpty():
                break
            found = staged(self._split(staged(rows.join(large, "g"), "crowded"), len(self.groups)), "branches")
            self.spans.append(found.where("g is null").select("a", "b", "start", "stop", "whole"))
            rows = found.where("g is not null").select(*rows.columns)
            sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")

    def _split(self, crowd: DataFrame, turn: int) -> DataFrame:
        """One step down the trees of large groups; crowd: rows with their groups' sizes."""
        unit = F.pmod(F.xxhash64(F.lit(turn), "g", "a", "b", F.element_at("places", 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        drawn = crowd.where(unit * F.col("m") < _DRAWN).select("g", "a", "b", "places", "left", "right")

        def best(part: pa.Table) -> pa.Table:
            rows = part.select(["left", "right"]).to_pylist()
            of = [sum(common(r["left"], o["left"]) + common(r["right"], o["right"]) for o in rows) for r in rows]
            chosen = part.slice(max(range(len(rows)), key=lambda i: (of[i], part.column("a")[i].as_py(), part.column("b")[i].as_py())), 1)
            return pa.table({"g": chosen.column("g"), "path": pa.array(chosen.drop_columns("g").to_pylist(), _PATH)})

        paths = drawn.groupBy("g").applyInArrow(best, "g long, path struct<a: long, b: long, places: array<long>, left: binary, right: binary>")
        # a plain equi-join, which the adaptive planner splits at a hot group
        length, words, every = self.length, self.words, self.every
        return crowd.drop("m").join(paths, "g", "left").mapInArrow(lambda b: along_paths(b, length, words, every), f"{ROW}, start long, stop long, whole boolean")

    def sorted_groups(self) -> DataFrame:
        """All groups of at most ``most`` rows, each in one partition and in a row."""
        rows = self.groups[0]
        for more in self.groups[1:]:
            rows = rows.unionByName(more)
        return rows.repartition("g").sortWithinPartitions("g")

    def all_spans(self) -> DataFrame:
        length, words, every = self.length, self.words, self.every
        spans = self.sorted_groups().mapInArrow(lambda b: tree_spans(b, length, words, every), SPAN)
        for more in self.spans:
            spans = spans.unionByName(more)
        return spans


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Spans that touch or overlap, as one."""
    if not starts.size:
        return []
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], ends.size) - 1].tolist(), strict=True))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    words: int = WORDS,
    gram: int = GRAM,
    gram_words: int = GRAM_WORDS,
    most: int = MOST,
) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, spans (start, stop) for every row of ``docs``.

    Removed is every byte covered by a string of ``length`` bytes that also
    starts anywhere else in the texts of ``docs``, the same text included.
    ``n_passages`` counts the runs of bytes covered by repeats of ``length``
    bytes or ``words`` words (words cut at its ends counted); for shared
    passages shorter than ``length`` this is the only trace.  Null texts are
    empty.  Rows with equal texts, repeated rows included, are copies of each
    other.  Ids may be null or repeated; other columns are ignored, whatever
    their names; an empty table gives no rows.  ``gram``, ``gram_words`` and
    ``most`` change the plan, not the result.
    """
    repeats = Repeats(docs, id_col, text_col, length, words, gram, gram_words, most)
    spans = repeats.all_spans().groupBy("a", "b").agg(F.collect_list(F.struct("start", "stop", "whole")).alias("spans"))
    repeated = repeats.texts.where("copies = 1").select("a", "b", "text").join(spans, ["a", "b"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, starts, stops, whole in _lists(batch.column(3), "start", "stop", "whole"):
                a, b, text = (batch.column(k)[i].as_py() for k in range(3))
                raw, gone = text.encode(), merged(starts[whole], stops[whole])
                sha, at = hashlib.sha256(), 0
                for start, stop in gone:
                    sha.update(raw[at:start])
                    at = stop
                sha.update(raw[at:])
                passages = len(merged(starts, stops))
                rows.append((a, b, sum(y - x for x, y in gone), [{"start": x, "stop": y} for x, y in gone], sha.hexdigest(), passages))
            c = list(zip(*rows, strict=True)) if rows else [()] * 6
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), kind, pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["a", "b", "n", "spans", "kept", "passages"])

    done = repeated.mapInArrow(cut, "a long, b long, n long, spans array<struct<start:bigint,stop:bigint>>, kept string, passages long")
    # staged, so that the rows' join is one of two exchanges, which the adaptive planner splits at a text with many copies
    facts = staged(repeats.classes.join(done, ["a", "b"], "left").where("copies > 1 or n is not null"), "repeat-facts")
    wordy = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= words
    rows = repeats.base.select("id", "a", "b", "n_bytes", "sha256", F.when(F.col("n_bytes") < length, wordy).otherwise(F.lit(True)).alias("wordy")).join(facts, ["a", "b"], "left")
    copied, part = F.coalesce(F.col("copies") > 1, F.lit(False)), F.col("n").isNotNull()
    whole = copied & (F.col("n_bytes") >= length)
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return rows.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).when(part, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(part, F.size("spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).when(part, F.col("kept")).otherwise(F.col("sha256")).alias("kept_sha256"),
        F.when(copied & F.col("wordy"), F.lit(1)).when(part, F.col("passages")).otherwise(F.lit(0)).cast("long").alias("n_passages"),
        F.when(whole, span).when(part, F.col("spans")).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
    )


def repeat_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    words: int = WORDS,
    gram: int = GRAM,
    gram_words: int = GRAM_WORDS,
    most: int = MOST,
) -> DataFrame:
    """repeat (SHA-256 of its bytes), n_bytes, id, start: the occurrences of maximal repeats of ``length`` bytes or ``words`` words.

    Repeats are followed for ``length`` bytes on either side of an anchor;
    texts with copies are repeats as a whole.  Where a gram's tree was taken
    apart along a path, an occurrence stands under the repeat that it shares
    with the path.  Nulls, ties and repeated rows as in ``remove_repeats``.
    """
    repeats = Repeats(docs, id_col, text_col, length, words, gram, gram_words, most, every=True)
    spans = repeats.all_spans().groupBy("a", "b").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = repeats.texts.select("a", "b", "text").join(spans, ["a", "b"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, found in columns(batch, "a", "b", "text", "spans"):
                raw = text.encode()
                own = sorted({(s["start"], s["stop"]) for s in found})
                keys = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in own]
                arrays = [pa.array(keys, pa.string()), *(pa.array(v, pa.int64()) for v in ([y - x for x, y in own], [a] * len(own), [b] * len(own), [x for x, _ in own]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["repeat", "n_bytes", "a", "b", "start"])

    found = rows.mapInArrow(named, "repeat string, n_bytes long, a long, b long, start long").distinct()
    ids = repeats.base.select("id", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("sha256"), F.col("n_bytes").alias("_n"))
    wordy = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= words
    copied = repeats.classes.where("copies > 1").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    whole = repeats.base.where((F.col("n_bytes") >= length) | wordy).withColumnsRenamed({"a": "_a", "b": "_b"}).join(copied, ["_a", "_b"], "left_semi")
    parts = found.join(ids, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("repeat", "n_bytes", "id", "start")
    return parts.unionByName(whole.select(F.col("sha256").alias("repeat"), "n_bytes", "id", F.lit(0).cast("long").alias("start"))).distinct().withColumnRenamed("id", id_col)
