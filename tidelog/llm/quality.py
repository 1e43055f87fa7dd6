"""Quality rules with a line labeller.

Counts over words, lines and windows reject the plain cases.  For the rest, a
linear-chain conditional random field labels every line with words as content
or boilerplate (Viterbi decoding); a document stays if enough of its words
stand in content lines.

The field is trained by gradient on the log-likelihood, from a bounded sample
of documents with a quality label.  Labels of lines are not known; they are
found by turns (hard EM): a first field without transitions tells lines apart
by their document's label; then every line takes its label in the best
labelling, but so that the document's share of content agrees with its label,
and the field, transitions included, is fitted to those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import columns

#: Bound of the training sample, in labelled documents.
SAMPLE_DOCS = 3000
#: Training texts of more lines are taken as several runs of so many neighbouring lines.
RUN_LINES = 64
CONTENT_SHARE = 0.5
LEAST_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20  # percent of words
SYMBOLS = "#*$%&|<>"
_SYMBOLS = str.maketrans("", "", SYMBOLS)
_BLANK_BYTES = b" \t\n\x0b\x0c\r"
_FEW = 1 << 15
_OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines long, content_words long, content_share double, kept boolean"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, all of its places counted."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n < _FEW and len(set(zip(*(words[i:] for i in range(window)), strict=False))) == n:
        return 0  # the usual case, told at once
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # windows get their numbers by doubling: a window of a + b words is a pair of a window of a and one of b
    parts, at, rank = [], 0, ids
    length = 1
    while True:
        if window & length:
            parts.append((at, length, rank))
            at += length
        if 2 * length > window:
            break
        pair = rank[: ids.size - 2 * length + 1] * np.int64(ids.size + 1) + rank[length : ids.size - length + 1]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        length *= 2
    whole = None
    for at, _, rank in parts:
        part = rank[at : at + n]
        whole = part if whole is None else np.unique(whole * np.int64(ids.size + 1) + part, return_inverse=True)[1].astype(np.int64)
    counts = np.bincount(whole)
    again = counts[whole] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    lines: list[str] = field(repr=False)
    again: list[bool] = field(repr=False)

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def count(text: str | None) -> Counts:
    """Base counts; ``lines`` are those with a word, ``again`` whether they equal an earlier one."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    # characters less blanks: every character that is not an ASCII blank lies in a word
    chars = len(text) - (len(raw) - len(raw.translate(None, _BLANK_BYTES)))
    seen: set[str] = set()
    lines, again, dup = [], [], 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines.append(line)
            again.append(line in seen)
            dup += line in seen
            seen.add(line)
    return Counts(len(words), chars, len(text) - len(text.translate(_SYMBOLS)), dup, repeated_words(words), lines, again)


N_FEATURES = 13


def features(lines: list[str], again: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """A row per line, and its words."""
    rows, words = [], []
    for line, dup in zip(lines, again, strict=True):
        raw = line.encode()
        size, w = len(raw), raw.split()
        n, kinds = len(w), len(set(w))
        letters = size - len(raw.translate(None, _LETTERS))
        marks = size - len(raw.translate(None, _MARKS))
        words.append(n)
        rows.append(
            (
                1.0,
                min(n, 40) / 40,
                letters / size,
                (size - len(raw.translate(None, _UPPER))) / max(1, letters),
                min(1.0, 4 * marks / n),
                min(1.0, raw.count(b"|") * 2 / n),
                min(1.0, raw.count(b"!") * 2 / n),
                kinds / n,
                kinds * 2 < n,
                dup,
                line.rstrip().endswith((".", "!", "?", ":")),
                min(1.0, (size - len(raw.translate(None, _DIGITS))) * 4 / size),
                n < 4,
            )
        )
    return np.array(rows, float).reshape(-1, N_FEATURES), np.array(words, np.int64)


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_MARKS = SYMBOLS.encode()


class LineField:
    """Linear-chain conditional random field over two labels: 0 boilerplate, 1 content."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((2, N_FEATURES)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def viterbi(self, rows: np.ndarray) -> np.ndarray:
        """The best labelling; of equal ones, content."""
        n = len(rows)
        if not n:
            return np.zeros(0, np.int8)
        unit = (rows @ self.weights.T).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = unit[0]
        back: list[tuple[int, int]] = []
        for u0, u1 in unit[1:]:
            from0, from1 = int(b + m10 >= a + m00), int(b + m11 >= a + m01)
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + u0, (b + m11 if from1 else a + m01) + u1
        labels = np.zeros(n, np.int8)
        at = int(b >= a)
        labels[-1] = at
        for i in range(n - 2, -1, -1):
            at = back[i][at]
            labels[i] = at
        return labels

    def gradient(self, rows: np.ndarray, labels: np.ndarray, sizes: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the scaled log-likelihood of labelled sequences, padded to one length, by forward and backward sums."""
        n, longest, _ = rows.shape
        unit = rows @ self.weights.T
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = unit[:, 0]
        for i in range(1, longest):
            before = ahead[:, i - 1, :, None] + self.moves
            ahead[:, i] = unit[:, i] + np.logaddexp(before[:, 0], before[:, 1])
        for i in range(longest - 2, -1, -1):
            after = self.moves + (unit[:, i + 1] + behind[:, i + 1])[:, None, :]
            behind[:, i] = np.where((i + 1 < sizes)[:, None], np.logaddexp(after[:, :, 0], after[:, :, 1]), 0.0)
        each, inside = np.arange(n), np.arange(longest) < sizes[:, None]
        log_z = np.logaddexp(*ahead[each, sizes - 1].T)
        own = np.exp(ahead + behind - log_z[:, None, None]) * inside[:, :, None]
        truth = np.eye(2)[labels] * inside[:, :, None]
        gold = (unit * truth).sum((1, 2))
        moved = np.zeros((2, 2))
        if longest > 1:
            both = inside[:, 1:, None, None]
            pair = np.exp(np.where(both, ahead[:, :-1, :, None] + self.moves + (unit + behind)[:, 1:, None, :] - log_z[:, None, None, None], -np.inf))
            seen = truth[:, :-1, :, None] * truth[:, 1:, None, :]
            gold += (seen * self.moves).sum((1, 2, 3))
            moved = np.einsum("n,ntij->ij", scale, seen - pair)
        return np.einsum("n,ntk,ntf->kf", scale, truth - own, rows), moved, float(scale @ (gold - log_z))

    def _ascend(self, rows: np.ndarray, labels: np.ndarray, sizes: np.ndarray, scale: np.ndarray, moves: bool, steps: int = 120, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Adaptive gradient steps."""
        lines = float(scale @ sizes)
        sums = [np.full(self.weights.shape, 1e-8), np.full(self.moves.shape, 1e-8)]
        for _ in range(steps):
            g_w, g_m, _ = self.gradient(rows, labels, sizes, scale)
            for p, g, s in ((self.weights, g_w, sums[0]), (self.moves, g_m, sums[1]))[: 1 + moves]:
                g = g / lines - decay * p
                s += g * g
                p += rate * g / np.sqrt(s)

    def lines_of(self, rows: np.ndarray, words: np.ndarray, label: int) -> np.ndarray:
        """The best labelling whose share of content agrees with the document's label; the least certain lines give way."""
        labels = self.viterbi(rows)
        margin = (rows @ (self.weights[1] - self.weights[0])) * (1 if label else -1)
        wrong = np.flatnonzero(labels != label)
        for i in wrong[np.argsort(-margin[wrong], kind="stable")].tolist():
            content = words[labels == 1].sum()
            if (content >= CONTENT_SHARE * words.sum()) == bool(label):
                break
            labels[i] = label
        return labels

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray, int]], turns: int = 2) -> LineField:
        """From features and words of the lines, and the label, of each document; both labels have equal weight."""
        of = [sum(y == k for *_, y in documents) for k in (0, 1)]
        if not all(of):
            return self
        runs = [(d, at, min(RUN_LINES, len(rows) - at)) for d, (rows, _, _) in enumerate(documents) for at in range(0, len(rows), RUN_LINES)]
        sizes = np.array([n for *_, n in runs])
        scale = np.array([len(documents) / (2 * of[documents[d][2]]) for d, *_ in runs])
        rows = np.zeros((len(runs), sizes.max(), N_FEATURES))
        for k, (d, at, n) in enumerate(runs):
            rows[k, :n] = documents[d][0][at : at + n]
        for turn in range(turns):
            labels = np.zeros(rows.shape[:2], int)
            found = [np.full(len(x), y) if not turn else self.lines_of(x, words, y) for x, words, y in documents]
            for k, (d, at, n) in enumerate(runs):
                labels[k, :n] = found[d][at : at + n]
            self._ascend(rows, labels, sizes, scale, moves=turn > 0)
        return self


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """A field from a bounded sample (by a hash of the id) of labelled documents that pass the base rules.

    ``labels``: id, quality (0 or 1; other values, nulls and ids with both are
    left out).  Of rows with one id, equal texts count once.  Without documents
    of both kinds the weights are zero, and every line is content.
    """
    named = lambda c: F.col(f"`{c}`")
    known = labels.where("quality in (0, 1)").groupBy(named(id_col).alias("_l")).agg(F.min("quality").cast("int").alias("_y"), F.max("quality").cast("int").alias("_z"))
    known = known.where("_y = _z and _l is not null").select("_l", "_y")
    # the smallest hashes of either kind: a top-k over the labels, whatever their number
    kinds = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_l"), "_l").limit(sample_docs // 2) for y in (0, 1)]
    sample = kinds[0].unionByName(kinds[1])
    texts = docs.select(named(id_col).alias("_d"), named(text_col).cast("string").alias("_t")).join(F.broadcast(sample), F.col("_d") == F.col("_l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ys, rows, words = [], [], [], []
            for key, y, text in columns(batch, "_k", "_y", "_t"):
                c = count(text)
                if c.failed or not c.lines:
                    continue
                f, w = features(c.lines, c.again)
                keys.append(key)
                ys.append(y)
                rows.append(f.ravel().tolist())
                words.append(w.tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(ys, pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int64()))], names=["k", "y", "f", "w"]
            )

    found = texts.select(F.sha2("_t", 256).alias("_k"), "_y", "_t").mapInArrow(run, "k string, y int, f array<double>, w array<long>").collect()
    by_text = {(r["k"], r["y"]): (np.array(r["f"]).reshape(-1, N_FEATURES), np.array(r["w"]), r["y"]) for r in found}
    return LineField().fit([by_text[k] for k in sorted(by_text)])


def judge(docs: DataFrame, model: LineField, text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` with the counts, the content share and ``kept`` behind its columns.

    Columns of those names are replaced.  A null or empty text has no words
    and fails; rows are judged one by one, repeated rows alike.  Of a text
    that the base rules pass, at least one line has words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dozen numbers
    made = [x.split()[0] for x in _OUT.split(", ")]
    keep = [c for c in docs.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows = []
                for (text,) in columns(batch, "_text"):
                    c = count(text)
                    content, good = 0, False
                    if c.lines:
                        f, words = features(c.lines, c.again)
                        content = int(words[chain.viterbi(f) == 1].sum())
                    part = content / c.n_words if c.n_words else 0.0
                    good = not c.failed and part >= share
                    rows.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.failed, len(c.lines), content, part, good))
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(made)
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
                own = [batch.column(batch.schema.get_field_index(f"_k{i}")) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names=[*(f"_k{i}" for i in range(len(keep))), *made])

    named = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = T.StructType([T.StructField(f"_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    for made_as in _OUT.split(", "):
        schema = schema.add(*made_as.split())
    out = named.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *made)
