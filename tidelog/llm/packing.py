"""Sum-of-squares online packing of token sequences.

The level array holds, for every fill level 0 < h < size, how many windows
stand at that level.  A piece of s tokens goes to the level h (0: a new
window) for which the sum of the squared counts after the placement is
smallest, windows that become full leaving the array.  Documents of ``size``
tokens or more first give up whole windows.

Each task packs its own stream, so there is no shuffle at all.  At the end of
a task, and whenever more than ``most_open`` windows are open, the open
windows are drained: their pieces are laid end to end and cut where a window
is full, so that a drain leaves one window short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import Emitter, columns
from tidelog.llm.tokens import encoder, vocabulary_path

SIZE = 2048
END_ID = 1
MOST_OPEN = 4096
SCHEMA = "{id} long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
)

Piece = tuple  # (doc id, start, number of tokens, tokens of the document, ids)


class SumOfSquares:
    """Packs pieces of less than ``size`` tokens; gives back windows that are full."""

    def __init__(self, size: int = SIZE):
        self.size = size
        self.windows: dict[int, list[list[Piece]]] = {}
        self.open = 0
        # cost of moving a window from h to h + s, up to a constant: gain[h + s] - loss[h]
        self.gain, self.loss = np.zeros(size + 1), np.full(size + 1, -np.inf)
        self.gain[size], self.loss[0] = -0.5, 0.5

    def _count(self, level: int, by: int) -> None:
        self.gain[level] += by
        self.loss[level] = self.gain[level] if self.gain[level] else -np.inf
        self.open += by

    def place(self, piece: Piece) -> list[Piece] | None:
        """Place a piece; the window's pieces if that filled it."""
        n = piece[2]
        cost = self.gain[n:] - self.loss[: self.size + 1 - n]
        level = cost.size - 1 - int(np.argmin(cost[::-1]))  # of equal costs, the fullest window
        window = []
        if level:
            window = self.windows[level].pop()
            self._count(level, -1)
        window.append(piece)
        if level + n == self.size:
            return window
        self.windows.setdefault(level + n, []).append(window)
        self._count(level + n, 1)
        return None

    def drain(self) -> Iterator[list[Piece]]:
        """All open windows, refilled by cutting pieces; only the last is short."""
        rest = [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        self.__init__(self.size)
        window, room = [], self.size
        for doc, start, n, total, ids in rest:
            at = 0
            while at < n:
                step = min(room, n - at)
                window.append((doc, start + at, step, total, ids[4 * at : 4 * (at + step)]))
                at, room = at + step, room - step
                if not room:
                    yield window
                    window, room = [], self.size
        if window:
            yield window


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    most_open: int = MOST_OPEN,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Pack all documents; one row per piece, with its ids as little-endian 32-bit integers.

    ``added``: tokens, with their ids, that are found in a text before it is
    encoded; without them their strings are ordinary text.

    A null or empty text is ``end_id`` alone.  Pieces of a sequence lie gapless
    from offset 0.  Null ids stay null; repeated rows are packed each; other
    columns are ignored; an empty table gives no rows.  ``sequence_id`` holds
    the task's number in its upper bits: the same files read in the same
    splits give the same sequences, so a task that runs again after a lost
    executor agrees with its first run.
    """
    path = tokenizer or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, end = encoder(path), np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        packer, out = SumOfSquares(size), Emitter(ARROW)

        def emit(window: list[Piece]) -> None:
            nonlocal next_id
            at = 0
            for doc, start, n, total, ids in window:
                out.add((doc, start, n, total, next_id, at, ids), len(ids))
                at += n
            next_id += 1

        for batch in batches:
            for doc, text in columns(batch, "_id", "_text"):
                ids = tool.encode_added(text or "", added or {}) + end
                total = len(ids) // 4
                whole = total - total % size
                for start in range(0, whole, size):
                    emit([(doc, start, size, total, ids[4 * start : 4 * (start + size)])])
                    if out.full():
                        yield out.take()
                if total > whole and (window := packer.place((doc, whole, total - whole, total, ids[4 * whole :]))):
                    emit(window)
                if packer.open > most_open:
                    for window in packer.drain():
                        emit(window)
                if out.full():
                    yield out.take()
        for window in packer.drain():
            emit(window)
            if out.full():
                yield out.take()
        if out.rows:
            yield out.take()

    schema = SCHEMA.format(id=f"`{id_col}`")
    named = docs.selectExpr(f"cast(`{id_col}` as long) as _id", f"cast(`{text_col}` as string) as _text")
    renamed = ARROW.names[1:]
    made = named.mapInArrow(lambda b: (x.rename_columns([id_col, *renamed]) for x in run(b)), schema)
    return made
