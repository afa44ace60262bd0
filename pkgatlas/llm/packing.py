"""Packing: sum-of-squares online packing of token documents into windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgatlas.llm.common import text_or_empty
from pkgatlas.llm.tokens import PieceEncoder

WINDOW = 4096
OPEN_WINDOWS = 1024
#: Sequence numbers of one task begin at its number times this.
TASK_STRIDE = 1 << 33


class SquaresPacker:
    """Places pieces one by one; ``level`` counts the partially filled windows at each fill.

    A piece of s tokens goes to the fill h (0: a new window) for which the sum of the squared
    counts grows least: the window leaves level h and enters level h + s, or is closed when
    full. When ``open_windows`` are open, and at the end, the fullest are topped up with tokens
    cut from the emptiest, so what stays in memory is bounded and little is padded.
    """

    def __init__(self, window: int, open_windows: int, first_id: int) -> None:
        self.window, self.most, self.next_id = window, open_windows, first_id
        self.level = np.zeros(window + 1, np.int64)
        self.held: list[list[list]] = [[] for _ in range(window + 1)]  # windows by fill
        self.n_open = 0
        self.closed: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def _put(self, pieces: list, fill: int) -> None:
        if fill == self.window:
            self._close(pieces)
        else:
            self.held[fill].append(pieces)
            self.level[fill] += 1
            self.n_open += 1

    def _take(self, fill: int) -> list:
        self.level[fill] -= 1
        self.n_open -= 1
        return self.held[fill].pop()

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self._put([(doc, start, ids[start : start + self.window], total)], self.window)
            start += self.window
        size = total - start
        if size:
            piece = (doc, start, ids[start:].copy(), total)  # not a view that holds a whole chunk
            # growth of the sum of squares, halved: enter h + s, leave h
            fills = self.level[: self.window - size + 1]
            entered = self.level[size : self.window + 1].astype(np.float64)
            entered[-1] = -0.5  # a full window is no longer counted
            growth = entered - fills + 1.0
            growth[0] = entered[0] + 0.5
            growth[1:][fills[1:] == 0] = np.inf
            # ties go to the fuller window
            best = len(growth) - 1 - int(np.argmin(growth[::-1]))
            window = self._take(best) if best else []
            window.append(piece)
            self._put(window, best + size)
            if self.n_open > self.most:
                self.settle(self.most // 2)

    def settle(self, leave: int) -> None:
        """Close windows until ``leave`` are open, topping the fullest up from the emptiest."""
        while self.n_open > max(leave, 1):
            full = int(np.flatnonzero(self.level)[-1])
            window = self._take(full)
            room = self.window - full
            while room and self.n_open:
                low = int(np.flatnonzero(self.level)[0])
                donor = self._take(low)
                doc, start, ids, total = donor.pop()
                cut = min(room, len(ids))
                # the tail is moved, so what stays keeps its start
                keep = len(ids) - cut
                window.append((doc, start + keep, ids[keep:], total))
                if keep:
                    donor.append((doc, start, ids[:keep], total))
                room -= cut
                if donor:
                    self._put(donor, low - cut)
            self._close(window)

    def finish(self) -> None:
        self.settle(1)
        for fill in np.flatnonzero(self.level).tolist():
            while self.level[fill]:
                self._close(self._take(fill))

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.closed)) if self.closed else [()] * 7
        self.closed = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def _pack_task(make: Callable[[str, int], PieceEncoder], path: str, end_id: int, window: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make(path, end_id)
        packer = SquaresPacker(window, open_windows, TaskContext.get().partitionId() * TASK_STRIDE)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                packer.add(doc, ids)
                if len(packer.closed) >= 500:
                    yield packer.drain()
        packer.finish()
        if packer.closed:
            yield packer.drain()

    return run


def pack(
    docs: DataFrame,
    make_encoder: Callable[[str, int], PieceEncoder],
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pieces of token documents: id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    Every document's ids end with ``end_id``. One of ``window`` ids or more is cut into full
    windows first; the rest is placed whole by the sum-of-squares rule, and cut only to top up
    windows when too many are open or the task ends. Each task packs its own documents as they
    come, with no shuffle, and leaves one sequence that is not full; memory is bounded by
    ``open_windows`` windows. Pieces of a sequence lie side by side from offset 0.

    A null or empty text is the end id alone. Rows with the same id, and null ids, are packed
    like any other row. Further columns are ignored; an empty table gives an empty table.
    """
    pieces = docs.select(
        F.col(id_col).cast("long").alias("doc"), text_or_empty(F.col(text_col)).cast("binary").alias("text")
    ).mapInArrow(
        _pack_task(make_encoder, tokenizer_path, end_id, window, open_windows),
        "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return pieces.withColumnRenamed("doc", id_col)
