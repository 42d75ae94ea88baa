"""Sum-of-squares online packing of token sequences into windows.

A task keeps an array with the number of open windows of each fill level.  A
document goes to the level for which the sum of the squared counts of partially
filled windows is least afterwards; level 0 opens a window.  Full windows leave
at once.  What is longer than a window is cut into whole windows and a rest.

When a task ends, or holds ``max_open`` windows, its open windows are drained:
pieces of the emptiest fill up the fullest, cut where they meet the end.  Of the
one window that can be left, every power of two in its length becomes a sequence
of its own, which needs no padding.

Each task packs the rows that it reads, so nothing is shuffled, a hot source is
of no matter, and a repeated task makes the same sequences.  A task holds the
open windows (8 KB each) and one batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import bound_batches
from graphlake.llm.tokenizing import encode_texts, forget

END = np.asarray([1], "<u4").tobytes()
WIDTH = 4
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Packs one stream of documents; ``out`` gathers finished rows."""

    def __init__(self, window: int = 2048, first_id: int = 0, max_open: int = 4096) -> None:
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // WIDTH
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            self._emit([(doc_id, at, ids[at * WIDTH : (at + self.window) * WIDTH], n)])
        if whole < n:
            self._place((doc_id, whole, ids[whole * WIDTH :], n), n - whole)

    def _place(self, piece: tuple, size: int) -> None:
        top = self.window - size
        levels = np.flatnonzero(self.counts[1 : top + 1]) + 1
        best, level = 2 * self.counts[size] + 1, 0
        if len(levels):
            after = self.counts[levels + size]
            change = 2 * (after - self.counts[levels]) + 2
            if levels[-1] == top:
                change[-1] = 1 - 2 * self.counts[top]
            i = len(levels) - 1 - int(np.argmin(change[::-1]))  # the fullest of the best
            if change[i] <= best:
                level = int(levels[i])
        if level:
            pieces = self.levels[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self._emit(pieces)
            return
        self.levels[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open >= self.max_open:
            self.drain()

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            length = len(ids) // WIDTH
            self.out.append((doc_id, start, length, ids, n, self.next_id, offset))
            offset += length
        self.next_id += 1

    def drain(self) -> None:
        """Close all open windows without padding."""
        full = [p for level in range(self.window, 0, -1) for p in self.levels[level]]
        sizes = [level for level in range(self.window, 0, -1) for _ in self.levels[level]]
        i, j = 0, len(full) - 1
        while i < j:
            while sizes[i] < self.window and i < j:
                doc_id, start, ids, n = full[j].pop()
                take = min(self.window - sizes[i], len(ids) // WIDTH)
                full[i].append((doc_id, start, ids[: take * WIDTH], n))
                if take * WIDTH < len(ids):
                    full[j].append((doc_id, start + take, ids[take * WIDTH :], n))
                sizes[i] += take
                sizes[j] -= take
                if not sizes[j]:
                    j -= 1
            if sizes[i] == self.window:
                self._emit(full[i])
                i += 1
        if i == j and sizes[i]:
            self._split(full[i], sizes[i])
        self.counts[:] = 0
        self.levels = [[] for _ in range(self.window + 1)]
        self.n_open = 0

    def _split(self, pieces: list[tuple], size: int) -> None:
        rest = pieces[::-1]
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            now = []
            while room:
                doc_id, start, ids, n = rest.pop()
                take = min(room, len(ids) // WIDTH)
                now.append((doc_id, start, ids[: take * WIDTH], n))
                if take * WIDTH < len(ids):
                    rest.append((doc_id, start + take, ids[take * WIDTH :], n))
                room -= take
            self._emit(now)

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = 2048,
    max_open: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens.

    A document is its text's ids and a closing id 1.  Returns a row for each
    piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and
    ``offset`` in the sequence.  Sequences are ``window`` long, or a power of two.

    * Null or empty text is the closing id alone.
    * Null and repeated ids are packed like others, a row of ``docs`` each.
    * Other columns are not read.  An empty table gives an empty table.
    * A text longer than memory cannot be read by Spark either; any other is
      cut as it is packed.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = SumOfSquares(window, (context.partitionId() if context else 0) << 32, max_open)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def rows() -> Iterator[pa.RecordBatch]:
            taken = packer.taken()
            for at in range(0, len(taken), 2000):
                part = zip(*taken[at : at + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names)

        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    for doc_id, ids in zip(part[0].to_pylist(), encode_texts(part[1].to_pylist(), tokenizer_path), strict=True):
                        packer.add(doc_id, ids + END)
                    yield from rows()
            packer.drain()
            yield from rows()
        finally:
            forget(tokenizer_path)

    bound_batches(docs.sparkSession)
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(packed, SCHEMA)
