"""Packing of token sequences by the sum-of-squares rule.

Each task packs the documents of its partition as they come. A level array
counts the partly filled windows of each fill; a piece goes to the level (or to
a new window) after which the sum of the squared counts is smallest. That keeps
windows of many different fills at hand, so later pieces find one that they
complete. What is still open at the end of a task, or beyond a set number of
open windows, is cut anew: the emptier windows are poured into the fuller ones,
so that a task leaves one padded window at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.bpe import of_task, slices, vocabulary

#: sequence_id is the partition's number times this, plus the window's number in it.
WINDOWS_PER_TASK = 1 << 40


class SquaresPacker:
    """Windows of one task. A piece is (key, start, ids as bytes); ids take four bytes each."""

    def __init__(self, size: int = 2048, most_open: int = 4096):
        self.size, self.most_open = size, most_open
        #: level[h]: number of windows filled to h, for 0 < h < size.
        self.level = np.zeros(size, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size)]
        self.n_open = 0
        self.full: list[list[tuple]] = []

    def choose(self, n: int) -> int:
        """The level that a piece of n ids goes to: 0 is a new window, and ties go to the fullest."""
        gain = np.full(self.size, np.iinfo(np.int64).max)
        # Taking a window from h lowers the sum by 2 N[h] - 1; adding one at h + n raises it by 2 N[h+n] + 1.
        fits = np.flatnonzero(self.level[: self.size - n + 1])
        gain[fits] = 1 - 2 * self.level[fits]
        partly = fits[fits + n < self.size]
        gain[partly] += 2 * self.level[partly + n] + 1
        gain[0] = 2 * self.level[n] + 1
        return self.size - 1 - int(np.argmin(gain[::-1]))

    def add(self, key: object, ids: bytes) -> None:
        """Whole windows are cut off a long document; the rest is one piece."""
        n, start = len(ids) // 4, 0
        while n - start >= self.size:
            self.full.append([(key, start, ids[start * 4 : (start + self.size) * 4])])
            start += self.size
        if start < n:
            self.put((key, start, ids[start * 4 :]))
        if self.n_open > self.most_open:
            self.settle()

    def put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        h = self.choose(n)
        if h:
            window = self.open[h].pop()
            self.level[h] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if h + n == self.size:
            self.full.append(window)
        else:
            self.open[h + n].append(window)
            self.level[h + n] += 1
            self.n_open += 1

    def settle(self, last: bool = False) -> None:
        """Pours the emptiest open windows into the fullest, cutting pieces; one stays partly filled.

        That one stays open for what comes, or is given out as it is if nothing comes.
        """
        windows = [(h, w) for h in range(self.size - 1, 0, -1) for w in self.open[h]]
        self.level[:], self.n_open = 0, 0
        self.open = [[] for _ in range(self.size)]
        i, j = 0, len(windows) - 1
        fill, window = windows[0] if windows else (0, [])
        loose: list[tuple] = []
        while i < j or loose:
            if not loose:
                loose, j = windows[j][1], j - 1
            key, start, ids = loose.pop()
            room = (self.size - fill) * 4
            if len(ids) > room:
                loose.append((key, start + room // 4, ids[room:]))
                ids = ids[:room]
            window.append((key, start, ids))
            fill += len(ids) // 4
            if fill == self.size:
                self.full.append(window)
                i += 1
                fill, window = windows[i] if i <= j else (0, [])
        if window and last:
            self.full.append(window)
        elif window:
            self.open[fill].append(window)
            self.level[fill], self.n_open = 1, 1

    def take(self) -> Iterator[list[tuple]]:
        """The windows that are ready."""
        yield from self.full
        self.full = []


SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document's ids are its text's and then end_id, so a null or an empty text
    has one. Each id lies in one piece; the pieces of a sequence follow one
    another without gaps from offset 0. Each row of docs is packed, also if its
    id is null or repeated. Nothing is shuffled: the sequences hold the rows of
    one partition, and a lost partition is packed the same way again.
    keep_ids=False leaves ids null.
    """
    shared = vocabulary(docs.sparkSession, path)

    def rows(windows, task: int, number: int, sizes: dict):
        out: list[list] = [[] for _ in range(8)]
        for window in windows:
            offset = 0
            for (row, doc), start, ids in window:
                n = len(ids) // 4
                values = doc, start, n, zlib.crc32(ids), sizes[row], task * WINDOWS_PER_TASK + number, offset, np.frombuffer(ids, dtype="<u4").astype(np.int32) if keep_ids else None
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                offset += n
            number += 1
        arrays = [pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.list_(pa.int32()))]
        return number, pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    def run(batches):
        from pyspark import TaskContext

        task, bpe, packer, number, row = TaskContext.get().partitionId(), of_task(shared), SquaresPacker(size), 0, 0
        sizes: dict[int, int] = {}
        ending = end_id.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in slices(batch, 1):
                for doc, coded in zip(ids[start:], bpe.encode(texts), strict=False):
                    coded += ending
                    sizes[row] = len(coded) // 4
                    packer.add((row, doc), coded)
                    row += 1
                number, out = rows(packer.take(), task, number, sizes)
                yield out
        packer.settle(last=True)
        _, out = rows(packer.take(), task, number, sizes)
        yield out

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
