"""Groups of any size as bounded pieces of work: blocks, pairs of blocks, and whole groups from sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, n: str, block: int) -> DataFrame:
    """rows with p and q, the pair of blocks that they are compared in, and mine, the block that they are of.

    n names the column with the size of a row's group. A group of more than
    block rows is split into blocks; each row goes to the pairs that its block
    is part of, and no task gets more than two blocks.
    """
    split = rows.withColumn("parts", F.ceil(F.col(n) / block).cast("int")).drop(n)
    split = split.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("p"), F.greatest(o, F.col("mine")).alias("q"))))
    return split.select("*", pairs.alias("pq")).select("*", "pq.p", "pq.q").drop("pq", "parts")


def bounded_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, starts) of whole groups from batches sorted by their first n_keys columns; no group is cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(n_keys)]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(n_keys)):
            change = np.r_[0, change]
        if not len(change):
            held.append(batch)
            continue
        yield from _starts([*held, batch.slice(0, change[-1])], n_keys)
        held = [batch.slice(change[-1])]
    yield from _starts(held, n_keys)


def _starts(parts: list[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    if rows := sum(p.num_rows for p in parts):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=rows)[0]
        keys = [whole.column(k).to_numpy() for k in range(n_keys)]
        yield whole, np.r_[0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1]


def meetings(batches: Iterator[pa.RecordBatch], n_keys: int, guest: int, most: int) -> Iterator[tuple[str, pa.RecordBatch | None]]:
    """Groups of home rows and the guests that come by, from batches sorted by their first n_keys columns and the column guest (0 at home, 1 not).

    ("open", all home rows), ("guests", at most `most` rows) any number of
    times, and ("close", None) for each group; only the home rows are held. A
    group without home rows is left out.
    """
    key, home, parts = None, False, []

    def opened():
        return "open", pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=sum(p.num_rows for p in parts))[0]

    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in (*range(n_keys), guest)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for i, j in zip([0, *change], [*change, batch.num_rows], strict=True):
            if i == j:
                continue
            if (here := tuple(c[i] for c in columns[:-1])) != key:
                if parts:
                    if not home:
                        yield opened()
                    yield "close", None
                key, home, parts = here, False, []
            part = batch.slice(i, j - i)
            if not columns[-1][i]:
                parts.append(part)
            elif parts:
                if not home:
                    home = True
                    yield opened()
                for lo in range(0, j - i, most):
                    yield "guests", part.slice(lo, most)
    if parts:
        if not home:
            yield opened()
        yield "close", None
