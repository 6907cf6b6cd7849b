"""Whole groups of rows, many at a time, as Arrow tables in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..session import ship

#: Rows that are handed over together at least, unless a partition has fewer.
ROWS = 20_000


def starts(t: pa.Table, by: list[str]) -> np.ndarray:
    """Where groups of equal ``by`` begin in a table in which each is together."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for c in by:
        k = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
        k = k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k
        k = k.indices.to_numpy(zero_copy_only=False)
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def in_groups(df: DataFrame, by: list[str], order: list[Column], f: Callable[[pa.Table, np.ndarray], Iterable[pa.Table]], schema: str, parts: int | None = None) -> DataFrame:
    """``f(table, starts)`` over tables of whole groups in ``order``; what it yields are the rows. A worker holds one such
    table, that is about ``ROWS`` rows or one group."""
    rows = ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, rows
        for b in batches:
            held.append(b)
            n += len(b)
            if n < enough:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            s = starts(t, by)
            if s[-1] > 0:
                for x in f(t.slice(0, s[-1]), s[:-1]):
                    yield from x.to_batches()
            t = t.slice(s[-1])
            held, n = t.to_batches(), len(t)
            enough = max(rows, 2 * n)  # a large group is not looked through again for every batch
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            for x in f(t, starts(t, by)):
                yield from x.to_batches()

    ship(df.sparkSession)
    x = df.repartition(parts, *by) if parts else df.repartition(*by)
    return x.sortWithinPartitions(*by, *order).mapInArrow(run, schema)
