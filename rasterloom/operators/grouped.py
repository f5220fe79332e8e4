"""Sorted rows of an Arrow stream, group by group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of equal ``keys``; rows come sorted by them, and a run may span batches.

    Thousands of small groups share a batch, so a group costs no call of its own
    between the JVM and Python.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        codes = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for at in range(1, len(codes) + 1):
            if at < len(codes) and codes[at] == codes[start]:
                continue
            if held and codes[start] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = codes[start]
            held.append(b.slice(start, at - start))
            start = at
    if held:
        yield last, pa.Table.from_batches(held)
