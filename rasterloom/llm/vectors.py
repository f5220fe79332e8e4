"""What the vector operators share: valid rows, k-means on a bounded sample, block-against-block items."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.shared import bounded, drop, with_row_id, written

#: Vectors that the first level of lists is fitted on, lists of that level, vectors to fit a list of the second level on, vectors of one side of an item, about.
SAMPLE, FAN, PER_CENTROID, BLOCK = 16_384, 256, 64, 1_024
#: Distances that one step of a task holds at a time.
STEP = 4_000_000


def numbered(df: DataFrame, *more: str, kind: str = "double") -> DataFrame:
    """Written rows (rid, vec_id, ``more``, v): v is the vector as ``kind``, null where it takes no part.

    No part take vectors that are null, empty, zero, or hold a null or a
    non-finite component. Vectors of several lengths may stand side by side.
    """
    v = F.expr("CASE WHEN forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0) THEN cast(embedding AS array<%s>) END" % kind)
    return written(with_row_id(df.select("vec_id", *more, v.alias("v"))), "vectors")


def sample_matrix(distinct: DataFrame, n: int = SAMPLE) -> np.ndarray:
    """Up to ``n`` of the vectors, those of the smallest hashed rid."""
    rows = distinct.select("rid", "v").orderBy(F.xxhash64("rid"), "rid").limit(n).toArrow().column("v").combine_chunks()
    if not len(rows):
        return np.zeros((0, 1))
    return np.asarray(rows.flatten()).reshape(len(rows), -1)


def list_count(n: int, per_list: int) -> int:
    """Lists for ``n`` vectors: ``per_list`` to a list, or half the square root of ``n`` where that is more.

    So tasks hold at most 2 sqrt(n) centroids, and lists grow no faster than that.
    """
    return max(1, -(-n // max(per_list, math.isqrt(max(n, 1)) // 2)))


def steps(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows whose distances to ``width`` centroids fit one step."""
    size = max(1, STEP // max(1, width))
    return (slice(a, min(n, a + size)) for a in range(0, n, size))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


def k_means(x: np.ndarray, k: int, rounds: int = 8, balanced: bool = False, seed: int = 7) -> np.ndarray:
    """``k`` centroids. If ``balanced``, with one more coordinate that evens out the lists.

    A vector has 0 there and a crowded list the square root of its fee, so the
    nearest centroid of the longer vectors is the one of least distance² + fee.
    Lists that stay nearly empty first move to a member of a crowded one.
    """
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    if not len(x):
        return np.zeros((1, x.shape[1] + balanced))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    mean = len(x) / k
    for turn in range(rounds + 4 * balanced):
        near = np.concatenate([distances2(x[s], c).argmin(axis=1) for s in steps(len(x), k)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if balanced and turn < rounds:
            for poor, rich in zip(np.flatnonzero(n < mean / 4), np.argsort(-n, kind="stable"), strict=False):
                if n[rich] > 1.75 * mean:
                    c[poor] = x[rng.choice(np.flatnonzero(near == rich))]
    return np.column_stack([c, np.sqrt(_fees(x, c))]) if balanced else c


def _fees(x: np.ndarray, c: np.ndarray, turns: int = 80) -> np.ndarray:
    """What each list charges on top of distance², so that all get about as many of ``x``; steps shrink."""
    k, some = len(c), x[: PER_CENTROID * len(c)]
    d = np.concatenate([distances2(some[s], c).astype(np.float32) for s in steps(len(some), k)])
    fee, mean, step = np.zeros(k, dtype=np.float32), len(some) / k, 0.3 * float(d.min(axis=1).mean())
    least, best = math.inf, fee
    for _ in range(turns):
        n = np.bincount((d + fee).argmin(axis=1), minlength=k)
        if n.max() < least:
            least, best = n.max(), fee
        fee = fee + step * np.clip(n / mean - 1, -1, 1).astype(np.float32)
        fee, step = fee - fee.min(), 0.93 * step
    return best.astype(np.float64)


def fit_lists(rows: DataFrame, n: int, lists: int, lift: Callable[[np.ndarray], np.ndarray] = lambda x: x, balanced: bool = False, fan: int = FAN) -> np.ndarray:
    """Centroids of about ``lists`` lists for the ``n`` written ``rows`` (rid, v) of one length, ``lift`` applied to the vectors.

    Up to ``fan`` lists are fitted by the driver on at most 16,384 vectors. More
    are fitted in two levels: ``fan`` cells by the driver, then each cell's lists
    in a task of its own, on ``PER_CENTROID`` vectors to a list, picked by hash.
    """
    top = k_means(lift(sample_matrix(rows)), min(lists, fan), balanced=balanced)
    if lists <= fan:
        return top
    width = top.shape[1] - balanced

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = lift(matrix(b.column("v")))
            x = np.column_stack([x, np.zeros(len(x))]) if balanced else x
            near = [distances2(x[s], top).argmin(axis=1) for s in steps(len(x), len(top))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*near, np.zeros(0, dtype=int)]), pa.int32()), b.column("rid"), b.column("v")], names=["cell", "rid", "v"])

    share = min(1.0, PER_CENTROID * lists / n)
    picked = rows.select("rid", "v").where(F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    picked = written(picked.mapInArrow(cell, f"cell int, rid long, v {rows.schema['v'].dataType.simpleString()}"), "fit-sample")
    wanted = lists / max(1, picked.count())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k,), t in by_item(batches, ["cell"]):
            x = lift(matrix(t.column("v").combine_chunks()))
            c = k_means(x, max(1, round(len(x) * wanted)), balanced=balanced)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.int32()), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["cell", "c"])

    dealt = picked.repartition("cell").sortWithinPartitions("cell", "rid")
    got = sorted(tuple(r) for r in dealt.mapInArrow(split, "cell int, c array<double>").collect())  # about ``lists`` rows
    c = np.array([c for _, c in got])
    if balanced:
        c[:, width] = np.sqrt(_shared_fees(picked, lift, c[:, :width], picked.count() / len(c)))
    drop(picked)
    return c


def _shared_fees(picked: DataFrame, lift: Callable, c: np.ndarray, mean: float, turns: int = 20) -> np.ndarray:
    """:func:`_fees` over rows (v) that no single task holds: each turn is a count per list."""
    fee, step, least, best = np.zeros(len(c)), None, math.inf, np.zeros(len(c))
    for _ in range(turns):

        def near(batches: Iterator[pa.RecordBatch], fee: np.ndarray = fee) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(c), dtype=np.int64), np.zeros(len(c))
            for b in batches:
                x = lift(matrix(b.column("v")))
                for s in steps(len(x), len(c)):
                    d = distances2(x[s], c)
                    at = (d + fee).argmin(axis=1)
                    n += np.bincount(at, minlength=len(c))
                    total += np.bincount(at, weights=d.min(axis=1), minlength=len(c))
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(n[on]), pa.array(total[on])], names=["list", "n", "d"])

        n = np.zeros(len(c))
        got = picked.select("v").mapInArrow(near, "list int, n long, d double").groupBy("list").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()  # one row per list
        n[[r["list"] for r in got]] = [r["n"] for r in got]
        step = 0.2 * sum(r["d"] for r in got) / max(1, n.sum()) if step is None else 0.75 * step
        if n.max() < least:
            least, best = n.max(), fee
        fee = fee + step * np.clip(n / mean - 1, -1, 1)
        fee = fee - fee.min()
    return best


def items(rows: DataFrame, cell: list[str], same: bool, block: int = BLOCK, cells: DataFrame | None = None, order: tuple[str, ...] = ("rid",)) -> DataFrame:
    """Deal ``rows`` of cells (side 0: members, 1: queries) to block-against-block items.

    Every member of a cell meets every query of it in exactly one item and, if
    ``same``, every other member too. A side of a cell is cut into blocks of
    about ``block`` rows, so that a hot cell becomes many items and no item is
    large. ``rows`` are written rows, which are read twice, or come with their
    written ``cells`` (cell, mb, qb: blocks of each side). Adds item (kind, i, j)
    and place (0 or 1); rows of a place come in ``order``.
    """
    if cells is None:
        n = rows.groupBy(*cell).agg(F.sum(1 - F.col("side")).alias("m"), F.sum("side").alias("q"))
        cells = written(n.select(*cell, F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("int").alias("mb"), F.ceil(F.col("q") / block).cast("int").alias("qb")), "cells")
    n = bounded(cells)
    d = rows.join(n, cell).withColumn("b", F.pmod(F.xxhash64("rid"), F.when(F.col("side") == 0, F.col("mb")).otherwise(F.greatest("qb", F.lit(1)))).cast("int"))
    met = "transform(if(qb = 0, array(), sequence(0, qb - 1)), o -> named_struct('kind', 1, 'i', b, 'j', o, 'place', 0))"
    own = "transform(sequence(0, mb - 1), o -> named_struct('kind', 0, 'i', least(b, o), 'j', greatest(b, o), 'place', if(b <= o, 0, 1)))"
    asks = "transform(sequence(0, mb - 1), o -> named_struct('kind', 1, 'i', o, 'j', b, 'place', 1))"
    member = f"concat({own}, {met})" if same else met
    d = d.withColumn("it", F.explode(F.expr(f"if(side = 0, {member}, {asks})"))).drop("mb", "qb", "b")
    keys = [*cell, "kind", "i", "j"]
    d = d.select("*", "it.kind", "it.i", "it.j", "it.place").drop("it")
    return d.repartition(*keys).sortWithinPartitions(*keys, "place", *order)


def by_item(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal ``keys`` as tables; rows come sorted, a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        codes = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for at in range(1, len(codes) + 1):
            if at < len(codes) and codes[at] == codes[start]:
                continue
            if last is not None and codes[start] != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = codes[start]
            held.append(b.slice(start, at - start))
            start = at
    if held:
        yield last, pa.Table.from_batches(held)
