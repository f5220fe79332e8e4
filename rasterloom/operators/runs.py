"""Run-length operators: capped runs as islands, greedy predictor runs as folds, expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.pixel import RUN_CAP
from rasterloom.operators.predict import DELTA_ORDER, KEY_ORDER
from rasterloom.operators.sequence import carry, dense

_RANK = {False: KEY_ORDER, True: DELTA_ORDER}


def capped_runs(df: DataFrame, order: str, value: Column, by: list[str] = (), cap: int = RUN_CAP) -> DataFrame:
    """(by..., run, start, value, n): maximal runs of equal ``value`` by ``order``, cut at ``cap``.

    Gaps and islands: an island's number is the count of changes so far, its
    parts are numbered by position. Without ``by`` all rows are one sequence:
    the running count is then built from range partitions (:func:`global_runs`).
    """
    w = Window.partitionBy(*by).orderBy(order)
    d = df.select(*by, F.col(order), value.alias("value"))
    d = d.withColumn("new", F.when(F.lag("value").over(w).eqNullSafe(F.col("value")) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1))
    d = d.withColumn("island", F.sum("new").over(w))
    inside = F.row_number().over(Window.partitionBy(*by, "island").orderBy(order)) - 1
    d = d.withColumn("part", F.floor(inside / cap))
    return d.groupBy(*by, "island", "part", "value").agg(F.min(order).alias("start"), F.count("*").alias("n")).select(*by, "start", "value", "n")


def global_runs(df: DataFrame, order: str, value: Column, cap: int = RUN_CAP, width: int = 4096) -> DataFrame:
    """Capped runs of one sequence of any length, no single-task window over all rows.

    The ids ``order`` may have gaps: runs are cut by row number, and ``start``
    is the id of a run's first row. Blocks of ``width`` rows find their own
    changes; one row per block learns where the island that enters the block
    began (:func:`carry`).
    """
    d = dense(df.select(F.col(order).alias("id"), value.alias("value")), "id", "o").withColumn("blk", F.floor(F.col("o") / width).cast("long"))
    w = Window.partitionBy("blk").orderBy("o")
    d = d.withColumn("new", F.when(F.lag("value").over(w).eqNullSafe(F.col("value")) & F.lag(F.lit(1)).over(w).isNotNull(), F.lit(None)).otherwise(F.col("o")))
    # Heads of blocks count as changes for now; whether they are is settled on one row per block.
    edge = d.groupBy("blk").agg(F.min_by("value", "o").alias("first"), F.max_by("value", "o").alias("last"), F.min("o").alias("at"), F.max("new").alias("begin"), F.countDistinct("new").alias("islands"))
    ahead = edge.select((F.col("blk") + 1).alias("blk"), F.col("last").alias("before"), F.lit(True).alias("known"))
    edge = edge.join(ahead, "blk", "left").withColumn("goes_on", F.coalesce("known", F.lit(False)) & F.col("before").eqNullSafe(F.col("first")))
    # An island that crosses blocks began where the last block that did not merely continue it has its last change; places only grow.
    edge = edge.withColumn("own", F.when((F.col("islands") > 1) | ~F.col("goes_on"), F.col("begin")))
    edge = carry(edge, "blk", "own", "max", "entry", width)
    heads = edge.select("blk", "at", F.when(F.col("goes_on"), F.col("entry")).otherwise(F.col("at")).alias("head"))
    d = d.join(heads, "blk").withColumn("new", F.when(F.col("o") == F.col("at"), F.col("head")).otherwise(F.col("new")))
    d = d.withColumn("island", F.last("new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.floor((F.col("o") - F.col("island")) / cap)
    return d.groupBy("island", part.alias("part"), "value").agg(F.min("id").alias("start"), F.count("*").alias("n")).select("start", "value", "n")


def expand(runs: DataFrame, value: str = "value", n: str = "n", start: str = "start") -> DataFrame:
    """Runs back to rows (pos, value)."""
    return runs.select("*", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))).alias("k")).select((F.col(start) + F.col("k")).alias("pos"), F.col(value).alias("value"))


def greedy_fold(fits: np.ndarray, delta: bool, cap: int = RUN_CAP) -> tuple[list[int], list[int]]:
    """(types, lengths) of the greedy rule over fit masks in scan order.

    At a start the first fitting predictor of the priority is chosen (literal
    if none); the run goes on while that same one fits, up to ``cap``.
    """
    types, lengths, at, n = [], [], 0, len(fits)
    order = _RANK[delta]
    # For each predictor, the next place where it does not fit: one backward pass each, so a run is one jump.
    stops = {}
    for k in (0, *order):
        miss = np.flatnonzero((fits >> k) & 1 == 0)
        nxt = np.full(n + 1, n)
        nxt[miss] = miss
        stops[k] = np.minimum.accumulate(nxt[::-1])[::-1]
    while at < n:
        kind = next((k for k in order if fits[at] >> k & 1), 0)
        end = min(int(stops[kind][at + 1]) if at + 1 < n else n, at + cap, n)
        types.append(kind)
        lengths.append(end - at)
        at = end
    return types, lengths


def greedy_runs(masked: DataFrame, keys: list[str], delta: bool) -> DataFrame:
    """Greedy predictor runs per group of ``keys``: rows (keys..., seq, start, ptype, n, r, g, b).

    ``masked`` has fits, pos and the channels. Groups are frames (or row bands)
    for keyframes and blocks for delta frames; rows stream sorted through each
    task, and one group at a time is held.
    """
    cols = [*keys, "pos", "fits", "r", "g", "b"]
    types = dict(masked.dtypes)
    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", seq int, start bigint, ptype int, n int, r int, g int, b int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            kinds, lengths = greedy_fold(t.column("fits").to_numpy(), delta)
            start = np.cumsum([0, *lengths[:-1]])
            part = t.take(pa.array(start))
            n = len(kinds)
            chan = [pa.array([v if k == 0 else None for v, k in zip(part.column(c).to_pylist(), kinds, strict=True)], pa.int32()) for c in "rgb"]
            return pa.RecordBatch.from_arrays(
                [*(part.column(k).combine_chunks() for k in keys), pa.array(range(n), pa.int32()), part.column("pos").combine_chunks(), pa.array(kinds, pa.int32()), pa.array(lengths, pa.int32()), *chan],
                names=[*keys, "seq", "start", "ptype", "n", "r", "g", "b"],
            )

        for b in batches:
            codes = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for at in range(1, len(codes) + 1):
                if at < len(codes) and codes[at] == codes[start]:
                    continue
                if held and codes[start] != last:
                    yield out()
                    held = []
                last = codes[start]
                held.append(b.slice(start, at - start))
                start = at
        if held:
            yield out()

    return masked.select(*cols).repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(run, ddl)


def block_greedy(masked: DataFrame, keys: list[str], cap: int = RUN_CAP) -> DataFrame:
    """The delta-frame fold over small blocks inside Catalyst, by ``aggregate`` (no Python): (keys..., runs).

    For blocks of a few hundred pixels only: the accumulator is copied per step.
    """
    order = "CASE " + " ".join(f"WHEN (m & {1 << k}) != 0 THEN {k}" for k in DELTA_ORDER) + " ELSE 0 END"
    d = masked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "fits"))).alias("p"))
    fold = F.expr(
        f"""aggregate(transform(p, x -> x.fits), cast(array() AS array<struct<ptype: int, n: int>>), (a, m) ->
        CASE WHEN size(a) > 0 AND a[size(a) - 1].n < {cap} AND (shiftright(m, a[size(a) - 1].ptype) & 1) = 1
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('ptype', a[size(a) - 1].ptype, 'n', a[size(a) - 1].n + 1)))
        ELSE concat(a, array(named_struct('ptype', {order}, 'n', 1))) END)"""
    )
    return d.select(*keys, fold.alias("runs"))
