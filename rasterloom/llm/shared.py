"""Helpers shared by the operators: written cut points, row ids, word caches, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the master is local (tests, one machine) a temporary folder is made; on a
    cluster without the setting this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="rasterloom-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


#: Folders written by this process and not yet removed.
_written: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def drop(*tables: DataFrame) -> None:
    """Delete :func:`written` tables that no result reads any more."""
    for t in tables:
        if (path := getattr(t, "_written_path", None)) in _written:
            _remove(t.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that this process has written, once all results are stored elsewhere."""
    for path in sorted(_written):
        _remove(spark, path)


@atexit.register
def _drop_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_all(spark)


#: Rows that a broadcast of short rows may hold (some tens of MB).
BROADCAST_ROWS = 1_000_000


def bounded(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (written, short rows), marked for broadcast if it has at most ``rows`` rows; else as it is."""
    return F.broadcast(table) if table.count() <= rows else table


def heavy_join(rows: DataFrame, table: DataFrame, key: str, size: str, how: str = "inner", parts: int = 1000) -> DataFrame:
    """Join (``inner`` or ``left``) of written ``rows`` with written ``table``, one row per ``key`` that ``size`` rows have.

    Keys that hold more than one in ``parts`` of all rows are at most ``parts``
    many: they travel by broadcast, so no hot key is gathered in a task. All
    other keys meet by a shuffle join.
    """
    least = max(1, -(-rows.count() // parts))
    heavy = F.broadcast(table.where(F.col(size) > least))
    light = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col(size) <= least), key, how)
    return rows.join(heavy, key).unionByName(light)


def with_row_id(df: DataFrame, column: str = "rid") -> DataFrame:
    """Add a number unique per row. Only stable once the result is written."""
    return df.withColumn(column, F.monotonically_increasing_id())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added until no column of ``df`` is called so (in any letter case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Generations(dict):
    """A bounded cache: a full young generation replaces the old one.

    Lookups of cached keys stay inside ``dict.__getitem__``; results never
    depend on what the cache holds.
    """

    def __init__(self, make: Callable, size: int = 300_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def release(*caches: Generations) -> None:
    """Empty ``caches`` and give freed memory back, at the end of a task: workers are used again by other stages."""
    import ctypes

    import pyarrow as pa

    for c in caches:
        c.clear()
        c.old = {}
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 100) -> DataFrame:
    """Connected components of undirected ``edges``: (node, component = smallest node reachable).

    Alternating large-star and small-star steps. Each star is a minimum per node
    (combined before the shuffle) joined back to the edges, so that a node of
    very many edges is never gathered in one task. Nodes without edges are not
    listed; loops are ignored; an empty input gives an empty result. Every round
    is written to the shared folder.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    cur = written(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    nodes = written(cur.select(F.col("u").alias("node")).union(cur.select("v")).distinct(), "nodes")
    digest = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    was = digest(cur)
    for _ in range(rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = written(nxt, "cc")
        drop(cur)
        cur, before, was = nxt, was, digest(nxt)
        if was == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
