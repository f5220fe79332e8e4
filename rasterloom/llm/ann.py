"""Nearest neighbours by largest inner product, from balanced posting lists.

Vectors get a coordinate that makes all norms equal, so that the largest inner
product is the smallest distance, and centroids one more that makes crowded
lists farther, so that lists are balanced. A vector stands in its nearest list
and, near a boundary, in others too. A query walks a neighbour graph of the
centroids held in memory and keeps the lists within a ratio of the nearest
one's distance; the ratio is the smallest that reaches the wanted recall for
held-out queries, whose true neighbours come from a pass over all rows. Scores
are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.shared import written
from rasterloom.llm.vectors import BLOCK, by_item, distances2, fit_lists, items, list_count, matrix, numbered, sample_matrix, steps

#: Vectors to a list, about; lists that a boundary vector stands in, at most, and that a vector stands in on average.
PER_LIST, COPIES, REPLICAS = 1_024, 4, 1.3
#: Recall that the pruning ratio must reach, and queries to measure it with.
RECALL, PROBES = 0.96, 256
DEGREE = 16


@dataclass
class Index:
    centroids: np.ndarray  # of lifted vectors, then the balance coordinate
    length2: float  # the largest squared norm
    boundary: float = 1.0
    ratio: float = 1.0

    def __post_init__(self):
        """The neighbour graph: to each centroid its nearest ones and, so that it is connected, the next and the last in number."""
        c, n = self.centroids, len(self.centroids)
        self.graph, m = [], min(DEGREE + 1, n)
        for s in steps(n, n):
            d = distances2(c[s], c)
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            for k, row in zip(range(s.start, s.stop), near, strict=True):
                self.graph.append(np.setdiff1d([*row, (k + 1) % n, (k - 1) % n], [k]))
        self.start = int(distances2(c.mean(axis=0)[None], c).argmin())

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.length2 - (x * x).sum(axis=1)))])

    def _nearest(self, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``m`` nearest lists of each vector and their distances, in order."""
        d = np.sqrt(distances2(np.column_stack([self.lift(x), np.zeros(len(x))]), self.centroids))
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(axis=1, kind="stable"), 1)
        return near, np.take_along_axis(d, near, 1)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list and, of the next ones, those within the boundary ratio."""
        who, where = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
        for s in steps(len(x), len(self.centroids)):
            near, d = self._nearest(x[s], min(COPIES, len(self.centroids)))
            on = d <= self.boundary * d[:, :1]
            on[:, 0] = True
            a, b = np.nonzero(on)
            who.append(a + s.start)
            where.append(near[a, b])
        return np.concatenate(who), np.concatenate(where)

    def set_boundary(self, sample: np.ndarray, replicas: float = REPLICAS) -> None:
        """The ratio at which ``sample`` stands in ``replicas`` lists on average."""
        m = min(COPIES, len(self.centroids))
        if m > 1 and len(sample):
            d = np.concatenate([self._nearest(sample[s], m)[1] for s in steps(len(sample), len(self.centroids))])
            ratios = np.sort((d[:, 1:] / np.maximum(d[:, :1], 1e-12)).ravel())
            self.boundary = float(ratios[min(len(ratios) - 1, int((replicas - 1) * len(sample)))])

    def list_distances(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(distances2(np.append(q, [0.0, 0.0])[None], self.centroids))[0]

    def probe(self, q: np.ndarray, ratio: float | None = None) -> list[int]:
        """Lists of the query ``q`` in order of distance: best first through the graph, as far as the ratio goes."""
        ratio = self.ratio if ratio is None else ratio
        x = np.append(q, [0.0, 0.0])
        dist = lambda k: np.sqrt(np.maximum(0, ((self.centroids[k] - x) ** 2).sum(axis=-1)))
        # Walk down to the nearest centroid.
        at, best = self.start, float(dist(self.start))
        while len(self.graph[at]):
            d = dist(self.graph[at])
            if d.min() >= best:
                break
            at, best = int(self.graph[at][d.argmin()]), float(d.min())
        seen, heap, found = {at}, [(best, at)], []
        while heap:
            d, k = heapq.heappop(heap)
            if d > best * ratio * 1.02 and len(found) > 8:
                break
            found.append((d, k))
            best = min(best, d)
            new = [int(n) for n in self.graph[k] if int(n) not in seen]
            if new:
                seen.update(new)
                for dn, n in zip(dist(np.array(new)).tolist(), new, strict=True):
                    heapq.heappush(heap, (dn, n))
        return [k for d, k in sorted(found) if d <= best * ratio]


def calibrate(ix: Index, one: DataFrame, postings: DataFrame, k: int, recall: float = RECALL) -> None:
    """Set the least ratio at which held-out queries find ``recall`` of their ``k`` nearest among all rows.

    The queries are those of the largest hashed rid; the lists were fitted on
    those of the smallest. Their true neighbours come from one pass over ``one``
    (rid, v); what the driver gets is bounded by queries, ``k`` and copies.
    """
    probes = one.select("rid", "v").orderBy(F.desc(F.xxhash64("rid")), "rid").limit(PROBES).collect()
    if not probes or len(ix.centroids) == 1:
        ix.ratio = float("inf")
        return
    q, ids = np.array([p["v"] for p in probes]), np.array([p["rid"] for p in probes])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_r = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), dtype=np.int64)
        for b in batches:
            rid = b.column("rid").to_numpy()
            s = q @ matrix(b.column("v")).T
            s[ids[:, None] == rid[None]] = -np.inf
            held_s, held_r = np.column_stack([held_s, s]), np.column_stack([held_r, np.broadcast_to(rid, s.shape)])
            if held_s.shape[1] > k:
                top = np.argpartition(-held_s, k - 1, axis=1)[:, :k]
                held_s, held_r = np.take_along_axis(held_s, top, 1), np.take_along_axis(held_r, top, 1)
        a, j = np.nonzero(held_s > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(held_r[a, j]), pa.array(held_s[a, j])], names=["probe", "rid", "score"])

    near = one.select("rid", "v").mapInArrow(best, "probe int, rid long, score double")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "rid"))).where(F.col("rn") <= k)
    near = F.broadcast(near.select("probe", "rid"))  # at most PROBES * k rows
    needed: dict[tuple[int, int], float] = {}
    ratios: dict[int, np.ndarray] = {}
    for r in postings.select("rid", "list").join(near, "rid").collect():  # each row stands in at most COPIES lists
        if r["probe"] not in ratios:
            d = ix.list_distances(q[r["probe"]])
            ratios[r["probe"]] = d / max(d.min(), 1e-12)
        key = r["probe"], r["rid"]
        needed[key] = min(needed.get(key, np.inf), float(ratios[r["probe"]][r["list"]]))
    each = sorted(needed.values())
    ix.ratio = each[min(len(each) - 1, int(np.ceil(recall * len(each))))] * (1 + 1e-9) if each else float("inf")


def nearest(df: DataFrame, *, k: int = 20, every: int = 20, per_list: int = PER_LIST, block: int = BLOCK) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its ``k`` nearest other rows.

    Nearness is the largest inner product, in doubles, of the vectors as given;
    ties go to the smaller vec_id. Null vec_ids neither ask nor answer. Vectors
    that are null, empty, zero, or hold null or non-finite components take no
    part. A query meets the vectors of its own length, which have an index of
    their own. Equal vectors are indexed once with
    their k + 1 smallest rows, which is all that an answer can hold of them;
    each repeated query row gets its own answer. A query that found fewer than
    ``k`` searches all lists; an empty table gives no rows; other columns are
    ignored.

    Lists hold ``per_list`` vectors, or as many as there are lists where that is
    more. They are fitted on a sample (see :func:`fit_lists`); every vector
    stands in one to ``COPIES`` lists. On vectors without structure the wanted
    recall may take most lists, and the work then grows with rows times queries.
    The k-th best score within the sample bounds each query's answer from
    below, so tasks return only rows that may be part of it.
    """
    rows = numbered(df).where("v IS NOT NULL AND vec_id IS NOT NULL")
    dims = sorted(r["dim"] for r in rows.select(F.size("v").alias("dim")).distinct().collect())
    parts = [_nearest_of(rows.where(F.size("v") == dim), k, every, per_list, block) for dim in dims]
    return reduce(DataFrame.union, parts) if parts else _nearest_of(rows, k, every, per_list, block)


def build_index(one: DataFrame, k: int, per_list: int = PER_LIST) -> tuple[Index, DataFrame, np.ndarray]:
    """(index, postings, fit sample) of the written rows ``one`` (rid, v); every row stands in the postings."""
    stats = one.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("m")).first()
    n, length2 = stats["n"], stats["m"] or 0.0
    lift = lambda x: np.column_stack([x, np.sqrt(np.maximum(0, length2 - (x * x).sum(axis=1)))])
    sample = sample_matrix(one)
    ix = Index(fit_lists(one, n, list_count(n, per_list), lift, balanced=True), length2)
    ix.set_boundary(sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _rows(b, *ix.lists_of(matrix(b.column("v"))), 0)

    postings = written(one.select("rid", "v").mapInArrow(place, _DDL), "postings")
    calibrate(ix, one, postings, k)
    return ix, postings, sample


_DDL = "list int, side int, rid long, v array<double>, least double"


def _rows(b: pa.RecordBatch, who: np.ndarray, where: np.ndarray, side: int, least: np.ndarray | None = None) -> pa.RecordBatch:
    t = b.take(pa.array(who))
    least = np.full(len(who), -np.inf) if least is None else least
    return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([side] * len(who), pa.int32()), t.column("rid"), t.column("v"), pa.array(least)], names=["list", "side", "rid", "v", "least"])


def _nearest_of(rows: DataFrame, k: int, every: int, per_list: int, block: int) -> DataFrame:
    """:func:`nearest` over valid rows whose vectors have one length."""
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "rid"))).where(F.col("rn") <= k + 1)
    one = first.groupBy("v").agg(F.min("rid").alias("rid"), F.array_sort(F.collect_list(F.struct("vec_id", "rid"))).alias("ids"))
    one = written(one, "distinct")
    ix, members, sample = build_index(one, k, per_list)
    bound = sample if len(sample) > k else None

    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("rid", "vec_id", "v")
    asked = asking.join(one.select("v", F.col("rid").alias("rep")), "v").select("rid", "vec_id", "rep")
    asked = written(asked, "queries")
    wanted = one.join(asked.select(F.col("rep").alias("rid")).distinct(), "rid", "left_semi").select("rid", "v")

    def ask(ratio: float | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column("v"))
                least = np.full(len(x), -np.inf)
                if bound is not None and ratio is None:
                    for part in steps(len(x), len(bound)):  # the query itself may be in the sample, so one more
                        least[part] = np.partition(x[part] @ bound.T, -(k + 1), axis=1)[:, -(k + 1)]
                    least -= 1e-9 * np.abs(least)
                lists = [ix.probe(q, ratio) for q in x]
                who = np.repeat(np.arange(len(x)), [len(p) for p in lists])
                yield _rows(b, who, np.concatenate(lists).astype(int), 1, least[who])

        return run

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in by_item(batches, ["list", "kind", "i", "j"]):
            side, rid = t.column("place").to_numpy(), t.column("rid").to_numpy()
            x, least = matrix(t.column("v").combine_chunks()), t.column("least").to_numpy()
            m, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(m) or not len(q):
                continue
            s = x[q] @ x[m].T
            if len(m) > k + 1:
                kth = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)]
                s = np.where(s >= np.maximum(kth - 1e-9 * np.abs(kth), least[q])[:, None], s, -np.inf)
            else:
                s = np.where(s >= least[q][:, None], s, -np.inf)
            a, b = np.nonzero(s > -np.inf)
            exact = np.cumsum(x[q[a]] * x[m[b]], axis=1)[:, -1]  # in order of the components, as anyone would add them
            yield pa.RecordBatch.from_arrays([pa.array(rid[q[a]]), pa.array(rid[m[b]]), pa.array(exact)], names=["query", "rep", "score"])

    def search(queries: DataFrame, ratio: float | None) -> DataFrame:
        found = items(members.union(written(queries.mapInArrow(ask(ratio), _DDL), "asked")), ["list"], False, block).mapInArrow(scan, "query long, rep long, score double")
        found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
        found = found.join(one.select(F.col("rid").alias("rep"), "ids"), "rep")
        # The k + 1 best vectors, by score and smallest row, hold the k + 1 best rows: each vector before brings a better one.
        best = found.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.expr("ids[0].vec_id"), "rep"))).where(F.col("rn") <= k + 1)
        rows_ = best.select("query", "score", F.explode("ids").alias("id"))
        rows_ = rows_.select("query", "score", "id.vec_id", "id.rid")
        rows_ = rows_.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid"))).where(F.col("rn") <= k + 1)
        return rows_.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "rid", "score"))).alias("near"))

    got = written(search(wanted, None), "neighbours")
    all_rows = rows.count()
    need = min(k + 1, all_rows)
    full = got.where(F.size("near") >= need)
    short = wanted.join(full.select(F.col("query").alias("rid")), "rid", "left_anti")
    if short.limit(1).count():
        got = full.union(search(short, float("inf")))
    out = asked.join(got, asked.rep == got.query)
    near = F.slice(F.filter("near", lambda x: x.rid != F.col("rid")), 1, k)
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(near).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
