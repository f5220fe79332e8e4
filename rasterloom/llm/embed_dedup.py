"""Near-duplicate vectors: inverted lists, residual product codes, exact rerank.

Unit vectors with cosine >= c are at most the angle arccos(c) apart. A coarse
quantiser parts them into lists. A vector asks every list that a partner could
be in: the partner's angle to the list's direction lies in the range of angles
that the list's vectors have, and the partner is nearer to that centroid than to
the vector's own one; both are tested against the best that any vector within
the angle could reach. Two vectors are compared only if each asks the other's
list. A product code stands for the residual with a known error, so distances to
what the codes stand for above the radius plus the error rule out a pair for
certain; they are matrix products, list against list. What is left is ranked by
the exact cosine. No pair above the threshold is lost.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.shared import bounded, components, drop, written
from rasterloom.llm.vectors import BLOCK, distances2, fit_lists, items, k_means, list_count, matrix, numbered, sample_matrix, steps

COSINE = 0.93
#: Vectors of a label to a list, about; components to a subspace, about, and codes of each.
PER_LIST, COMPONENTS, CODES = 64, 4, 256
#: Members of an item, at most, and parts of a label that items aim at; rows of the asking side held at a time.
MOST_BLOCK, PARTS, CHUNK = 131_072, 6, 16_384
#: Rows that a pass may deal to items: so many, or as many as the table has.
PASS = 500_000
#: Rounding of single-precision products, and of distances by them.
SLACK, FAR = 2e-5, 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, lest squares overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Quantiser:
    lists: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def __post_init__(self):
        self.square = (self.lists * self.lists).sum(axis=1)
        size = np.sqrt(self.square)
        self.directions = self.lists / np.maximum(size, 1e-12)[:, None]
        self.angles = np.tile([0.0, np.pi], (len(self.lists), 1))
        self.group = np.zeros(len(self.lists), dtype=int)

    def join_groups(self, most: int, block: int) -> None:
        """Neighbouring lists, about ``self.block`` vectors of a label of ``most``, travel together; a vector is sent to a group once.

        Lists are put in the order of their groups.
        """
        self.block = min(MOST_BLOCK, max(block, most // PARTS))
        self.ask_block = max(self.block, min(4 * self.block, most // 4))
        middles = k_means(self.lists, -(-len(self.lists) // max(1, self.block * len(self.lists) // most)))
        group = distances2(self.lists, middles).argmin(axis=1)
        self.lists = self.lists[np.argsort(group, kind="stable")]
        self.__post_init__()
        self.group = np.sort(group)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The nearest list of each row, but for :data:`SLACK`."""
        c, half, x = self.lists.astype(np.float32).T, (self.square / 2).astype(np.float32), x.astype(np.float32)
        return np.concatenate([*((x[s] @ c - half).argmax(axis=1) for s in steps(len(x), len(self.lists))), np.zeros(0, dtype=int)])

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, errors, angles to the own list's direction)."""
        rest = x - self.lists[own]
        codes, near = np.zeros((len(x), len(self.books)), dtype=np.uint8), np.zeros_like(rest)
        for s, book in enumerate(self.books):
            part = slice(self.cuts[s], self.cuts[s + 1])
            codes[:, s] = (rest[:, part].astype(np.float32) @ book.T.astype(np.float32) - ((book * book).sum(axis=1) / 2).astype(np.float32)).argmax(axis=1)
            near[:, part] = book[codes[:, s]]
        angle = np.arccos(np.clip((x * self.directions[own]).sum(axis=1), -1, 1))
        return codes, np.sqrt(((rest - near) ** 2).sum(axis=1)), angle

    def asks(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray, cosine: float) -> np.ndarray:
        """(list, row): which of ``lists`` could hold a vector of ``cosine`` or more to the row.

        A vector y of list k, c its centroid and o the row's own one, has
        y (c - o) >= h, half of |c|² - |o|². Turned by an angle, x reaches that if
        x (c - o) >= cos h - sin sqrt(|c - o|² - h²), which two lists fix.
        """
        turn = float(np.arccos(np.clip(cosine, -1, 1)))
        cos, sin = np.cos(turn), np.sin(turn)
        c, size = self.lists[lists], np.sqrt(self.square[lists])
        low = (size * np.cos(np.minimum(self.angles[lists, 1] + turn, np.pi)) - SLACK).astype(np.float32)[:, None]
        high = (size * np.cos(np.maximum(self.angles[lists, 0] - turn, 0)) + SLACK).astype(np.float32)[:, None]
        c32, x = c.astype(np.float32), x.astype(np.float32)
        out = np.zeros((len(lists), len(x)), dtype=bool)
        for s in steps(len(x), len(lists)):
            mine, at = np.unique(own[s], return_inverse=True)
            h = (self.square[lists][:, None] - self.square[mine][None]) / 2 - SLACK
            apart = distances2(c, self.lists[mine])
            need = cos * h - sin * np.sqrt(np.maximum(apart - h * h, 0)) - SLACK
            need = np.where(h <= -cos * np.sqrt(apart), -np.inf, need).astype(np.float32)
            to = c32 @ x[s].T
            out[:, s] = (to >= low) & (to <= high)
            to -= (x[s] * self.lists[own[s]].astype(np.float32)).sum(axis=1)
            out[:, s] &= to >= need[:, at]
        return out

    def probes(self, x: np.ndarray, own: np.ndarray, cosine: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Per slice of rows, (row, list): other lists that could hold a vector of ``cosine`` or more to the row's."""
        for s in steps(len(x), len(self.lists)):
            may = self.asks(x[s], own[s], np.arange(len(self.lists)), cosine)
            may[own[s], np.arange(may.shape[1])] = False
            b, a = np.nonzero(may)
            yield s, a + s.start, b

    def stand(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What ``codes`` of ``lists`` stand for, in single precision."""
        out = self.lists[lists].astype(np.float32)
        for s, book in enumerate(self.books):
            out[:, self.cuts[s] : self.cuts[s + 1]] += book.astype(np.float32)[codes[:, s]]
        return out

    def tables(self, x: np.ndarray) -> np.ndarray:
        """What :meth:`lookup` needs of the rows: one product with what codes stand for gives all subspaces at once."""
        return x.astype(np.float32)

    def lookup(self, x: np.ndarray, tables: np.ndarray, k: int, codes: np.ndarray) -> np.ndarray:
        """Distances from ``x`` to what ``codes`` of list ``k`` stand for."""
        near = self.stand(np.full(len(codes), k), codes)
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (near * near).sum(axis=1)[None] - 2 * tables @ near.T))


def fit_quantiser(rows: DataFrame, n: int, most: int, per_list: int = PER_LIST, block: int = BLOCK) -> Quantiser:
    """Lists and codes for the ``n`` written rows (rid, v) of one length; the largest label has ``most`` of them."""
    lists = fit_lists(rows, n, list_count(most, per_list), unit)
    x = sample_matrix(rows)
    x = unit(x) if len(x) else x
    q = Quantiser(lists, [], [])
    rest = x - lists[q.own(x)] if len(x) else x
    q.cuts = np.linspace(0, x.shape[1], -(-x.shape[1] // COMPONENTS) + 1).astype(int).tolist()
    q.books = [k_means(rest[:, a:b], CODES, rounds=5) for a, b in zip(q.cuts, q.cuts[1:], strict=False)]
    q.join_groups(most, block)
    return q


def near_vectors(df: DataFrame, *, cosine: float = COSINE, per_list: int = PER_LIST, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are
    equal, and their cosine, in doubles, is ``cosine`` or more. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing.
    Equal vectors and repeated rows link with one another and are one vector
    with a count until the end. Null vec_ids count as rows and never name a
    component that has another id; an empty table gives no rows; other columns
    are ignored.

    Each length has a quantiser, its lists sized by the most frequent label
    (``per_list`` vectors to a list, or as many as there are lists where that is
    more) and fitted on a sample (see :func:`fit_lists`); every vector is
    indexed and asks. Groups of lists, of ``block`` vectors of a label or more,
    meet in items, a table of many rows in passes (:data:`PASS`), so that
    about a copy of each vector lies on disk at once. Tasks return a row per vector with
    links (a sum and a spanning link), never pairs. On vectors without structure
    most lists could hold a partner; work then grows with the square of a label.
    """
    kind = "float" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = numbered(df, "label", kind=kind)
    one, fitted = index_vectors(rows.where("v IS NOT NULL AND label IS NOT NULL"), per_list, block, kind)
    within = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def dealt(b: pa.RecordBatch, q: Quantiser, passes: int, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows, their groups, side) of a pass: members, and vectors that ask lists of another group where the two groups meet."""
        own = b.column("list").to_numpy()
        order = np.argsort(own, kind="stable")
        own, x = own[order], unit(matrix(b.column("v")))[order]
        mine = q.group[own]
        here = mine % passes == turn
        yield order[here], mine[here], 0
        lists = np.flatnonzero(q.group % passes == turn)
        if len(lists):
            groups, starts = np.unique(q.group[lists], return_index=True)
            for s in steps(len(x), len(lists)):
                may = np.logical_or.reduceat(q.asks(x[s], own[s], lists, cosine), starts, axis=0)
                odd = (groups[:, None] + mine[s][None]) % 2 == 1
                may &= np.where(odd, groups[:, None] > mine[s][None], groups[:, None] < mine[s][None])
                to, who = np.nonzero(may)
                yield order[s][who], groups[to], 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in (part for whole in batches for part in _by_length(whole)):
            q = fitted[dim]
            for who, to, side in dealt(b, q, 1, 0):
                t = pa.table({"label": b.column("label").take(pa.array(who)), "group": pa.array(to, pa.int32())}).group_by(["label", "group"]).aggregate([([], "count_all")])
                fixed = [pa.array([v] * len(t), pa.int32()) for v in (dim, side, q.block, q.ask_block)]
                yield pa.RecordBatch.from_arrays([t["label"].combine_chunks(), t["group"].combine_chunks(), t["count_all"].combine_chunks(), *fixed], names=["label", "group", "n", "dim", "side", "block", "ask_block"])

    def asked(passes: int, turn: int) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dim, b in (part for whole in batches for part in _by_length(whole)):
                for who, to, side in dealt(b, fitted[dim], passes, turn):
                    for at in range(0, len(who), 10_000):
                        c = b.take(pa.array(who[at : at + 10_000])).column
                        group = pa.array(to[at : at + 10_000], pa.int32())
                        columns = [c("label"), c("dim"), group, pa.array([side] * len(group), pa.int32()), *map(c, ("rid", "mult", "v", "list", "code", "err"))]
                        yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "group", "side", "rid", "mult", "v", "list", "code", "err"])

        return one.mapInArrow(ask, f"label int, dim int, group int, side int, rid long, mult long, v array<{kind}>, list int, code binary, err double")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, last = [], None, None
        for (key, place), t in _pieces(batches, ["label", "dim", "group", "kind", "i", "j"], "place"):
            q = fitted[key[1]]
            if key != last:
                yield from _within(held, last, fitted, within, cosine)
                held, members, last = [], None, key
            if place == 0:
                held.append(t)
                continue
            if not held:
                continue
            if members is None:
                members = _Side(pa.concat_tables(held), q, within)
            yield from _links(q, _Side(t, q), members, cosine)
        yield from _within(held, last, fitted, within, cosine)

    cells = one.mapInArrow(count, "label int, group int, n long, dim int, side int, block int, ask_block int").groupBy("label", "dim", "group").agg(*(F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(a) for k, a in ((0, "m"), (1, "q"))), F.max("block").alias("block"), F.max("ask_block").alias("ask_block"))
    cells = written(cells.select("label", "dim", "group", "m", "q", F.greatest(F.lit(1), F.ceil(F.col("m") / F.col("block"))).cast("int").alias("mb"), F.ceil(F.col("q") / F.col("ask_block")).cast("int").alias("qb")), "cells")
    sizes = cells.agg(F.sum(F.expr("m * (mb + qb) + q * mb")).alias("copies"), F.sum("m").alias("rows"), F.max("group").alias("last")).first()
    passes = min(-(-(sizes["copies"] or 0) // max(PASS, sizes["rows"] or 0)), (sizes["last"] or 0) + 1) or 1
    parts = []
    if passes > 1:
        _collect(df)
    for turn in range(passes):
        dealt_out = items(asked(passes, turn), ["label", "dim", "group"], True, cells=cells.drop("m", "q"), order=("list", "rid"))
        parts.append(written(dealt_out.mapInArrow(compare, "rid long, n long, root long"), "links"))
        del dealt_out
        if passes > 1:
            _collect(df)
    drop(cells)
    links = reduce(DataFrame.unionByName, parts)
    degree = links.groupBy("rid").agg(F.sum("n").alias("n"))
    groups = components(links, "rid", "root").withColumnRenamed("node", "rid")
    known = one.select("rid", "mult").join(degree, "rid", "left").join(groups, "rid", "left").select(F.col("rid").alias("first"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rid").alias("group"))
    out = rows.select("rid", "vec_id").join(_copies(rows, one), "rid", "left").withColumn("first", F.coalesce("first", "rid"))
    out = out.join(known, "first", "left").select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group", "rid").alias("group"))
    out = written(out, "vector-groups")
    name = out.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    return out.join(name, "group").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _collect(df: DataFrame) -> None:
    """Collect plans that are no longer used: shuffle files go with them."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _copies(rows: DataFrame, one: DataFrame) -> DataFrame:
    """(rid, first) of each row whose vector other rows have too: ``first`` stands for it in ``one``.

    Only rows of a hash that such a vector has travel with their vectors.
    """
    several = one.where("mult > 1").select("label", "v", F.col("rid").alias("first"))
    hashed = several.select(F.xxhash64("label", "v").alias("h")).distinct()
    some = rows.join(bounded(hashed), F.xxhash64(rows.label, rows.v) == F.col("h"), "left_semi")
    several = bounded(several, 20_000).select(F.col("label").alias("l"), F.col("v").alias("w"), "first")
    return some.join(several, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("rid", "first")


_INDEX = "label int, rid long, mult long, v array<{}>, dim int, list int, code binary, err double, angle double"


class _Side:
    """Rows of an item, in order of their lists; of members (``within`` given) also what their codes stand for."""

    def __init__(self, t: pa.Table, q: Quantiser, within: float | None = None):
        column = lambda c: t.column(c).combine_chunks()
        self.rid, self.mult, self.list = (column(c).to_numpy() for c in ("rid", "mult", "list"))
        self.v = np.asarray(column("v").flatten()).reshape(len(self.rid), -1)
        self.x = np.empty(self.v.shape, dtype=np.float32)
        for at in range(0, len(self.x), 8_192):
            self.x[at : at + 8_192] = unit(self.v[at : at + 8_192].astype(np.float64))
        self.names, starts = np.unique(self.list, return_index=True)
        self.starts, self.ends = starts, np.append(starts[1:], len(self.rid))
        if within is not None:
            codes = np.frombuffer(b"".join(column("code").to_pylist()), dtype=np.uint8).reshape(len(self.rid), -1)
            self.stand = q.stand(self.list, codes)
            reach = within + column("err").to_numpy() + FAR
            # |x - s| <= reach, for x of length 1, as a product
            self.least = ((1 + (self.stand.astype(np.float64) ** 2).sum(axis=1) - reach * reach) / 2).astype(np.float32)


def _within(held: list[pa.Table], key: tuple | None, fitted: dict[int, Quantiser], within: float, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links among the members of an item that is one block of a cell against itself."""
    if held and key[3] == 0 and key[4] == key[5]:
        side = _Side(pa.concat_tables(held), fitted[key[1]], within)
        yield from _links(fitted[key[1]], side, side, cosine)


def _links(q: Quantiser, left: _Side, right: _Side, cosine: float) -> Iterator[pa.RecordBatch]:
    """Per row with links between ``left`` and ``right``: how many, and the least row of a tree of them.

    Rows of two lists meet if each asks the other's list, those of one list all.
    """
    same = left is right
    asks_l = q.asks(left.x, left.list, right.names, cosine)
    asks_r = asks_l if same else q.asks(right.x, right.list, left.names, cosine)
    some = np.logical_or.reduceat(asks_l, left.starts, axis=1).T & np.logical_or.reduceat(asks_r, right.starts, axis=1)
    some |= left.names[:, None] == right.names[None]
    if same:
        some = np.triu(some)
    shift = 0 if same else len(left.rid)
    rid = left.rid if same else np.concatenate([left.rid, right.rid])
    n, trees = np.zeros(len(rid), dtype=np.int64), []
    for i, j in zip(*np.nonzero(some), strict=True):
        a0, a1, b0, b1 = left.starts[i], left.ends[i], right.starts[j], right.ends[j]
        one = left.names[i] == right.names[j]
        rows, others = (np.arange(a0, a1), np.arange(b0, b1)) if one else (a0 + np.flatnonzero(asks_l[j, a0:a1]), b0 + np.flatnonzero(asks_r[i, b0:b1]))
        near, least = right.stand[others], right.least[others]
        for s in steps(len(rows), len(others)):
            part = rows[s]
            may = left.x[part] @ near.T >= least
            if same and one:  # each pair once
                may &= part[:, None] < others[None]
            if not may.any():
                continue
            a, b = np.nonzero(may)
            a, b = _exact(left.v[part], right.v[others], a, b, cosine)
            if len(a):
                n[part] += np.bincount(a, weights=right.mult[others[b]], minlength=len(part)).astype(np.int64)
                n[shift + others] += np.bincount(b, weights=left.mult[part[a]], minlength=len(others)).astype(np.int64)
                nodes, at = np.unique(np.concatenate([part[a], shift + others[b]]), return_inverse=True)
                root = _roots(len(nodes), at[: len(a)], at[len(a) :])
                trees.append((nodes, nodes[root]))
    if trees:
        root = _roots(len(rid), np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees]))
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(rid[on]), pa.array(n[on]), pa.array(rid[root[on]])], names=["rid", "n", "root"])


def _exact(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows whose cosine, in doubles, is ``cosine`` or more."""
    use_l, use_r = np.unique(a), np.unique(b)
    x, y = unit(left[use_l].astype(np.float64)), unit(right[use_r].astype(np.float64))
    on = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 16_384):
        s = slice(at, at + 16_384)
        # in order of the components, whatever the block holds
        on[s] = np.cumsum(x[np.searchsorted(use_l, a[s])] * y[np.searchsorted(use_r, b[s])], axis=1)[:, -1] >= cosine
    return a[on], b[on]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows reaches by links (a, b)."""
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == was).all():
            return root


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str], place: str) -> Iterator[tuple[tuple[tuple, int], pa.Table]]:
    """((key, place), rows): runs of equal keys and place in order, in pieces of about :data:`CHUNK` rows."""
    held, size, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in (*keys, place)]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [b.num_rows]])
        for at, end in zip(starts, starts[1:], strict=False):
            *key, side = (c[at].item() for c in columns)
            if held and (last != (tuple(key), side) or size >= CHUNK):
                yield last, pa.Table.from_batches(held)
                held, size = [], 0
            last = (tuple(key), side)
            held.append(b.slice(at, end - at))
            size += end - at
    if held:
        yield last, pa.Table.from_batches(held)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = pc.list_value_length(b.column("v"))
    for dim in pc.unique(dims).to_pylist():
        yield dim, b.filter(pc.equal(dims, dim))


def index_vectors(valid: DataFrame, per_list: int = PER_LIST, block: int = BLOCK, kind: str = "double") -> tuple[DataFrame, dict[int, Quantiser]]:
    """(distinct vectors of each label with their list and code, written; the quantiser of each length)."""
    one = written(valid.groupBy("label", "v").agg(F.min("rid").alias("rid"), F.count("*").alias("mult")), "distinct")
    per = one.groupBy(F.size("v").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect()
    fitted = {m["dim"]: fit_quantiser(one.where(F.size("v") == m["dim"]), m["n"], m["most"], per_list, block) for m in per}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in (part for whole in batches for part in _by_length(whole)):
            x = unit(matrix(b.column("v")))
            own = fitted[dim].own(x)
            codes, err, angle = fitted[dim].encode(x, own)
            columns = [*b.columns, pa.array([dim] * len(x), pa.int32()), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "rid", "mult", "v", "dim", "list", "code", "err", "angle"])

    out = written(one.select("label", "rid", "mult", "v").mapInArrow(encode, _INDEX.format(kind)), "index")
    drop(one)
    for r in out.groupBy("dim", "list").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # one row per list
        fitted[r["dim"]].angles[r["list"]] = r["low"], r["high"]
    return out, fitted
