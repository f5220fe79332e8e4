"""Vector operators against brute force."""

import numpy as np
import pytest

from rasterloom.llm import ann, embed_dedup
from rasterloom.llm.shared import components

SCHEMA = "vec_id long, embedding array<float>, label int, rid string"


def vectors(n=400, d=16, seed=1, groups=6):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for k in range(groups):  # near copies, within and beyond the threshold
        a = r.normal(size=d)
        m = slice(k * 20, k * 20 + 20)
        x[m] = a + r.normal(size=(20, d)) * 0.05 * (k + 1)
    x[200:230] = x[200]
    return x.astype(np.float32)


def odd_rows():
    x = vectors()
    rows = [(k, v.tolist(), int(k % 3) if k >= 230 else int(k // 115), "r") for k, v in enumerate(x)]
    bad = [(1000, None, 1, None), (1001, [0.0] * 16, 1, None), (1002, [float("nan")] * 16, 1, None), (1003, [None] + [1.0] * 15, 1, None), (1004, [], 1, None), (1005, [1.0] * 3, 1, None), (1006, [float("inf")] * 16, 1, None)]
    return rows + [(2000, rows[0][1], None, None), (2020, (x[5] * 3).tolist(), 0, None), rows[7], (None, rows[9][1], 0, None)] + bad


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(4)


def valid(v):
    return v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("block,per_list", [(1024, 512), (32, 20)])
def test_embedding_dedup_matches_brute_force(table, block, per_list):
    rows = odd_rows()
    n = len(rows)
    x = np.array([r[1] if valid(r[1]) else [1.0] * 16 for r in rows], dtype=float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = [r[2] if valid(r[1]) else None for r in rows]
    link = np.array([[a != b and label[a] is not None and label[a] == label[b] for b in range(n)] for a in range(n)]) & (x @ x.T >= 0.93)
    comp = np.arange(n)
    while True:
        was = comp.copy()
        for a in range(n):
            comp[a] = min(comp[a], *(comp[link[a]] if link[a].any() else [n]))
        if (comp == was).all():
            break
    name = {c: min((rows[k][0] for k in np.flatnonzero(comp == c) if rows[k][0] is not None), default=None) for c in set(comp.tolist())}
    want = sorted(((rows[k][0], int(link[k].sum()), name[comp[k]], rows[k][0] == name[comp[k]]) for k in range(n)), key=str)
    got = sorted((tuple(r) for r in embed_dedup.near_vectors(table, block=block, per_list=per_list).collect()), key=str)
    assert got == want


def test_embedding_dedup_empty(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    bad = spark.createDataFrame([(1, None, 1, None), (2, [0.0], 1, None)], SCHEMA)
    assert sorted(tuple(r) for r in embed_dedup.near_vectors(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("block", [1024, 64])
def test_neighbours_recall_and_scores(table, block):
    rows = [r for r in odd_rows() if valid(r[1]) and r[0] is not None]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    got = {}
    for r in ann.nearest(table, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [k for k in range(len(rows)) if ids[k] % 20 == 0]
    assert set(got) == {int(ids[k]) for k in asked}
    hits = []
    for k in asked:
        s = x @ x[k]
        order = sorted((j for j in range(len(rows)) if j != k), key=lambda j: (-s[j], ids[j]))[:20]
        mine = sorted(got[ids[k]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(a[2] > b[2] - 1e-9 for a, b in zip(mine, mine[1:], strict=False))
        assert all(any(abs(s[j] - m[2]) < 1e-9 for j in np.flatnonzero(ids == m[1])) for m in mine)
        hits.append(len({m[1] for m in mine} & {int(ids[j]) for j in order}) / len({int(ids[j]) for j in order}))
    assert np.mean(hits) >= 0.95


def test_neighbours_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, None), (1, [0.5, 0.5], 1, None), (2, [0.5, 0.5], 1, None), (20, None, 1, None)], SCHEMA)
    assert [tuple(r) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.nearest(few.limit(0)).collect() == []


def test_neighbours_large_norms(spark):
    """Inner product, not cosine: a long vector wins."""
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 8)) * r.uniform(0.2, 5, size=(300, 1))
    df = spark.createDataFrame([(k, v.tolist(), 0, None) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int, rid string")
    got = {}
    for row in ann.nearest(df, k=5).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = [len(got[k] & set([j for j in np.argsort(-(x @ x[k]), kind="stable") if j != k][:5])) / 5 for k in got]
    assert len(got) == 15 and np.mean(hits) >= 0.9


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (300, 200), (200, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
