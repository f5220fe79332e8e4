"""Vectors of several lengths in one table: those of equal length meet."""

import numpy as np

from rasterloom.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows():
    """60 vectors of length 16, 30 of length 5 and 4 of length 3, near copies in each; labels hold more than one length."""
    r = np.random.default_rng(11)
    out = []
    for dim, n in ((16, 60), (5, 30), (3, 4)):
        base = r.normal(size=(max(1, n // 10), dim))
        out += [(base[k % len(base)] + r.normal(size=dim) * 0.1).astype(np.float32) for k in range(n)]
    return [(k, v.tolist(), k % 2) for k, v in enumerate(out)]


def test_embedding_dedup_links_within_each_length(spark):
    data = rows()
    x = [np.array(v) / np.linalg.norm(v) for _, v, _ in data]
    want = {a: sum(b != a and data[a][2] == data[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.93 for b in range(len(data))) for a in range(len(data))}
    assert min(sum(want[a] for a in want if len(x[a]) == dim) for dim in (16, 5, 3)) > 0
    got = embed_dedup.near_vectors(spark.createDataFrame(data, SCHEMA).repartition(3), per_list=10).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == want
    sizes = {}
    for r in got:
        sizes.setdefault(r["component_id"], set()).add(len(x[r["vec_id"]]))
    assert all(len(s) == 1 for s in sizes.values())


def test_neighbours_within_each_length(spark):
    data = rows()
    got = {}
    for r in ann.nearest(spark.createDataFrame(data, SCHEMA).repartition(3), k=3, every=1).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == set(range(len(data)))
    for a, near in got.items():
        same = [b for b in range(len(data)) if b != a and len(data[b][1]) == len(data[a][1])]
        best = sorted(same, key=lambda b: (-np.dot(data[a][1], data[b][1]), b))[:3]
        assert [b for _, b in sorted(near)] == best
