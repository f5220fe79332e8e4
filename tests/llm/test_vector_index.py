"""How far the two vector indexes prune, and that nothing is lost for it."""

import numpy as np
import pytest

from rasterloom.llm import ann, embed_dedup
from rasterloom.llm.shared import written
from rasterloom.llm.vectors import fit_lists, k_means, list_count


def clustered(n, clusters, d=64, spread=0.3, seed=3, hot=0):
    """Vectors around ``clusters`` centres; the first ``hot`` of them around one."""
    r = np.random.default_rng(seed)
    c = r.normal(size=(clusters, d))
    which = r.integers(0, clusters, n)
    which[:hot] = 0
    x = c[which] + spread * r.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], "rid long, v array<double>, label int").repartition(4)


@pytest.mark.parametrize("hot", [0, 4000])
def test_neighbours_prune(spark, hot):
    """Balanced lists, replicas, few lists asked, none twice, recall against brute force."""
    n = 12_000
    x = clustered(n, 200, hot=hot)
    ix, postings, _ = ann.build_index(written(frame(spark, x), "t"), 20, per_list=300)
    assert len(ix.centroids) == 40
    stands = {}
    for r in postings.select("rid", "list").collect():
        stands.setdefault(r["rid"], []).append(r["list"])
    assert sorted(stands) == list(range(n))
    assert all(len(v) == len(set(v)) <= ann.COPIES for v in stands.values())
    sizes = np.bincount([k for v in stands.values() for k in v], minlength=40)
    assert sizes.sum() / n > 1.1 and sizes.max() <= 2 * sizes.mean()
    asked, hits = [], []
    for q in range(0, n, 97):
        lists = ix.probe(x[q])
        assert len(lists) == len(set(lists))
        s = x @ x[q]
        s[q] = -np.inf
        asked.append(len(lists) / 40)
        hits.append(np.mean([bool(set(lists) & set(stands[k])) for k in np.argsort(-s)[:20]]))
    assert np.mean(asked) <= 0.25 and np.mean(hits) >= 0.9


def test_neighbours_through_many_lists(spark):
    x = clustered(6000, 60, d=16).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(df, per_list=100, every=60, block=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for q in range(0, 6000, 60):
        s = x @ x[q]
        s[q] = -np.inf
        assert sorted(r for r, _, _ in got[q]) == list(range(1, 21)) and all(abs(s[i] - v) < 1e-12 for _, i, v in got[q])
        hits.append(len({i for _, i, _ in got[q]} & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_lists_in_two_levels(spark):
    """More lists than the driver fits: cells first, then each cell's lists in its own task."""
    x = clustered(6000, 100)
    c = fit_lists(written(frame(spark, x), "t"), len(x), 60, balanced=True, fan=6)
    assert 50 <= len(c) <= 70
    d = ((x[:, None] - c[None, :, :-1]) ** 2).sum(axis=2) + c[:, -1] ** 2
    sizes = np.bincount(d.argmin(axis=1), minlength=len(c))
    assert sizes.max() <= 3 * sizes.mean()
    assert len(fit_lists(written(frame(spark, x), "t"), len(x), 60, fan=6)) >= 50


def test_list_count_has_no_ceiling():
    assert [list_count(n, 1024) for n in (0, 1, 1024, 1025, 1 << 20, 1 << 30)] == [1, 1, 1, 2, 1024, 1 << 16]


def test_balance_on_equal_vectors():
    assert len(k_means(np.ones((50, 3)), 4, balanced=True)) == 4
    assert k_means(np.zeros((0, 3)), 4, balanced=True).shape == (1, 4)


@pytest.mark.parametrize("clusters", [30, 500])
def test_embedding_dedup_prunes(spark, clusters):
    """Few other lists are asked, every partner's list is, and codes exclude nearly all that is no partner."""
    n = 8000
    x = clustered(n, clusters, spread=0.15)
    one, fitted = embed_dedup.index_vectors(written(frame(spark, x), "t").withColumn("label", __import__("pyspark").sql.functions.lit(0)))
    q = fitted[64]
    rows = {r["rid"]: r for r in one.collect()}
    own = np.array([rows[k]["list"] for k in range(n)])
    err = np.array([rows[k]["err"] for k in range(n)])
    assert len(q.lists) == list_count(n, embed_dedup.PER_LIST) > 50
    asked = np.zeros((n, len(q.lists)), dtype=bool)
    for _, a, b in q.probes(x, own, 0.93):
        asked[a, b] = True
    assert asked.sum() / (n * (len(q.lists) - 1)) < 0.3
    assert err.mean() < np.sqrt(2 - 2 * 0.93)
    some = range(0, n, 40)
    for k in some:
        for p in np.flatnonzero(x @ x[k] >= 0.93):
            assert own[p] == own[k] or asked[k, own[p]]


def test_embedding_dedup_codes_keep_partners_and_drop_the_rest():
    r = np.random.default_rng(5)
    x = embed_dedup.unit(r.normal(size=(3000, 64)))
    x[1:600:2] = embed_dedup.unit(x[0:600:2] + r.normal(size=(300, 64)) * 0.04)
    lists = k_means(x, 20)
    q = embed_dedup.Quantiser(lists, [], list(range(0, 65, 4)))
    own = q.own(x)
    q.books = [k_means((x - lists[own])[:, a : a + 4], 256, rounds=5) for a in range(0, 64, 4)]
    codes, err, _ = q.encode(x, own)
    within, kept, all_ = np.sqrt(2 - 2 * 0.93), 0, 0
    for k in range(20):
        right = np.flatnonzero(own == k)
        may = q.lookup(x, q.tables(x), k, codes[right]) <= within + err[right] + 1e-4
        stand = lists[k] + np.concatenate([q.books[s][codes[right, s]] for s in range(16)], axis=1)
        assert np.allclose(q.lookup(x[:50], q.tables(x[:50]), k, codes[right]), np.linalg.norm(x[:50, None] - stand[None], axis=2), atol=1e-4)
        assert not (~may & (x @ x[right].T >= 0.93)).any()
        kept, all_ = kept + may.sum(), all_ + may.size
    assert kept / all_ < 0.02
