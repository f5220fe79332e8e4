"""A label of many lists: each vector travels a few times, in several passes, and no link is lost."""

import numpy as np

from rasterloom.llm import embed_dedup


def test_embedding_dedup_deals_few_copies(spark, monkeypatch):
    n = 17_000  # more than 256 lists, so that lists are fitted in two levels
    r = np.random.default_rng(6)
    x = r.normal(size=(n, 16))
    x[::7] = x[r.integers(0, 40, len(x[::7])) * 7] + r.normal(size=(len(x[::7]), 16)) * 0.2  # clusters about the threshold
    x[1:200:9], x[5:3000:50] = x[1], x[5]
    x[3] = x[2] * 2
    x = x.astype(np.float32)
    x[10], x[11] = 0, 0
    x[10, :2], x[11, :2] = (0.0, 1.0), (-0.0, 1.0)
    dealt, items = [], embed_dedup.items

    def counted(*args, **more):
        out = items(*args, **more)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(embed_dedup, "items", counted)
    monkeypatch.setattr(embed_dedup, "PASS", 1_000, raising=False)
    df = spark.createDataFrame([(k, v.tolist(), 5) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {row["vec_id"]: (row["n_links"], row["component_id"]) for row in embed_dedup.near_vectors(df).collect()}
    assert sum(dealt) <= 7 * n and len(dealt) > 1 and max(dealt) <= 2.5 * n
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links, component = np.zeros(n, dtype=int), np.arange(n)
    pairs = []
    for at in range(0, n, 1000):
        a, b = np.nonzero(u[at : at + 1000] @ u.T >= 0.93)
        pairs.append(np.stack([a + at, b])[:, a + at != b])
    a, b = np.concatenate(pairs, axis=1)
    np.add.at(links, a, 1)
    while True:
        was = component.copy()
        np.minimum.at(component, a, component[b])
        if (component == was).all():
            break
    assert len(a) > 10_000 and len(got) == n and links[10] == 1
    assert got == {k: (links[k], component[k]) for k in range(n)}
