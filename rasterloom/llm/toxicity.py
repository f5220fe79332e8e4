"""Toxicity by a classifier chain of linear models over hashed words and word beginnings.

Categories are predicted in order; each later model also sees the probabilities
of the earlier ones. In training these are out-of-fold, so a later model meets
them as uncertain as they will be on new documents.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.shared import Generations, fresh, release, written

#: Labelled documents to fit on at most, hash space, folds.
SAMPLE, SPACE, FOLDS = 20_000, 1 << 18, 5
#: Log-likelihood ratio that a kept feature exceeds: one in a thousand does by chance.
LEAST_SCORE = 10.8
PREFIXES = (3, 4, 5, 6)
#: A threshold that no probability reaches.
NEVER = 2.0
_PUNCTUATION = string.punctuation + "«»„“”‘’…–—¿¡"


def _features(word: str) -> tuple[int, ...]:
    import xxhash

    w = word.strip(_PUNCTUATION)
    if not w:
        return ()
    names = [f"={w}", *(f"^{w[:n]}" for n in PREFIXES if len(w) >= n)]
    return tuple({xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % SPACE for x in names})


@lru_cache(maxsize=1)
def _cache() -> Generations:
    return Generations(_features, 50_000)


def document_features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    cache = _cache()
    found: set[int] = set()
    for w in set((text or "").lower().split()):
        found.update(cache[w])
    return np.fromiter(found, dtype=np.int64, count=len(found))


@dataclass
class Chain:
    """Kept features (sorted); per category weights: features, earlier probabilities, bias; the last one's threshold."""

    categories: list[str]
    features: np.ndarray
    weights: list[np.ndarray]
    threshold: float = 0.5

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """One row per document; ``columns`` are positions in ``features``."""
        out = np.zeros((len(columns), len(self.categories)))
        m = len(self.features)
        for c, w in enumerate(self.weights):
            z = np.array([w[x].sum() for x in columns], dtype=float) if columns else np.zeros(0)
            z += out[:, :c] @ w[m : m + c] + w[-1]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _fit_one(col: np.ndarray, row: np.ndarray, m: int, extra: np.ndarray, y: np.ndarray, steps: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression over sparse 0/1 columns and dense ``extra``; the bias last. AdaGrad over the whole sample."""
    n, k = len(y), extra.shape[1]
    w = np.zeros(m + k + 1)
    rate = (y.sum() + 1) / (n + 2)
    w[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        w[-1] = -5.0  # nothing to tell apart
        return w
    past = np.full(m + k + 1, 1e-8)
    for _ in range(steps):
        z = np.bincount(row, weights=w[col], minlength=n) + extra @ w[m : m + k] + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(col, weights=r[row], minlength=m), extra.T @ r, [r.sum()]]) / n
        g[:-1] += l2 * w[:-1] / 10
        past += g * g
        w -= 0.7 * g / np.sqrt(past)
    return w


def fit_chain(columns: list[np.ndarray], labels: np.ndarray, categories: list[str], features: np.ndarray, folds: int = FOLDS) -> Chain:
    """``labels``: one row per document, a column per category."""
    n, m = len(columns), len(features)
    sizes = np.array([len(c) for c in columns], dtype=np.int64)
    col = np.concatenate(columns) if n and sizes.sum() else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(n), sizes)
    fold = np.arange(n) % folds
    oof, weights = np.zeros((n, 0)), []
    for c in range(len(categories)):
        y = labels[:, c].astype(float) if n else np.zeros(0)
        p = np.zeros(n)
        for f in range(folds):
            inside = fold != f
            at = np.cumsum(inside) - 1
            e = inside[row]
            w = _fit_one(col[e], at[row[e]], m, oof[inside], y[inside])
            z = np.bincount(row, weights=w[col], minlength=n) + oof @ w[m:-1] + w[-1]
            p[~inside] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[~inside]
        weights.append(_fit_one(col, row, m, oof, y))
        oof = np.column_stack([oof, p])
    return Chain(categories, features, weights, best_threshold(oof[:, -1], labels[:, -1].astype(bool)) if n else 0.5)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where out-of-fold probabilities part best (largest F1), halfway in log-odds across the gap; at most 0.5.

    Where flagging everything is best, the model tells nothing apart and nothing is flagged.
    """
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    if not len(p) or not hit[-1] or hit[-1] == len(p):
        return 0.5
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + hit[-1])
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # ties stay together
    k = int(f1.argmax())
    if k == len(p) - 1:
        return NEVER  # nothing is told apart
    low, high = p[order[min(k + 1, len(p) - 1)]], p[order[k]]
    odds = lambda q: np.log(q / (1 - q))
    middle = (odds(np.clip(low, 1e-9, 1 - 1e-9)) + odds(np.clip(high, 1e-9, 1 - 1e-9))) / 2
    return float(min(0.5, 1 / (1 + np.exp(-middle))))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], *, sample: int = SAMPLE, least_docs: int = 5) -> Chain:
    """A chain over ``categories`` (name to SQL expression over ``labels``), in their order.

    Fits on at most ``sample`` labelled documents, those of the smallest hashed
    doc_id. Labels of one doc_id combine by maximum; null ids and null labels
    are left out; without labels (or with one class only) nothing is ever
    flagged. All features are kept that speak for a category by their
    log-likelihood ratio; the hash space bounds their number.
    """
    names = list(categories)
    y = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.expr(e).cast("int")).alias(f"y{k}") for k, e in enumerate(categories.values())))
    y = y.dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = written(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").drop("doc_id"), "labelled")  # y has at most ``sample`` rows
    width = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((width + 1, SPACE), dtype=np.int64)
        for b in batches:
            ys = np.column_stack([b.column(f"y{k}").to_numpy(zero_copy_only=False) for k in range(width)])
            for t, v in zip(b.column("text").to_pylist(), ys, strict=True):
                f = document_features(t)
                n[0, f] += 1
                for k in np.flatnonzero(v):
                    n[k + 1, f] += 1
        release(_cache())
        used = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(n[k, used]) for k in range(width + 1))], names=["f", *(f"n{k}" for k in range(width + 1))])

    stats = chosen.mapInArrow(count, "f long, " + ", ".join(f"n{k} long" for k in range(width + 1)))
    stats = stats.groupBy("f").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(width + 1))).where(F.col("n0") >= least_docs)
    size = chosen.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"y{k}"), F.lit(0)).alias(f"y{k}") for k in range(width))).first()
    n, score = float(size["n"]), F.lit(0.0)
    for k in range(width):
        pos = float(size[f"y{k}"])
        if 0 < pos < n:
            term = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
            a, b = F.col(f"n{k + 1}").cast("double"), (F.col("n0") - F.col(f"n{k + 1}")).cast("double")
            g2 = 2 * (term(a, F.col("n0") * pos / n) + term(b, F.col("n0") * (n - pos) / n) + term(pos - a, (n - F.col("n0")) * pos / n + 1e-9) + term((n - pos) - b, (n - F.col("n0")) * (n - pos) / n + 1e-9))
            score = F.greatest(score, F.when(a * n > F.col("n0") * pos, g2).otherwise(0.0))
    best = [r["f"] for r in stats.withColumn("score", score).where(F.col("score") > LEAST_SCORE).select("f").collect()]  # at most ``SPACE``
    features = np.array(sorted(best), dtype=np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.flatnonzero(np.isin(features, document_features(t))).astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cols], pa.binary()), *(b.column(f"y{k}") for k in range(width))], names=["c", *(f"y{k}" for k in range(width))])
        release(_cache())

    rows = chosen.mapInArrow(project, "c binary, " + ", ".join(f"y{k} int" for k in range(width))).collect()  # at most ``sample`` short rows
    rows.sort(key=lambda r: tuple(r))  # folds do not depend on the order of tasks
    columns = [np.frombuffer(r["c"], dtype=np.int32) for r in rows]
    return fit_chain(columns, np.array([[r[f"y{k}"] for k in range(width)] for r in rows]).reshape(len(rows), width), names, features)


def score(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability per category appended (columns ``prefix`` + name), whole texts read.

    Null and empty texts have no features and get the chain's base rates; rows
    are never dropped or joined, so repeated rows and null ids stay as they are;
    other columns pass through; a new name that is taken gets underscores.
    """
    new = fresh(docs, *(f"{prefix}{c}" for c in chain.categories))
    place = {int(f): k for k, f in enumerate(chain.features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(word: str) -> tuple[int, ...]:
            return tuple(place[f] for f in _features(word) if f in place)

        cache = Generations(kept, 50_000)
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            columns = []
            for t in b.column("text").to_pylist():
                found: set[int] = set()
                for x in set(map(cache.__getitem__, set((t or "").lower().split()))):
                    found.update(x)
                columns.append(np.array(sorted(found), dtype=np.int64))
            p = np.round(chain.probabilities(columns), 6)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(len(new)))], names=[*b.schema.names, *new])
        release(cache)

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields])
    for c in new:
        schema = schema.add(c, DoubleType())
    return docs.mapInArrow(run, schema)
