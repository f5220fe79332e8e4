"""MinHash near-duplicates of texts by DartMinHash signatures, banding and an exact check.

A document is the multiset of its five-word shingles: a shingle's weight is its
count, and similarity is the weighted Jaccard of two documents. Darts are thrown
by hash into weighted regions of each shingle: a region of weight width d gets
a Poisson process of rate d in time, seeded by (shingle, region) alone; a dart
counts for a document if its weight coordinate lies below the shingle's weight.
Each dart hashes to one of ``k`` coordinates, and a coordinate keeps its
earliest dart. Only darts up to time t / total weight are thrown, t of them on
average; documents with an unfilled coordinate double t.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.shared import Generations, bounded, components, drop, fresh, heavy_join, release, with_row_id, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Documents that one verifying task compares at a time come in blocks of about so many at most, and of about so many characters.
BLOCK, BLOCK_CHARS = 256, 4_000_000
_PUNCTUATION = string.punctuation + "«»„“”‘’…–—¿¡"
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _times(n: int, odd: np.uint64) -> np.uint64:
    return np.uint64(n * int(odd) % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@lru_cache(maxsize=1)
def _word_hashes() -> Generations:
    import xxhash

    return Generations(lambda w: xxhash.xxh3_64_intdigest((w.strip(_PUNCTUATION) or w).encode("utf-8", "surrogatepass")), 60_000)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words: lower case, parted by white space, without outer punctuation."""
    words = text.lower().split()
    return np.fromiter(map(_word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, counts). A text of fewer words is one shingle, none of no words."""
    n = len(words)
    if not n:
        return words, np.zeros(0, dtype=np.int64)
    m = max(1, n - width + 1)
    h = np.full(m, _times(min(n, width), _STEP), dtype=np.uint64)
    for j in range(min(n, width)):
        h = mix(h + words[j : j + m] * _times(2 * j + 1, _STEP))
    return np.unique(h, return_counts=True)


def signatures(items: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int, slack: float = 2.5) -> np.ndarray:
    """DartMinHash signatures (rows of ``k`` 64-bit values) of sets laid end to end.

    ``items`` are 64-bit element hashes, ``weights`` positive numbers, ``sizes``
    (all positive) the elements of each set.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, weights=weights, minlength=len(sizes))
    out = np.zeros((len(sizes), k), dtype=np.uint64)
    todo, t = np.arange(len(sizes)), k * (log(k) + slack)
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < len(sizes) else np.ones(len(owner), dtype=bool)
        slot = np.full(len(sizes), -1)
        slot[todo] = np.arange(len(todo))
        e, w, d = items[mine], weights[mine], slot[owner[mine]]
        until = (t / total[todo])[d]
        got: list[tuple] = []
        low, width, region = 0.0, 1.0, 0
        while True:
            live = np.flatnonzero(w > low)
            if not len(live):
                break
            seed = mix(e[live] + _times(region + 1, _M2))
            time, n = np.zeros(len(live)), 0
            while len(live):
                dart = mix(seed + _times(n + 1, _STEP))
                time = time - np.log(_uniform(dart)) / width
                on = time < until[live]
                live, seed, time, dart = live[on], seed[on], time[on], dart[on]
                name = mix(dart ^ _M1)
                hit = low + width * _uniform(mix(name)) < w[live] if region else w[live] >= 1
                if region == 0 and not hit.all():
                    hit = _uniform(mix(name)) < w[live]
                got.append((d[live][hit] * k + (name[hit] % np.uint64(k)).astype(np.int64), time[hit], name[hit]))
                n += 1
            low, width, region = (low + width), (width if region == 0 else 2 * width), region + 1
        at, when, name = (np.concatenate(x) for x in zip(*got, strict=True))
        sig, full = np.zeros(len(todo) * k, dtype=np.uint64), np.zeros(len(todo) * k, dtype=bool)
        late_first = np.argsort(-when, kind="stable")
        sig[at[late_first]] = name[late_first]  # the earliest is written last
        full[at] = True
        done = full.reshape(-1, k).all(axis=1)
        out[todo[done]] = sig.reshape(-1, k)[done]
        todo, t = todo[~done], 2 * t
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(sig), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for r in range(rows):
        h = mix(h ^ sig[:, r : bands * rows : rows] * _M2)
    return h.view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("k", pa.binary()), ("h", pa.binary()), ("chars", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = part.column("text").to_pylist()
            hs, at_unique, sets = [], {}, []
            for t in texts:
                w = word_hashes(t or "")
                h = xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None
                hs.append(h)
                if h is not None and h not in at_unique:
                    at_unique[h] = len(sets)
                    sets.append(shingles(w))
            rows_of = np.zeros((0, bands), dtype=np.int64)
            if sets:
                sig = signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(float), np.array([len(s[0]) for s in sets]), bands * rows)
                rows_of = band_hashes(sig, bands, rows)
            pick = np.array([at_unique[h] for h in hs if h is not None], dtype=np.int64)
            n = np.cumsum([0] + [0 if h is None else bands for h in hs])
            lists = pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(rows_of[pick].ravel() if len(pick) else [], pa.int64()), mask=pa.array([h is None for h in hs]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), pa.array(hs, pa.binary()), pa.array([len(t or "") for t in texts], pa.int64()), lists], schema=_SKETCH)
    release(_word_hashes())


def links_in_block(sets: list[tuple[np.ndarray, np.ndarray]], least: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever pairs of weighted Jaccard >= ``least`` connect, one for each join of two parts.

    A found document is compared with those not yet found only, so a block of
    near copies of one text takes few comparisons; nothing is skipped otherwise.
    Documents of equal ``known`` are connected already and found together.
    """
    sizes = np.array([len(s[0]) for s in sets])
    _, col = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
    tf = np.concatenate([s[1] for s in sets]).astype(np.int32)
    ends = np.cumsum(sizes)
    total = np.add.reduceat(tf, ends - sizes).astype(np.float64)
    seen = np.zeros(col.max() + 1, dtype=np.int32)
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    left = np.arange(len(sets))  # not found yet; l_col and l_tf hold these documents' entries
    l_col, l_tf, l_size = col, tf, sizes
    out: list[tuple[int, int]] = []

    def take(labels: np.ndarray) -> list[int]:
        nonlocal left, l_col, l_tf, l_size
        mask = ~np.isin(label[left], labels)
        found = left[~mask].tolist()
        e = np.repeat(mask, l_size)
        left, l_col, l_tf, l_size = left[mask], l_col[e], l_tf[e], l_size[mask]
        return found

    while len(left) > 1:
        queue = take(label[left[:1]])
        while queue and len(left):
            x = queue.pop()
            span = slice(ends[x] - sizes[x], ends[x])
            seen[col[span]] = tf[span]
            both = np.add.reduceat(np.minimum(seen[l_col], l_tf), np.cumsum(l_size) - l_size)
            seen[col[span]] = 0
            like = both >= least * (total[x] + total[left] - both) - 1e-9
            if like.any():
                out += [(x, y) for y in left[like].tolist()]
                queue += take(label[left[like]])
    return out


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sets of (sorted elements, counts)."""
    total = float(a[1].sum() + b[1].sum())
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = float(np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum())
    return both / (total - both)


_LINKS = "a long, b long"


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _verify_stars(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (leader, block, rid, text) sorted so that the leader comes first; it is compared with each other row, and only its shingles are held."""
    key, center, links = None, None, []
    for batch in batches:
        for lead, block, r, t in zip(*(batch.column(n).to_pylist() for n in ("leader", "block", "rid", "text")), strict=True):
            mine = shingles(word_hashes(t or ""))
            if (lead, block) != key:
                key, center = (lead, block), mine
            elif _likeness(center, mine) >= least - 1e-12:
                links.append((lead, r))
        if links:
            yield _link_batch(links)
            links = []
    release(_word_hashes())


def _verify_buckets(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, rid, v, text) come sorted by item; each item's documents are compared with one another."""
    key, held = None, {}

    def compare() -> pa.RecordBatch | None:
        if len({v for _, v in held.values()}) < 2:
            return None
        ids = list(held)
        links = links_in_block([held[r][0] for r in ids], least, [held[r][1] for r in ids])
        return _link_batch([(ids[a], ids[b]) for a, b in links])

    for batch in batches:
        for c, i, j, r, v, t in zip(*(batch.column(n).to_pylist() for n in ("bucket", "i", "j", "rid", "v", "text")), strict=True):
            if (c, i, j) != key:
                if (out := compare()) is not None:
                    yield out
                key, held = (c, i, j), {}
            held[r] = shingles(word_hashes(t or "")), v
    if (out := compare()) is not None:
        yield out
    release(_word_hashes())


def _blocks(n: str, chars: str, block: int) -> Column:
    """Blocks for ``n`` texts of ``chars`` characters: about ``block`` texts and ``BLOCK_CHARS`` characters to each."""
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(chars) / BLOCK_CHARS), F.lit(1)).cast("int")


def _star_links(shared: DataFrame, texts: DataFrame, least: float, block: int) -> DataFrame:
    """Links of each bucket's members with its leader (the smallest of them), each pair compared once.

    ``shared`` has (bucket, leader, rid), ``texts`` (rid, text, chars). A leader
    of many members is sent to several blocks of them, smaller ones than where
    documents meet each other.
    """
    block = max(1, block // 4)
    pairs = written(shared.where("rid != leader").select("leader", "rid").distinct(), "star-pairs")
    stars = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    stars = bounded(written(stars.select("leader", F.ceil(F.col("n") / block).cast("int").alias("nb")), "stars"))
    members = pairs.join(stars, "leader").select("leader", F.pmod(F.xxhash64("rid"), F.col("nb")).cast("int").alias("block"), "rid")
    leaders = stars.select("leader", F.explode(F.expr("sequence(0, nb - 1)")).alias("block"), F.col("leader").alias("rid"))
    dealt = members.union(leaders).join(texts.select("rid", "text"), "rid").select("leader", "block", "rid", "text")
    dealt = dealt.repartition("leader", "block").sortWithinPartitions("leader", "block", F.col("rid") != F.col("leader"), "rid")
    return written(dealt.mapInArrow(lambda it: _verify_stars(it, least), _LINKS), "links")


def _bucket_links(shared: DataFrame, texts: DataFrame, links: DataFrame, least: float, block: int) -> DataFrame:
    """Links within the buckets whose members ``links`` have not made one class yet.

    Buckets of the same members count once. In a bucket, documents outside its
    largest class meet all others, block against block; nothing else needs
    comparing. So the work is (documents outside) x (documents) of a bucket that
    holds unlike documents, and none for the many buckets of a group of copies.
    """
    found = components(links).select(F.col("node").alias("rid"), F.col("component").alias("found"))
    in_class = written(shared.join(found, "rid", "left").select("bucket", "rid", F.coalesce("found", "rid").alias("v")), "bucket-classes")
    open_ = in_class.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("who"), F.min("v").alias("low"), F.max("v").alias("high"))
    open_ = written(open_.where("low != high").groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "open")
    d = written(heavy_join(in_class, open_, "bucket", "n").drop("n").join(texts.select("rid", "chars"), "rid"), "open-buckets")
    drop(in_class)
    per = d.groupBy("bucket", "v").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    main = per.groupBy("bucket").agg(F.max_by("v", F.struct("n", "v")).alias("main"), F.max("n").alias("m"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.max_by("c", F.struct("n", "v")).alias("mc"))
    main = main.withColumn("rn", F.col("n") - F.col("m")).withColumn("rc", F.col("c") - F.col("mc"))
    main = written(main.select("bucket", "main", _blocks("n", "c", block).alias("nb"), _blocks("m", "mc", block).alias("mb"), _blocks("rn", "rc", block).alias("rb")), "open-sizes")
    d = d.join(bounded(main), "bucket").withColumn("own", F.pmod(F.xxhash64("rid"), F.expr("if(v = main, mb, rb)")).cast("int"))
    # A bucket of one block is one item. Else blocks 0 .. rb - 1 are of the rest, rb .. rb + mb - 1 of the largest class.
    of_main = "transform(sequence(0, rb - 1), o -> named_struct('i', o, 'j', rb + own))"
    of_rest = "concat(transform(sequence(0, rb - 1), o -> named_struct('i', least(o, own), 'j', greatest(o, own))), transform(sequence(0, mb - 1), o -> named_struct('i', own, 'j', rb + o)))"
    d = d.withColumn("it", F.explode(F.expr(f"if(nb = 1, array(named_struct('i', 0, 'j', 0)), if(v = main, {of_main}, {of_rest}))")))
    dealt = d.select("bucket", "it.i", "it.j", "rid", "v").join(texts.select("rid", "text"), "rid")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rid")
    return written(dealt.mapInArrow(lambda it: _verify_buckets(it, least), _LINKS), "links")


def _key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, *, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, and k, the MD5 of the text.

    Classes are the connected components of pairs whose five-word shingles have
    a weighted Jaccard of ``least`` or more, among pairs that share a band.
    class_id is the smallest doc_id of the class; kept marks one row of each (the
    smallest doc_id, then the first row).

    Null texts are empty. A text without words is a class of its own; texts
    under five words are one shingle; equal texts and repeated rows are one
    class; null ids come first in the order; an empty table gives no rows; other
    columns are ignored.

    Texts of equal words are one representative from the start, so a group of
    exact copies is a few rows. Every pair that shares a bucket is compared or
    connected already: first each member of a bucket with the bucket's smallest
    one, then, in buckets that this leaves in several classes, the documents
    outside the largest class with all others. Only similar pairs are linked;
    what merely collides is never joined. Tasks return links that join parts,
    never all pairs. Texts travel by representative that shares a bucket, found
    by a broadcast of their keys up to ``BROADCAST_ROWS`` of them, by a shuffle
    join beyond.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("k", _key())
    sketch = base.mapInArrow(lambda it: _sketch(it, bands, rows), "doc_id long, k binary, h binary, chars long, bands array<long>")
    sketch = written(with_row_id(sketch), "sketch")
    first = sketch.where("h IS NOT NULL").groupBy("h").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    first = written(first, "firsts")
    again = first.where("copies > 1")  # unique texts stand for themselves
    rows_ = heavy_join(sketch.select("rid", "doc_id", "k", "h"), again, "h", "copies", "left")
    rows_ = written(rows_.select("rid", "doc_id", "k", F.coalesce("rep", "rid").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "copies")

    reps = sketch.join(first.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", F.explode("bands").alias("bucket"))
    leader = written(reps.groupBy("bucket").agg(F.min("rid").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    shared = written(reps.join(leader, "bucket").select("bucket", "leader", "rid"), "shared-buckets")  # AQE splits a hot bucket
    wanted_ = written(shared.select("rid").distinct().join(sketch.select("rid", "doc_id", "k", "chars"), "rid"), "wanted")
    wanted = wanted_.withColumnsRenamed({"doc_id": "d", "k": "kk"})
    texts = base.join(bounded(wanted), (base.k == F.col("kk")) & base.doc_id.eqNullSafe(F.col("d"))).select("rid", "text", "chars")
    texts_ = written(texts, "candidates")  # repeated rows give a rid its text more than once
    texts = texts_ if texts_.count() == wanted.count() else texts_.dropDuplicates(["rid"])
    links = _star_links(shared, texts, least, block)
    links = links.union(_bucket_links(shared, texts, links, least, block))

    classes = components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "class")
    classes = written(classes.join(first.select("rep", F.col("copies").alias("n")), "rep"), "linked")  # one row per representative with a link
    counted = written(classes.groupBy("class").agg(F.sum("n").alias("class_size"), F.count("*").alias("reps")), "class-sizes")
    classes = written(heavy_join(classes, counted, "class", "reps").drop("reps"), "classes")
    joined = heavy_join(rows_, classes, "rep", "n", "left")
    joined = written(joined.select("rid", "doc_id", "k", F.coalesce("class", "rep").alias("class"), F.coalesce("class_size", "copies").alias("class_size")), "in-classes")
    firsts = joined.where("class_size > 1").groupBy("class").agg(F.min(F.struct("doc_id", "rid")).alias("f"), F.count("*").alias("n"))
    grouped = heavy_join(joined.where("class_size > 1"), written(firsts, "class-firsts"), "class", "n")
    drop(sketch, first, rows_, leader, shared, wanted_, texts_, classes, counted)
    grouped = grouped.select("doc_id", F.col("f.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("f.rid")).alias("kept"), "k")
    single = joined.where("class_size = 1").select("doc_id", F.col("doc_id").alias("class_id"), "class_size", F.lit(True).alias("kept"), "k")
    return grouped.union(single)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns.

    Null texts are empty, and texts without words stay. Rows come back by
    (doc_id, hash of the text); of several rows equal in both, the one whose
    columns come first as JSON stays, so a retried task keeps the same. An empty
    table gives no rows; extra columns pass through.

    Rows to drop travel by broadcast up to ``BROADCAST_ROWS`` of them; beyond,
    one shuffle of the rows finds them.
    """
    found = written(near_duplicates(docs, **options), "classes")
    per = found.groupBy("doc_id", "k").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    d, kk, kept, key, row = fresh(docs, "__d", "__kk", "__kept", "__key", "__row")
    per = written(per.where("NOT kept OR n > 1").select(F.col("doc_id").alias(d), F.col("k").alias(kk), F.col("kept").alias(kept)), "dropped")
    cols = docs.columns
    keyed = docs.withColumn(key, _key())
    on = (F.col(key) == F.col(kk)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d))
    single = keyed.join(bounded(per), on, "left_anti").select(*cols)
    twice = keyed.join(bounded(per.where(F.col(kept))), on, "left_semi")
    twice = twice.withColumn(row, F.struct(*cols)).groupBy("doc_id", key).agg(F.min_by(row, F.to_json(row)).alias(row))
    return single.union(twice.select(f"{row}.*"))
