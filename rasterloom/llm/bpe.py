"""Byte-level BPE encoding and decoding by a tiktoken rank file.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel.
Two neighbours agree from the first place on where both have a pre-token
boundary (the pattern never looks back), so the text is stitched there and the
pieces between stitches are encoded in parallel. Texts of one chunk are encoded
where they are read. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.shared import with_row_id, written

CHUNK, OVERLAP = 16_384, 1_024
#: A boundary this near to a chunk's cut end may move when more text follows:
#: a contraction needs two further characters, a run needs one.
MARGIN = 3


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = {i: t for t, i in ranks.items()}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def encode_ids(text: str, path: str, pattern: str) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit integers."""
    enc, _ = _encoding(path, pattern)
    return np.array(enc.encode_ordinary(text), dtype="<u4").tobytes()


def narrow(path: str, pattern: str) -> str:
    """Integer type in which ids travel: two bytes where all fit."""
    return "<u2" if max(_encoding(path, pattern)[1]) < 1 << 16 else "<u4"


def decode_bytes(ids: bytes, path: str, pattern: str) -> bytes:
    """The raw bytes that ``ids`` stand for."""
    _, table = _encoding(path, pattern)
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Ends of the pre-tokens of ``text``."""
    return np.fromiter((m.end() for m in _pattern(pattern).finditer(text)), dtype=np.int64)


def safe(text: str, ends: np.ndarray) -> np.ndarray:
    """Those of ``ends`` where the texts on both sides can be encoded apart.

    A piece that ends in white space could tokenise otherwise without what
    follows, so the character before must not be white space.
    """
    return np.array([e for e in ends.tolist() if 0 < e <= len(text) and not text[e - 1].isspace()], dtype=np.int64)


def _finish(ids: bytes, path: str, pattern: str) -> dict:
    return {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decode_bytes(ids, path, pattern)).hexdigest()}


_SHORT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("chunk", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])
_SHORT_DDL = "rid long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, chunk long, start long, text string, last boolean"
_BORDER = pa.schema([("rid", pa.int64()), ("chunk", pa.int64()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])


def encode_documents(docs: DataFrame, path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty (no ids); texts of any length are taken whole; repeated
    rows and null ids are rows of their own; an empty table gives no rows; other
    columns are ignored. Where two neighbouring chunks nowhere agree in their
    overlap (one pre-token longer than it) they are encoded as one piece.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, i, t in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = t or ""
                if len(t) <= chunk + overlap:
                    rows.append({"rid": r, "doc_id": i, **_finish(encode_ids(t, path, pattern), path, pattern)})
                    continue
                n = -(-(len(t) - overlap) // chunk)
                rows += [{"rid": r, "doc_id": i, "chunk": k, "start": k * chunk, "text": t[k * chunk : (k + 1) * chunk + overlap], "last": k == n - 1} for k in range(n)]
            yield pa.RecordBatch.from_pylist(rows, schema=_SHORT)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.to_pylist():
                t, at = x["text"], x["start"]
                ends = safe(t, boundaries(t, pattern))
                head = [] if x["chunk"] == 0 else (ends[ends <= overlap - MARGIN] + at).tolist()
                tail = [] if x["last"] else (ends[(ends >= chunk) & (ends <= len(t) - MARGIN)] + at).tolist()
                rows.append({"rid": x["rid"], "chunk": x["chunk"], "head": head, "tail": tail})
            yield pa.RecordBatch.from_pylist(rows, schema=_BORDER)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(encode_ids(t, path, pattern), "<u4").astype(kind).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("piece"), pa.array(ids, pa.binary())],
                names=["rid", "piece", "ids"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_finish(np.frombuffer(b"".join(p), kind).astype("<u4").tobytes(), path, pattern) for p in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pylist([{"rid": r, "doc_id": None, **d} for r, d in zip(b.column("rid").to_pylist(), done, strict=True)], schema=pa.schema(list(_SHORT)[:5]))

    kind = narrow(path, pattern)
    base = with_row_id(docs.select("doc_id", "text"))
    first = written(base.mapInArrow(read, _SHORT_DDL), "bpe")
    short = first.where("chunk IS NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    chunks = first.where("chunk IS NOT NULL").select("rid", "chunk", "start", "text", "last").repartition("rid", "chunk")
    # Borders are compared through a shuffle of boundaries only: border k lies between chunks k - 1 and k.
    ends = chunks.mapInArrow(pretokenise, "rid long, chunk long, head array<long>, tail array<long>")
    tails = ends.select("rid", (F.col("chunk") + 1).alias("chunk"), "tail")
    stitch = ends.select("rid", "chunk", "head").join(tails, ["rid", "chunk"]).select("rid", "chunk", F.array_min(F.array_intersect("head", "tail")).alias("at"))
    placed = chunks.join(stitch, ["rid", "chunk"], "left")
    begins = stitch.select("rid", (F.col("chunk") - 1).alias("chunk"), F.col("at").alias("until"))
    placed = placed.join(begins, ["rid", "chunk"], "left")
    # Chunk k gives [its stitch or, where none was found, the end of chunk k-1's text; next stitch or its own end).
    own_end = F.col("start") + F.length("text")
    low = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.coalesce("at", F.col("start") + overlap))
    high = F.coalesce("until", own_end)
    part = F.substring("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    parts = placed.select("rid", "chunk", ((F.col("chunk") == 0) | F.col("at").isNotNull()).cast("long").alias("opens"), part.alias("text"))
    # Pieces are single chunks nearly always; runs without a stitch are put together.
    w = Window.partitionBy("rid").orderBy("chunk")
    runs = parts.select("rid", "chunk", "opens").withColumn("piece", F.sum("opens").over(w)).select("rid", "chunk", "piece")
    sized = runs.withColumn("n", F.count("*").over(Window.partitionBy("rid", "piece")))
    parts = parts.select("rid", "chunk", "text").join(sized, ["rid", "chunk"])
    alone = parts.where("n = 1").select("rid", "piece", "text")
    merged = parts.where("n > 1").groupBy("rid", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "").alias("text"))
    ids = alone.union(merged).mapInArrow(encode, "rid long, piece long, ids binary")
    whole = ids.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]).alias("ids"))
    done = whole.mapInArrow(join, "rid long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").drop("doc_id")
    long = first.where("chunk = 0").select("rid", "doc_id").join(done, "rid").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return short.union(long)
