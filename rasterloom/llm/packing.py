"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Full pieces are
sequences by themselves. The others are packed by best-fit decreasing in
partitions of bounded size; lower bounds from dual feasible functions certify a
partition whose bin count they reach. Partitions with a gap give up their bins
that have room, the documents of these are dealt out anew, and best-fit
decreasing runs again, for a few rounds or until no gap is left; an exchange
that saves no bin is not taken.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.shared import Generations, release, written

CAPACITY = 2048
#: Pieces that one task packs at a time.
PER_TASK = 50_000
ROUNDS = 6
_PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def word_ids(path: str) -> Generations:
    """White-space separated word to its ids (little-endian bytes), by the tokenizers library.

    The tokenizer lower-cases, parts at white space, and a word's ids don't
    depend on its neighbours. Words of plain Latin letters go to the library's
    BPE model directly, which saves its normaliser; all others go through the
    whole of it.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters, marks = tokenizer.model, _byte_letters(), {"": b""}

    def whole(word: str) -> bytes:
        ids = tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def make(word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        if not m:
            return whole(word)
        plain, mark = m.groups()
        ids = [t.id for t in model.tokenize(unicodedata.normalize("NFC", plain).lower().encode().decode("latin-1").translate(letters))]
        if mark not in marks:
            marks[mark] = whole(mark)
        return struct.pack(f"<{len(ids)}I", *ids) + marks[mark]

    return Generations(make)


def document_ids(text: str, path: str) -> bytes:
    """Ids of the whole text, then id 0."""
    words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return b"".join(map(word_ids(path).__getitem__, words)) + b"\0\0\0\0"


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenise_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32); only documents longer than ``capacity`` are cut."""
    step = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = document_ids(t or "", path)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, v in zip(rows, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _PIECE, strict=True)], schema=_PIECE)
        release(word_ids(path))

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE_DDL)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that ``lengths`` (each at most ``capacity``) can need, by dual feasible functions.

    Takes the largest of the plain volume, the rounding functions u_k (k to 20),
    and the threshold functions with the pairing argument, for every threshold.
    """
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * size).sum()) // capacity)
    for k in range(1, 21):
        x = (k + 1) * size
        u = np.where(x % capacity == 0, size * k, (x // capacity) * capacity)  # times k
        best = max(best, -(-int((n * u).sum()) // (capacity * k)))
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    half = capacity // 2
    a = np.arange(0, half + 1)
    big = count[capacity + 1] - count[capacity - a + 1]  # longer than capacity - a
    mid = count[capacity - a + 1] - count[half + 1]
    room = mid * capacity - (total[capacity - a + 1] - total[half + 1])
    small = total[half + 1] - total[a]
    return max(best, int((big + mid + np.maximum(0, -(-(small - room) // capacity))).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each of ``lengths``, which must not increase. Bins are found by their room through a bit set."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, out = 0, 0, np.empty(len(lengths), dtype=np.int64)
    for k, x in enumerate(lengths.tolist()):
        fitting = rooms >> x
        if fitting:
            room = x + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        out[k] = b
        left = room - x
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return out


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, per_task: int = PER_TASK, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the single id 0. Equal and repeated rows are pieces
    of their own; null ids are kept; an empty table gives no rows; other columns
    are ignored. Pieces are dealt to tasks evenly whatever their ids, so no
    document, source or repeated row makes a hot task.
    """
    pieces = written(tokenise_pieces(docs, path, capacity), "pieces")
    return pack_pieces(pieces, capacity=capacity, per_task=per_task, rounds=rounds)


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, per_task: int = PER_TASK, rounds: int = ROUNDS) -> DataFrame:
    out_ddl = f"{_PIECE_DDL}, sequence_id long, offset long, open boolean"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(range(at, at + n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array([False] * n, pa.bool_())],
                names=[*columns, "sequence_id", "offset", "open"],
            )
            at += n

    def packer(turn: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(batches)  # per_task pieces, dealt evenly
            if not sum(b.num_rows for b in parts):
                return
            d = pa.Table.from_batches(parts).cast(_PIECE)
            d = d.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32"))])
            lengths = d["length"].to_numpy()
            bins = best_fit_decreasing(lengths, capacity)
            n_bins = int(bins.max()) + 1
            fill = np.bincount(bins, weights=lengths, minlength=n_bins).astype(np.int64)
            gap = n_bins - lower_bound(lengths, capacity)
            # Certified partitions keep all bins; others give up the emptiest ones, several for each bin of the gap.
            freed = np.zeros(n_bins, dtype=bool)
            if gap > 0 and not last:
                loose = np.argsort(fill, kind="stable")[: 8 * gap]
                freed[loose[fill[loose] < capacity]] = True
            order = np.argsort(bins, kind="stable")
            before = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
            first = np.concatenate([[True], np.diff(bins[order]) > 0])
            d = d.take(pa.array(order))
            d = d.append_column("sequence_id", pa.array((turn + 1 << 56) + (TaskContext.get().partitionId() << 32) + bins[order]))
            d = d.append_column("offset", pa.array(before - before[first][np.cumsum(first) - 1]))
            yield from d.append_column("open", pa.array(freed[bins[order]])).combine_chunks().to_batches()

        return run

    full = pieces.where(F.col("length") == capacity).mapInArrow(alone, out_ddl)
    done, rest = [full], pieces.where(F.col("length") < capacity)
    n = rest.count()
    held, n_held = None, 0  # what was given up, as it was packed before
    for turn in range(rounds):
        if not n:
            break
        # Round robin over written rows: equal rows spread as well, and a retried task gets the same rows.
        dealt = rest.repartition(max(1, -(-n // per_task)))
        packed = written(dealt.mapInArrow(packer(turn, turn == rounds - 1), out_ddl), f"packed{turn}")
        bins, n = packed.agg(F.countDistinct("sequence_id"), F.count_if("open")).first()
        if held is not None and bins >= n_held:
            done.append(held)  # the exchange gained nothing
            break
        done.append(packed.where("NOT open"))
        held = packed.where("open")
        rest, n_held = held.select(*columns), held.select("sequence_id").distinct().count() if n else 0
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select(*columns, "sequence_id", "offset")
