"""Token counts without ids: every distinct pre-token is counted once for the corpus.

1. Each document becomes pre-token frequencies (in Arrow batches).
2. Distinct pre-tokens, combined before the shuffle, are counted in pieces once.
3. Frequencies join to those counts and are summed per document. A head of at
   most ``head`` frequent pre-tokens of at most 64 characters joins where the
   documents are read (its size is fixed, so it can travel with the tasks); all
   others join by shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.shared import with_row_id, written

#: Pre-tokens in the head, and characters of each, at most; longer ones join by shuffle.
HEAD, HEAD_CHARS = 131_072, 64
_BLANK = re.compile(r"\s ")
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def _splitter(path: str):
    specials = sorted(_specials(path), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None


def chunks_of(text: str, path: str) -> list[str]:
    """``text`` in parts that pre-tokenise apart; special strings are parts of their own.

    The text is cut before a space that follows a character other than white
    space. There a pre-token always begins and none before looks further, so the
    parts pre-tokenise as the whole would.
    """
    split = _splitter(path)
    pieces = split.split(text) if split and any(s in text for s in _specials(path)) else [text]
    out: list[str] = []
    for piece in pieces:
        if not piece:
            continue
        if _BLANK.search(piece) or piece[0] == " ":
            out += re.split(r"(?<=\S)(?= )", piece)
        else:
            first, *rest = piece.split(" ")
            out.append(first)
            out += [" " + x for x in rest]
    return out


def pretokens_of(chunk: str, path: str) -> tuple[str, ...]:
    """The pre-tokens of a part, by the library's own pre-tokeniser; plain Latin words with a mark are cut here."""
    m = _PLAIN.fullmatch(chunk)
    if m:
        return m.groups() if m[2] else (m[1],)
    if chunk in _specials(path):
        return (chunk,)
    return tuple(chunk[a:b] for _, (a, b) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(chunk))


def pretoken_counts(text: str, path: str) -> Counter:
    """Frequencies of the pre-tokens of ``text``; special strings count as pre-tokens of their own."""
    out: Counter = Counter()
    for chunk, n in Counter(chunks_of(text, path)).items():
        for p in pretokens_of(chunk, path):
            out[p] += n
    return out


def pieces_of(pretoken: str, path: str) -> int:
    return len(_tokenizer(path).encode(pretoken, add_special_tokens=False))


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; texts are counted whole;
    repeated rows and null ids are rows of their own; an empty table gives no
    rows; other columns are ignored.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out: Counter = Counter()
            for chunk, n in total.items():
                for p in pretokens_of(chunk, path):
                    out[p] += n
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["pretoken", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    total.update(chunks_of(t, path))
            if len(total) > 400_000:
                yield flush()
        yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [pieces_of(p, path) for p in b.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("pretoken"), b.column("n"), pa.array(tokens, pa.int64())], names=["pretoken", "n", "tokens"])

    base = docs.select("doc_id", "text")
    words = base.select("text").mapInArrow(distinct, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    vocabulary = written(words.mapInArrow(count, "pretoken string, n long, tokens long"), "pretokens")
    # The head is all counts from a level on that leaves at most ``head`` of them; levels are eighths of a power of two.
    level = F.floor(F.log2("n") * 8)
    short = vocabulary.where(F.length("pretoken") <= HEAD_CHARS)
    levels, room, least = sorted(((r[0], r[1]) for r in short.groupBy(level).count().collect()), reverse=True), head, None
    for k, n in levels:
        room -= n
        if room < 0:
            break
        least = k
    top = {} if least is None else {r["pretoken"]: r["tokens"] for r in short.where(level >= least).select("pretoken", "tokens").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(top)  # at most ``head`` entries of ``HEAD_CHARS`` characters

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        table: dict[str, int] = {}  # parts whose pre-tokens are all in the head; bounded

        for b in batches:
            ids, sums, p_id, p_tok, p_n, n_bytes = [], [], [], [], [], []
            for r, t in zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = t or ""
                chunks = chunks_of(t, path)
                sizes = list(map(table.get, chunks, repeat(0)))
                total = sum(sizes)
                for chunk, n in Counter([c for c, k in zip(chunks, sizes, strict=True) if not k]).items():
                    tokens = pretokens_of(chunk, path)
                    counts = [known.get(p, 0) for p in tokens]
                    total += sum(counts) * n
                    if all(counts):
                        if len(table) < 3 * head:
                            table[chunk] = sum(counts)
                        continue
                    for p, k in zip(tokens, counts, strict=True):
                        if not k:
                            p_id.append(r)
                            p_tok.append(p)
                            p_n.append(n)
                ids.append(r)
                sums.append(total)
                n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
            n, m = len(ids), len(p_id)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + p_id, pa.int64()), pa.array(b.column("doc_id").to_pylist() + [None] * m, pa.int64()), pa.array(n_bytes + [None] * m, pa.int64()),
                    pa.array([None] * n + p_tok, pa.string()), pa.array(sums + p_n, pa.int64()),
                ],
                names=["rid", "doc_id", "n_bytes", "pretoken", "n"],
            )

    rows = written(with_row_id(base).mapInArrow(frequencies, "rid long, doc_id long, n_bytes long, pretoken string, n long"), "frequencies")
    rare = rows.where("pretoken IS NOT NULL").select("rid", "pretoken", "n")
    rare = rare.join(vocabulary.select("pretoken", "tokens"), "pretoken").groupBy("rid").agg(F.sum(F.col("n") * F.col("tokens")).alias("rare"))
    out = rows.where("pretoken IS NULL").select("rid", "doc_id", "n_bytes", "n").join(rare, "rid", "left")
    n_tokens = F.col("n") + F.coalesce("rare", F.lit(0))
    return out.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))

