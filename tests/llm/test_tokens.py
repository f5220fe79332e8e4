"""Packing, token counts and byte-level BPE against the tokenizer libraries."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterloom.llm import bpe, packing, token_counts
from tests.llm.conftest import odd_documents, words

WORD, BYTE, RANKS = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))
TEXT = st.text(st.sampled_from(list("abcXYZ 12.,'\n\t!éß中\u00a0\u0301😀<|>")) | st.characters(exclude_categories=("Cs",)), max_size=60)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def ranks():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_equal_the_library(text):
    t = Tokenizer.from_file(WORD) if not hasattr(test_word_ids_equal_the_library, "t") else test_word_ids_equal_the_library.t
    test_word_ids_equal_the_library.t = t
    assert np.frombuffer(packing.document_ids(text, WORD), "<u4").tolist() == [*ids(t, text), 0]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pretoken_counts_sum_to_the_library(text):
    t = Tokenizer.from_file(BYTE) if not hasattr(test_pretoken_counts_sum_to_the_library, "t") else test_pretoken_counts_sum_to_the_library.t
    test_pretoken_counts_sum_to_the_library.t = t
    assert sum(n * token_counts.pieces_of(p, BYTE) for p, n in token_counts.pretoken_counts(text, BYTE).items()) == len(ids(t, text))


def check_packing(rows, expected, capacity=2048):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(expected)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def expected_pieces(docs, word, capacity=2048):
    out = []
    for d in docs:
        x = [*ids(word, d[1]), 0]
        for k, at in enumerate(range(0, len(x), capacity)):
            p = x[at : at + capacity]
            out.append((d[0], k, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    return out


def test_packing_odd_documents(odd, word):
    rows = packing.pack(odd, WORD).collect()
    check_packing(rows, expected_pieces(odd_documents(), word))


def test_packing_empty(none):
    assert packing.pack(none, WORD).collect() == []


def test_packing_exchanges_between_partitions(spark):
    lengths = np.random.default_rng(3).integers(1, 2048, 3000)
    df = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    want = [(k, 0, 0, int(n), 0) for k, n in enumerate(lengths)]
    exchanged, apart, together = (check_packing(packing.pack_pieces(df, per_task=p, rounds=r).collect(), want) for p, r in ((500, 6), (500, 1), (3000, 1)))
    bound = packing.lower_bound(lengths, 2048)
    assert bound <= together <= bound + 10 and together <= exchanged < apart


def test_lower_bound_holds_and_bites():
    r = np.random.default_rng(1)
    for _ in range(60):
        x = np.sort(r.integers(1, 101, r.integers(1, 12)))[::-1]
        bins = packing.best_fit_decreasing(x, 100)
        n = bins.max() + 1
        assert (np.bincount(bins, weights=x) <= 100).all()
        best = optimum(x.tolist(), 100)
        assert packing.lower_bound(x, 100) <= best <= n
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5  # volume says 4


def optimum(sizes, cap):
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= cap and bins[b] not in bins[:b]:
                bins[b] += sizes[k]
                go(k + 1, bins)
                bins[b] -= sizes[k]
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_token_counts_odd_documents(odd, byte, head):
    got = Counter(tuple(r) for r in token_counts.count_tokens(odd, BYTE, limit=20, head=head).collect())
    want = Counter((d[0], len((d[1] or "").encode()), n := len(ids(byte, d[1])), n > 20) for d in odd_documents())
    assert got == want


def test_token_counts_empty(none):
    assert token_counts.count_tokens(none, BYTE).collect() == []


def expected_codes(docs, ranks):
    out = Counter()
    for d in docs:
        t = d[1] or ""
        x = ranks.encode_ordinary(t)
        out[(d[0], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("chunk,overlap", [(16_384, 1_024), (512, 64), (100, 16)])
def test_bpe_odd_documents(odd, ranks, chunk, overlap):
    got = Counter(tuple(r) for r in bpe.encode_documents(odd, RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect())
    assert got == expected_codes(odd_documents(), ranks)


def test_bpe_empty(none):
    assert bpe.encode_documents(none, RANKS, P.PATTERN).collect() == []


def test_bpe_stitches_awkward_texts(spark, ranks):
    """White-space runs, contractions and letters without end across the chunk borders."""
    docs = [(k, t) for k, t in enumerate(["a" + " " * k + "b" * 30 + "\n" * (k % 7) + "x're" * 9 for k in range(40)] + ["é" * 300, " " * 300, "\n x" * 90, "'" * 150 + "re" * 60])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(tuple(r) for r in bpe.encode_documents(df, RANKS, P.PATTERN, chunk=32, overlap=12).collect())
    assert got == expected_codes(docs, ranks)
