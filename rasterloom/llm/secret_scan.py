"""Secret scans with corpus-wide ownership frequency.

Base kinds are fixed patterns. The method adds spans of two kinds after looking
at the whole corpus: every candidate value is hashed and counted by distinct
owners (source) and repositories (source and language); values of few owners
look live, values that many owners share are copied examples.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from rasterloom.llm.shared import fresh, with_row_id, written

KINDS = ("assign", "access", "hex", "live", "example")
_WORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as of [0-9a-f]+, that are long enough
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_ANYLONG = re.compile(r"\S{20}")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * log2(k / n) for k in Counter(s).values())


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the base patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def extra_candidates(text: str) -> list[tuple[int, int]]:
    """Long tokens that mix letter cases and digits and have a key's entropy."""
    if not _ANYLONG.search(text):
        return []
    found = []
    for m in _LONG.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and _entropy(s) >= 3.5:
            found.append((m.start(), m.end()))
    return found


_SCAN = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("base", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("cands", pa.list_(pa.struct([("h", pa.binary()), ("s", pa.int64()), ("e", pa.int64())])))])


#: What a text must match somewhere to hold any base span or candidate: the assign pattern with its least length, or 20 characters of a key (which long hex and access keys are too).
_ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
_KEY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"


def _holding(text: str = "text") -> Column:
    """True where the text may hold a span, by JVM patterns, so that only such texts go to Python; never null."""
    t = F.col(text)
    sign = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    return F.coalesce((sign & t.rlike(_ASSIGNED)) | t.rlike(_KEY), F.lit(False))


def _candidates(text: str, base: list[tuple[str, int, int, int, int]]) -> list[dict]:
    """Hash and place of each candidate value: those of the base matches and the long mixed tokens."""
    spans = dict.fromkeys([(x[3], x[4]) for x in base] + extra_candidates(text))
    return [{"h": hashlib.blake2b(text[s:e].encode("utf-8", "surrogatepass"), digest_size=16).digest(), "s": s, "e": e} for s, e in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, text, source, lang in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("source").to_pylist(), b.column("lang").to_pylist(), strict=True):
            text = text or ""
            base = base_spans(text)
            n = Counter(x[0] for x in base)
            rows.append(
                {
                    "doc_id": i, "source": source, "lang": lang, "base": ",".join(f"{k}:{s}:{e}" for k, s, e, _, _ in base),
                    "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"],
                    "cands": _candidates(text, base),
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)


_SCAN_DDL = "doc_id long, source string, lang string, base string, n_assign long, n_access long, n_hex long, cands array<struct<h: binary, s: long, e: long>>"


def _ownership(cand: DataFrame) -> DataFrame:
    """(h, owners, repos): distinct owners and (owner, lang) pairs of each value, each level combined before the next."""
    held = cand.select("h", "owner", "lang").distinct().groupBy("h", "owner").agg(F.count("*").alias("repos"))
    return held.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def _copied(owners: int, repositories: int) -> Column:
    return (F.col("owners") >= owners) | (F.col("repos") >= repositories)


def scan_secrets(docs: DataFrame, *, example_owners: int = 3, example_repositories: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base string, spans (array of kind, s, e).

    A candidate value (the value of a base match, or a long mixed token of high
    entropy) adds a span: ``example`` if at least ``example_owners`` distinct
    sources or ``example_repositories`` distinct (source, language) pairs hold
    it, else ``live``. Base spans always stay. Null texts are empty; null
    sources and languages count as one owner called ''; repeated rows and null
    ids are rows of their own; long texts are scanned whole; an empty table
    gives no rows; other columns are ignored.

    Ownership is counted per (value, owner) with map-side combination before
    values meet, so a value that a third of the corpus repeats is a handful of
    rows by then; it returns to the documents by a join that AQE can split.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    seen = written(with_row_id(d.mapInArrow(_scan, _SCAN_DDL)), "secrets")
    cand = seen.where(F.size("cands") > 0).select("rid", F.coalesce("source", F.lit("")).alias("owner"), F.coalesce("lang", F.lit("")).alias("lang"), F.explode("cands").alias("c"))
    cand = cand.select("rid", "owner", "lang", "c.h", "c.s", "c.e")
    kind = F.when(_copied(example_owners, example_repositories), "example").otherwise("live")
    added = cand.join(_ownership(cand), "h").groupBy("rid").agg(F.collect_list(F.struct(kind.alias("kind"), "s", "e")).alias("added"))
    out = seen.join(added, "rid", "left")
    base = F.expr("transform(filter(split(base, ','), x -> x != ''), x -> named_struct('kind', split(x, ':')[0], 's', cast(split(x, ':')[1] AS long), 'e', cast(split(x, ':')[2] AS long)))")
    every = F.concat(base, F.coalesce("added", F.expr("cast(array() AS array<struct<kind: string, s: bigint, e: bigint>>)")))
    order = F.expr("transform(spans, x -> named_struct('s', x.s, 'k', array_position(array('assign', 'access', 'hex', 'live', 'example'), x.kind), 'e', x.e, 'kind', x.kind))")
    out = out.withColumn("spans", every).withColumn("spans", F.transform(F.array_sort(order), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base", "spans")


def secret_digest(found: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[secret]", *, example_owners: int = 3, example_repositories: int = 5) -> DataFrame:
    """``docs`` with the value of every live-looking secret replaced by ``mark``; no row is dropped.

    Values that the corpus shows to be copied examples stay. Null and empty texts
    stay as they are; null sources and languages are one owner called '';
    repeated rows and null ids are rows of their own; overlapping values are one
    cut; long texts are read whole; an empty table gives no rows. Columns and
    rows are those of ``docs``; n_chars, where there is one, is the new length of
    a text that changed.

    Texts that may hold a span, by a JVM pattern, are scanned once and written
    with what was found; the others pass by without Python.
    """
    cols, schema = docs.columns, docs.schema
    rid, cands, cuts_ = fresh(docs, "__rid", "__cands", "__cuts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _SCAN.field("cands").type
        for b in batches:
            found = [_candidates(t or "", base_spans(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, cands])

    added = StructType([*schema.fields]).add(cands, ArrayType(StructType().add("h", BinaryType()).add("s", LongType()).add("e", LongType())))
    seen = written(with_row_id(docs.where(_holding()).mapInArrow(scan, added), rid), "scanned")
    cand = seen.where(F.size(cands) > 0).select(rid, F.coalesce("source", F.lit("")).alias("owner"), F.coalesce("lang", F.lit("")).alias("lang"), F.explode(cands).alias("c"))
    cand = cand.select(F.col(rid).alias("rid"), "owner", "lang", "c.h", "c.s", "c.e")
    live = cand.join(_ownership(cand).where(~_copied(example_owners, example_repositories)), "h")
    cuts = live.groupBy("rid").agg(F.collect_set(F.struct("s", "e")).alias(cuts_)).withColumnRenamed("rid", rid)
    at = cols.index("text")
    n_at = cols.index("n_chars") if "n_chars" in cols else None

    def cut(text: str, spans: list) -> str:
        out, done = [], 0
        for s, e in sorted((x["s"], x["e"]) for x in spans):
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join([*out, text[done:]])

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut(t, c) if c else t for t, c in zip(b.column("text").to_pylist(), b.column(cuts_).to_pylist(), strict=True)]
            columns = b.columns[: len(cols)]
            columns[at] = pa.array(texts, columns[at].type)
            if n_at is not None:
                columns[n_at] = pa.array([len(t) if c else n for t, c, n in zip(texts, b.column(cuts_).to_pylist(), columns[n_at].to_pylist(), strict=True)], columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=cols)

    changed = seen.join(cuts, rid, "left").select(*cols, cuts_).mapInArrow(redact, schema)
    return docs.where(~_holding()).union(changed)
