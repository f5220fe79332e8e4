"""The pipeline's stages in turn, each against a plain version on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm import queries
from tests.llm.conftest import odd_documents, words


def corpus(spark, path):
    docs, labels = [], []
    for k in range(240):
        w = words(70, 1000 + k)
        if k % 6 == 0:
            w = "ztrash " + w + " zscum ztrash"
        docs.append((k, w))
        if k % 2 == 0:
            labels.append((k, 1, int(k % 6 == 0)))
    for k in range(20):  # near copies of clean documents
        w = docs[6 * k + 1][1].split()
        w[35] = "changed"
        docs.append((300 + k, " ".join(w)))
    docs += [(400, docs[7][1]), (401, words(60, 9) + " token = 'abcdef0123456789' end"), (402, None), (403, ""), (404, words(3000, 12))]
    rows = [(i, t, "en", f"s{i % 7}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {i: t for i, t in docs}


def test_stages(spark, tmp_path):
    texts = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "packing"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/out{k}"))
        assert k == 3 or seen[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen[:4]]
    assert ids[1] == {i for i, t in texts.items() if "zscum" not in (t or "")}
    assert ids[2] == {i for i in ids[1] if i not in range(300, 320) and i != 400 or i in {300 + k for k in range(20) if 6 * k + 1 not in ids[1]}}
    assert ids[3] == ids[2]
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen[3].collect()}
    assert "abcdef0123456789" not in clean[401][0] and clean[401][1] == len(clean[401][0])
    assert all(clean[i][0] == texts[i] for i in clean if i != 401)
    t = Tokenizer.from_file(P.path(queries.WORD_BPE))
    want = set()
    for i, (x, _) in clean.items():
        x = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want |= {(i, k, at, len(p := x[at : at + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(x), 2048))}
    got = seen[4].collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_operators_do_not_swallow_import_errors():
    for name in ("corpus_pipeline.py", "rasterloom/llm/queries.py"):
        assert not re.search(r"except\s+\(?ImportError", open(name).read())


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_documents_with_clashing_columns(spark, tmp_path):
    """Nulls in every column, repeated rows, long and empty texts, and columns named like the stages' own."""
    rows = [r[:5] for r in odd_documents()]
    clash = {"rid": "r", "__rid": 1, "__cands": 2, "__cuts": 3, "__p_toxic": 0.5, "__kept": True, "__key": "x", "__row": 1, "k": 7, "h": "h", "bucket": 1, "segment": "s"}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, value in clash.items():
        df = df.withColumn(name, F.lit(value))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{n}")
        out = spark.read.parquet(f"{tmp_path}/out{n}")
        if n < 3:
            assert out.columns == docs.columns and out.schema == docs.schema
            kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
            assert not kept - Counter((r[0], r[1]) for r in rows)
            docs = out
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in kept}
    assert (None, None) in kept and (1, "") in kept  # empty texts stay
    assert sum(n for (_, t), n in kept.items() if t == rows[7][1]) == 1
