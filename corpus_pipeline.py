"""The corpus pipeline: toxicity, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import near_dedup, packing, queries, secret_scan, toxicity
from rasterloom.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; it is fitted on the labelled ones among ``docs``.

    Null and empty texts have no features and are judged by the base rates;
    repeated rows are judged alike; without labels,
    or with one class only, all rows stay; no documents give none. Clashing
    column names are kept: scores take other names.
    """
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.CATEGORIES)
    scored = toxicity.score(docs, chain, prefix="__p_")
    return scored.where(F.col(scored.columns[-1]) < chain.threshold).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id, null first.

    Texts without words (null, empty, blank) stay, each on its own, but of rows
    equal in doc_id and text one stays. Long texts are read whole; columns pass
    through; no documents give none.
    """
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced; every document stays.

    Null and empty texts stay as they are; repeated rows are changed alike; null
    sources and languages count as one owner; columns pass through, n_chars
    follows a changed text; no documents give none.
    """
    return secret_scan.redact_secrets(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it.

    Null and empty texts are the single id 0; repeated rows are pieces of their
    own; long texts are cut into full pieces and a rest; no documents give none.
    """
    return packing.pack(docs, queries._tokenizer_file(queries.WORD_BPE))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack_documents)]

#: Classifiers, signatures and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
