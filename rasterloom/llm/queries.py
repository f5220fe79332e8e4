"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BPE, BYTE_BPE, RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


#: Categories of the toxicity chain, in its order, over the labels table.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.embed_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer_file(WORD_BPE))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer_file(BYTE_BPE))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rasterloom.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), _tokenizer_file(RANKS), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, _table(spark, sf_dir, "labels"), CATEGORIES)
    return score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= chain.threshold).alias("toxic"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.chat import chat_digest, format_chat

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    turn = lambda k, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    extra = spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    return chat_digest(format_chat(turns.union(extra)))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), RULES)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.secret_scan import scan_secrets, secret_digest

    return secret_digest(scan_secrets(_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_packing, op3_token_counts, op4_byte_bpe, op5_toxicity, op6_chat, op7_url_filter, op8_neighbours, op9_near_duplicates, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    from rasterloom.llm import oracles
    from rasterloom.llm.url_filter import SEED_TERMS

    return {
        "op1_embedding_dedup": oracles.EMBEDDING_DEDUP,
        "op6_chat": oracles.CHAT,
        "op7_url_filter": oracles.urls(RULES, SEED_TERMS),
        "op8_neighbours": oracles.NEIGHBOURS,
    }
