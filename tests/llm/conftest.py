import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("rid", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("__rid", T.IntegerType()), T.StructField("__p_toxic", T.DoubleType()), T.StructField("kept", T.BooleanType()),
    ]
)


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "the", "io", "st", "qu", "él", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls everywhere, empty and very long texts, repeated rows, odd characters."""
    texts = [
        None, "", " ", "\n\n  \t ", "word", "two words", "a b c d e", words(50, 1), words(50, 1), words(9000, 2), "x" * 40_000, " lead and trail ", "nul\x00 sep\x1c nel\x85 wide\u3000end",
        "it's we'll they'RE ''re 'tis  12,345.67 <|endoftext|> <|startoftext|> e\u0301 \u212b \ud55c\uae00 \U0001f600\U0001f468\u200d\U0001f469", "!!! ??? ...", "!!! ??? ...", "ſtraße İstanbul Kelvin\u212a",
    ]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, None if t is None else len(t), "r", 1, 2, 0.5, None) for k, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, "null id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
