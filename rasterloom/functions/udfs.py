"""User-defined functions in their three forms: scalar (Arrow batches), aggregate (as partial sums), table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf


def check_digits(amount: str | Column) -> Column:
    """The remainder by 97 of an amount in hundredths, with the amount's sign; null stays null."""

    @pandas_udf("long")
    def digits(amounts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for a in amounts:
            yield pd.Series(np.fmod((a * 100).round(), 97)).astype("Int64")

    return digits(amount)


def geometric_mean(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Per ``by`` the geometric mean of positive ``value``: each Arrow batch gives one partial row per key."""
    types = dict(df.dtypes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.dropna(subset=[value])
            yield b.assign(__l=np.log(b[value])).groupby(by, as_index=False).agg(__s=("__l", "sum"), __n=("__l", "size"))

    parts = df.select(*by, value).mapInPandas(partial, ", ".join(f"{c} {types[c]}" for c in by) + ", __s double, __n long")
    return parts.groupBy(*by).agg(F.exp(F.sum("__s") / F.sum("__n")).alias(name))


@udtf(returnType="place: int, word: string")
class SplitWords:
    """Words of a text with their place."""

    def eval(self, text: str):
        for at, word in enumerate(text.split(" ") if text is not None else []):
            yield at, word
