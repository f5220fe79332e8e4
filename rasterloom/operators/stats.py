"""Context statistics in their static form: counts, cumulative counts, code length. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.sequence import dense


def histogram(df: DataFrame, ctx: list[str], sym: str) -> DataFrame:
    return df.groupBy(*ctx, sym).agg(F.count("*").alias("cnt"))


def cumulative(hist: DataFrame, ctx: list[str], sym: str) -> DataFrame:
    """Adds cum: the counts of smaller symbols of the context."""
    w = Window.partitionBy(*ctx).orderBy(sym).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("cum", F.coalesce(F.sum("cnt").over(w), F.lit(0)))


def bucket_rollup(df: DataFrame, ctx: str, sym: str, width: int = 16) -> DataFrame:
    """Counts by context, bucket of ``width`` symbols and symbol, with bucket and context totals (null where summed over)."""
    return df.select(ctx, F.floor(F.col(sym) / width).cast("int").alias("bucket"), sym).rollup(ctx, "bucket", sym).agg(F.count("*").alias("cnt"))


def distinct_stats(hist: DataFrame, ctx: list[str], sym: str) -> DataFrame:
    """Per context: symbols seen, different ones, the most frequent one (ties: the smallest)."""
    return hist.groupBy(*ctx).agg(F.sum("cnt").alias("n"), F.count("*").alias("d"), F.min_by(F.col(sym), F.struct(-F.col("cnt"), F.col(sym))).alias("top"))


def symbol_lists(hist: DataFrame, ctx: list[str], sym: str) -> DataFrame:
    """Per context the symbols ascending, and by falling count (ties: ascending)."""
    both = F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("c"), F.col(sym).alias("s"))))
    return hist.groupBy(*ctx).agg(F.array_sort(F.collect_list(sym)).alias("ascending"), F.transform(both, lambda x: x["s"]).alias("by_count"))


def transitions(df: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """Counts of (previous value, value) along ``order`` within ``by``; the first of each has none before."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.select(value.alias("cur"), F.lag(value).over(w).alias("prev"))
    return d.where("prev IS NOT NULL").groupBy("prev", "cur").agg(F.count("*").alias("cnt"))


def follower_counts(df: DataFrame, order: str, value: str) -> DataFrame:
    """Transition counts of one sequence, by an equi-join on the row number instead of a global window; ids may have gaps."""
    d = dense(df.select(order, value), order, "row")
    a = d.select(F.col("row").alias("o"), F.col(value).alias("prev"))
    b = d.select((F.col("row") - 1).alias("o"), F.col(value).alias("cur"))
    return a.join(b, "o").groupBy("prev", "cur").agg(F.count("*").alias("cnt"))


def code_length(hist: DataFrame, ctx: list[str]) -> DataFrame:
    """Per context: symbols and their ideal code length in bits under its own counts."""
    total = hist.groupBy(*ctx).agg(F.sum("cnt").alias("n"))
    bits = F.sum(-F.col("cnt") * F.log2(F.col("cnt") / F.col("n")))
    return hist.join(total, ctx).groupBy(*ctx).agg(F.max("n").alias("n"), F.round(bits, 6).alias("bits"))
