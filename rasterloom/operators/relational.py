"""Relational forms that Spark has no single operator for: as-of, range, band and interval joins, top k per group, salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` at or before its ``at``, per ``by``.

    Both sides meet in one union and one window, so rows are shuffled once and
    no pair is ever formed; of equal times the right side's largest values win.
    """
    box = F.struct(*values)
    none = F.lit(None).cast(right.select(box.alias("b")).schema["b"].dataType)
    extra = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.struct(*extra).alias("__l"), none.alias("__r"), F.lit(1).alias("__side"))
    nol = F.lit(None).cast(a.schema["__l"].dataType)
    b = right.select(*by, at, nol.alias("__l"), box.alias("__r"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(at, "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    d = a.union(b).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return d.select(*by, at, *(F.col(f"__l.{c}") for c in extra), *(F.col(f"__m.{v}").alias(v) for v in values))


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` with ``low <= point < high`` of ``spans``: an equi-join on buckets of ``width``, then the test.

    A span is copied to the buckets it touches; choose ``width`` near the usual
    length of a span.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    p = points.withColumn("__b", bucket(point))
    s = spans.where(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    return p.join(s, "__b").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group; ranks are limited before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def band_join(left: DataFrame, right: DataFrame, by: list[str], at: str, other: str, low: int, high: int) -> DataFrame:
    """Rows with equal ``by`` and ``at + low <= other <= at + high`` (integers): an equi-join on (by, bucket), then the test.

    Buckets are as wide as the band, so each left row looks into two of them,
    whatever a key's number of rows.
    """
    width = max(1, high - low + 1)
    bucket = lambda c: F.floor(c / width).cast("long")
    first = bucket(F.col(at) + low)
    a = left.withColumn("__b", F.explode(F.array_distinct(F.array(first, bucket(F.col(at) + high)))))
    b = right.withColumn("__b", bucket(F.col(other)))
    return a.join(b, [*by, "__b"]).where((F.col(other) >= F.col(at) + low) & (F.col(other) <= F.col(at) + high)).drop("__b")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], span: tuple[str, str], other: tuple[str, str], width: int) -> DataFrame:
    """Rows with equal ``by`` whose half-open spans overlap: an equi-join on (by, bucket), each pair once.

    A span is copied to the buckets of ``width`` that it touches; a pair counts
    in the bucket where the later of the two begins. Empty spans overlap nothing.
    """
    (a1, a2), (b1, b2) = span, other
    bucket = lambda c: F.floor(c / width).cast("long")
    spread = lambda d, lo, hi: d.where(F.col(lo) < F.col(hi)).withColumn("__b", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi) - 1))))
    d = spread(left, a1, a2).join(spread(right, b1, b2), [*by, "__b"])
    return d.where((F.col(a1) < F.col(b2)) & (F.col(b1) < F.col(a2)) & (F.col("__b") == bucket(F.greatest(a1, b1)))).drop("__b")


#: How partial results of an aggregate combine.
_COMBINE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def salted_aggregate(df: DataFrame, by: list[str], row: str, what: dict[str, tuple[str, str]], salts: int = 64) -> DataFrame:
    """Aggregates (name to (count, sum, min or max; column)) in two steps: per (by, salt of ``row``), then per ``by``."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    part = salted.groupBy(*by, "__salt").agg(*(getattr(F, how)(c).alias(name) for name, (how, c) in what.items()))
    return part.groupBy(*by).agg(*(_COMBINE[how](name).alias(name) for name, (how, _) in what.items()))
