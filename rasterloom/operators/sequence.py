"""Running values and keyframe segments over one long ordered sequence, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(blocks: DataFrame, order: str, value: str, how: str, name: str, width: int = 4096) -> DataFrame:
    """Adds ``name``: the sum or maximum of ``value`` over all rows of smaller ``order``.

    Groups of ``width`` rows carry on their own, and one row per group passes
    through the window over groups: of a sequence in blocks of ``width``, one
    row for each ``width``² rows.
    """
    agg = F.sum if how == "sum" else F.max
    d = blocks.withColumn("__g", F.floor(F.col(order) / width).cast("long"))
    top = d.groupBy("__g").agg(agg(value).alias("__sum"))
    top = top.select("__g", agg("__sum").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)).alias("__up"))
    own = agg(value).over(Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__own", own).join(top, "__g")
    out = F.coalesce("__own", F.lit(0)) + F.coalesce("__up", F.lit(0)) if how == "sum" else F.greatest("__own", "__up")
    return d.withColumn(name, out).drop("__g", "__own", "__up")


def running(df: DataFrame, order: str, value: Column, how: str, name: str, width: int = 4096) -> DataFrame:
    """Adds ``name``: the running sum or maximum of ``value`` along the dense row number ``order``.

    Blocks of ``width`` rows run on their own; one row per block carries values
    over (:func:`carry`) and comes back by a join.
    """
    agg = F.sum if how == "sum" else F.max
    d = df.withColumn("__blk", F.floor(F.col(order) / width).cast("long")).withColumn("__v", value)
    inside = Window.partitionBy("__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = carry(d.groupBy("__blk").agg(agg("__v").alias("__t")), "__blk", "__t", how, "__c", width).drop("__t")
    d = d.join(carried, "__blk")
    own = agg("__v").over(inside)
    out = F.coalesce(own, F.lit(0)) + F.col("__c") if how == "sum" else F.greatest(own, F.col("__c"))
    return d.withColumn(name, out).drop("__blk", "__v", "__c")


def dense(df: DataFrame, order: str, name: str, width: int = 4096) -> DataFrame:
    """Adds ``name``: the row number (0, 1, ...) along the unique ids ``order``, which may have gaps.

    Blocks of ``width`` ids count on their own; one row per block that has rows
    carries the counts over (:func:`carry`).
    """
    d = df.withColumn("__blk", F.floor(F.col(order) / width).cast("long"))
    carried = carry(d.groupBy("__blk").agg(F.count("*").alias("__n")), "__blk", "__n", "sum", "__c", width).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__blk").orderBy(order)) - 1
    return d.withColumn("__k", inside).join(carried, "__blk").withColumn(name, F.col("__c") + F.col("__k")).drop("__blk", "__k", "__c")


def keyframes(df: DataFrame, order: str, flat: Column, interval: int) -> DataFrame:
    """Adds flat, is_key, segment (1, 2, ...) and since_key.

    A flat frame is a keyframe; so is the first other frame, and every
    ``interval``-th frame after a keyframe of any kind. ``order`` is a dense
    frame number.
    """
    d = df.withColumn("flat", flat)
    start = d.where("NOT flat").agg(F.min(order).alias("__first"))  # one row
    d = running(d, order, F.when(F.col("flat"), F.col(order)), "max", "__flat_at")
    d = d.join(F.broadcast(start))
    base = F.when((F.col("__flat_at") > F.col("__first")) | (F.col("__first").isNull()) | (F.col(order) < F.col("__first")), F.col("__flat_at")).otherwise(F.col("__first"))
    d = d.withColumn("since_key", (F.col(order) - base) % interval).withColumn("is_key", F.col("flat") | (F.col("since_key") == 0))
    d = d.withColumn("since_key", F.when(F.col("is_key"), 0).otherwise(F.col("since_key")))
    return running(d, order, F.col("is_key").cast("long"), "sum", "segment").drop("__flat_at", "__first")
