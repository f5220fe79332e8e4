"""Sequences whose ids have gaps, against the registered SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import runs, sequence
from rasterloom.plans import catalog


def plain(rows):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def gaps(spark, sf, tmp_path_factory):
    """The events without every id that 7 or 5 divides, then a far block; one run of 600 rows is longer than the cap."""
    out = str(tmp_path_factory.mktemp("gaps"))
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 7 <> 0 AND event_id % 5 <> 0")
    far = spark.range(600).select((F.col("id") * 3 + 1_000_000).alias("event_id"), F.lit("view").alias("event_type"))
    e.select("event_id", "event_type").union(far).coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", ["a50_event_transitions", "a128_code_length", "a70_event_rle_capped"])
def test_ids_with_gaps(spark, gaps, name):
    df = catalog.QUERIES[name](spark, gaps)
    cols = sorted(df.columns)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{gaps}/events.parquet/*.parquet'")
    assert plain(df.select(*cols).collect()) == plain(duck.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall())


def test_row_numbers_across_blocks(spark):
    ids = [-9, -1, 0, 3, 4, 50, 51, 1000]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "o long").repartition(3)
    assert {r["o"]: r["row"] for r in sequence.dense(df, "o", "row", 4).collect()} == {i: k for k, i in enumerate(ids)}
    got = runs.global_runs(df, "o", F.lit("x"), cap=3, width=4).orderBy("start").collect()
    assert [(r["start"], r["n"]) for r in got] == [(-9, 3), (3, 3), (51, 2)]


@pytest.mark.parametrize("width", [2, 3, 7])
def test_values_carried_over_groups_of_blocks(spark, width):
    """More blocks than one group of blocks: sums, maxima, row numbers and runs against plain loops."""
    import random
    from itertools import groupby

    r = random.Random(width)
    values = [r.choice([1, 2, None]) if k % 11 else 5 for k in range(150)]
    letters = [r.choice("aab") if k < 100 else "c" for k in range(150)]
    df = spark.createDataFrame([(k, 3 * k + k % 2, values[k], letters[k]) for k in range(150)], "o long, i long, v long, c string").repartition(3)
    total = [sum(x or 0 for x in values[: k + 1]) for k in range(150)]
    most = [max((x for x in values[: k + 1] if x is not None), default=None) for k in range(150)]
    assert {q["o"]: q["s"] for q in sequence.running(df, "o", F.col("v"), "sum", "s", width).collect()} == dict(enumerate(total))
    assert {q["o"]: q["s"] for q in sequence.running(df, "o", F.col("v"), "max", "s", width).collect()} == dict(enumerate(most))
    assert {q["o"]: q["n"] for q in sequence.dense(df, "i", "n", width).collect()} == {k: k for k in range(150)}
    want, at = [], 0
    for c, run in groupby(letters):
        n = len(list(run))
        want += [(3 * k + k % 2, c, min(5, at + n - k)) for k in range(at, at + n, 5)]
        at += n
    assert sorted(tuple(q) for q in runs.global_runs(df.select("i", "c"), "i", F.col("c"), cap=5, width=width).collect()) == sorted(want)
