"""Registered queries by operator, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import pixel
from rasterloom.operators import codec, diff, entropy, model, motion, predict, runs, sequence, stats
from rasterloom.operators.grouped import by_key
from rasterloom.sources import frames as fr
from rasterloom.sources.settings import settings

W, H = fr.WIDTH, fr.HEIGHT
INTERVAL = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(tail: str, *more: str, recursive: bool = False) -> str:
    """SQL over the CTE ``frames`` (the scenes), and more CTEs."""
    return f"WITH {'RECURSIVE ' if recursive else ''}frames AS ({fr.scene_sql('duckdb')}), " + ", ".join([*more, "last AS (SELECT 1)"]) + tail


_PAIR = "paired AS (SELECT *, lag(r) OVER w AS pr, lag(g) OVER w AS pg, lag(b) OVER w AS pb FROM frames WINDOW w AS (PARTITION BY y, x ORDER BY frame_id))"
_CH = "(r <> pr OR g <> pg OR b <> pb)"
_BLOCKS = (
    f"raw AS (SELECT frame_id, CAST(y // 16 AS INT) AS brow, CAST(x // 16 AS INT) AS bx, min(x) FILTER (WHERE {_CH}) AS x1, min(y) FILTER (WHERE {_CH}) AS y1,"
    f" max(x) FILTER (WHERE {_CH}) + 1 AS x2, max(y) FILTER (WHERE {_CH}) + 1 AS y2, min(x) AS a1, min(y) AS b1, max(x) + 1 AS a2, max(y) + 1 AS b2, count(*) AS pixels"
    " FROM paired WHERE pr IS NOT NULL GROUP BY frame_id, y // 16, x // 16)",
    "blocks AS (SELECT frame_id, brow, bx, CASE WHEN x1 = a1 AND y1 = b1 AND x2 = a2 AND y2 = b2 THEN 1 ELSE 2 END AS bt, x1, y1, x2, y2 FROM raw WHERE x1 IS NOT NULL)",
)
_NEAR = (
    f"near AS (SELECT *, y * {W} + x AS pos, lag(r, 1) OVER s AS lr, lag(g, 1) OVER s AS lg, lag(b, 1) OVER s AS lb, lag(r, {W}) OVER s AS ur, lag(g, {W}) OVER s AS ug, lag(b, {W}) OVER s AS ub,"
    f" CASE WHEN x > 0 THEN lag(r, {W + 1}) OVER s END AS vr, CASE WHEN x > 0 THEN lag(g, {W + 1}) OVER s END AS vg, CASE WHEN x > 0 THEN lag(b, {W + 1}) OVER s END AS vb"
    f" FROM paired WINDOW s AS (PARTITION BY frame_id ORDER BY y * {W} + x))"
)
_L, _U, _V, _P = ("(coalesce(r = {0}r AND g = {0}g AND b = {0}b, false))".format(c) for c in ("l", "u", "v", "p"))
_G = "(coalesce(r = lr + ur - vr AND g = lg + ug - vg AND b = lb + ub - vb, false))"
_KEY = f"CASE WHEN {_L} THEN 1 WHEN {_V} THEN 5 WHEN {_U} THEN 2 WHEN {_G} THEN 4 ELSE 0 END"
_DELTA = f"CASE WHEN x = 0 OR y = 0 THEN CASE WHEN {_P} THEN 3 ELSE 0 END WHEN {_L} THEN 1 WHEN {_P} THEN 3 WHEN {_V} THEN 5 WHEN {_U} THEN 2 WHEN {_G} THEN 4 ELSE 0 END"


def _paired(spark, sf_dir):
    return diff.with_previous(fr.scene_frames(spark, sf_dir))


# Sources and formats


@query(_with(" SELECT frame_id, count(*) AS pixels, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(b) AS BIGINT) AS sum_b FROM frames GROUP BY frame_id"))
def a01_frame_source(spark, sf_dir):
    """Frames through the image form and back."""
    f = fr.from_images(fr.to_images(fr.scene_frames(spark, sf_dir)))
    return f.groupBy("frame_id").agg(F.count("*").alias("pixels"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"))


@query(_with(" SELECT frame_id, y, x, ((255::BIGINT * 256 + r) * 256 + g) * 256 + b AS word, r, g, b FROM frames"))
def a05_a07_rgb32(spark, sf_dir):
    d = fr.scene_frames(spark, sf_dir).withColumn("word", pixel.pack32("r", "g", "b"))
    r, g, b = pixel.unpack32("word")
    return d.select("frame_id", "y", "x", "word", r.alias("r"), g.alias("g"), b.alias("b"))


@query(_with(" SELECT frame_id, y, x, CAST((r // 8) * 1024 + (g // 8) * 32 + b // 8 AS INT) AS word, CAST(r // 8 AS INT) AS r5, CAST(g // 8 AS INT) AS g5, CAST(b // 8 AS INT) AS b5 FROM frames"))
def a06_a08_rgb16(spark, sf_dir):
    d = fr.scene_frames(spark, sf_dir)
    d = d.withColumn("word", pixel.pack16([F.shiftright(c, 3) for c in "rgb"]))
    r, g, b = pixel.unpack16("word")
    return d.select("frame_id", "y", "x", "word", r.alias("r5"), g.alias("g5"), b.alias("b5"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) // 2 * 1024 + CAST(round(l_discount * 100) AS INT) * 32 + CAST(round(l_tax * 100) AS INT) AS INT) AS word, CAST(CAST(l_quantity AS INT) % 2 AS INT) AS low FROM lineitem")
def a08_pack_columns(spark, sf_dir):
    """The 16-bit packing over all rows: half the quantity fits five bits, and ``low`` keeps the bit that it lacks."""
    d = _t(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    word = pixel.pack16([F.shiftright(q, 1), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", word.alias("word"), (q % 2).alias("low"))


@query(_with(f" SELECT frame_id, y, string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY x) || '{'00' * ((-3 * W) % 4)}' AS line FROM frames GROUP BY frame_id, y"))
def a09_a10_scan_lines(spark, sf_dir):
    """Padded scan lines, as hex."""
    g = fr.scene_frames(spark, sf_dir).groupBy("frame_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b"))).alias("p"))
    return g.select("frame_id", "y", pixel.row_bytes(F.col("p"), W).alias("line"))


@query(
    "SELECT w, h, d, d IN (16, 24, 32) AND w > 0 AND h > 0 AS encodes, d IN (16, 24, 32) AND w > 0 AND h > 0 AND w = 50 AND h = 38 AND d = 24 AS decodes, CAST(w * h * 6 AS BIGINT) AS max_bytes, (w * 3 + 3) // 4 * 4 AS stride, (w + 15) // 16 AS nbx, (h + 15) // 16 AS nby"
    " FROM (SELECT DISTINCT CAST(p_size AS INT) AS w, CAST(p_partkey % 40 AS INT) AS h, CAST(CASE p_partkey % 5 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 24 WHEN 3 THEN 32 ELSE 48 END AS INT) AS d FROM part)"
)
def a11_a15_formats(spark, sf_dir):
    """Format predicates and sizes over formats derived from all parts."""
    k = F.col("p_partkey") % 5
    d = _t(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("w"), (F.col("p_partkey") % 40).cast("int").alias("h"), F.when(k == 0, 8).when(k == 1, 16).when(k == 2, 24).when(k == 3, 32).otherwise(48).alias("d")).distinct()
    ok, fits = fr.encodes("w", "h", "d"), fr.decodes("w", "h", "d", fr.FrameFormat(W, H))
    return d.select("w", "h", "d", ok.alias("encodes"), fits.alias("decodes"), pixel.max_packet_bytes("w", "h").alias("max_bytes"), pixel.align4(F.col("w") * 3).alias("stride"), pixel.ceil_div("w").alias("nbx"), pixel.ceil_div("h").alias("nby"))


@query(
    "SELECT p_partkey, CASE d WHEN 16 THEN 'word int' WHEN 32 THEN 'word bigint' ELSE 'r int, g int, b int' END AS pixel, loss = 0 AS lossless, CAST(w * h * 6 AS BIGINT) AS max_bytes, CAST((w * 3 + 3) // 4 * 4 AS BIGINT) AS stride"
    " FROM (SELECT p_partkey, p_size AS w, p_size % 7 + 1 AS h, CASE p_partkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE 32 END AS d, p_partkey % 4 AS loss FROM part)"
)
def a13_a145_output_formats(spark, sf_dir):
    """Output schema and description of a codec for a format per part."""
    import pandas as pd

    def describe(batches):
        for b in batches:
            rows = []
            for k, w, h, d, loss in zip(*(b[c] for c in ("p_partkey", "w", "h", "d", "loss")), strict=True):
                f = fr.FrameFormat(w, h, d, loss=loss)
                told = f.describe()
                rows.append((k, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in f.output_schema().fields[3:]), told["lossless"], told["max_bytes"], f.stride()))
            yield pd.DataFrame(rows, columns=["p_partkey", "pixel", "lossless", "max_bytes", "stride"])

    k = F.col("p_partkey") % 3
    d = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_size") % 7 + 1).alias("h"), F.when(k == 0, 16).when(k == 1, 24).otherwise(32).alias("d"), (F.col("p_partkey") % 4).cast("int").alias("loss"))
    return d.mapInPandas(describe, "p_partkey long, pixel string, lossless boolean, max_bytes long, stride long")


# Predicates


@query(_with(" SELECT frame_id, min(r) = max(r) AND min(g) = max(g) AND min(b) = max(b) AS flat FROM frames GROUP BY frame_id"))
def a20_frame_flat(spark, sf_dir):
    return diff.flat_frames(fr.scene_frames(spark, sf_dir))


@query(_with(f" SELECT frame_id, bool_or({_CH}) AS changed FROM paired WHERE pr IS NOT NULL GROUP BY frame_id", _PAIR))
def a21_a44_frame_changed(spark, sf_dir):
    return diff.changed_frames(_paired(spark, sf_dir))


@query(_with(" SELECT * FROM blocks", _PAIR, *_BLOCKS))
def a22_a23_a40_changed_blocks(spark, sf_dir):
    return diff.changed_blocks(_paired(spark, sf_dir))


@query(_with(" SELECT frame_id, brow, bx, CASE WHEN x1 IS NULL THEN 0 WHEN x1 = a1 AND y1 = b1 AND x2 = a2 AND y2 = b2 THEN 1 ELSE 2 END AS bt, pixels FROM raw", _PAIR, *_BLOCKS))
def a41_block_types(spark, sf_dir):
    return diff.block_types(_paired(spark, sf_dir))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, loss, CASE WHEN loss = 0 THEN q ELSE CAST(q // (1 << loss) * (1 << loss) + (1 << loss) // 2 AS INT) END AS quantised"
    " FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q, CAST(l_linenumber % 5 AS INT) AS loss FROM lineitem)"
)
def a24_pixel_quantize(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), (F.col("l_linenumber") % 5).cast("int").alias("loss"))
    out = F.col("q")
    for k in range(1, 5):
        out = F.when(F.col("loss") == k, pixel.quantise("q", k)).otherwise(out)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "loss", out.alias("quantised"))


@query(_with(f" SELECT frame_id, CAST(sum(CASE WHEN {_CH} THEN 0 ELSE 1 END) AS BIGINT) AS matched, count(*) AS total FROM paired WHERE pr IS NOT NULL GROUP BY frame_id", _PAIR))
def a30_previous_match(spark, sf_dir):
    return diff.matched_pixels(_paired(spark, sf_dir))


_MV = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(motion.priorities()))


_MOTION = (
    f"disp AS (SELECT * FROM (VALUES {_MV}) t(prio, dx, dy))",
    # Corner pixels first, then the whole rectangle by division.
    f"cand AS (SELECT b.*, d.prio, d.dx, d.dy FROM blocks b, disp d WHERE b.x1 + d.dx >= 0 AND b.y1 + d.dy >= 0 AND b.x2 + d.dx <= {W} AND b.y2 + d.dy <= {H})",
    "corner AS (SELECT c.* FROM cand c JOIN frames a ON a.frame_id = c.frame_id AND a.x = c.x1 AND a.y = c.y1 JOIN frames p ON p.frame_id = c.frame_id - 1 AND p.x = c.x1 + c.dx AND p.y = c.y1 + c.dy AND p.r = a.r AND p.g = a.g AND p.b = a.b)",
    "full_ AS (SELECT c.frame_id, c.brow, c.bx, c.prio, any_value(c.dx) AS dx, any_value(c.dy) AS dy FROM corner c JOIN frames a ON a.frame_id = c.frame_id AND a.x >= c.x1 AND a.x < c.x2 AND a.y >= c.y1 AND a.y < c.y2"
    " JOIN frames p ON p.frame_id = c.frame_id - 1 AND p.x = a.x + c.dx AND p.y = a.y + c.dy AND p.r = a.r AND p.g = a.g AND p.b = a.b GROUP BY c.frame_id, c.brow, c.bx, c.prio, c.x1, c.x2, c.y1, c.y2 HAVING count(*) = (c.x2 - c.x1) * (c.y2 - c.y1))",
    "best AS (SELECT frame_id, brow, bx, arg_min(dx, prio) AS dx, arg_min(dy, prio) AS dy FROM full_ GROUP BY frame_id, brow, bx)",
    "moved AS (SELECT b.frame_id, b.brow, b.bx, b.bt + CASE WHEN v.dx IS NULL THEN 0 ELSE 2 END AS bt, b.x1, b.y1, b.x2, b.y2, CAST(v.dx AS INT) AS dx, CAST(v.dy AS INT) AS dy FROM blocks b LEFT JOIN best v USING (frame_id, brow, bx))",
)


@query(_with(" SELECT * FROM moved", _PAIR, *_BLOCKS, *_MOTION))
def a25_a31_motion_vectors(spark, sf_dir):
    """Motion search with its full windows (256 and 8)."""
    f = fr.scene_frames(spark, sf_dir)
    return motion.with_motion_codes(motion.motion_vectors(fr.to_images(f), diff.changed_blocks(diff.with_previous(f))))


_SAME = "coalesce(lag(dx) OVER w = dx AND lag(dy) OVER w = dy, false)"


@query(_with(f" SELECT *, {_SAME} AS same FROM moved WHERE dx IS NOT NULL WINDOW w AS (PARTITION BY frame_id ORDER BY brow, bx)", _PAIR, *_BLOCKS, *_MOTION))
def a126_repeated_vectors(spark, sf_dir):
    return motion.repeated_vectors(a25_a31_motion_vectors(spark, sf_dir))


@query()
def a32_reused_vectors(spark, sf_dir):
    """The search that tries the last vector and that of the block above first."""
    f = fr.scene_frames(spark, sf_dir)
    return motion.with_motion_codes(motion.motion_vectors(fr.to_images(f), diff.changed_blocks(diff.with_previous(f)), reuse=True))


@query(_with(" SELECT * FROM blocks", _PAIR, *_BLOCKS))
def a22_a133_image_blocks(spark, sf_dir):
    """Changed blocks from whole images, each compared with the one before of its stream as arrays: no row per pixel is shuffled."""
    images = fr.to_images(fr.scene_frames(spark, sf_dir)).withColumn("stream_id", F.lit("scenes"))
    return diff.changed_blocks_of_images(images, stream="stream_id").drop("stream_id")


@query(
    _with(
        f" SELECT frame_id, min(bx) AS bx1, min(brow) AS by1, max(bx) AS bx2, max(brow) AS by2, CAST(min(brow) * {-(-W // 16)} + min(bx) AS INT) AS first_index, CAST(max(brow) * {-(-W // 16)} + max(bx) AS INT) AS last_index FROM (SELECT r.frame_id, b.brow, b.bx FROM raw r LEFT JOIN blocks b USING (frame_id, brow, bx)) GROUP BY frame_id",
        _PAIR, *_BLOCKS,
    )
)
def a42_a43_region_bounds(spark, sf_dir):
    return diff.region_bounds(_paired(spark, sf_dir), W)


# Statistics

_CTX = (
    f"seqs AS (SELECT frame_id, CAST((y * {W} + x) * 3 + c AS BIGINT) AS seq, c AS channel, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS sym FROM frames, (VALUES (0), (1), (2)) t(c))",
    "ctxs AS (SELECT frame_id, seq, channel, CAST((coalesce(lag(sym, 2) OVER w, 0) // 4) * 64 + coalesce(lag(sym, 1) OVER w, 0) // 4 AS INT) AS ctx, sym FROM seqs WINDOW w AS (PARTITION BY frame_id ORDER BY seq))",
    "hist AS (SELECT channel, ctx, sym, count(*) AS cnt FROM ctxs GROUP BY channel, ctx, sym)",
)


def _contexts(spark, sf_dir):
    return predict.colour_contexts(fr.scene_frames(spark, sf_dir), W)


def _hist(spark, sf_dir):
    return stats.histogram(_contexts(spark, sf_dir), ["channel", "ctx"], "sym")


@query(_with(" SELECT * FROM ctxs", *_CTX))
def a66_colour_contexts(spark, sf_dir):
    return _contexts(spark, sf_dir).withColumn("seq", F.col("seq").cast("long"))


@query(_with(" SELECT * FROM hist", *_CTX))
def a45_a150_context_histogram(spark, sf_dir):
    return _hist(spark, sf_dir)


@query(_with(" SELECT *, CAST(coalesce(sum(cnt) OVER (PARTITION BY channel, ctx ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM hist", *_CTX))
def a47_cumulative_frequency(spark, sf_dir):
    return stats.cumulative(_hist(spark, sf_dir), ["channel", "ctx"], "sym")


@query("SELECT event_type, CAST(k // 16 AS INT) AS bucket, k, count(*) AS cnt FROM (SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) GROUP BY ROLLUP (event_type, k // 16, k)")
def a46_bucket_rollup(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    return stats.bucket_rollup(e, "event_type", "k")


_EH = "WITH h AS (SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, count(*) AS cnt FROM events GROUP BY ALL)"


def _events_k(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))


@query(_EH + " SELECT event_type, CAST(sum(cnt) AS BIGINT) AS n, count(*) AS d, arg_min(k, (-cnt, k)) AS top FROM h GROUP BY event_type")
def a48_a49_context_distinct(spark, sf_dir):
    return stats.distinct_stats(stats.histogram(_events_k(spark, sf_dir), ["event_type"], "k"), ["event_type"], "k")


@query(_EH + " SELECT event_type, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS ascending, string_agg(CAST(k AS VARCHAR), ',' ORDER BY cnt DESC, k) AS by_count FROM h GROUP BY event_type")
def a80_a81_a85_symbol_lists(spark, sf_dir):
    d = stats.symbol_lists(stats.histogram(_events_k(spark, sf_dir), ["event_type"], "k"), ["event_type"], "k")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return d.select("event_type", text("ascending"), text("by_count"))


@query("SELECT prev, event_type AS cur, count(*) AS cnt FROM (SELECT event_type, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY ALL")
def a50_event_transitions(spark, sf_dir):
    return stats.follower_counts(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")


@query(_with(" SELECT prev, cur, count(*) AS cnt FROM (SELECT ptype AS cur, lag(ptype) OVER (PARTITION BY frame_id ORDER BY pos) AS prev FROM p) WHERE prev IS NOT NULL AND cur IS NOT NULL GROUP BY ALL", _PAIR, _NEAR, f"p AS (SELECT frame_id, pos, CASE WHEN pos > {W} THEN {_KEY} END AS ptype FROM near)"))
def a50_a152_predictor_transitions(spark, sf_dir):
    p = predict.choose_key(predict.neighbours(fr.scene_frames(spark, sf_dir), W), W)
    return stats.transitions(p.where("ptype IS NOT NULL"), ["frame_id"], "pos", F.col("ptype"))


@query(
    "WITH h AS (SELECT prev, event_type, count(*) AS cnt FROM (SELECT event_type, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY ALL), t AS (SELECT prev, sum(cnt) AS n FROM h GROUP BY prev)"
    " SELECT h.prev, CAST(max(n) AS BIGINT) AS n, round(sum(-cnt * log2(cnt / n)), 6) AS bits FROM h JOIN t USING (prev) GROUP BY h.prev"
)
def a128_code_length(spark, sf_dir):
    h = stats.follower_counts(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")
    return stats.code_length(h.withColumnRenamed("cur", "sym"), ["prev"])


# Predictors


@query(_with(f" SELECT frame_id, y, x, CASE WHEN pos > {W} THEN {_KEY} END AS ptype FROM near", _PAIR, _NEAR))
def a60_predictor_key(spark, sf_dir):
    return predict.choose_key(predict.neighbours(fr.scene_frames(spark, sf_dir), W), W).select("frame_id", "y", "x", "ptype")


@query(_with(f" SELECT frame_id, y, x, {_DELTA} AS ptype FROM near WHERE pr IS NOT NULL", _PAIR, _NEAR))
def a61_a62_predictor_delta(spark, sf_dir):
    return predict.choose_delta(predict.neighbours(_paired(spark, sf_dir), W)).where("pr IS NOT NULL").select("frame_id", "y", "x", "ptype")


def _streams(spark, sf_dir):
    return fr.to_images(fr.scene_frames(spark, sf_dir)).withColumn("stream_id", F.lit("scenes"))


@query(_with(f" SELECT frame_id, y, x, CASE WHEN pos > {W} THEN {_KEY} END AS ptype FROM near", _PAIR, _NEAR))
def a60_image_predictors_key(spark, sf_dir):
    """The same choice from whole images, as arrays."""
    return predict.choose_of_images(_streams(spark, sf_dir), "stream_id", False).drop("stream_id")


@query(_with(f" SELECT frame_id, y, x, {_DELTA} AS ptype FROM near WHERE pr IS NOT NULL", _PAIR, _NEAR))
def a61_image_predictors_delta(spark, sf_dir):
    return predict.choose_of_images(_streams(spark, sf_dir), "stream_id", True).drop("stream_id")


@query(
    _with(
        f" SELECT frame_id, y, x, CAST(CASE WHEN x = 0 OR y = 0 THEN ({_P}::INT) * 8 + {_L}::INT ELSE {_L}::INT * 3 + {_U}::INT * 4 + {_P}::INT * 8 + {_G}::INT * 16 + {_V}::INT * 32 END AS INT) AS fits FROM near WHERE pr IS NOT NULL",
        _PAIR, _NEAR,
    )
)
def a63_fit_mask(spark, sf_dir):
    return predict.fit_mask(predict.neighbours(_paired(spark, sf_dir), W), True).where("pr IS NOT NULL").select("frame_id", "y", "x", "fits")


# Runs

_RLE = (
    "WITH c AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS island FROM c),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY event_id) - 1 AS k FROM i)"
)


@query(_RLE + " SELECT min(event_id) AS start, event_type AS value, count(*) AS n FROM n GROUP BY island, k // 255, event_type")
def a70_event_rle_capped(spark, sf_dir):
    return runs.global_runs(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", F.col("event_type"))


@query("SELECT event_id AS pos, event_type AS value FROM events")
def a74_rle_expand(spark, sf_dir):
    return runs.expand(a70_event_rle_capped(spark, sf_dir))


@query(
    _with(
        " SELECT frame_id, CAST(min(idx) AS INT) AS start, bt AS value, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, island ORDER BY idx) - 1 AS k FROM isl) GROUP BY frame_id, island, k // 255, bt",
        _PAIR, *_BLOCKS,
        f"typ AS (SELECT r.frame_id, r.brow * {-(-W // 16)} + r.bx AS idx, coalesce(b.bt, 0) AS bt FROM raw r LEFT JOIN blocks b USING (frame_id, brow, bx))",
        "chg AS (SELECT *, CASE WHEN lag(bt) OVER (PARTITION BY frame_id ORDER BY idx) = bt THEN 0 ELSE 1 END AS new FROM typ)",
        "isl AS (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY idx) AS island FROM chg)",
    )
)
def a73_block_type_rle(spark, sf_dir):
    d = diff.block_types(_paired(spark, sf_dir)).withColumn("idx", F.col("brow") * -(-W // 16) + F.col("bx"))
    return runs.capped_runs(d, "idx", F.col("bt"), ["frame_id"])


@query(_with(" SELECT frame_id, string_agg(CAST(bt AS VARCHAR), '' ORDER BY brow, bx) AS types FROM (SELECT frame_id, brow, bx, CASE WHEN x1 IS NULL THEN 0 WHEN x1 = a1 AND y1 = b1 AND x2 = a2 AND y2 = b2 THEN 1 ELSE 2 END AS bt FROM raw) GROUP BY frame_id", _PAIR, *_BLOCKS))
def a75_a82_block_type_expand(spark, sf_dir):
    """Block types from their runs, in raster order."""
    d = runs.expand(a73_block_type_rle(spark, sf_dir).withColumn("value", F.struct("frame_id", "value")))
    placed = d.groupBy("value.frame_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("value.value").alias("bt")))).alias("p"))
    return placed.select("frame_id", F.array_join(F.transform("p", lambda x: x.bt.cast("string")), "").alias("types"))


def _key_masked(spark, sf_dir):
    m = predict.fit_mask(predict.neighbours(fr.scene_frames(spark, sf_dir), W), False)
    return m.where(F.col("pos") > W)


def _walk(keys: str, kinds: tuple[int, ...], masked: str) -> tuple[str, ...]:
    """CTEs that step from run to run: ``masked`` has keys, i, pos, kind, f0 and f<k> for each predictor, and the channels."""
    stops = ", ".join(f"min(CASE WHEN NOT f{k} THEN i END) OVER n AS s{k}" for k in (0, *kinds))
    stop = " ".join(f"WHEN {k} THEN s{k}" for k in (0, *kinds))
    on = " AND ".join(f"w.{k} = n.{k}" for k in keys.split(", "))
    named = ", ".join(f"n.{k}" for k in keys.split(", "))
    return (
        f"masked AS MATERIALIZED ({masked})",
        f"ends AS (SELECT *, {stops}, max(i) OVER (PARTITION BY {keys}) + 1 AS fin FROM masked WINDOW n AS (PARTITION BY {keys} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))",
        f"nexts AS MATERIALIZED (SELECT {keys}, i, pos, kind, r, g, b, least(coalesce(CASE kind {stop} END, fin), i + 255, fin) AS stop FROM ends)",
        f"walk AS (SELECT {keys}, min(i) AS i, 0 AS seq FROM nexts GROUP BY {keys} UNION ALL SELECT {named}, n.stop AS i, w.seq + 1 AS seq FROM walk w JOIN nexts n ON {on} AND w.i = n.i JOIN (SELECT {keys}, max(stop) AS fin FROM nexts GROUP BY {keys}) z ON {on.replace('n.', 'z.')} WHERE n.stop < z.fin)",
        f"walked AS (SELECT {named}, CAST(w.seq AS INT) AS seq, CAST(n.pos AS BIGINT) AS start, CAST(n.kind AS INT) AS ptype, CAST(n.stop - n.i AS INT) AS n, CASE WHEN n.kind = 0 THEN n.r END AS r, CASE WHEN n.kind = 0 THEN n.g END AS g, CASE WHEN n.kind = 0 THEN n.b END AS b FROM walk w JOIN nexts n ON {on} AND w.i = n.i)",
    )


_KEY_WALK = (_PAIR, _NEAR, *_walk("frame_id", (1, 5, 2, 4), f"SELECT frame_id, pos AS i, pos, r, g, b, {_KEY} AS kind, {_L} AS f0, {_L} AS f1, {_V} AS f5, {_U} AS f2, {_G} AS f4 FROM near WHERE pos > {W}"))
_IN = "x > 0 AND y > 0 AND "
_DELTA_WALK = (
    _PAIR, _NEAR, *_BLOCKS,
    *_walk(
        "frame_id, brow, bx", (1, 3, 5, 2, 4),
        f"SELECT frame_id, brow, bx, row_number() OVER s AS i, pos, r, g, b, {_DELTA} AS kind, coalesce(lag(r) OVER s = r AND lag(g) OVER s = g AND lag(b) OVER s = b, false) AS f0,"
        f" {_IN}{_L} AS f1, {_P} AS f3, {_IN}{_V} AS f5, {_IN}{_U} AS f2, {_IN}{_G} AS f4 FROM near JOIN blocks USING (frame_id) WHERE y // 16 = brow AND x // 16 = bx AND x >= x1 AND x < x2 AND y >= y1 AND y < y2"
        " WINDOW s AS (PARTITION BY frame_id, brow, bx ORDER BY pos)",
    ),
)


@query(_with(" SELECT * FROM walked", *_KEY_WALK, recursive=True))
def a71_greedy_runs_key(spark, sf_dir):
    """Greedy predictor runs of every frame taken as a keyframe."""
    return runs.greedy_runs(_key_masked(spark, sf_dir), ["frame_id"], False)


def _delta_masked(spark, sf_dir):
    p = _paired(spark, sf_dir)
    m = predict.fit_mask(predict.neighbours(p, W), True).where("pr IS NOT NULL")
    m = m.withColumn("brow", F.floor(F.col("y") / 16).cast("int")).withColumn("bx", F.floor(F.col("x") / 16).cast("int"))
    m = m.join(diff.changed_blocks(p), ["frame_id", "brow", "bx"]).where("x >= x1 AND x < x2 AND y >= y1 AND y < y2")
    # Bit 0 compares with the pixel before in the rectangle's own scan.
    w = Window.partitionBy("frame_id", "brow", "bx").orderBy("pos")
    again = F.coalesce((F.lag("r").over(w) == F.col("r")) & (F.lag("g").over(w) == F.col("g")) & (F.lag("b").over(w) == F.col("b")), F.lit(False))
    return m.withColumn("fits", F.col("fits").bitwiseAND(F.lit(62)) + again.cast("int"))


@query(_with(" SELECT * FROM walked", *_DELTA_WALK, recursive=True))
def a72_greedy_runs_delta(spark, sf_dir):
    return runs.greedy_runs(_delta_masked(spark, sf_dir), ["frame_id", "brow", "bx"], True)


@query(_with(" SELECT frame_id, brow, bx, seq, ptype, n FROM walked", *_DELTA_WALK, recursive=True))
def a72_greedy_runs_native(spark, sf_dir):
    """The same fold inside Catalyst."""
    d = runs.block_greedy(_delta_masked(spark, sf_dir), ["frame_id", "brow", "bx"])
    return d.select("frame_id", "brow", "bx", F.posexplode("runs").alias("seq", "run")).select("frame_id", "brow", "bx", "seq", "run.ptype", "run.n")


@query(_with(" SELECT ptype, n, count(*) AS cnt FROM walked GROUP BY ptype, n", *_KEY_WALK, recursive=True))
def a51_a151_run_lengths(spark, sf_dir):
    return a71_greedy_runs_key(spark, sf_dir).groupBy("ptype", "n").agg(F.count("*").alias("cnt"))


# Scalars


@query(
    "SELECT o_orderkey, q, CAST(CASE WHEN q >= 10000 THEN 0 ELSE least((10000 - q) // 2000, 4) END AS INT) AS loss, CASE CAST(CASE WHEN q >= 10000 THEN 0 ELSE least((10000 - q) // 2000, 4) END AS INT) WHEN 0 THEN 'lossless' WHEN 1 THEN '1 bit' WHEN 2 THEN '2 bits' WHEN 3 THEN '3 bits' ELSE '4 bits' END AS label"
    " FROM (SELECT o_orderkey, CAST(o_orderkey * 37 % 12000 AS INT) AS q FROM orders)"
)
def a94_a95_quality_to_loss(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 12000).cast("int").alias("q"))
    loss = pixel.quality_to_loss("q")
    return d.select("o_orderkey", "q", loss.alias("loss"), pixel.loss_label(loss).alias("label"))


@query(
    "SELECT p_partkey, (p_size + 15) // 16 AS blocks, (p_size + 3) // 4 * 4 AS aligned, least(greatest(p_size, 8), 40) AS clamped, p_size & 12 AS anded, p_size | 3 AS ored, p_size << 2 AS lefted, p_size >> 1 AS righted, -p_size - 1 AS notted, abs(25 - p_size) AS absed,"
    " CAST(p_partkey % 65536 & 255 AS INT) AS low, CAST(p_partkey % 65536 >> 8 AS INT) AS high, CAST((p_size % 3 + 1) * 16 + 2 AS INT) AS tag, CAST(((p_size % 3 + 1) * 16 + 2 >> 4) + 1 AS INT) AS version, CAST((p_size * 7 - 1) // 51 AS INT) AS segment FROM part"
)
def a90_a98_scalars(spark, sf_dir):
    s = F.col("p_size")
    low, high = pixel.index_bytes((F.col("p_partkey") % 65536).cast("int"))
    tag = pixel.version_tag(s % 3 + 2, 2)
    return _t(spark, sf_dir, "part").select(
        "p_partkey", pixel.ceil_div("p_size").alias("blocks"), pixel.align4("p_size").alias("aligned"), pixel.clamp("p_size", 8, 40).alias("clamped"), s.bitwiseAND(F.lit(12)).alias("anded"), s.bitwiseOR(F.lit(3)).alias("ored"),
        F.shiftleft(s, 2).alias("lefted"), F.shiftright(s, 1).alias("righted"), F.bitwise_not(s).alias("notted"), F.abs(25 - s).alias("absed"), low.alias("low"), high.alias("high"), tag.alias("tag"), pixel.tag_version(tag).alias("version"),
        pixel.segment_of(s - 1, F.lit(51), 7).alias("segment"),
    )


# Models, coding, codec


def _modelled(spark, sf_dir, length: int, sym, alphabet: int | None = None):
    """Intervals of a symbol per event, statistics anew every ``length`` ids."""
    e = _t(spark, sf_dir, "events").select(F.floor(F.col("event_id") / length).alias("segment"), F.col("event_id").alias("seq"), sym.cast("int").alias("sym"))
    return model.adaptive_intervals(e, ["segment"], alphabet)


def _numbered(length: int, sym: str) -> str:
    return f"WITH n AS (SELECT event_id // {length} AS segment, event_id AS seq, CAST({sym} AS INT) AS sym, row_number() OVER (PARTITION BY event_id // {length} ORDER BY event_id) - 1 AS k FROM events), r AS (SELECT *, max(CASE WHEN k = 0 THEN sym END) OVER (PARTITION BY segment) AS again FROM n)"


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


@query(
    _numbered(370, "event_id * 7 % 251")
    # 251 different symbols are listed raw, and so is the first that repeats; then each has 16 of 4096, that one 32.
    + " SELECT segment, seq, sym, CAST(CASE WHEN k <= 251 THEN sym ELSE sym * 16 + CASE WHEN again < sym THEN 16 ELSE 0 END END AS INT) AS start, CAST(CASE WHEN k <= 251 THEN 0 WHEN sym = again THEN 32 ELSE 16 END AS INT) AS freq,"
    " CAST(CASE WHEN k = 0 THEN 0 WHEN k <= 14 THEN 1 WHEN k <= 64 THEN 2 WHEN k <= 251 THEN 3 ELSE 7 END AS INT) AS kind FROM r"
)
def a100_a103_a107_list_models(spark, sf_dir):
    return _modelled(spark, sf_dir, 370, F.col("event_id") * 7 % 251)


def _small(sym: str, values: tuple[int, ...], kind: int) -> str:
    """Counted symbols: 50 for each time they came, 1 for all others, doubled past half the scale, the rest to the favourite, which is the first with the highest count."""
    return (
        _numbered(60, sym)
        + f", x AS (SELECT n.*, v, 50 * coalesce(sum(CASE WHEN sym = v THEN 1 ELSE 0 END) OVER w, 0) AS c, coalesce(max(CASE WHEN sym = v THEN k END) OVER w, 1000) AS last FROM n, (VALUES {', '.join(f'({v})' for v in values)}) s(v)"
        " WINDOW w AS (PARTITION BY segment, v ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),"
        " t AS (SELECT segment, seq, sym, k, sum(c) + 256 - count(*) FILTER (WHERE c > 0) AS total, arg_min(v, (-c, last)) AS fav, sum(c) FILTER (WHERE v < sym) AS below, count(*) FILTER (WHERE v < sym AND c > 0) AS d, max(c) FILTER (WHERE v = sym) AS own, bool_or(c > 50) AS counted FROM x GROUP BY ALL),"
        " u AS (SELECT *, CASE WHEN total > 2048 THEN 0 WHEN total > 1024 THEN 1 WHEN total > 512 THEN 2 ELSE 3 END AS shift FROM t),"
        " b AS (SELECT *, CAST((4096 - total * (1 << shift)) // (1 << shift) AS BIGINT) AS bonus FROM u)"
        " SELECT segment, seq, sym, CAST(CASE WHEN NOT counted THEN sym ELSE (coalesce(below, 0) + sym - d + CASE WHEN fav < sym THEN bonus ELSE 0 END) * (1 << shift) END AS INT) AS start,"
        f" CAST(CASE WHEN NOT counted THEN 0 ELSE (greatest(own, 1) + CASE WHEN fav = sym THEN bonus ELSE 0 END) * (1 << shift) END AS INT) AS freq, CAST(CASE WHEN counted THEN {kind} WHEN k = 0 THEN 0 ELSE 1 END AS INT) AS kind FROM b"
    )


@query(_small(f"{_K} % 4 * 60 + 5", (5, 65, 125, 185), 4))
def a104_small_model(spark, sf_dir):
    """Up to four symbols."""
    return _modelled(spark, sf_dir, 60, F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 4 * 60 + 5)


@query(_small(f"CASE WHEN event_id % 60 < 8 THEN event_id % 60 ELSE {_K} % 8 END * 30 + 2", tuple(range(2, 242, 30)), 5))
def a105_small_model(spark, sf_dir):
    """Five to sixteen symbols: eight are listed before one repeats."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 8
    return _modelled(spark, sf_dir, 60, F.when(F.col("event_id") % 60 < 8, F.col("event_id") % 60).otherwise(k) * 30 + 2)


@query(
    _numbered(80, "event_id % 30 * 5")
    # 30 listed symbols weigh 32 each, the one that repeated 64, all others 1; doubled once, then frozen.
    + " SELECT segment, seq, sym, CAST(CASE WHEN k <= 30 THEN sym ELSE 2 * (sym - sym // 5 + 32 * (sym // 5) + CASE WHEN again < sym THEN 32 ELSE 0 END) END AS INT) AS start, CAST(CASE WHEN k <= 30 THEN 0 WHEN sym = again THEN 128 ELSE 64 END AS INT) AS freq,"
    " CAST(CASE WHEN k = 0 THEN 0 WHEN k <= 14 THEN 1 WHEN k <= 30 THEN 2 ELSE 6 END AS INT) AS kind FROM r"
)
def a106_middle_model(spark, sf_dir):
    return _modelled(spark, sf_dir, 80, F.col("event_id") % 30 * 5)


@query(
    _numbered(200, f"{_K} % 6")
    # Even shares of 682 for 128 symbols, then the counts: half a share and 16 for each time.
    + ", c AS (SELECT segment, v, 341 + 16 * count(*) FILTER (WHERE sym = v) AS f FROM n, (VALUES (0), (1), (2), (3), (4), (5)) s(v) WHERE k < 128 GROUP BY segment, v),"
    " cum AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY segment ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c)"
    " SELECT n.segment, seq, sym, CAST(CASE WHEN k < 128 THEN sym * 682 ELSE s END AS INT) AS start, CAST(CASE WHEN k < 128 THEN 682 ELSE f END AS INT) AS freq, CAST(7 AS INT) AS kind FROM n JOIN cum ON cum.segment = n.segment AND v = sym"
)
def a108_fixed_model(spark, sf_dir):
    return _modelled(spark, sf_dir, 200, F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 6, 6)


@query()
def a100_a107_model_intervals(spark, sf_dir):
    """Adaptive intervals of the events' numbers in the context of their type; statistics start anew with each segment of ids, as at keyframes."""
    e = _t(spark, sf_dir, "events").select("event_type", F.floor(F.col("event_id") / 4096).alias("segment"), F.col("event_id").alias("seq"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("sym"))
    return model.adaptive_intervals(e, ["event_type", "segment"])


@query()
def a120_a125_entropy_blocks(spark, sf_dir):
    """Adaptive intervals of every frame's colours, entropy-coded by frame and block."""
    c = _contexts(spark, sf_dir).withColumn("seq", F.col("seq").cast("long"))
    iv = model.adaptive_intervals(c, ["frame_id", "channel", "ctx"])
    return entropy.entropy_blocks(iv.select("frame_id", "seq", "start", "freq")).select("frame_id", "block", "n", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))


@query("SELECT event_type, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")
def a127_range_coder(spark, sf_dir):
    """The events' numbers through the range coder and back, with counts that adapt (A45), per type and block of ids."""
    import pyarrow as pa

    def both(batches):
        for _, t in by_key(batches, ["event_type", "block"]):
            syms = t.column("k").to_pylist()
            back = entropy.range_decode(entropy.range_encode(syms, 100, 400), len(syms), 100, 400)
            yield pa.RecordBatch.from_arrays([t.column("event_type").combine_chunks(), t.column("event_id").combine_chunks(), pa.array(back, pa.int32())], names=["event_type", "event_id", "k"])

    d = _events_k(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / 4096))
    return d.repartition("event_type", "block").sortWithinPartitions("event_type", "block", "event_id").mapInArrow(both, "event_type string, event_id long, k int")


_KEYS = (
    f"f AS (SELECT event_id, event_type = 'error' AS flat FROM events), s AS (SELECT min(event_id) FILTER (WHERE NOT flat) AS f0 FROM f), m AS (SELECT f.*, s.f0, max(CASE WHEN flat THEN event_id END) OVER (ORDER BY event_id) AS fat FROM f, s),"
    f" k AS (SELECT event_id, flat, (event_id - CASE WHEN fat > f0 OR f0 IS NULL OR event_id < f0 THEN fat ELSE f0 END) % {INTERVAL} AS d FROM m)"
)


@query(f"WITH {_KEYS} SELECT event_id, flat, CASE WHEN flat OR d = 0 THEN 0 ELSE d END AS since_key, flat OR d = 0 AS is_key, CAST(sum(CASE WHEN flat OR d = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS segment FROM k")
def a130_a131_a52_keyframe_segments(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "event_type")
    return sequence.keyframes(e, "event_id", F.col("event_type") == "error", INTERVAL).select("event_id", "flat", "since_key", "is_key", "segment")


def _packets(spark, sf_dir):
    f = fr.scene_frames(spark, sf_dir)
    seg = sequence.keyframes(diff.flat_frames(f).withColumnRenamed("flat", "is_flat"), "frame_id", F.col("is_flat"), INTERVAL)
    return codec.encode(fr.to_images(f), seg.select("frame_id", "segment", "is_key"))


@query()
def a02_a03_packets(spark, sf_dir):
    """Every frame encoded; packet sizes and types."""
    return _packets(spark, sf_dir).select("frame_id", "segment", "ftype", "size", codec.packet_type(F.ascii(F.substring("payload", 1, 1)), "size", F.col("ftype")).alias("inferred"))


_FRAME_KEYS = (
    "f AS (SELECT frame_id AS event_id, min(r) = max(r) AND min(g) = max(g) AND min(b) = max(b) AS flat FROM frames GROUP BY frame_id)",
    "s AS (SELECT min(event_id) FILTER (WHERE NOT flat) AS f0 FROM f)",
    "m AS (SELECT f.*, s.f0, max(CASE WHEN flat THEN event_id END) OVER (ORDER BY event_id) AS fat FROM f, s)",
    f"k AS (SELECT event_id AS frame_id, flat OR (event_id - CASE WHEN fat > f0 OR f0 IS NULL OR event_id < f0 THEN fat ELSE f0 END) % {INTERVAL} = 0 AS is_key FROM m)",
)
_N = -(-W // 16)


@query(
    _with(
        " SELECT channel, ctx, value, count(*) AS cnt FROM symbols GROUP BY ALL",
        _PAIR, *_BLOCKS, *_MOTION, *_FRAME_KEYS,
        "dm AS (SELECT v.*, x1 - bx * 16 AS e0, y1 - brow * 16 AS e1, x2 - 1 - bx * 16 AS e2, y2 - 1 - brow * 16 AS e3 FROM moved v JOIN k USING (frame_id) WHERE NOT is_key)",
        f"span AS (SELECT frame_id, min(brow) * {_N} + min(bx) AS first, max(brow) * {_N} + max(bx) AS last FROM dm GROUP BY frame_id)",
        f"typ AS (SELECT s.frame_id, i.idx, coalesce(d.bt, 0) AS bt FROM (SELECT frame_id, first, unnest(range(first, last + 1)) AS idx FROM span) i JOIN span s USING (frame_id) LEFT JOIN dm d ON d.frame_id = s.frame_id AND d.brow * {_N} + d.bx = i.idx)",
        "chg AS (SELECT *, CASE WHEN lag(bt) OVER (PARTITION BY frame_id ORDER BY idx) = bt THEN 0 ELSE 1 END AS new FROM typ)",
        "isl AS (SELECT frame_id, any_value(bt) AS bt, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY idx) AS island FROM chg) GROUP BY frame_id, island)",
        f"vec AS (SELECT dx, dy, {_SAME} AS same FROM dm WHERE dx IS NOT NULL WINDOW w AS (PARTITION BY frame_id ORDER BY brow, bx))",
        "symbols AS (SELECT 'index' AS channel, 0 AS ctx, CAST((v >> b) & 255 AS INT) AS value FROM (SELECT unnest([first, last]) AS v FROM span), (VALUES (0), (8), (16), (24)) t(b)"
        " UNION ALL SELECT 'bt', 0, CAST(bt AS INT) FROM isl UNION ALL SELECT 'bn', 0, CAST(n AS INT) FROM isl"
        " UNION ALL SELECT 'edge', CAST(t.c AS INT), CAST(CASE t.c WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS INT) FROM dm, (VALUES (0), (1), (2), (3)) t(c) WHERE bt IN (2, 4)"
        " UNION ALL SELECT 'flag', 0, CAST(same AS INT) FROM vec UNION ALL SELECT 'mv', 0, CAST(dx + 256 AS INT) FROM vec WHERE NOT same UNION ALL SELECT 'mv', 1, CAST(dy + 256 AS INT) FROM vec WHERE NOT same)",
    )
)
def a153_a158_channel_histograms(spark, sf_dir):
    """What the codec writes on the channels of changed regions, block types, rectangles and vectors, counted."""
    f = fr.scene_frames(spark, sf_dir)
    seg = sequence.keyframes(diff.flat_frames(f).withColumnRenamed("flat", "is_flat"), "frame_id", F.col("is_flat"), INTERVAL)
    symbols = codec.symbols(fr.to_images(f), seg.select("frame_id", "segment", "is_key"))
    return stats.histogram(symbols.where(F.col("channel").isin("index", "bt", "bn", "edge", "flag", "mv")), ["channel", "ctx"], "value")


@query(_with(" SELECT * FROM (SELECT frame_id, y, x, r, g, b FROM frames)"))
def a141_range_codec_roundtrip(spark, sf_dir):
    """The round trip with the range coder in place of the other one."""
    f = fr.scene_frames(spark, sf_dir)
    seg = sequence.keyframes(diff.flat_frames(f).withColumnRenamed("flat", "is_flat"), "frame_id", F.col("is_flat"), INTERVAL)
    packets = codec.encode(fr.to_images(f), seg.select("frame_id", "segment", "is_key"), coder="range")
    return fr.from_images(codec.decode(packets, H, W, coder="range"))


@query(_with(" SELECT * FROM (SELECT frame_id, y, x, r, g, b FROM frames)"))
def a04_a64_codec_roundtrip(spark, sf_dir):
    """Frames encoded and decoded again: the original frames, pixel for pixel."""
    return fr.from_images(codec.decode(_packets(spark, sf_dir), H, W))


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) % 7 = 1 AS is_key, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 7 + 1 AS BIGINT) AS segment, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 7 AS BIGINT) AS since_key FROM events")
def a130_a133_stream_keyframes(spark, sf_dir):
    """Keyframe decisions by a streaming query with a state per event type."""
    from rasterloom.streaming.keyframes import drain, stream_keyframes

    src = _t(spark, sf_dir, "events")
    e = spark.readStream.schema(src.schema).parquet(f"{sf_dir}/events.parque[t]").select("event_type", "event_id", F.lit(False).alias("flat"))
    return drain(stream_keyframes(e, "event_type", "event_id", "flat", INTERVAL), "keys")


@query("SELECT event_type, event_id, props <> lag(props) OVER (PARTITION BY event_type ORDER BY event_id) AS changed FROM events")
def a132_stream_changes(spark, sf_dir):
    """Each event's payload against the one before of its type, by a streaming query."""
    from rasterloom.streaming.keyframes import drain, stream_changes

    src = _t(spark, sf_dir, "events")
    e = spark.readStream.schema(src.schema).parquet(f"{sf_dir}/events.parque[t]").select("event_type", "event_id", "props")
    return drain(stream_changes(e, "event_type", "event_id", "props"), "changes")


def _event_stream(spark, sf_dir, *columns):
    src = _t(spark, sf_dir, "events")
    return spark.readStream.schema(src.schema).parquet(f"{sf_dir}/events.parque[t]").select(*columns)


_STATE = "SELECT *, lag(flat) OVER w AS pf, lag(k) OVER w AS pk, max(CASE WHEN is_key THEN 1 ELSE 0 END) OVER w AS opened FROM (SELECT user_id, event_id, event_type = 'error' AS flat, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) // 25 AS k, event_type IN ('error', 'purchase') AS is_key FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


@query(f"SELECT user_id, event_id, is_key AND NOT (flat AND coalesce(pf AND pk = k, false)) AS resets, opened = 1 AS decodable FROM ({_STATE})")
def a134_a135_stream_state(spark, sf_dir):
    """Per user as a stream of frames: which keyframes reset the statistics (not a flat one like the flat one before), and which frames can be decoded (none before the first keyframe)."""
    from rasterloom.streaming.keyframes import drain, stream_resets

    e = _event_stream(spark, sf_dir, "user_id", "event_id", (F.col("event_type") == "error").alias("flat"), F.floor(F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 25).cast("int").alias("colour"), F.col("event_type").isin("error", "purchase").alias("is_key"))
    return drain(stream_resets(e, "user_id", "event_id"), "resets")


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS seen, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS total FROM events")
def a45_a133_stream_counts(spark, sf_dir):
    """Adaptive counts as state of a stream: how often each symbol came before, and how many symbols came."""
    from rasterloom.streaming.keyframes import drain, stream_counts

    return drain(stream_counts(_event_stream(spark, sf_dir, "user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"), "counts")


@query("SELECT * FROM (VALUES ('interval', '500', 'default'), ('far', '64', 'option'), ('near', '8', 'default'), ('loss', '0', 'default'), ('coder', 'range', 'option')) t(name, value, source)")
def a146_settings(spark, sf_dir):
    """Settings with two options given."""
    rows = [(name, str(value), source) for name, (value, source) in settings(spark, far=64, coder="range").items()]
    return spark.createDataFrame(rows, "name string, value string, source string")
