"""Structured Streaming forms: keyframe decisions and frame differences with per-stream state."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_keyframes(frames: DataFrame, key: str, order: str, flat: str, interval: int) -> DataFrame:
    """Streaming rows (key, order, is_key, segment, since_key): one small state per stream of frames.

    ``frames`` has a boolean column ``flat``. Rows of a micro-batch are taken in
    order; a stream's frames must arrive in order over micro-batches.
    """
    types = dict(frames.dtypes)

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, since, segment = state.get if state.exists else (False, 0, 0)
        d = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, is_flat in zip(d[order], d[flat], strict=True):
            key_now = bool(is_flat) or not started or since + 1 >= interval
            started = started or not is_flat
            since = 0 if key_now else since + 1
            segment += key_now
            out.append((k[0], o, key_now, segment, since))
        state.update((started, since, segment))
        yield pd.DataFrame(out, columns=[key, order, "is_key", "segment", "since_key"])

    return frames.groupBy(key).applyInPandasWithState(
        decide, f"{key} {types[key]}, {order} {types[order]}, is_key boolean, segment long, since_key long", "started boolean, since long, segment long", "append", GroupStateTimeout.NoTimeout
    )


def stream_changes(frames: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Streaming rows (key, order, changed): each frame against the one before of its stream, by a digest in state.

    Frames before the first are unknown, so the first has null.
    """
    types = dict(frames.dtypes)
    hashed = frames.select(key, order, F.sha2(F.col(payload).cast("binary"), 256).alias("h"))

    def compare(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        d = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, h in zip(d[order], d["h"], strict=True):
            out.append((k[0], o, None if last is None else h != last))
            last = h
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, order, "changed"]).astype({"changed": object})

    return hashed.groupBy(key).applyInPandasWithState(compare, f"{key} {types[key]}, {order} {types[order]}, changed boolean", "h string", "append", GroupStateTimeout.NoTimeout)


def stream_resets(frames: DataFrame, key: str, order: str) -> DataFrame:
    """Streaming rows (key, order, resets, decodable) of frames with columns is_key, flat and colour, state per stream.

    A keyframe resets the statistics unless it is flat and the frame before was
    flat in the same colour. Frames before a stream's first keyframe cannot be
    decoded.
    """
    types = dict(frames.dtypes)

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, last_flat, last_colour = state.get if state.exists else (False, False, 0)
        d = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, is_key, flat, colour in zip(d[order], d["is_key"], d["flat"], d["colour"], strict=True):
            opened = opened or bool(is_key)
            out.append((k[0], o, bool(is_key) and not (flat and last_flat and colour == last_colour), opened))
            last_flat, last_colour = bool(flat), int(colour)
        state.update((opened, last_flat, last_colour))
        yield pd.DataFrame(out, columns=[key, order, "resets", "decodable"])

    rows = frames.select(key, order, "is_key", "flat", "colour")
    return rows.groupBy(key).applyInPandasWithState(decide, f"{key} {types[key]}, {order} {types[order]}, resets boolean, decodable boolean", "opened boolean, flat boolean, colour int", "append", GroupStateTimeout.NoTimeout)


def stream_counts(symbols: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Streaming rows (key, order, value, seen, total): the adaptive counts that a symbol meets, state per stream."""
    types = dict(symbols.dtypes)

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = dict(state.get[0]) if state.exists else {}
        d = pd.concat(list(batches)).sort_values(order)
        out, total = [], sum(counts.values())
        for o, v in zip(d[order], d[value], strict=True):
            out.append((k[0], o, v, counts.get(v, 0), total))
            counts[v], total = counts.get(v, 0) + 1, total + 1
        state.update((counts,))
        yield pd.DataFrame(out, columns=[key, order, value, "seen", "total"])

    ddl = f"{key} {types[key]}, {order} {types[order]}, {value} {types[value]}, seen long, total long"
    return symbols.select(key, order, value).groupBy(key).applyInPandasWithState(count, ddl, f"counts map<{types[value]}, bigint>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """Tumbling counts with a watermark; ``ts`` is cast, since watermarks refuse time stamps without a zone."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and the master is local, a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    base = tempfile.mkdtemp(prefix="rasterloom-")
    atexit.register(shutil.rmtree, base, True)
    return base


def drain(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Run ``stream`` over what there is, into Parquet in the shared folder, and read that."""
    spark: SparkSession = stream.sparkSession
    base = shared_folder(spark)
    out, at = f"{base}/{name}-{uuid.uuid4().hex}", f"{base}/{name}-state-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
