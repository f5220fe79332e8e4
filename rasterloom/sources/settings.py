"""Codec settings: an option given, else a Spark setting, else the default."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Frames between keyframes, search ranges, bits dropped; and the entropy coder.
DEFAULTS = {"interval": 500, "far": 256, "near": 8, "loss": 0, "coder": "rans"}
PREFIX = "rasterloom."


def settings(spark: SparkSession, **options) -> dict[str, tuple[object, str]]:
    """(value, where it comes from) by name. An option or a value of another type than the default's raises."""
    unknown = set(options) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    out = {}
    for name, default in DEFAULTS.items():
        said = spark.conf.get(PREFIX + name, None)
        value, source = (options[name], "option") if name in options else (said, "session") if said is not None else (default, "default")
        out[name] = type(default)(value), source
    return out
