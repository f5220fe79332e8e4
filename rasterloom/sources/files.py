"""Tables in files: CSV, JSON, ORC and Parquet, always read with a schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rasterloom.streaming.keyframes import shared_folder

FORMATS = ("csv", "json", "orc", "parquet")
_OPTIONS = {"csv": {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}, "json": {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}}


def write_table(df: DataFrame, path: str, kind: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").options(**_OPTIONS.get(kind, {})).partitionBy(*partition_by).format(kind).save(path)


def read_table(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """Rows that do not fit ``schema`` raise in text formats; no inference pass is made."""
    options = _OPTIONS.get(kind, {}) | ({"mode": "FAILFAST"} if kind in ("csv", "json") else {})
    return spark.read.schema(schema).options(**options).format(kind).load(path)


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as ``kind`` into the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    write_table(df, path, kind)
    return read_table(df.sparkSession, path, kind, df.schema)
