"""What the operators of this package share: word rules, stored tables, Arrow helpers."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: The six white-space characters that part words.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: evaluated once, and no lineage behind it."""
    return materialise(df, f"llm-{name}")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of words of a text column, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(df: DataFrame, rows_each: int) -> int:
    """A partition count that grows with the rows: one per `rows_each`, at least 1."""
    return max(1, math.ceil(df.count() / rows_each))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
