"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the control characters tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*columns: str | Column) -> Column:
    """128-bit key of the values; rows with equal values get equal keys.

    Nulls count as a value of their own.
    """
    parts = []
    for column in columns:
        value = (F.col(column) if isinstance(column, str) else column).cast("string")
        parts += [F.when(value.isNull(), "-").otherwise("+"), F.coalesce(value, F.lit(""))]
    return F.md5(F.concat_ws("\x1f", *parts))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: Most bytes of a table that may travel to every task.
SMALL_BYTES = 32 << 20


def few_rows(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small; else left to a shuffle."""
    size = df.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df
