"""Keyed account table: lookup, filter, ingest, update, delete, export."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stayrate.schema import KEY, STAMPS, require_columns
from stayrate.session import settle
from stayrate.sources.files import write_csv

def lookup_account(df: DataFrame, value: str, key: str = KEY) -> DataFrame:
    """The row with this key; no row if there is none."""
    return df.where(F.col(key) == F.lit(value))


def filter_accounts(df: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Rows meeting every equality. Nothing equals None; unknown columns are an error."""
    require_columns(df, *criteria)
    if not criteria:
        return df
    return df.where(reduce(and_, [F.col(c) == F.lit(v) for c, v in criteria.items()]))


def with_stamps(df: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return df.withColumns({c: now for c in STAMPS})


def _first_per_key(incoming: DataFrame, order: str, key: str) -> DataFrame:
    """First row of each key by ``order``, then by the fields themselves.

    An aggregate keeps one candidate per key and task, so repeated keys are
    reduced before they are shuffled.
    """
    fields = [c for c in incoming.columns if c not in (key, order)]
    return (
        incoming.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(order, F.struct(*fields).alias("row"))).alias("first"))
        .select(key, "first.row.*")
    )


def new_accounts(
    incoming: DataFrame, table: DataFrame | None, order: str, key: str = KEY
) -> DataFrame:
    """Incoming rows that may be inserted: first of their key, and not stored yet.

    The first rows are written, so that the incoming ones are read once and the
    keys looked for among the stored ones have a known size: where they are few,
    Spark sends them to the stored table, which is then not shuffled.
    """
    first = _first_per_key(incoming, order, key)
    if table is None:
        return first
    first = settle(first)
    stored = table.select(key).join(first.select(key), key, "left_semi")
    return first.join(stored, key, "left_anti")


def stored_accounts(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        return None


def append_accounts(
    incoming: DataFrame,
    path: str,
    order: str,
    key: str = KEY,
    inserted: Observation | None = None,
) -> None:
    """Append the rows that may be inserted; columns unlike the stored ones are an error.

    ``inserted`` takes the number of rows written, from the write itself.
    """
    table = stored_accounts(incoming.sparkSession, path)
    fresh = with_stamps(new_accounts(incoming, table, order, key))
    if table is not None:
        stored = {f.name: f.dataType for f in table.schema}
        given = {f.name: f.dataType for f in fresh.schema}
        other = sorted(c for c in stored | given if stored.get(c) != given.get(c))
        if other:
            raise ValueError(f"columns unlike those stored: {', '.join(other)}")
    if inserted is not None:
        fresh = fresh.observe(inserted, F.count("*").alias("n"))
    fresh.write.mode("append").parquet(path)


def ingest_accounts(
    incoming: DataFrame, path: str, order: str, key: str = KEY
) -> tuple[int, int]:
    """Append new accounts to a stored Parquet table; ``(inserted, failed)``.

    A row fails if its key is missing, stored already, or came earlier in the
    same batch. The incoming rows are counted as they are read and the inserted
    ones as they are written, so nobody else's rows are in the counts.
    """
    read, inserted = Observation(), Observation()
    counted = incoming.observe(read, F.count("*").alias("n"))
    append_accounts(counted, path, order, key, inserted)
    return inserted.get["n"], read.get["n"] - inserted.get["n"]


def ingest_counts(
    incoming: DataFrame, table: DataFrame | None, order: str, key: str = KEY
) -> DataFrame:
    """The counts ``ingest_accounts`` would report, as one row."""
    fresh = new_accounts(incoming, table, order, key)
    total = incoming.agg(F.count("*")).scalar()
    return fresh.agg(F.count("*").alias("inserted")).withColumn(
        "failed", total - F.col("inserted")
    )


def update_accounts(
    df: DataFrame,
    updates: DataFrame,
    order: str,
    key: str = KEY,
    now: Column | None = None,
    supplied: str | None = None,
) -> DataFrame:
    """Rows with supplied fields replaced and ``updated_at`` stamped.

    A field is supplied if it is not NULL, or, with ``supplied``, if the list of
    names in that column has it; then NULL is a value like any other. Of several
    updates to one key, each field takes the last supplied value by ``order``.
    Write the result to a new path.
    """
    fields = [c for c in updates.columns if c not in (key, order, supplied)]
    require_columns(df, *fields)
    now = F.current_timestamp() if now is None else now

    def given(c: str) -> Column:
        return F.col(c).isNotNull() if supplied is None else F.array_contains(supplied, c)

    last = updates.groupBy(key).agg(
        *[
            F.max_by(F.struct(c), F.when(given(c), F.struct(order, c))).alias(f"new_{c}")
            for c in fields
        ],
        F.lit(True).alias("hit"),
    )
    merged = df.join(last, key, "left")
    changes = {
        c: F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}")[c])
        .otherwise(F.col(c))
        .cast(df.schema[c].dataType)
        for c in fields
    }
    if "updated_at" in df.columns:
        changes["updated_at"] = F.when(F.col("hit"), now).otherwise(F.col("updated_at"))
    return merged.withColumns(changes).select(*df.columns)


def unknown_keys(df: DataFrame, wanted: DataFrame, key: str = KEY) -> DataFrame:
    """Keys of ``wanted`` the table does not hold."""
    return wanted.select(key).distinct().join(df.select(key), key, "left_anti")


def delete_accounts(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def export_csv(
    df: DataFrame, path: str, criteria: Mapping[str, object] | None = None
) -> bool:
    """Write all rows, or those meeting the criteria; False and no file if none."""
    chosen = filter_accounts(df, criteria or {})
    if chosen.isEmpty():
        return False
    write_csv(chosen, path)
    return True
