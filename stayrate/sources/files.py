"""Reading and writing accounts, predictions and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.operators.scoring import Scorer, score_batch
from stayrate.schema import ACCOUNT_SCHEMA


def null_nans(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in floating-point columns."""
    floats = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats})


#: How account files are written: a header row, and text as it stands. A file whose
#: header differs from the schema it is read with is an error.
CSV_OPTIONS = {
    "header": True,
    "enforceSchema": False,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def header_schema(spark: SparkSession, path: str, schema: T.StructType) -> T.StructType:
    """``schema`` in the order of the header row; other columns there are text.

    A column that the header lacks is an error.
    """
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    absent = [c for c in schema.names if c not in header]
    if absent:
        raise ValueError(f"columns not found: {', '.join(absent)}")
    return T.StructType(
        [schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in header]
    )


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType = ACCOUNT_SCHEMA
) -> DataFrame:
    """CSV with a header row, its columns taken by name; a missing path is an error.

    Text is read as it stands: a blank total is a blank, not NULL. All files of a
    folder must have the same header.
    """
    named = header_schema(spark, path, schema)
    rows = spark.read.schema(named).options(**CSV_OPTIONS).csv(path)
    return null_nans(rows.select(*schema.names))


def scan_all(spark: SparkSession, path: str) -> DataFrame:
    """Whole stored table."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).mode("errorifexists").csv(
        path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


def score_csv(spark: SparkSession, source: str, target: str, scorer: Scorer) -> str:
    """Score a CSV of accounts into a CSV of predictions."""
    return write_csv(score_batch(scan_csv(spark, source), scorer), target)


def save_predictions(predictions: DataFrame, path: str, fmt: str = "csv") -> str:
    if fmt == "csv":
        return write_csv(predictions, path)
    predictions.write.format(fmt).save(path)
    return path


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Add prediction records, stamped now, to an append-only table."""
    predictions.withColumn("timestamp", F.current_timestamp()).write.mode(
        "append"
    ).parquet(path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_sql(
    spark: SparkSession,
    query: str,
    params: Sequence = (),
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Free SQL with positional ``?`` parameters over named frames."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=list(params)) if params else spark.sql(query)
