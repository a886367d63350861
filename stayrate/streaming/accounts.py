"""Scoring and inserting accounts as they arrive."""

from __future__ import annotations

from threading import Event

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stayrate.operators.quality import rejected_rows, valid_rows
from stayrate.operators.scoring import Scorer, score_batch, scorecard
from stayrate.operators.table import append_accounts
from stayrate.schema import KEY, TEXT_SCHEMA
from stayrate.session import shared_dir
from stayrate.sources.accounts import load_accounts
from stayrate.sources.files import CSV_OPTIONS, header_schema


def read_accounts(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of CSV account files, every field as text until it is checked.

    Columns are taken by the names in the header of the files there at the start;
    with none there, the files to come must have the declared order. A file with
    another header ends the stream with an error.
    """
    try:
        schema = header_schema(spark, path, TEXT_SCHEMA)
    except AnalysisException as error:  # no file yet
        if "UNABLE_TO_INFER" not in str(error):
            raise
        schema = TEXT_SCHEMA
    reader = spark.readStream.schema(schema).options(**CSV_OPTIONS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path).select(*TEXT_SCHEMA.names)


def stream_score(
    arriving: DataFrame,
    scorer: Scorer,
    path: str,
    checkpoint: str,
    rejected: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Append predictions for valid arriving rows, stamped and keyed by batch.

    Totals that are blank count as missing rather than wrong. Rows that are not
    valid go to ``rejected``, by default beside ``path``, with the reason. A batch
    is named by the checkpoint's query and its number: run again it replaces
    itself, and a fresh checkpoint replaces nothing.
    """
    rejected = rejected or f"{path.rstrip('/')}_rejected"
    started = Event()
    blank = F.trim("TotalCharges") == ""
    given = arriving.withColumn("TotalCharges", F.when(~blank, F.col("TotalCharges")))

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        folder = f"batch={query.id}-{batch_id}"
        predictions = score_batch(valid_rows(batch), scorer)
        for rows, target in ((predictions, path), (rejected_rows(batch), rejected)):
            stamped = rows.withColumn("timestamp", F.current_timestamp())
            stamped.write.mode("overwrite").parquet(f"{target}/{folder}")

    query = (
        given.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    started.set()
    return query


def stream_ingest(
    arriving: DataFrame, order: str, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Insert arriving rows whose key is new, first by ``order`` within a batch.

    The table is the one ``ingest_accounts`` keeps. Every batch looks at all keys
    stored by then, so a batch run again inserts only what is not there yet.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_accounts(batch, path, order)

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def replay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account view sent through the scoring stream."""
    source, target, checkpoint = (shared_dir(spark) for _ in range(3))
    accounts = load_accounts(spark, sf_dir)
    accounts.write.option("header", True).csv(
        source, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    _finish(stream_score(read_accounts(spark, source, 4), scorecard, target, checkpoint))
    return spark.read.parquet(target).drop("timestamp", "batch")


def replay_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account view, each account twice, sent through the inserting stream."""
    source, target, checkpoint = (shared_dir(spark) for _ in range(3))
    accounts = load_accounts(spark, sf_dir)
    twice = accounts.withColumn("arrival", F.lit(1)).unionByName(
        accounts.withColumn("Contract", F.lit("Two year")).withColumn("arrival", F.lit(2))
    )
    twice.write.parquet(source)
    arriving = (
        spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 4).parquet(source)
    )
    _finish(stream_ingest(arriving, "arrival", target, checkpoint))
    return spark.read.parquet(target).select(KEY, "tenure", "MonthlyCharges", "Churn")
