"""Batch scoring with bands, reasons and actions, by any scorer.

A scorer maps prepared accounts to the same rows with ``churn_probability``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions import scoring as X
from stayrate.operators.cleaning import clean_accounts, derive_features
from stayrate.schema import KEY
from stayrate.session import settle

Scorer = Callable[[DataFrame], DataFrame]

PROBABILITY = "churn_probability"


def scorecard(df: DataFrame) -> DataFrame:
    """Scorer with constant weights; needs no fitted model."""
    return df.withColumn(PROBABILITY, X.scorecard_probability())


def model_scorer(model: PipelineModel) -> Scorer:
    """Scorer that applies a fitted pipeline and keeps only the probability."""

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        probability = vector_to_array("probability")[1]
        return scored.withColumn(PROBABILITY, probability).select(*df.columns, PROBABILITY)

    return score


def prepare_batch(df: DataFrame) -> DataFrame:
    """Cleaned accounts with derived features; the key stays beside them."""
    return derive_features(clean_accounts(df))


def with_probability(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Raw accounts with ``churn_probability`` beside their own columns.

    The raw row rides along as a struct, so scoring needs no join back.
    """
    raw = F.struct(*[F.col(c) for c in df.columns])
    prepared = prepare_batch(df.withColumn("raw", raw))
    return scorer(prepared).select("raw.*", PROBABILITY)


def _outcome(key: str) -> list:
    p = F.col(PROBABILITY)
    return [
        F.col(key).alias("customer_id"),
        X.predicted_label(p).alias("churn_prediction"),
        p,
        X.risk_band(p).alias("risk_level"),
        X.confidence(p).alias("confidence"),
    ]


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows with ``name``, numbered from 0 without gaps in the order they are read.

    The rows are written once, each with its place in its partition; the totals
    of the partitions, one row each, give every partition its first number.
    """
    place = next(f"{name}_place{i}" for i in range(len(df.columns) + 1) if f"{name}_place{i}" not in df.columns)
    part = F.shiftright(F.col(place), 33)
    rows = settle(df.withColumn(place, F.monotonically_increasing_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        rows.groupBy(part.alias("part"))
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    packed = rows.select(F.struct(*df.columns).alias("row"), part.alias("part"), place)
    number = F.col("start") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return packed.join(F.broadcast(firsts), "part").select("row.*", number.alias(name))


def _with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows without a key column get ids ``customer_<number>``, consecutive from 0."""
    if key in df.columns:
        return df
    numbered = number_rows(df, key)
    return numbered.withColumn(key, F.concat(F.lit("customer_"), F.col(key).cast("string")))


def score_batch(df: DataFrame, scorer: Scorer, key: str = KEY) -> DataFrame:
    """One prediction record per account."""
    return scorer(prepare_batch(_with_key(df, key))).select(*_outcome(key))


def explain_batch(df: DataFrame, scorer: Scorer, key: str = KEY) -> DataFrame:
    """Prediction records with ordered reasons and suggested actions."""
    scored = with_probability(_with_key(df, key), scorer)
    return scored.select(
        *_outcome(key),
        X.churn_factors().alias("important_factors"),
        X.retention_actions(F.col(PROBABILITY)).alias("recommendations"),
    )


def score_stored(
    accounts: DataFrame, ids: DataFrame, scorer: Scorer, key: str = KEY
) -> DataFrame:
    """Predictions for the stored accounts whose key appears in ``ids``."""
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias(key)).distinct()
    return score_batch(accounts.join(wanted, key, "left_semi"), scorer, key)


def batch_summary(predictions: DataFrame) -> DataFrame:
    """Scored, predicted churners, their percentage, and high-risk count."""
    churners = F.count_if(F.col("churn_prediction") == "Yes")
    return predictions.agg(
        F.count("*").alias("scored"),
        churners.alias("predicted_churners"),
        F.coalesce(F.try_divide(churners * 100, F.count("*")), F.lit(0.0)).alias(
            "churner_percent"
        ),
        F.count_if(F.col("risk_level").isin("High", "Very High")).alias("high_risk"),
    )


def latest_prediction(predictions: DataFrame, key: str = "customer_id") -> DataFrame:
    """Most recent record per account of an append-only predictions table.

    The label column of the account table is never overwritten.
    """
    fields = [c for c in predictions.columns if c != key]
    return (
        predictions.groupBy(key)
        .agg(F.max(F.struct("timestamp", F.struct(*fields).alias("row"))).alias("latest"))
        .select(key, "latest.row.*")
    )
