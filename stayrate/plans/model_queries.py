"""Registered queries: synthetic rebalancing, training, search and models.

Tree counts, search sizes, folds and families are those of the stored sets and of
the reference; the rows are always all of them.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stayrate.operators import models, search, synthesis
from stayrate.operators.preparation import fit_preparation
from stayrate.operators.resampling import stratified_split
from stayrate.operators.scoring import model_scorer, score_batch
from stayrate.plans.explore_queries import featured, labelled
from stayrate.plans.oracle_views import ACCOUNTS, SCORED
from stayrate.plans.registry import Query, rounds
from stayrate.plans.score_queries import OUTCOME
from stayrate.plans.settings import BOUNDED, FAMILIES, STORED, family_grid
from stayrate.schema import KEY
from stayrate.session import settle, shared_dir
from stayrate.sources import files
from stayrate.sources.accounts import load_accounts
from stayrate.streaming import accounts as streams

#: Settings and folds of a random search, and of a bounded one.
RANDOM, BOUNDED_DRAWS, FOLDS = 20, 50, 5


def _rows(spark, sf_dir):
    """Prepared accounts with key and 0/1 label, written once for many passes."""
    return settle(labelled(spark, sf_dir).drop("Churn"))


def _parts(spark, sf_dir):
    return stratified_split(_rows(spark, sf_dir), label="label", classes=(0, 1))


def _encoded(spark, sf_dir):
    """Encoded accounts with a rarer class: those on two-year contracts."""
    two_year = (F.col("Contract") == "Two year").cast("int")
    df = settle(featured(spark, sf_dir).withColumn("label", two_year).drop("Contract"))
    return settle(fit_preparation(df).transform(df).select(KEY, "features", "label"))


def _made(maker, *args):
    """Rebalanced rows as class, origin, and the vector as text of rounded entries."""

    def run(spark, sf_dir):
        out = maker(_encoded(spark, sf_dir), *args)
        entries = F.transform(vector_to_array("features"), lambda x: F.round(x, 6))
        return out.select(KEY, "label", entries.cast("string").alias("features"))

    return run


def _fitted(family, setting):
    def run(spark, sf_dir):
        train_rows, test_rows = _parts(spark, sf_dir)
        model = models.train(train_rows, family, setting)
        return models.score_rows(model, test_rows).select(
            KEY, "label", "predicted", "churn_probability"
        )

    return run


def _random_search(spark, sf_dir):
    metrics, _ = search.random_search_cv(
        _rows(spark, sf_dir), "logistic", RANDOM, folds=FOLDS, parallelism=8
    )
    return metrics


def _bounded_search(spark, sf_dir):
    metrics, _ = search.bounded_search_cv(
        _rows(spark, sf_dir),
        "gradient_boosting",
        BOUNDED["gradient_boosting"],
        BOUNDED_DRAWS,
        folds=FOLDS,
        parallelism=8,
    )
    return metrics


def _compare(spark, sf_dir):
    train_rows, test_rows = _parts(spark, sf_dir)
    grids = {family: family_grid(family) for family in FAMILIES}
    metrics, winner, _ = search.compare_models(
        train_rows, test_rows, grids, RANDOM, folds=FOLDS, parallelism=8
    )
    return metrics.withColumn("best", F.col("model_name") == winner)


def _given(spark, sf_dir):
    metrics, _ = search.train_given_params(*_parts(spark, sf_dir), STORED)
    return metrics


def _best(spark, sf_dir):
    return models.best_model(_given(spark, sf_dir))


def _report(spark, sf_dir):
    train_rows, test_rows = _parts(spark, sf_dir)
    fitted = search.train_families(train_rows, STORED)
    return search.report_models(fitted, test_rows, shared_dir(spark))


def _refit(spark, sf_dir):
    df = _rows(spark, sf_dir)
    model = search.refit_full(df, "logistic", STORED["logistic"])
    return models.score_rows(model, df).select(KEY, "label", "predicted", "churn_probability")


def _importance(spark, sf_dir):
    df = _rows(spark, sf_dir)
    return models.feature_importance(models.train_random_forest(df, STORED["random_forest"]), df)


def _saved(spark, sf_dir):
    df = _rows(spark, sf_dir)
    model = models.train_logistic(df, STORED["logistic"])
    return files.save_model(model, shared_dir(spark))


def _save_model(spark, sf_dir):
    """What was written: one row per saved stage, with its place."""
    path = _saved(spark, sf_dir)
    stages = spark.read.json(f"{path}/stages/*/metadata").select("class", "uid")
    place = F.regexp_extract(F.input_file_name(), r"/stages/(\d+)_", 1).cast("int")
    kind = F.substring_index("class", ".", -1)
    return stages.select(place.alias("position"), kind.alias("stage"))


def _load_model(spark, sf_dir):
    model = files.load_model(_saved(spark, sf_dir))
    return score_batch(load_accounts(spark, sf_dir), model_scorer(model))


QUERIES: dict[str, Query] = {
    "smote": Query(_made(synthesis.smote, 1.0, 5)),
    "adasyn": Query(_made(synthesis.adasyn, 1.0, 5)),
    "smoten": Query(_made(synthesis.smoten, 1.0, 5)),
    "cluster_centroids": Query(_made(synthesis.cluster_centroids, 1.0)),
    "train_logistic": Query(_fitted("logistic", {**STORED["logistic"], "resampler": "none"})),
    "train_random_forest": Query(_fitted("random_forest", STORED["random_forest"])),
    "train_gradient_boosting": Query(_fitted("gradient_boosting", STORED["gradient_boosting"])),
    "train_xgboost": Query(_fitted("xgboost", STORED["xgboost"])),
    "random_search_cv": Query(_random_search),
    "bounded_search_cv": Query(_bounded_search),
    "compare_models": Query(_compare),
    "train_given_params": Query(_given),
    "best_model": Query(_best),
    "refit_full": Query(_refit),
    "training_report": Query(_report),
    "feature_importance": Query(_importance),
    "cumulative_importance": Query(
        lambda s, d: models.cumulative_importance(_importance(s, d))
    ),
    "top_features": Query(lambda s, d: models.top_features(_importance(s, d))),
    "save_model": Query(
        _save_model,
        """SELECT * FROM (VALUES (0, 'SQLTransformer'), (1, 'StringIndexerModel'),
            (2, 'OneHotEncoderModel'), (3, 'VectorAssembler'), (4, 'SQLTransformer'),
            (5, 'LogisticRegressionModel')) AS saved(position, stage)""",
    ),
    "load_model": Query(_load_model),
    "stream_score": Query(
        streams.replay_scores,
        f"{SCORED} SELECT {OUTCOME} FROM scored",
        rounds(6, "churn_probability", "confidence"),
    ),
    "stream_ingest": Query(
        streams.replay_ingest,
        f"{ACCOUNTS} SELECT customerID, tenure, MonthlyCharges, Churn FROM accounts",
    ),
}
