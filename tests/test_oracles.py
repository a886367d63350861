"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from stayrate.plans.catalog import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
ORACLES = {k: q.oracle() for k, q in QUERIES.items() if q.sql is not None}
# Queries without SQL that fit models many times are run in test_models.
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def database(small):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    return connection


def _rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, plain.values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, database, name):
    found = entry_points.queries()[name](spark, small).toPandas()
    wanted = database.execute(ORACLES[name]).fetchdf()
    assert _rows(found) == _rows(wanted)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 3


def test_only_model_work_lacks_sql():
    assert ROWS_ONLY == sorted(
        [
            "adasyn",
            "best_model",
            "bounded_search_cv",
            "cluster_centroids",
            "compare_models",
            "cumulative_importance",
            "feature_importance",
            "load_model",
            "random_search_cv",
            "refit_full",
            "smote",
            "smoten",
            "top_features",
            "train_given_params",
            "train_gradient_boosting",
            "train_logistic",
            "train_random_forest",
            "train_xgboost",
            "training_report",
        ]
    )
