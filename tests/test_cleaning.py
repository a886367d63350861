"""Hand-made rows for cleaning, features, caps and quality."""

import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stayrate.operators import cleaning, quality
from stayrate.schema import ACCOUNT_COLUMNS, ACCOUNT_SCHEMA
from stayrate.sources import files


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(
        [
            ("1234", "Male", 0, "Yes", 12, 50.0, "600.0", "DSL", "Yes", "Month-to-month", "No"),
            ("5678", "Female", 1, "No", 24, 75.0, "1800.0", "Fiber optic", "No", "Two year", "Yes"),
            ("9012", "Male", 0, "Yes", 6, 100.0, " ", "No", "No internet service", "One year")
            + ("No",),
        ],
        "customerID string, gender string, SeniorCitizen int, Partner string, tenure int, "
        "MonthlyCharges double, TotalCharges string, InternetService string, "
        "OnlineSecurity string, Contract string, Churn string",
    )


def _by_key(df):
    return {r["customerID"]: r.asDict() for r in df.collect()}


def test_cleaning_of_the_sample(sample):
    rows = _by_key(cleaning.clean_accounts(sample))
    assert [rows[k]["TotalCharges"] for k in ("1234", "5678", "9012")] == [600.0, 1800.0, 600.0]
    assert {r["SeniorCitizen"] for r in rows.values()} == {"0", "1"}


def test_features_of_the_sample(sample):
    df = cleaning.derive_features(cleaning.clean_accounts(sample))
    rows = _by_key(df)
    assert [rows[k]["HasInternetService"] for k in ("1234", "5678", "9012")] == [1, 1, 0]
    assert [rows[k]["NumAdditionalServices"] for k in ("1234", "5678", "9012")] == [1, 0, 0]
    assert rows["1234"]["MonthlyToTotalRatio"] == pytest.approx(50 / 600, abs=1e-3)
    assert "InternetService" not in df.columns and "OnlineSecurity" not in df.columns


def test_medians_of_the_sample(sample):
    medians = cleaning.median_values(sample, ["tenure", "MonthlyCharges", "gender"])
    assert medians == {"tenure": 12.0, "MonthlyCharges": 75.0}


@pytest.mark.parametrize(
    "text, number",
    [
        ("12.5", 12.5),
        (" 7 ", 7.0),
        ("-3e2", -300.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("1d", None),
        ("1,000", None),
        ("", None),
        (" ", None),
        ("NaN", None),
        ("x", None),
        (None, None),
    ],
)
def test_text_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "TotalCharges string")
    assert cleaning.coerce_total(df).first()["TotalCharges"] == number


@pytest.mark.parametrize(
    "monthly, tenure, total",
    [(10.0, 0, 0.0), (10.0, 3, 30.0), (None, 0, None), (10.0, None, None)],
)
def test_missing_totals(spark, monthly, tenure, total):
    df = spark.createDataFrame(
        [(None, monthly, tenure)], "TotalCharges double, MonthlyCharges double, tenure int"
    )
    assert cleaning.impute_total(df).first()["TotalCharges"] == total


@pytest.mark.parametrize(
    "monthly, total, tenure, ratio",
    [
        (50.0, 600.0, 12, 50 / 600.000001),
        (50.0, 0.0, 0, 1.0),
        (50.0, 10.0, 5, 1.0),
        (None, 10.0, 5, 0.0),
        (None, 10.0, 0, 1.0),
        (-5.0, 10.0, 5, -5 / 10.000001),
        (5.0, -1e-6, 5, 0.0),
    ],
)
def test_charge_ratio(spark, monthly, total, tenure, ratio):
    df = spark.createDataFrame(
        [(monthly, total, tenure)], "MonthlyCharges double, TotalCharges double, tenure int"
    )
    found = cleaning.with_charge_ratio(df).first()["MonthlyToTotalRatio"]
    assert found == pytest.approx(ratio)


def test_missing_internet_service_counts_as_present(spark):
    df = spark.createDataFrame([(None,), ("No",), ("DSL",)], "InternetService string")
    assert [r[0] for r in cleaning.with_internet_flag(df).collect()] == [1, 0, 1]


def test_caps(spark):
    df = spark.createDataFrame(
        zip([1, 2, 3, 4, 5, 100], [-50, 10, 20, 30, 40, 50]), "feature1 int, feature2 int"
    ).withColumn("text", F.lit("x"))
    columns = ["feature1", "feature2", "text", "absent"]
    assert cleaning.quantile_caps(df, columns)["feature1"] == pytest.approx((1.05, 95.25))
    capped = cleaning.cap_outliers(df, columns)
    row = capped.agg(F.max("feature1"), F.min("feature2")).first()
    assert row[0] < 100 and row[1] > -50


def test_caps_keep_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert [r["x"] is None for r in cleaning.apply_caps(df, {"x": (1.5, 2.5)}).collect()] == [
        False,
        True,
        False,
    ]


def test_missing_target_is_an_error(sample):
    features, rows = cleaning.split_features_target(sample)
    assert "Churn" not in features and "customerID" not in features
    assert rows.columns[0] == "customerID" and rows.columns[-1] == "Churn"
    with pytest.raises(ValueError, match="Churn"):
        cleaning.split_features_target(sample.drop("Churn"))


def test_quality_of_the_broken_sample(spark):
    df = spark.createDataFrame(
        [("1234", "Male", "invalid", 0), ("5678", None, "12", 5)],
        "customerID string, gender string, tenure string, SeniorCitizen int",
    )
    expected = ["customerID", "gender", "tenure", "SeniorCitizen", "MonthlyCharges"]
    found = quality.quality_report(df.withColumn("TechSupport", F.lit("Maybe")), expected)
    report = {(r["category"], r["column"]): (r["detail"], r["n"]) for r in found.collect()}
    assert report == {
        ("missing_columns", "MonthlyCharges"): ("absent", 2),
        ("missing_values", "gender"): ("null", 1),
        ("data_type_issues", "tenure"): ("should be numeric, is string", 2),
        ("data_type_issues", "SeniorCitizen"): ("should be categorical, is int", 2),
        ("value_issues", "SeniorCitizen"): ("not '0' or '1'", 1),
        ("value_issues", "TechSupport"): ("Maybe", 2),
    }


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert quality.null_counts(df).first()["n"] == 1


@pytest.mark.parametrize(
    "field, value, reason",
    [
        ("tenure", "invalid", "tenure: not a whole number"),
        ("tenure", "1.5", "tenure: not a whole number"),
        ("tenure", "-1", "tenure: negative"),
        ("tenure", "12", None),
        ("tenure", None, None),
        ("MonthlyCharges", "-10.0", "MonthlyCharges: negative"),
        ("MonthlyCharges", "abc", "MonthlyCharges: not a number"),
        ("TotalCharges", "0", None),
    ],
)
def test_row_checks(spark, field, value, reason):
    df = spark.createDataFrame([("a", value)], f"customerID string, {field} string")
    assert quality.check_rows(df).first()["reason"] == reason
    assert quality.valid_rows(df).count() + quality.rejected_rows(df).count() == 1


def test_csv_round_trip_keeps_blank_totals(spark, tmp_path):
    values = {c: "x" for c in ACCOUNT_COLUMNS} | {
        "SeniorCitizen": 1,
        "tenure": 0,
        "MonthlyCharges": 2.5,
        "TotalCharges": " ",
    }
    df = spark.createDataFrame([tuple(values[c] for c in ACCOUNT_COLUMNS)], ACCOUNT_SCHEMA)
    path = files.write_csv(df, str(tmp_path / "accounts"))
    assert files.scan_csv(spark, path).collect() == df.collect()


def test_missing_csv_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.scan_csv(spark, str(tmp_path / "nothing"))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "a")], "x double, y string")
    row = files.null_nans(df).first()
    assert row["x"] is None and row["y"] == "a" and not math.isnan(0.0)


def test_numbers_beyond_their_type_are_rejected(spark):
    rows = [("1e30", "0"), ("9223372036854775808", "0"), ("5", "3000000000"), ("5", "1")]
    df = spark.createDataFrame(rows, "tenure string, SeniorCitizen string")
    assert [tuple(r) for r in quality.valid_rows(df).collect()] == [(5, 1)]
    assert quality.rejected_rows(df).count() == 3
