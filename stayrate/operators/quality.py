"""Data quality: a report over whole tables, and typed accept/reject splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.functions.cleaning import NUMBER_PATTERN, text_to_number
from stayrate.schema import (
    ACCOUNT_COLUMNS,
    ADDONS,
    CATEGORICAL,
    NUMERIC,
    SENIOR_DOMAIN,
    SERVICE_DOMAIN,
)

NUMERIC_EXPECTED = (*NUMERIC, "MonthlyToTotalRatio", "NumAdditionalServices")
CATEGORICAL_EXPECTED = (*CATEGORICAL, "HasInternetService")
DOMAIN_CHECKED = ("MultipleLines", *ADDONS)


def _report(df: DataFrame, checks: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """Rows ``(category, column, detail, n)`` with n > 0, from one aggregate."""
    entries = [
        F.struct(
            F.lit(category).alias("category"),
            F.lit(column).alias("column"),
            F.lit(detail).alias("detail"),
            F.col(f"n{i}").alias("n"),
        )
        for i, (category, column, detail, _) in enumerate(checks)
    ]
    if not entries:
        return df.sparkSession.createDataFrame(
            [], "category string, column string, detail string, n bigint"
        )
    return (
        df.agg(*[c.alias(f"n{i}") for i, (*_, c) in enumerate(checks)])
        .select(F.inline(F.array(*entries)))
        .where("n > 0")
    )


def _missing_columns(df: DataFrame, expected: Sequence[str]):
    return [
        ("missing_columns", c, "absent", F.count(F.lit(1)))
        for c in expected
        if c not in df.columns
    ]


def _null_counts(df: DataFrame):
    checks = []
    for field in df.schema:
        gone = F.col(field.name).isNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            gone = gone | F.isnan(field.name)
        checks.append(("missing_values", field.name, "null", F.count_if(gone)))
    return checks


def _types(df: DataFrame):
    checks = []
    for names, right, wanted in (
        (NUMERIC_EXPECTED, T.NumericType, "numeric"),
        (CATEGORICAL_EXPECTED, T.StringType, "categorical"),
    ):
        for c in names:
            if c in df.columns and not isinstance(df.schema[c].dataType, right):
                found = df.schema[c].dataType.simpleString()
                checks.append(
                    (
                        "data_type_issues",
                        c,
                        f"should be {wanted}, is {found}",
                        F.count(F.lit(1)),
                    )
                )
    return checks


def _senior_domain(df: DataFrame):
    if "SeniorCitizen" not in df.columns:
        return []
    valid = F.col("SeniorCitizen").cast("string").isin(*SENIOR_DOMAIN)
    bad = F.count_if(~F.coalesce(valid, F.lit(False)))
    return [("value_issues", "SeniorCitizen", "not '0' or '1'", bad)]


def missing_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected columns that are absent, with the number of rows lacking them."""
    return _report(df, _missing_columns(df, expected))


def null_counts(df: DataFrame) -> DataFrame:
    """Columns holding nulls (or NaN) and how many."""
    return _report(df, _null_counts(df))


def type_issues(df: DataFrame) -> DataFrame:
    """Columns whose type is not the expected kind."""
    return _report(df, _types(df))


def senior_domain(df: DataFrame) -> DataFrame:
    """Count of senior flags outside the domain; NULL counts as outside."""
    return _report(df, _senior_domain(df))


def service_domain(df: DataFrame, columns: Sequence[str] = DOMAIN_CHECKED) -> DataFrame:
    """Unexpected service values, each with its count.

    Values are free text, so they are grouped rather than gathered.
    """
    present = [c for c in columns if c in df.columns]
    bad = [F.when(~F.col(c).isin(*SERVICE_DOMAIN), F.col(c)).alias(c) for c in present]
    return (
        df.select(*bad)
        .where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in present]))
        .unpivot([], present, "column", "detail")
        .where(F.col("detail").isNotNull())
        .groupBy("column", "detail")
        .agg(F.count("*").alias("n"))
        .select(F.lit("value_issues").alias("category"), "column", "detail", "n")
    )


def quality_report(df: DataFrame, expected: Sequence[str] = ACCOUNT_COLUMNS) -> DataFrame:
    """Every check as rows ``(category, column, detail, n)``."""
    checks = (
        _missing_columns(df, expected) + _null_counts(df) + _types(df) + _senior_domain(df)
    )
    return _report(df, checks).unionByName(service_domain(df))


# --- typed rows -----------------------------------------------------------

#: Whole numbers with the limits of their declared types; as doubles, the upper
#: limit of a long is the first number beyond it.
_WHOLE = {"SeniorCitizen": ("int", -(2.0**31), 2.0**31), "tenure": ("long", -(2.0**63), 2.0**63)}
_FRACTION = ("MonthlyCharges", "TotalCharges")
_NOT_NEGATIVE = ("tenure", "MonthlyCharges", "TotalCharges")


def _number(column: str) -> Column:
    return text_to_number(F.col(column))


def rejection_reason(columns: Sequence[str]) -> Column:
    """First reason a row of text fields is unacceptable, or NULL.

    Fields are optional; those given must have the declared type and fit it, and
    tenure and charges must not be negative.
    """
    reasons = []
    for c in columns:
        given = F.col(c).isNotNull()
        if c in _WHOLE:
            _, low, high = _WHOLE[c]
            fits = (_number(c) >= low) & (_number(c) < high)
            whole = F.trim(c).rlike(NUMBER_PATTERN) & (_number(c) % 1 == 0) & fits
            reasons.append(
                F.when(given & ~F.coalesce(whole, F.lit(False)), f"{c}: not a whole number")
            )
        if c in _FRACTION:
            reasons.append(F.when(given & _number(c).isNull(), f"{c}: not a number"))
        if c in _NOT_NEGATIVE:
            reasons.append(F.when(_number(c) < 0, f"{c}: negative"))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def check_rows(df: DataFrame) -> DataFrame:
    """Text rows with the column ``reason``, NULL where a row is acceptable."""
    return df.withColumn("reason", rejection_reason(df.columns))


def typed_rows(df: DataFrame) -> DataFrame:
    """Cast acceptable text rows to the declared types; what does not fit becomes NULL."""
    casts = {c: _number(c).try_cast(kind) for c, (kind, _, _) in _WHOLE.items()}
    casts |= {c: _number(c) for c in _FRACTION}
    return df.withColumns({c: e for c, e in casts.items() if c in df.columns})


def valid_rows(df: DataFrame) -> DataFrame:
    """Acceptable rows with declared types."""
    return typed_rows(check_rows(df).where("reason IS NULL").drop("reason"))


def rejected_rows(df: DataFrame) -> DataFrame:
    """Rows turned away, as given, with the reason."""
    return check_rows(df).where("reason IS NOT NULL")

