"""Cleaning, derived features, outlier caps and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.functions import cleaning as X
from stayrate.operators.order_stats import quantiles
from stayrate.schema import ADDONS, KEY, LABEL, STAMPS, require_columns

#: Columns turned into 0/1 for correlations, with the value that becomes 1.
# Fixed values.
BINARY_RECODES = {
    "Churn": "Yes",
    "gender": "Male",
    "Partner": "Yes",
    "Dependents": "Yes",
    "PhoneService": "Yes",
    "PaperlessBilling": "Yes",
}


def coerce_total(df: DataFrame) -> DataFrame:
    """``TotalCharges`` as a number; blanks and malformed text become NULL."""
    c = F.col("TotalCharges")
    if isinstance(df.schema["TotalCharges"].dataType, T.StringType):
        return df.withColumn("TotalCharges", X.text_to_number(c))
    return df.withColumn("TotalCharges", c.cast("double"))


def impute_total(df: DataFrame) -> DataFrame:
    """Fill missing numeric ``TotalCharges`` from monthly charges and tenure."""
    return df.withColumn(
        "TotalCharges",
        X.imputed_total(F.col("TotalCharges"), F.col("MonthlyCharges"), F.col("tenure")),
    )


def senior_to_string(df: DataFrame) -> DataFrame:
    return df.withColumn("SeniorCitizen", X.flag_to_string(F.col("SeniorCitizen")))


def clean_accounts(df: DataFrame) -> DataFrame:
    """Numeric, imputed totals and a textual senior flag; absent columns skipped."""
    if "TotalCharges" in df.columns:
        df = impute_total(coerce_total(df))
    if "SeniorCitizen" in df.columns:
        df = senior_to_string(df)
    return df


def with_charge_ratio(df: DataFrame) -> DataFrame:
    if not {"MonthlyCharges", "TotalCharges"} <= set(df.columns):
        return df
    return df.withColumn(
        "MonthlyToTotalRatio",
        X.charge_ratio(F.col("MonthlyCharges"), F.col("TotalCharges"), F.col("tenure")),
    )


def with_addon_count(df: DataFrame) -> DataFrame:
    """Replace the add-on columns present by how many of them are 'Yes'."""
    present = [c for c in ADDONS if c in df.columns]
    if not present:
        return df
    return df.withColumn("NumAdditionalServices", X.count_yes(present)).drop(*present)


def with_internet_flag(df: DataFrame) -> DataFrame:
    """Replace ``InternetService`` by a 0/1 flag."""
    if "InternetService" not in df.columns:
        return df
    return df.withColumn(
        "HasInternetService", X.internet_flag(F.col("InternetService"))
    ).drop("InternetService")


def derive_features(df: DataFrame) -> DataFrame:
    """All derived features of cleaned accounts; source columns are dropped."""
    return with_internet_flag(with_addon_count(with_charge_ratio(df)))


def is_numeric(df: DataFrame, column: str) -> bool:
    return column in df.columns and isinstance(
        df.schema[column].dataType, T.NumericType
    )


def quantile_caps(
    df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99
) -> dict[str, tuple[float, float]]:
    """Cap per numeric column present; fit these on the training part only."""
    chosen = {c: F.col(c) for c in columns if is_numeric(df, c)}
    found = quantiles(df, chosen, [lower, upper])
    return {c: (lo, hi) for c, (lo, hi) in found.items() if lo is not None}


def apply_caps(df: DataFrame, caps: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip columns to their caps, NULL kept."""
    return df.withColumns(
        {
            c: F.when(
                F.col(c).isNotNull(),
                F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).cast("double"))),
            )
            for c, (lo, hi) in caps.items()
        }
    )


def cap_outliers(
    df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99
) -> DataFrame:
    """Clip numeric columns to their own quantiles."""
    return apply_caps(df, quantile_caps(df, columns, lower, upper))


def median_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of the numeric columns present."""
    chosen = {c: F.col(c) for c in columns if is_numeric(df, c)}
    return {c: v[0] for c, v in quantiles(df, chosen, [0.5]).items()}


def split_features_target(
    df: DataFrame, target: str = LABEL, key: str = KEY
) -> tuple[list[str], DataFrame]:
    """Feature names, and the rows with the key kept beside them as a side column.

    Spark keeps rows whole, so features and target stay in one frame.
    """
    require_columns(df, target)
    features = [c for c in df.columns if c not in (key, target)]
    side = [key] if key in df.columns else []
    return features, df.select(*side, *features, target)


def binary_label(df: DataFrame, column: str = LABEL, name: str = "label") -> DataFrame:
    return df.withColumn(name, X.is_yes(F.col(column)))


def recode_binary(df: DataFrame, recodes: Mapping[str, str] | None = None) -> DataFrame:
    """Two-valued text columns as 0/1."""
    recodes = BINARY_RECODES if recodes is None else recodes
    return df.withColumns(
        {
            c: F.col(c).eqNullSafe(one).cast("int")
            for c, one in recodes.items()
            if c in df.columns
        }
    )


def drop_nonfeatures(df: DataFrame, extra: Sequence[str] = (LABEL,)) -> DataFrame:
    """Without stamps and label, ready for scoring."""
    return df.drop(*STAMPS, *extra)


def retype_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as text, so they count as categorical."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
