"""Account table schema and column roles."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "customerID"
LABEL = "Churn"
STAMPS = ("created_at", "updated_at")

# The account table's columns, roles and value domains.
ADDONS = (
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
)
NUMERIC = ("tenure", "MonthlyCharges", "TotalCharges")
CATEGORICAL = (
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    *ADDONS,
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
)
DERIVED = ("MonthlyToTotalRatio", "NumAdditionalServices", "HasInternetService")
SERVICES = ("PhoneService", "InternetService", *ADDONS)
SERVICE_DOMAIN = ("Yes", "No", "No phone service", "No internet service")
SENIOR_DOMAIN = ("0", "1")

ACCOUNT_COLUMNS = (
    KEY,
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "tenure",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    *ADDONS,
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
    "MonthlyCharges",
    "TotalCharges",
    LABEL,
)

_TYPES = {
    "SeniorCitizen": T.IntegerType(),
    "tenure": T.LongType(),
    "MonthlyCharges": T.DoubleType(),
}

#: Raw accounts: ``TotalCharges`` is text because source files hold blanks in it.
ACCOUNT_SCHEMA = T.StructType(
    [T.StructField(c, _TYPES.get(c, T.StringType()), True) for c in ACCOUNT_COLUMNS]
)

#: Every column as text, for rows whose types are still to be checked.
TEXT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in ACCOUNT_COLUMNS]
)

#: Columns expected after cleaning, and after the derived features replaced
#: their source columns.
CLEAN_COLUMNS = ACCOUNT_COLUMNS
FEATURE_COLUMNS = tuple(
    c for c in ACCOUNT_COLUMNS if c not in ADDONS and c != "InternetService"
) + DERIVED


def require_columns(df, *columns: str) -> None:
    """Raise ``ValueError`` naming the columns ``df`` lacks."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {', '.join(absent)}")
