"""Column expressions over churn probabilities and account attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band floors and names, limits, reasons and actions users see.
RISK_BANDS = ((0.8, "Very High"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low"))
LOWEST_BAND = "Very Low"
HIGH_CHARGE = 70
NEW_ACCOUNT_MONTHS = 6
EARLY_MONTHS = 12
LOW_RISK = 0.3
PRIORITY_RISK = 0.7
REASONS = {
    "contract": "Month-to-month contract (higher churn risk)",
    "tenure": ("New customer (tenure: ", " months)"),
    "payment": "Electronic check payment (associated with higher churn)",
    "security": "No online security service",
    "support": "No tech support service",
    "charges": "High monthly charges ($%.2f)",
}
ACTIONS = {
    "low": "Low risk - maintain regular engagement",
    "contract": "Offer incentive to switch to annual contract",
    "tenure": "Implement new customer retention program",
    "services": "Bundle additional services with discount",
    "charges": "Review pricing and offer competitive rate",
    "priority": "Priority intervention - personal outreach recommended",
}

# Weights of the constant scorecard, a stand-in for a fitted model.
SCORECARD_INTERCEPT = -1.0
SCORECARD_WEIGHTS = {
    "tenure": -0.03,
    "MonthlyCharges": 0.012,
    "MonthlyToTotalRatio": 0.4,
    "NumAdditionalServices": -0.15,
    "HasInternetService": 0.6,
}
SCORECARD_LEVELS = {
    ("Contract", "Month-to-month"): 1.1,
    ("Contract", "Two year"): -0.8,
    ("PaymentMethod", "Electronic check"): 0.5,
    ("SeniorCitizen", "1"): 0.2,
}


def scorecard_probability() -> Column:
    """Logistic score with constant weights on prepared columns; NULL counts as 0."""
    z = F.lit(SCORECARD_INTERCEPT)
    for column, weight in SCORECARD_WEIGHTS.items():
        z = z + F.lit(weight) * F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    for (column, level), weight in SCORECARD_LEVELS.items():
        z = z + F.when(F.col(column) == level, weight).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-z))


def risk_band(p: Column) -> Column:
    """Name of the band a probability falls in, each closed at its floor."""
    band = F.lit(LOWEST_BAND)
    for floor, name in reversed(RISK_BANDS):
        band = F.when(p >= floor, name).otherwise(band)
    return band


def predicted_label(p: Column) -> Column:
    """'Yes' above one half; a tie gives 'No'."""
    return F.when(p > 0.5, "Yes").otherwise("No")


def confidence(p: Column) -> Column:
    """Probability of the likelier class."""
    return F.greatest(p, 1 - p)


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def churn_factors() -> Column:
    """Ordered ``array<string>`` of reasons an account is at risk.

    Missing tenure and charges count as 0, a missing internet service as one.
    """
    tenure = _or_zero("tenure")
    served = ~F.col("InternetService").eqNullSafe("No")
    before, after = REASONS["tenure"]
    # ``rint`` settles half cents to the even cent before formatting.
    charge = F.rint(F.col("MonthlyCharges").cast("double") * 100) / 100
    reasons = [
        (F.col("Contract") == "Month-to-month", F.lit(REASONS["contract"])),
        (
            tenure < NEW_ACCOUNT_MONTHS,
            F.concat(F.lit(before), tenure.cast("string"), F.lit(after)),
        ),
        (F.col("PaymentMethod") == "Electronic check", F.lit(REASONS["payment"])),
        (served & (F.col("OnlineSecurity") == "No"), F.lit(REASONS["security"])),
        (served & (F.col("TechSupport") == "No"), F.lit(REASONS["support"])),
        (
            _or_zero("MonthlyCharges") > HIGH_CHARGE,
            F.format_string(REASONS["charges"], charge),
        ),
    ]
    return F.array_compact(F.array(*[F.when(test, text) for test, text in reasons]))


def retention_actions(p: Column) -> Column:
    """Ordered ``array<string>`` of suggested actions for a probability ``p``."""
    bare = [F.col(c).eqNullSafe("No") for c in ("OnlineSecurity", "TechSupport")]
    tests = {
        "contract": F.col("Contract") == "Month-to-month",
        "tenure": _or_zero("tenure") < EARLY_MONTHS,
        "services": bare[0] | bare[1],
        "charges": _or_zero("MonthlyCharges") > HIGH_CHARGE,
        "priority": p > PRIORITY_RISK,
    }
    chosen = F.array(*[F.when(test, ACTIONS[name]) for name, test in tests.items()])
    return F.when(p < LOW_RISK, F.array(F.lit(ACTIONS["low"]))).otherwise(
        F.array_compact(chosen)
    )
