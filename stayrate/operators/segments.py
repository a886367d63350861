"""Counts, shares and churn rates by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.functions.cleaning import is_yes
from stayrate.schema import ADDONS, LABEL, SERVICES
from stayrate.session import settle

# Tenure bands as (label, above, up to), in months.
TENURE_BANDS = (
    ("0-12", 0, 12),
    ("13-24", 12, 24),
    ("25-48", 24, 48),
    ("49-72", 48, 72),
)
#: Add-ons compared among internet users.
IMPACT_SERVICES = ADDONS[:4]


def _churned() -> Column:
    return is_yes(F.col(LABEL))


def churn_kpis(df: DataFrame) -> DataFrame:
    """One row of headline figures; no row for an empty table."""
    return (
        df.agg(
            F.count("*").alias("total_customers"),
            F.sum(_churned()).alias("churned_customers"),
            F.avg("tenure").alias("avg_tenure"),
            F.avg("MonthlyCharges").alias("avg_monthly_charges"),
        )
        .where("total_customers > 0")
        .select(
            "total_customers",
            "churned_customers",
            (F.col("churned_customers") / F.col("total_customers") * 100).alias("churn_rate"),
            "avg_tenure",
            "avg_monthly_charges",
        )
    )


def churn_by_contract(df: DataFrame, key: str = "Contract") -> DataFrame:
    """Total, churned and rate per contract, accounts without one included."""
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("total"), F.sum(_churned()).alias("churned"))
        .withColumn("rate", F.col("churned") / F.col("total") * 100)
    )


def churn_rate_by(df: DataFrame, key: str) -> DataFrame:
    """Percent churned per value of ``key``; rows without a value are left out."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg((F.avg(_churned()) * 100).alias("churn_rate"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per non-null value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share per non-null value, most frequent first.

    Counts and their total come from one aggregate, which is written: a row per value.
    """
    known = df.where(F.col(column).isNotNull())
    counts = settle(
        known.cube(column).agg(F.count("*").alias("n"), F.grouping(column).alias("all"))
    )
    total = counts.where(F.col("all") == 1).select("n").scalar()
    return (
        counts.where(F.col("all") == 0)
        .select(column, (F.col("n") / total).alias("share"))
        .orderBy(F.desc("share"), column)
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def label_share_pivot(
    df: DataFrame, key: str, label: str = LABEL, values: Sequence[str] = ("No", "Yes")
) -> DataFrame:
    """Per group, the share of each label value as a column."""
    known = F.col(key).isNotNull() & F.col(label).isNotNull()
    return (
        df.where(known)
        .groupBy(key)
        .agg(*[F.avg((F.col(label) == v).cast("int")).alias(v) for v in values])
    )


def crosstab_margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Two-way counts ``r``, ``c``, ``n`` with the totals of rows, columns and all.

    One aggregate over the rows gives them all and is written. ``level`` is 0 for a
    cell, 1 for a row's total, 2 for a column's and 3 for the whole.
    """
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    pairs = known.select(F.col(row).alias("r"), F.col(column).alias("c"))
    return settle(
        pairs.cube("r", "c").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    )


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Two-way counts in long form; rows lacking either value are left out."""
    return (
        df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row, column)
        .agg(F.count("*").alias("n"))
    )


def churned_retained(df: DataFrame, key: str) -> DataFrame:
    """Churned and retained counts per group; 0 where nobody churned."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.sum(_churned()).alias("churned"),
            F.sum(1 - _churned()).alias("retained"),
        )
    )


def tenure_band(tenure: Column) -> Column:
    """Band label; NULL at 0, above the last band and for missing tenure."""
    band = F.lit(None).cast("string")
    for label, above, upto in TENURE_BANDS:
        band = F.when((tenure > above) & (tenure <= upto), label).otherwise(band)
    return band


def _per_band(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Average per band; every band is listed, with NULL where it is empty."""
    bands = df.sparkSession.createDataFrame([(b[0],) for b in TENURE_BANDS], "band string")
    measured = (
        df.select(tenure_band(F.col("tenure")).alias("band"), value.alias("value"))
        .where("band IS NOT NULL")
        .groupBy("band")
        .agg(F.avg("value").alias(name))
    )
    return bands.join(measured, "band", "left")


def churn_by_tenure_band(df: DataFrame) -> DataFrame:
    return _per_band(df, _churned() * 100, "churn_rate")


def charges_by_tenure_band(df: DataFrame) -> DataFrame:
    return _per_band(df, F.col("MonthlyCharges"), "avg_monthly_charges")


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(service, value, churned)``, one per account and service."""
    return df.select(_churned().alias("churned"), *columns).unpivot(
        ["churned"], list(columns), "service", "value"
    )


def churn_by_service(df: DataFrame, services: Sequence[str] = SERVICES) -> DataFrame:
    """Percent churned per service and value, all services in one pass."""
    return (
        _long(df, services)
        .where("value IS NOT NULL")
        .groupBy("service", "value")
        .agg((F.avg("churned") * 100).alias("churn_rate"))
    )


def internet_users(df: DataFrame) -> DataFrame:
    """Accounts whose internet service is not 'No'; a missing one counts."""
    return df.where(~F.col("InternetService").eqNullSafe("No"))


def service_impact(df: DataFrame, services: Sequence[str] = IMPACT_SERVICES) -> DataFrame:
    """Among internet users, percent churned with and without each service."""

    def rate(answer: str) -> Column:
        return F.avg(F.when(F.col("value") == answer, F.col("churned"))) * 100

    return (
        _long(internet_users(df), services)
        .groupBy("service")
        .agg(rate("Yes").alias("has_service"), rate("No").alias("no_service"))
    )


def class_balance(df: DataFrame) -> DataFrame:
    """Class counts and the weight that balances positives, 1 if there are none."""
    return df.agg(
        F.sum(1 - _churned()).alias("negatives"), F.sum(_churned()).alias("positives")
    ).withColumn(
        "positive_weight",
        F.coalesce(F.try_divide(F.col("negatives"), F.col("positives")), F.lit(1.0)),
    )


def survival_curve(df: DataFrame) -> DataFrame:
    """Per month t, the share not churned among accounts with tenure >= t.

    Rows collapse to one per month of tenure before the running sums, which
    therefore see as many rows as there are months.
    """
    months = (
        df.where("tenure IS NOT NULL")
        .groupBy("tenure")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col(LABEL) == "No").alias("kept"),
        )
    )
    axis = (
        months.agg(F.max("tenure").alias("last"))
        .where("last >= 1")
        .select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last"))).alias("t"))
    )
    later = Window.orderBy("t").rowsBetween(
        Window.currentRow, Window.unboundedFollowing
    )
    return (
        axis.join(months, F.col("t") == F.col("tenure"), "left")
        .select(
            "t",
            F.sum(F.coalesce("kept", F.lit(0))).over(later).alias("retained"),
            F.sum(F.coalesce("n", F.lit(0))).over(later).alias("total"),
        )
        .withColumn(
            "survival_rate",
            F.coalesce(F.try_divide(F.col("retained"), F.col("total")), F.lit(0.0)),
        )
    )


def trend_line(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line through points, each weighing the same."""
    return points.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def sorted_segments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Groups by their mean value, highest first."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(value).alias(f"avg_{value}"))
        .orderBy(F.desc(f"avg_{value}"), key)
    )


def head_rows(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows by key; Spark tables have no order of their own."""
    return df.orderBy(key).limit(n)
