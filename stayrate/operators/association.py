"""Correlations and significance tests, each from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.significance import chi_square_p_value, t_p_value
from stayrate.operators.segments import crosstab_margins

# The columns compared.
CORRELATED = (
    "Churn",
    "tenure",
    "MonthlyCharges",
    "TotalCharges",
    "SeniorCitizen",
    "Partner",
    "Dependents",
)


def _pearson(a: str, b: str) -> Column:
    """Correlation, NULL for a constant; ``corr`` fails on one under ANSI rules."""

    def spread(x: str, other: str) -> Column:
        return F.stddev_pop(F.when(F.col(other).isNotNull(), F.col(x)))

    if a == b:
        return F.when(F.stddev_pop(a) > 0, 1.0)
    return F.try_divide(F.covar_pop(a, b), spread(a, b) * spread(b, a))


def _pairwise(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each pair over rows where both are present."""
    names = {c: f"x{i}" for i, c in enumerate(dict.fromkeys(c for p in pairs for c in p))}
    numbers = df.select(
        *[
            F.nanvl(F.col(c).try_cast("double"), F.lit(None)).alias(x)
            for c, x in names.items()
        ]
    )
    row = numbers.agg(
        *[_pearson(names[a], names[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("a"),
                        F.lit(b).alias("b"),
                        F.col(f"r{i}").alias("correlation"),
                    )
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Rows ``(a, b, correlation)`` for every ordered pair and the diagonal."""
    upper = _pairwise(df, [(c, c) for c in columns] + list(combinations(columns, 2)))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return upper.select(
        F.explode(F.array_distinct(both)).alias("pair"), "correlation"
    ).select("pair.a", "pair.b", "correlation")


def label_correlation(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Correlation of each column with the label, strongest positive first."""
    return (
        _pairwise(df, [(c, label) for c in columns])
        .select(F.col("a").alias("feature"), "correlation")
        .orderBy(F.desc_nulls_last("correlation"), "feature")
    )


def t_test(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Pooled two-sample t-test of each column, positives against negatives."""
    positive = F.col(label) == 1
    negative = F.col(label) == 0
    stats = []
    for c in columns:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None))
        one, zero = F.when(positive, x), F.when(negative, x)
        stats.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(one).alias("n1"),
                F.count(zero).alias("n0"),
                F.avg(one).alias("mean_churned"),
                F.avg(zero).alias("mean_not_churned"),
                F.var_samp(one).alias("v1"),
                F.var_samp(zero).alias("v0"),
            ).alias(f"stat_{c}")
        )
    rows = df.agg(*stats).select(
        F.inline(F.array(*[F.col(f"stat_{c}") for c in columns]))
    )
    dof = (F.col("n1") + F.col("n0") - 2).cast("double")
    pooled = F.try_divide(
        (F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), dof
    )
    spread = F.sqrt(
        pooled
        * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n0")))
    )
    return (
        rows.withColumn("dof", dof)
        .withColumn(
            "t_statistic",
            F.try_divide(F.col("mean_churned") - F.col("mean_not_churned"), spread),
        )
        .select(
            "feature",
            "mean_churned",
            "mean_not_churned",
            "t_statistic",
            "dof",
            t_p_value("t_statistic", "dof").alias("p_value"),
        )
    )


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Independence test of two columns, Yates-corrected for a 2x2 table.

    Only observed cells are visited. The empty ones add their expected counts,
    which is what the observed cells leave of the total. In a 2x2 table all
    four gaps are equal, so the largest observed one stands for them.
    """
    table = crosstab_margins(df, row, column)
    cells = table.where("level = 0").select("r", "c", "n")
    by_row = table.where("level = 1").select("r", F.col("n").alias("row_n"))
    by_column = table.where("level = 2").select("c", F.col("n").alias("column_n"))

    def margin(totals: DataFrame, n: str):
        return totals.agg(
            F.struct(
                F.count("*").alias("size"),
                F.sum(n).alias("total"),
                F.sum(1 / F.col(n)).alias("inverse"),
            )
        ).scalar()

    expected = F.col("row_n") * F.col("column_n") / F.col("total")
    gap = F.abs(F.col("n") - F.col("e"))
    plain = F.col("squares") + F.greatest(F.col("total") - F.col("seen"), F.lit(0.0))
    yates = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    return (
        cells.join(by_row, "r")
        .join(by_column, "c")
        .withColumn("total", table.where("level = 3").select("n").scalar())
        .withColumn("e", expected)
        .agg(
            F.sum(gap * gap / F.col("e")).alias("squares"),
            F.sum("e").alias("seen"),
            F.max(gap).alias("gap"),
        )
        .withColumn("rows", margin(by_row, "row_n"))
        .withColumn("columns", margin(by_column, "column_n"))
        .withColumn("total", F.col("rows.total"))
        .select(
            F.when(
                (F.col("rows.size") == 2) & (F.col("columns.size") == 2),
                yates * yates * F.col("total") * F.col("rows.inverse") * F.col("columns.inverse"),
            )
            .otherwise(plain)
            .alias("chi2"),
            ((F.col("rows.size") - 1) * (F.col("columns.size") - 1))
            .cast("double")
            .alias("dof"),
        )
        .select("chi2", "dof", chi_square_p_value("chi2", "dof").alias("p_value"))
    )
