"""Fitted preprocessing: exact imputation and scaling, one-hot, vector assembly.

Fitted statistics become literals of a ``SQLTransformer``, so a fitted
preparation is made of Spark's own stages and saves and loads with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.operators.order_stats import quantiles
from stayrate.schema import KEY, LABEL, STAMPS

SIDE_COLUMNS = (KEY, LABEL, "label", "fold", "weight", "copy", "is_test", *STAMPS)


def feature_types(
    df: DataFrame, exclude: Sequence[str] = SIDE_COLUMNS
) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names by type.

    The senior flag is categorical whatever its type; each column appears once.
    """
    numeric, categorical = [], []
    for field in df.schema:
        if field.name in exclude:
            continue
        if field.name == "SeniorCitizen" or isinstance(field.dataType, T.StringType):
            categorical.append(field.name)
        elif isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
    return numeric, categorical


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; 0 for a column without values."""
    found = quantiles(df, {c: F.col(c) for c in columns}, [0.5])
    return {c: 0.0 if v[0] is None else v[0] for c, v in found.items()}


def _filled(column: str, value: float):
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None)), F.lit(value))


def fit_scales(
    df: DataFrame, columns: Sequence[str], fill: dict[str, float] | None = None
) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, after filling."""
    if not columns:
        return {}
    exprs = {
        c: _filled(c, fill[c]) if fill else F.col(c).cast("double") for c in columns
    }
    row = df.agg(
        *[F.avg(e).alias(f"m_{c}") for c, e in exprs.items()],
        *[F.stddev_pop(e).alias(f"s_{c}") for c, e in exprs.items()],
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, value, n)`` over the non-null values."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        text.unpivot([], list(columns), "column", "value")
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties.

    Counts are grouped before the per-column pick, so no column's values meet
    in one place.
    """
    if not columns:
        return {}
    rows = (
        category_counts(df, columns)
        .groupBy("column")
        .agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        )
        .collect()
    )
    modes = {r["column"]: r["mode"] for r in rows}
    return {c: modes.get(c, "missing") for c in columns}


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    medians = fit_medians(df, columns)
    return df.withColumns({c: _filled(c, m) for c, m in medians.items()})


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; constant columns become 0."""
    scales = fit_scales(df, columns)
    return df.withColumns(
        {c: (F.col(c) - m) / (s if s > 0 else 1.0) for c, (m, s) in scales.items()}
    )


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = fit_modes(df, columns)
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in modes.items()}
    )


def fit_one_hot(df: DataFrame, columns: Sequence[str], prefix: str = "") -> PipelineModel:
    """Encoder of ``prefix + column`` into vectors ``cat__column``.

    Categories are in alphabetical order and none is left out; the indexer's
    slot for unseen values is the one the encoder drops, so these are all zeros.
    The driver holds every category of the columns, as the fitted model does.
    """
    indexer = StringIndexer(
        inputCols=[f"{prefix}{c}" for c in columns],
        outputCols=[f"idx__{c}" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(df)
    encoder = OneHotEncoder(
        inputCols=[f"idx__{c}" for c in columns],
        outputCols=[f"cat__{c}" for c in columns],
        dropLast=True,
    ).fit(indexer.transform(df.limit(0)))
    return PipelineModel([indexer, encoder])


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preparation(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    output: str = "features",
) -> PipelineModel:
    """Fit median and mode filling, scaling, one-hot and assembly on ``df``.

    The vector holds the numeric block, then the categorical block, with names
    in its metadata.
    """
    found_numeric, found_categorical = feature_types(df)
    numeric = list(found_numeric if numeric is None else numeric)
    categorical = list(found_categorical if categorical is None else categorical)
    # Each statistic is a pass; the columns they need are kept meanwhile.
    kept = df.select(*numeric, *categorical).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel(_fit_stages(kept, numeric, categorical, output))
    finally:
        kept.unpersist()


def _fit_stages(
    df: DataFrame, numeric: list[str], categorical: list[str], output: str
) -> list:
    medians = fit_medians(df, numeric)
    scales = fit_scales(df, numeric, medians)
    modes = fit_modes(df, categorical)

    derived = []
    for c in numeric:
        mean, std = scales[c]
        filled = f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), NULL), {medians[c]!r}D)"
        derived.append(f"({filled} - {mean!r}D) / {(std or 1.0)!r}D AS `num__{c}`")
    for c in categorical:
        derived.append(f"coalesce(CAST(`{c}` AS STRING), {_text(modes[c])}) AS `fill__{c}`")
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(derived)} FROM __THIS__")

    stages = [fill]
    blocks = [f"num__{c}" for c in numeric]
    scratch = list(blocks)
    if categorical:
        stages += fit_one_hot(fill.transform(df), categorical, "fill__").stages
        blocks += [f"cat__{c}" for c in categorical]
        scratch += [f"{p}__{c}" for p in ("fill", "idx", "cat") for c in categorical]
    stages.append(VectorAssembler(inputCols=blocks, outputCol=output))
    dropped = ", ".join(f"`{c}`" for c in scratch)
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}) FROM __THIS__"))
    return stages


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of a vector column's entries, from its metadata."""
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]
    entries = [a for group in attributes.values() for a in group]
    return [a["name"] for a in sorted(entries, key=lambda a: a["idx"])]
