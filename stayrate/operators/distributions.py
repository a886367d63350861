"""Histograms, densities, quartiles and summaries of numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.cleaning import is_yes
from stayrate.operators.order_stats import GATHER_LIMIT, quantiles
from stayrate.operators.skew import sized
from stayrate.schema import LABEL

WHISKER = 1.5


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin, the last one closed above."""
    place = F.floor((x - low) / ((high - low) / bins))
    return F.greatest(F.lit(0), F.least(place, F.lit(bins - 1))).cast("int")


def _edges(low: str, high: str) -> tuple[Column, Column]:
    """Range widened by one half each side when it has no width."""
    flat = F.col(low) == F.col(high)
    return (
        F.when(flat, F.col(low) - 0.5).otherwise(F.col(low)),
        F.when(flat, F.col(high) + 0.5).otherwise(F.col(high)),
    )


def _histogram(rows: DataFrame, ranges: DataFrame, by: str, bins: int) -> DataFrame:
    """Counts per group and bin for rows ``(by, x)`` and ranges ``(by, low, high)``.

    ``ranges`` has one row per group and travels to the rows. Empty bins are
    listed with 0.
    """
    low, high = _edges("low", "high")
    ranges = sized(ranges.select(by, low.alias("low"), high.alias("high")))
    counted = (
        rows.join(ranges, by)
        .groupBy(by, _bin(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    width = (F.col("high") - F.col("low")) / bins
    frame = ranges.select(
        by,
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.col("low"),
        width.alias("width"),
    )
    return frame.join(counted, [by, "bin"], "left").select(
        by,
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def _values(df: DataFrame, column: str, by: str) -> DataFrame:
    x = F.nanvl(F.col(column).cast("double"), F.lit(None))
    return df.select(by, x.alias("x")).where(
        F.col("x").isNotNull() & F.col(by).isNotNull()
    )


def _range_by(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.min("x").alias("low"), F.max("x").alias("high"))


def histogram_by_class(
    df: DataFrame, column: str, by: str = LABEL, bins: int = 30
) -> DataFrame:
    """Equal-width bins per class, each class over its own range."""
    rows = _values(df, column, by)
    return _histogram(rows, _range_by(rows, by), by, bins)


def histogram_shared(
    df: DataFrame, column: str, by: str = LABEL, bins: int = 20
) -> DataFrame:
    """Equal-width bins over the joint range of all classes."""
    rows = _values(df, column, by)
    per_class = _range_by(rows, by)
    whole = per_class.agg(F.struct(F.min("low").alias("low"), F.max("high").alias("high")))
    ranges = (
        per_class.select(by)
        .withColumn("whole", whole.scalar())
        .select(by, "whole.low", "whole.high")
    )
    return _histogram(rows, ranges, by, bins)


def histogram_density(
    df: DataFrame, column: str, by: str, bins: int = 30
) -> DataFrame:
    """Histogram per group scaled to unit area."""
    counts = histogram_by_class(df, column, by, bins)
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).select(
        by,
        "bin",
        "bin_start",
        "bin_end",
        (F.col("n") / (F.col("total") * (F.col("bin_end") - F.col("bin_start")))).alias(
            "density"
        ),
    )


def kde(df: DataFrame, column: str, by: str, points: int = 200) -> DataFrame:
    """Gaussian density per group on an even grid over the group's range.

    Scott's bandwidth. Every grid point is a sum of the aggregate, so a row stays
    one row and only the sums are shuffled.
    """
    rows = _values(df, column, by)
    bandwidth = F.stddev_samp("x") * F.pow(F.count("*").cast("double"), F.lit(-0.2))
    shape = sized(
        rows.groupBy(by)
        .agg(
            F.count("*").alias("total"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            bandwidth.alias("h"),
        )
        .where("h > 0")
    )
    # Place of the row and distance of two points of the grid, in bandwidths.
    place = (F.col("x") - F.col("low")) / F.col("h")
    step = (F.col("high") - F.col("low")) / (points - 1)
    scaled = rows.join(shape, by).select(
        by, "total", "low", "h", place.alias("place"), (step / F.col("h")).alias("step")
    )

    def bump(i: int) -> Column:
        gap = F.col("step") * i - F.col("place")
        return F.sum(F.exp(gap * gap * -0.5)).alias(f"s{i}")

    shape_columns = ("total", "low", "h", "step")
    sums = scaled.groupBy(by).agg(
        *[F.first(c).alias(c) for c in shape_columns], *[bump(i) for i in range(points)]
    )
    scale = F.col("total") * F.col("h") * math.sqrt(2 * math.pi)
    listed = F.array(*[F.col(f"s{i}") for i in range(points)])
    return sums.select(
        by, *shape_columns, F.posexplode(listed).alias("point", "mass")
    ).select(
        by,
        "point",
        (F.col("low") + F.col("point") * F.col("step") * F.col("h")).alias("grid"),
        (F.col("mass") / scale).alias("density"),
    )


def box_stats(
    df: DataFrame, column: str, by: str = LABEL, classes: Sequence[str] = ("No", "Yes")
) -> DataFrame:
    """Quartiles, whiskers at the extreme points inside the fences, outliers."""
    x = F.col(column).cast("double")
    found = quantiles(
        df, {c: F.when(F.col(by) == c, x) for c in classes}, [0.25, 0.5, 0.75]
    )
    boxes = [(c, *q) for c, q in found.items() if q[0] is not None]
    fences = df.sparkSession.createDataFrame(
        boxes, f"`{by}` string, q1 double, median double, q3 double"
    )
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    in_fence = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        _values(df, column, by)
        .join(F.broadcast(fences), by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min(F.when(in_fence, F.col("x"))).alias("whisker_low"),
            F.max(F.when(in_fence, F.col("x"))).alias("whisker_high"),
            F.count_if(~in_fence).alias("outliers"),
        )
    )


def churn_by_quantile_bin(
    df: DataFrame, column: str, q: int = 5, gather_limit: int = GATHER_LIMIT
) -> DataFrame:
    """Percent churned per quantile bin, right-closed, the lowest edge included.

    Equal edges are merged, so fewer than ``q`` bins may come out.
    """
    probs = [i / q for i in range(q + 1)]
    found = quantiles(df, {column: F.col(column)}, probs, gather_limit)[column]
    edges = sorted({e for e in found if e is not None})
    x = F.col(column).cast("double")
    place = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        place = F.when(x <= edges[i], i).otherwise(place)
    ends = df.sparkSession.createDataFrame(
        [(i, edges[i - 1], edges[i]) for i in range(1, len(edges))],
        "bin int, bin_start double, bin_end double",
    )
    rates = (
        df.select(place.alias("bin"), is_yes(F.col(LABEL)).alias("churned"))
        .where("bin IS NOT NULL")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), (F.avg("churned") * 100).alias("churn_rate"))
    )
    return ends.join(rates, "bin", "left").select(
        "bin",
        "bin_start",
        "bin_end",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "churn_rate",
    )


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    found = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    stats = []
    for c in columns:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None))
        q25, q50, q75 = (F.lit(v).cast("double") for v in found[c])
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                q25.alias("q25"),
                q50.alias("q50"),
                q75.alias("q75"),
                F.max(x).alias("max"),
            ).alias(f"stat_{c}")
        )
    return df.agg(*stats).select(
        F.inline(F.array(*[F.col(f"stat_{c}") for c in columns]))
    )
