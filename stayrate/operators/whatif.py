"""Price and scenario studies on real accounts, and column profiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.operators.cleaning import coerce_total
from stayrate.operators.resampling import SEED, hash_share
from stayrate.operators.running import running_totals
from stayrate.operators.scoring import PROBABILITY, Scorer, with_probability
from stayrate.operators.skew import lookup_join
from stayrate.schema import KEY, require_columns
from stayrate.session import settle

BASELINE = "Baseline"
# The profile kinds known, and when a number counts as a choice.
KINDS = (
    "uniform",
    "normal",
    "choice",
    "lognormal",
    "exponential",
    "poisson",
    "binomial",
    "beta",
    "gamma",
    "chi2",
    "f",
)
FEW_VALUES = 10
#: Shares may miss 1 by this much: 1e-8, and 1e-5 of the sum.
TOLERANCE = 1e-8 + 1e-5

Change = Callable[[Column], Column]


def price_sensitivity(
    accounts: DataFrame, factors: Sequence[float], scorer: Scorer
) -> DataFrame:
    """Per price factor, mean churn probability and expected retained revenue.

    Every account is repeated per factor next to its own data and aggregated
    before anything is shuffled.
    """
    # Totals do not depend on the factor, so they are read once per account.
    once = coerce_total(accounts) if "TotalCharges" in accounts.columns else accounts
    repeated = once.withColumn(
        "price_factor", F.explode(F.array(*[F.lit(float(f)) for f in factors]))
    ).withColumn("MonthlyCharges", F.col("MonthlyCharges") * F.col("price_factor"))
    return (
        with_probability(repeated, scorer)
        .groupBy("price_factor")
        .agg(
            F.avg(PROBABILITY).alias("avg_churn_rate"),
            F.sum((1 - F.col(PROBABILITY)) * F.col("MonthlyCharges")).alias(
                "total_retained_revenue"
            ),
        )
    )


def best_price(summary: DataFrame) -> DataFrame:
    """The price row with the largest retained revenue, the lowest factor on ties."""
    return summary.orderBy(F.desc("total_retained_revenue"), "price_factor").limit(1)


def segment_impact(
    accounts: DataFrame, factors: Sequence[float], scorer: Scorer, key: str = "Contract"
) -> DataFrame:
    """Mean churn probability per segment at the best price, highest first."""
    best = best_price(price_sensitivity(accounts, factors, scorer))
    factor = best.select("price_factor").scalar()
    repriced = accounts.withColumn("MonthlyCharges", F.col("MonthlyCharges") * factor)
    return (
        with_probability(repriced, scorer)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(PROBABILITY).alias("avg_churn_in_segment"))
        .orderBy(F.desc("avg_churn_in_segment"), key)
    )


def scenario_rows(
    accounts: DataFrame, scenarios: Mapping[str, Mapping[str, Change]]
) -> DataFrame:
    """Accounts repeated per scenario, the baseline included, with its changes."""
    names = [BASELINE, *scenarios]
    rows = accounts.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in names])))
    changed = {}
    for name, changes in scenarios.items():
        for column, change in changes.items():
            require_columns(accounts, column)
            present = changed.get(column, F.col(column))
            changed[column] = F.when(
                F.col("scenario") == name, change(F.col(column))
            ).otherwise(present)
    return rows.withColumns(changed) if changed else rows


def score_scenarios(
    accounts: DataFrame, scenarios: Mapping[str, Mapping[str, Change]], scorer: Scorer
) -> DataFrame:
    """Scored accounts of every scenario in one frame."""
    return with_probability(scenario_rows(accounts, scenarios), scorer)


def scenario_comparison(
    accounts: DataFrame, scenarios: Mapping[str, Mapping[str, Change]], scorer: Scorer
) -> DataFrame:
    """Mean churn probability per scenario against the baseline."""
    means = (
        score_scenarios(accounts, scenarios, scorer)
        .groupBy("scenario")
        .agg(F.avg(PROBABILITY).alias("avg_churn_rate"))
    )
    # One row per scenario is left, so a window over all of them is small.
    base = F.max(
        F.when(F.col("scenario") == BASELINE, F.col("avg_churn_rate"))
    ).over(Window.partitionBy())
    rise = F.col("avg_churn_rate") - F.col("base")
    return means.withColumn("base", base).select(
        "scenario",
        "avg_churn_rate",
        rise.alias("churn_increase"),
        F.when(F.col("base") > 0, rise / F.col("base") * 100)
        .otherwise(0.0)
        .alias("relative_increase"),
    )


def union_scenarios(results: Mapping[str, DataFrame]) -> DataFrame:
    """Results of separate scenarios stacked under a scenario column."""
    stacked = None
    for name, df in results.items():
        tagged = df.withColumn("scenario", F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked


def revenue_impact(scored: DataFrame, charges: str = "MonthlyCharges") -> DataFrame:
    """Expected customers and revenue kept and lost, as one row."""
    require_columns(scored, charges, PROBABILITY)
    p, m = F.col(PROBABILITY), F.col(charges)
    totals = scored.agg(
        F.count("*").alias("total_customers"),
        F.sum(p).alias("expected_churners"),
        F.sum(m).alias("total_potential_revenue"),
        F.sum(p * m).alias("expected_lost_revenue"),
    )
    customers = F.col("total_customers")
    kept = customers - F.col("expected_churners")
    revenue = F.col("total_potential_revenue")
    kept_revenue = revenue - F.col("expected_lost_revenue")
    return totals.select(
        "total_customers",
        "expected_churners",
        kept.alias("expected_retained"),
        F.try_divide("expected_churners", "total_customers").alias("churn_rate"),
        F.try_divide(kept, customers).alias("retention_rate"),
        "total_potential_revenue",
        "expected_lost_revenue",
        kept_revenue.alias("expected_retained_revenue"),
        F.try_divide(kept_revenue, revenue).alias("revenue_retention_rate"),
    )


# --- profiles -------------------------------------------------------------

PROFILE_SCHEMA = (
    "feature string, kind string, mean double, std double, min double, max double, "
    "value string, probability double"
)


def detect_kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """'choice' for text or fewer than ten distinct values, else 'normal'.

    Distinct counts are estimated; only columns the estimate puts near the
    limit are counted exactly.
    """
    kinds = {c: "choice" for c in columns if isinstance(df.schema[c].dataType, T.StringType)}
    numeric = [c for c in columns if c not in kinds]
    if not numeric:
        return kinds
    row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in numeric]).first()
    near = [c for c in numeric if row[c] < 2 * FEW_VALUES]
    if near:
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first()
        kinds |= {c: "choice" for c in near if exact[c] < FEW_VALUES}
    return {c: kinds.get(c, "normal") for c in columns}


def column_profile(
    df: DataFrame, columns: Sequence[str], kinds: Mapping[str, str] | None = None
) -> DataFrame:
    """Profile rows per column: values with shares, or mean and deviation, or range.

    ``kinds`` forces 'choice', 'normal' or 'uniform' for some columns.
    """
    require_columns(df, *columns)
    chosen = dict(kinds or {})
    bad = set(chosen.values()) - {"choice", "normal", "uniform"}
    if bad:
        raise ValueError(f"cannot fit: {', '.join(sorted(bad))}")
    chosen |= detect_kinds(df, [c for c in columns if c not in chosen])

    parts = []
    numeric = [c for c in columns if chosen[c] != "choice"]
    if numeric:
        stats = []
        for c in numeric:
            x = F.nanvl(F.col(c).cast("double"), F.lit(None))
            normal = chosen[c] == "normal"
            gone = F.lit(None).cast("double")
            stats.append(
                F.struct(
                    F.lit(c).alias("feature"),
                    F.lit(chosen[c]).alias("kind"),
                    (F.avg(x) if normal else gone).alias("mean"),
                    (F.stddev_samp(x) if normal else gone).alias("std"),
                    (gone if normal else F.min(x)).alias("min"),
                    (gone if normal else F.max(x)).alias("max"),
                    F.lit(None).cast("string").alias("value"),
                    gone.alias("probability"),
                ).alias(f"p_{c}")
            )
        parts.append(
            df.agg(*stats).select(F.inline(F.array(*[F.col(f"p_{c}") for c in numeric])))
        )
    listed = [c for c in columns if chosen[c] == "choice"]
    if listed:
        counts = (
            df.select(*[F.col(c).cast("string").alias(c) for c in listed])
            .unpivot([], listed, "feature", "value")
            .where("value IS NOT NULL")
            .groupBy("feature", "value")
            .agg(F.count("*").alias("n"))
        )
        totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
        gone = F.lit(None).cast("double")
        parts.append(
            counts.join(F.broadcast(totals), "feature").select(
                "feature",
                F.lit("choice").alias("kind"),
                gone.alias("mean"),
                gone.alias("std"),
                gone.alias("min"),
                gone.alias("max"),
                "value",
                (F.col("n") / F.col("total")).alias("probability"),
            )
        )
    profile = parts[0]
    for part in parts[1:]:
        profile = profile.unionByName(part)
    return profile


def check_profile(profile: DataFrame) -> DataFrame:
    """Rows ``(feature, kind, problem)``, the problem NULL where a profile is sound."""
    rows = profile.groupBy("feature", "kind").agg(
        F.count("value").alias("options"),
        F.count("probability").alias("shares"),
        F.sum("probability").alias("total"),
        F.count("mean").alias("means"),
        F.count("std").alias("stds"),
        F.count("min").alias("mins"),
        F.count("max").alias("maxs"),
    )
    kind = F.col("kind")
    problem = (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unsupported kind")
        .when((kind == "choice") & (F.col("options") == 0), "no options")
        .when(
            (kind == "choice") & (F.col("options") != F.col("shares")),
            "options and shares differ in number",
        )
        .when(
            (kind == "choice") & (F.abs(F.col("total") - 1) > TOLERANCE),
            "shares do not sum to 1",
        )
        .when(
            (kind == "normal") & ~((F.col("means") == 1) & (F.col("stds") == 1)),
            "needs mean and std",
        )
        .when(
            (kind == "uniform") & ~((F.col("mins") == 1) & (F.col("maxs") == 1)),
            "needs min and max",
        )
    )
    return rows.select("feature", "kind", problem.alias("problem"))


def shift_normal(df: DataFrame, column: str, mean: float, std: float) -> DataFrame:
    """Move a column to a new mean and deviation, keeping every row's place."""
    stats = df.agg(
        F.struct(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    ).scalar()
    x = F.col(column)
    place = F.coalesce(F.try_divide(x - stats["mean"], stats["std"]), F.lit(0.0))
    return df.withColumn(column, F.when(x.isNotNull(), F.lit(float(mean)) + place * std))


def shift_choice(
    df: DataFrame,
    column: str,
    options: Sequence[str],
    probabilities: Sequence[float],
    key: str = KEY,
    seed: int = SEED,
) -> DataFrame:
    """Redraw a column from options with shares, by the hash of the key."""
    if len(options) != len(probabilities) or abs(sum(probabilities) - 1) > TOLERANCE:
        raise ValueError("shares must match the options and sum to 1")
    u = hash_share(key, f"{column}{seed}")
    edges, total = [], 0.0
    for p in probabilities:
        total += p
        edges.append(total)
    drawn = F.lit(options[-1])
    for option, edge in reversed(list(zip(options[:-1], edges[:-1]))):
        drawn = F.when(u < edge, option).otherwise(drawn)
    return df.withColumn(column, drawn)


def shift_uniform(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Spread a column evenly over a range by rank; equal values stay equal.

    Ranks are running totals over distinct values, looked up by every row.
    """
    rows = df.withColumn("x", F.nanvl(F.col(column).cast("double"), F.lit(None)))
    points = settle(
        rows.where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"))
    )
    total = points.agg(F.sum("n")).scalar()
    middle = (F.col("cum_n") - F.col("n") / 2) / total
    moved = running_totals(points, "x", ["n"]).select(
        "x", "n", (F.lit(float(low)) + middle * (high - low)).alias("moved")
    )
    found = lookup_join(rows.where("x IS NOT NULL"), moved, ["x"], "n", total)
    unknown = rows.where("x IS NULL").withColumn("moved", F.lit(None).cast("double"))
    return (
        found.unionByName(unknown)
        .withColumn(column, F.col("moved"))
        .select(*df.columns)
    )
