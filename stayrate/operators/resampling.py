"""Stratified splits, folds and random resampling by key hash.

Every row's place in the random order is a hash of its key, so membership does
not depend on partitioning and survives recomputation. Exact class quotas come
from the hash value at the quota's rank; taking a sample is then a filter and
moves no rows. Keys must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.operators.order_stats import values_at_ranks
from stayrate.schema import KEY, LABEL

SEED = 42
CLASSES = ("No", "Yes")
_HEX_DIGITS = 13  # 52 bits: whole numbers a double holds exactly


def hash_place(key: str, seed: int | str = SEED) -> Column:
    """Pseudo-random whole number below 2**52 that depends on key and seed only."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double")


def hash_share(key: str, seed: int | str = SEED) -> Column:
    """Pseudo-random number in [0, 1)."""
    return hash_place(key, seed) / float(16**_HEX_DIGITS)


def class_counts(df: DataFrame, label: str, classes: Sequence) -> dict:
    row = df.agg(
        *[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)]
    ).first()
    return {c: row[f"n{i}"] for i, c in enumerate(classes)}


def _cutoffs(df, key, seed, label, classes, wanted) -> tuple[dict, dict]:
    """Class counts, and per class the hash values that end its first ``k`` rows.

    ``wanted`` is told the counts and names the ``k`` of each class it needs.
    """
    place = hash_place(key, seed)
    names = {str(i): c for i, c in enumerate(classes)}
    asked: dict = {}

    def ranks(sizes: dict[str, int]) -> dict[str, list[int]]:
        asked.update(wanted({names[i]: n for i, n in sizes.items()}))
        return {i: [k - 1 for k in asked[c]] for i, c in names.items() if c in asked}

    sizes, found = values_at_ranks(
        df, {i: F.when(F.col(label) == c, place) for i, c in names.items()}, ranks
    )
    counts = {names[i]: n for i, n in sizes.items()}
    cutoffs = {
        c: [found[i].get(k - 1, -1.0) for k in asked[c]] for i, c in names.items() if c in asked
    }
    return counts, cutoffs


def _up_to(cutoffs: dict, label: str, key: str, seed) -> Column:
    """True for rows of each class at or below the class's only cutoff."""
    place = hash_place(key, seed)
    chosen = F.lit(False)
    for c, (cutoff,) in cutoffs.items():
        chosen = F.when(F.col(label) == c, place <= cutoff).otherwise(chosen)
    return chosen


def test_quotas(counts: dict, test_size: float) -> dict:
    """Test rows per class: shares kept, largest remainders rounded up."""
    total = sum(counts.values())
    wanted = math.ceil(total * test_size)
    exact = {c: n * wanted / total if total else 0.0 for c, n in counts.items()}
    quotas = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(counts, key=lambda c: (quotas[c] - exact[c], str(c)))
    for c in by_remainder[: wanted - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def mark_test(
    df: DataFrame,
    test_size: float = 0.2,
    label: str = LABEL,
    key: str = KEY,
    seed: int = SEED,
    classes: Sequence = CLASSES,
) -> DataFrame:
    """Add ``is_test``, true for the exact test quota of each class."""

    def wanted(counts: dict) -> dict:
        return {c: [k] for c, k in test_quotas(counts, test_size).items()}

    _, cutoffs = _cutoffs(df, key, seed, label, classes, wanted)
    return df.withColumn("is_test", _up_to(cutoffs, label, key, seed))


def stratified_split(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with class shares kept; options as in ``mark_test``."""
    marked = mark_test(df, **options)
    return (
        marked.where(~F.col("is_test")).drop("is_test"),
        marked.where("is_test").drop("is_test"),
    )


def stratified_folds(
    df: DataFrame,
    folds: int = 5,
    label: str = LABEL,
    key: str = KEY,
    seed: int = SEED,
    classes: Sequence = CLASSES,
) -> DataFrame:
    """Add ``fold``: per class, fold sizes are within one row of each other."""

    def wanted(counts: dict) -> dict:
        return {c: [j * n // folds for j in range(1, folds)] for c, n in counts.items()}

    _, cutoffs = _cutoffs(df, key, seed, label, classes, wanted)
    place = hash_place(key, seed)
    fold = F.lit(0)
    for c, edges in cutoffs.items():
        mine = F.lit(0)
        for edge in edges:
            mine = mine + (place > edge).cast("int")
        fold = F.when(F.col(label) == c, mine).otherwise(fold)
    return df.withColumn("fold", fold.cast("int"))


def _minor_major(counts: dict) -> tuple:
    (a, n_a), (b, n_b) = counts.items()
    return (a, b) if n_a <= n_b else (b, a)


def extra_rows(counts: dict, ratio: float, strict: bool = True) -> tuple[object, int]:
    """Minority class and how many rows it needs for minority/majority = ratio.

    A ratio below the present one is an error, or asks for no rows if not strict.
    """
    minor, major = _minor_major(counts)
    extra = int(counts[major] * ratio - counts[minor])
    if extra < 0 and strict:
        raise ValueError(f"ratio {ratio} is below the present one")
    return minor, max(extra, 0)


def kept_rows(counts: dict, ratio: float, strict: bool = True) -> tuple[object, int]:
    """Majority class and how many of its rows leave minority/majority = ratio."""
    minor, major = _minor_major(counts)
    keep = int(counts[minor] / ratio)
    if keep > counts[major] and strict:
        raise ValueError(f"ratio {ratio} is below the present one")
    return major, min(keep, counts[major])


#: Copies of a row that one task makes.
CHUNK = 1000


def oversample_random(
    df: DataFrame,
    ratio: float = 1.0,
    label: str = LABEL,
    key: str = KEY,
    seed: int = SEED,
    classes: Sequence = CLASSES,
    strict: bool = True,
) -> DataFrame:
    """Repeat minority rows up to the ratio; ``copy`` numbers the repeats from 0.

    Repeats are spread evenly: every row gets the whole number of copies, the
    rest go to the first rows in hash order.
    """

    def shares(counts: dict) -> tuple:
        minor, extra = extra_rows(counts, ratio, strict)
        return minor, *(divmod(extra, counts[minor]) if counts[minor] else (0, 0))

    def wanted(counts: dict) -> dict:
        minor, _, rest = shares(counts)
        return {minor: [rest]}

    counts, cutoffs = _cutoffs(df, key, seed, label, classes, wanted)
    minor, whole, _ = shares(counts)
    last = F.when(
        F.col(label) == minor,
        F.lit(whole) + _up_to(cutoffs, label, key, seed).cast("int"),
    ).otherwise(F.lit(0))
    if whole < CHUNK:
        return df.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    # Runs of copies are dealt to tasks before they are made.
    runs = F.explode(F.sequence(F.lit(0), F.col("copies"), F.lit(CHUNK)))
    dealt = df.withColumn("copies", last).withColumn("run", runs).repartition(key, "run")
    upto = F.least(F.col("run") + CHUNK - 1, F.col("copies"))
    return dealt.withColumn("copy", F.explode(F.sequence("run", upto))).drop("copies", "run")


def undersample_random(
    df: DataFrame,
    ratio: float = 0.5,
    label: str = LABEL,
    key: str = KEY,
    seed: int = SEED,
    classes: Sequence = CLASSES,
    strict: bool = True,
) -> DataFrame:
    """Keep majority rows by hash order until minority/majority = ratio."""

    def wanted(counts: dict) -> dict:
        major, keep = kept_rows(counts, ratio, strict)
        return {major: [keep]}

    counts, cutoffs = _cutoffs(df, key, seed, label, classes, wanted)
    minor, _ = _minor_major(counts)
    return df.where((F.col(label) == minor) | _up_to(cutoffs, label, key, seed))


def class_weights(
    df: DataFrame,
    scheme: str | float | None = "balanced",
    label: str = LABEL,
    classes: Sequence = CLASSES,
) -> DataFrame:
    """Add ``weight``: 1, balanced n/(classes * n_class), or positives times a factor.

    ``scheme`` is None, 'balanced', 'positive' (negatives over positives) or a
    number that weighs the positive class, the last of ``classes``.
    """
    positive = F.col(label) == classes[-1]
    if scheme is None:
        return df.withColumn("weight", F.lit(1.0))
    if isinstance(scheme, (int, float)):
        return df.withColumn("weight", F.when(positive, float(scheme)).otherwise(1.0))
    n = [F.count_if(F.col(label) == c) for c in classes]
    if scheme == "positive":
        factor = df.agg(F.coalesce(F.try_divide(n[0], n[-1]), F.lit(1.0))).scalar()
        return df.withColumn("weight", F.when(positive, factor).otherwise(1.0))
    if scheme != "balanced":
        raise ValueError(f"unknown weighting: {scheme}")
    total = n[0]
    for more in n[1:]:
        total = total + more
    weights = df.agg(F.array(*[F.try_divide(total, len(classes) * c) for c in n])).scalar()
    weight = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        weight = F.when(F.col(label) == c, weights[i]).otherwise(weight)
    return df.withColumn("weight", weight)
