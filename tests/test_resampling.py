"""Splits, folds, random resampling and weights."""

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayrate.operators import resampling

QUICK = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
COUNTS = st.tuples(st.integers(2, 90), st.integers(2, 40))


def _rows(spark, no, yes):
    return spark.createDataFrame(
        [(f"n{i}", "No") for i in range(no)] + [(f"y{i}", "Yes") for i in range(yes)],
        "customerID string, Churn string",
    )


@QUICK
@given(counts=COUNTS, size=st.sampled_from([0.1, 0.2, 0.5]))
def test_split_is_disjoint_complete_and_stratified(spark, counts, size):
    df = _rows(spark, *counts)
    train, test = resampling.stratified_split(df, test_size=size)
    train, test = train.collect(), test.collect()
    assert sorted(train + test) == sorted(df.collect())
    quotas = resampling.test_quotas(dict(zip(("No", "Yes"), counts)), size)
    found = Counter(r["Churn"] for r in test)
    assert {c: found[c] for c in quotas} == quotas
    # The whole test part is rounded up first, then shared out by class.
    wanted = math.ceil(sum(counts) * size)
    assert sum(quotas.values()) == wanted
    for c, n in zip(("No", "Yes"), counts):
        assert abs(quotas[c] - n * wanted / sum(counts)) < 1


@QUICK
@given(counts=COUNTS)
def test_folds_are_even_per_class(spark, counts):
    folded = resampling.stratified_folds(_rows(spark, *counts), 5)
    sizes = Counter((r["Churn"], r["fold"]) for r in folded.collect())
    for c, n in zip(("No", "Yes"), counts):
        mine = [sizes[(c, fold)] for fold in range(5)]
        assert sum(mine) == n and max(mine) - min(mine) <= 1


@QUICK
@given(counts=COUNTS, ratio=st.sampled_from([0.7, 1.0]))
def test_oversampling_is_exact(spark, counts, ratio):
    low, high = min(counts), max(counts)
    df = _rows(spark, *counts)
    if int(high * ratio - low) < 0:
        with pytest.raises(ValueError, match="below"):
            resampling.oversample_random(df, ratio)
        return
    rows = resampling.oversample_random(df, ratio).collect()
    assert len(rows) == high + low + int(high * ratio - low)
    copies = Counter(r["customerID"] for r in rows)
    assert len(copies) == high + low
    repeats = [n for k, n in copies.items() if n > 1] or [1]
    assert max(repeats) - min(repeats) <= 1 or min(repeats) == 1


def test_undersampling_is_exact(spark):
    rows = resampling.undersample_random(_rows(spark, 50, 11), 0.5).collect()
    assert Counter(r["Churn"] for r in rows) == {"No": 22, "Yes": 11}
    with pytest.raises(ValueError, match="below"):
        resampling.undersample_random(_rows(spark, 50, 40), 0.5)


def test_membership_does_not_depend_on_partitions(spark):
    df = _rows(spark, 60, 30)
    found = [
        sorted(r[0] for r in resampling.mark_test(df.repartition(n)).where("is_test").collect())
        for n in (1, 7)
    ]
    assert found[0] == found[1]
    other = resampling.mark_test(df, seed=7).where("is_test")
    assert sorted(r[0] for r in other.collect()) != found[0]


def test_hash_share_is_even(spark):
    shares = [r[0] for r in spark.range(2000).select(resampling.hash_share("id")).collect()]
    assert min(shares) >= 0 and max(shares) < 1
    assert sum(shares) / len(shares) == pytest.approx(0.5, abs=0.03)


@pytest.mark.parametrize(
    "scheme, weights",
    [
        (None, {"No": 1.0, "Yes": 1.0}),
        ("balanced", {"No": 40 / 60, "Yes": 40 / 20}),
        ("positive", {"No": 1.0, "Yes": 3.0}),
        (1.5, {"No": 1.0, "Yes": 1.5}),
    ],
)
def test_weights(spark, scheme, weights):
    rows = resampling.class_weights(_rows(spark, 30, 10), scheme).collect()
    assert {r["Churn"]: r["weight"] for r in rows} == pytest.approx(weights)


def test_positive_weight_without_positives(spark):
    rows = resampling.class_weights(_rows(spark, 3, 0), "positive").collect()
    assert {r["weight"] for r in rows} == {1.0}


def test_unknown_weighting(spark):
    with pytest.raises(ValueError):
        resampling.class_weights(_rows(spark, 3, 1), "heavy")


def test_null_labels_are_not_test_rows(spark):
    df = _rows(spark, 10, 10).unionByName(
        spark.createDataFrame([("z", None)], "customerID string, Churn string")
    )
    assert not resampling.mark_test(df).where(F.col("Churn").isNull()).first()["is_test"]
