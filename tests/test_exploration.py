"""Segments, distributions, order statistics and significance."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayrate.functions.significance import chi_square_tail, t_tail
from stayrate.operators import association, distributions, order_stats, running, segments
from stayrate.operators.skew import lookup_join

QUICK = settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
NUMBERS = st.lists(
    st.one_of(st.sampled_from([0.0, 1.0, 2.5]), st.floats(-1e6, 1e6)), min_size=1, max_size=60
)


@QUICK
@given(values=NUMBERS, limit=st.sampled_from([1, 3, 1000]))
def test_quantiles_equal_numpy(spark, values, limit):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    found = order_stats.quantiles(df, {"x": F.col("x")}, probs, limit)["x"]
    assert found == pytest.approx(list(np.quantile(values, probs)), abs=1e-9)


def test_quantiles_narrow_down_with_a_coarse_sketch(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "ACCURACY", 20)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=4000).round(2), np.zeros(2500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.01, 0.37, 0.5, 0.66, 0.99]
    found = order_stats.quantiles(df, {"x": F.col("x")}, probs, 10)["x"]
    assert found == pytest.approx(list(np.quantile(x, probs)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert order_stats.quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [None]}


def test_quantiles_with_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in [-inf, -inf, 1.0, 2.0, inf]], "x double")
    sizes, found = order_stats.values_at_ranks(
        df, {"x": F.col("x")}, lambda sizes: {"x": range(sizes["x"])}, 1
    )
    assert sizes == {"x": 5}
    assert found["x"] == {0: -inf, 1: -inf, 2: 1.0, 3: 2.0, 4: inf}


@pytest.mark.parametrize("buckets", [1, 3, 16])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, buckets, descending):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.normal(size=200).round(2))
    counts = rng.integers(1, 9, len(keys))
    rows = [(float(k), int(n)) for k, n in zip(keys, counts)]
    df = spark.createDataFrame(rows, "k double, n long").repartition(5)
    found = running.running_totals(df, "k", ["n"], descending, buckets)
    step = -1 if descending else 1
    wanted = dict(zip(keys[::step], np.cumsum(counts[::step])))
    assert {r["k"]: r["cum_n"] for r in found.collect()} == wanted


def test_lookup_join_equals_left_join(spark):
    rows = spark.createDataFrame(
        [(i, 0 if i % 3 else i) for i in range(3000)] + [(-1, -7)], "id long, k long"
    )
    facts = rows.where("k >= 0").groupBy("k").agg(F.count("*").alias("n"))
    facts = facts.withColumn("twice", F.col("k") * 2)
    found = lookup_join(rows, facts, ["k"], "n", F.lit(3001))
    wanted = rows.join(facts.drop("n"), "k", "left").select("k", "id", "twice")
    assert sorted(found.select("k", "id", "twice").collect(), key=str) == sorted(
        wanted.collect(), key=str
    )


def test_histogram_of_many_groups(spark):
    ids = spark.range(20_000)
    rows = ids.select(F.col("id").alias("g"), F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("x"))
    found = distributions.histogram_by_class(rows, "x", "g", bins=2)
    assert found.count() == 40_000 and found.where("n != 1").isEmpty()


def _accounts(spark, rows):
    return spark.createDataFrame(
        rows, "tenure int, MonthlyCharges double, Contract string, Churn string"
    )


def test_kpis_of_nothing(spark):
    assert segments.churn_kpis(_accounts(spark, [])).count() == 0


def test_null_groups(spark):
    df = _accounts(
        spark, [(1, 1.0, None, "Yes"), (2, 2.0, "One year", None), (3, 3.0, "One year", "Yes")]
    )
    assert {r["Contract"]: r["rate"] for r in segments.churn_by_contract(df).collect()} == {
        None: 100.0,
        "One year": 50.0,
    }
    assert [r["churn_rate"] for r in segments.churn_rate_by(df, "Contract").collect()] == [50.0]


def test_group_without_churners(spark):
    df = _accounts(spark, [(1, 1.0, "One year", "No")])
    assert segments.churned_retained(df, "Contract").first()[1:] == (0, 1)


def test_tenure_bands(spark):
    df = _accounts(
        spark, [(t, 1.0, "x", "Yes") for t in (0, 1, 12, 13, 24, 72, 73, None)]
    )
    bands = [r[0] for r in df.select(segments.tenure_band(F.col("tenure"))).collect()]
    assert bands == [None, "0-12", "0-12", "13-24", "13-24", "49-72", None, None]
    rates = {r["band"]: r["churn_rate"] for r in segments.churn_by_tenure_band(df).collect()}
    assert rates == {"0-12": 100.0, "13-24": 100.0, "25-48": None, "49-72": 100.0}


def test_survival_has_every_month(spark):
    df = _accounts(spark, [(1, 1.0, "x", "Yes"), (4, 1.0, "x", "No"), (0, 1.0, "x", "No")])
    rows = sorted((r["t"], r["survival_rate"]) for r in segments.survival_curve(df).collect())
    assert rows == [(1, 0.5), (2, 1.0), (3, 1.0), (4, 1.0)]


def test_flat_histogram_is_widened(spark):
    df = _accounts(spark, [(1, 5.0, "x", "Yes")] * 3)
    rows = distributions.histogram_by_class(df, "MonthlyCharges", bins=4).collect()
    assert min(r["bin_start"] for r in rows) == 4.5 and max(r["bin_end"] for r in rows) == 5.5
    assert sum(r["n"] for r in rows) == 3


def test_histogram_keeps_every_row(spark):
    values = [0.1 * i for i in range(101)]
    df = _accounts(spark, [(1, v, "x", "Yes") for v in values])
    rows = distributions.histogram_by_class(df, "MonthlyCharges").collect()
    assert sum(r["n"] for r in rows) == 101
    counts, _ = np.histogram(values, bins=30)
    found = np.array([r["n"] for r in sorted(rows, key=lambda r: r["bin"])])
    assert abs(found - counts).sum() <= 4  # values on an edge may round either way


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(0)
    values = [("a", float(v)) for v in rng.normal(size=300)]
    df = spark.createDataFrame(values, "g string, x double")
    rows = distributions.histogram_density(df, "x", "g").collect()
    assert sum(r["density"] * (r["bin_end"] - r["bin_start"]) for r in rows) == pytest.approx(1)
    curve = sorted((r["grid"], r["density"]) for r in distributions.kde(df, "x", "g").collect())
    area = np.trapezoid([d for _, d in curve], [g for g, _ in curve])
    assert len(curve) == 200 and 0.9 < area < 1.0


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame(
        [(0.0, "Yes")] * 6 + [(1.0, "No")] * 2 + [(2.0, "No")] * 2, "x double, Churn string"
    )
    rows = sorted(distributions.churn_by_quantile_bin(df, "x").collect())
    assert sum(r["n"] for r in rows) == 10
    edges = sorted(set(np.quantile([0.0] * 6 + [1.0] * 2 + [2.0] * 2, np.linspace(0, 1, 6))))
    assert [r["bin_end"] for r in rows] == pytest.approx(edges[1:])


@pytest.mark.parametrize(
    "t, dof, p",
    # Student's t has closed forms for one and two degrees of freedom.
    [(1.0, 1, 0.5), (2.0, 2, 1 - 2 / math.sqrt(6)), (0.0, 10, 1.0)],
)
def test_t_tail(t, dof, p):
    assert t_tail(t, dof) == pytest.approx(p)


def test_t_tail_nears_the_normal():
    assert t_tail(1.959964, 1e7) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize(
    "x, dof, p",
    [
        (3.841459, 1, 0.05),
        (2.0, 2, math.exp(-1.0)),
        (6.0, 4, 4 * math.exp(-3.0)),
        (7.814728, 3, 0.05),
        (0.0, 5, 1.0),
    ],
)
def test_chi_square_tail(x, dof, p):
    assert chi_square_tail(x, dof) == pytest.approx(p, rel=1e-5)


def test_chi_square_of_a_larger_table_with_an_empty_cell(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5, ("c", "x"): 7}
    rows = [k for k, n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "r string, c string")
    o = np.array([[10, 20], [30, 5], [7, 0]], dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    row = association.chi_square(df, "r", "c").first()
    assert row["chi2"] == pytest.approx(((o - e) ** 2 / e).sum())
    assert row["dof"] == 2 and 0 < row["p_value"] < 1


def test_t_test_row(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 9.0, 9.5]
    df = spark.createDataFrame([(v, 1) for v in a] + [(v, 0) for v in b], "x double, label int")
    row = association.t_test(df, ["x"], "label").first()
    pooled = (3 * np.var(a, ddof=1) + 4 * np.var(b, ddof=1)) / 7
    assert row["t_statistic"] == pytest.approx(
        (np.mean(a) - np.mean(b)) / math.sqrt(pooled * (1 / 4 + 1 / 5))
    )
    assert row["dof"] == 7 and 0 < row["p_value"] < 1


def test_correlation_of_constants_is_unknown(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0)], "x double, label int")
    assert association.label_correlation(df, ["x"], "label").first()["correlation"] is None


def test_correlation_uses_rows_with_both_values(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 100.0), (50.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = {
        (r["a"], r["b"]): r["correlation"]
        for r in association.correlation_matrix(df, ["a", "b"]).collect()
    }
    wanted = np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1]
    assert found[("a", "b")] == found[("b", "a")] == pytest.approx(wanted)
    assert found[("a", "a")] == found[("b", "b")] == 1.0
