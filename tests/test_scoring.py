"""Bands, reasons, actions, curves and what-if studies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.functions import scoring as X
from stayrate.operators import evaluation, scoring, whatif
from stayrate.schema import ACCOUNT_COLUMNS
from stayrate.sources.accounts import load_accounts


@pytest.fixture(scope="module")
def accounts(spark, small):
    return load_accounts(spark, small)


@pytest.mark.parametrize(
    "p, name",
    [
        (0.8, "Very High"),
        (0.7999, "High"),
        (0.6, "High"),
        (0.4, "Medium"),
        (0.2, "Low"),
        (0.1999, "Very Low"),
        (0.0, "Very Low"),
        (1.0, "Very High"),
    ],
)
def test_bands(spark, p, name):
    row = spark.createDataFrame([(p,)], "p double").select(
        X.risk_band(F.col("p")), X.predicted_label(F.col("p")), X.confidence(F.col("p"))
    )
    band, label, confidence = row.first()
    assert band == name and label == ("Yes" if p > 0.5 else "No") and confidence >= 0.5


def test_tie_is_no(spark):
    assert spark.range(1).select(X.predicted_label(F.lit(0.5))).first()[0] == "No"


PROFILE = {
    "customerID": "demo",
    "tenure": 2,
    "Contract": "Month-to-month",
    "PaymentMethod": "Electronic check",
    "InternetService": "Fiber optic",
    "OnlineSecurity": "No",
    "TechSupport": "No",
    "MonthlyCharges": 85.0,
}
TYPES = (
    "customerID string, tenure int, Contract string, PaymentMethod string, "
    "InternetService string, OnlineSecurity string, TechSupport string, MonthlyCharges double"
)


def _profile(spark, **changes):
    return spark.createDataFrame([tuple({**PROFILE, **changes}.values())], TYPES)


def _factors(df):
    return df.select(X.churn_factors()).first()[0]


def _actions(df, p):
    return df.select(X.retention_actions(F.lit(p))).first()[0]


def test_reasons_in_order(spark):
    assert _factors(_profile(spark)) == [
        "Month-to-month contract (higher churn risk)",
        "New customer (tenure: 2 months)",
        "Electronic check payment (associated with higher churn)",
        "No online security service",
        "No tech support service",
        "High monthly charges ($85.00)",
    ]


def test_absent_values_in_reasons(spark):
    quiet = dict.fromkeys(TYPES.replace(",", "").split()[::2])
    df = spark.createDataFrame([tuple({**quiet, "OnlineSecurity": "No"}.values())], TYPES)
    assert _factors(df) == ["New customer (tenure: 0 months)", "No online security service"]
    assert _actions(df, 0.5) == [
        "Implement new customer retention program",
        "Bundle additional services with discount",
    ]


def test_no_internet_hides_service_reasons(spark):
    factors = _factors(_profile(spark, InternetService="No"))
    assert not any("service" in f for f in factors)


@pytest.mark.parametrize(
    "charge, text",
    [(70.0, None), (70.125, "$70.12"), (70.375, "$70.38"), (1234.5, "$1234.50")],
)
def test_charge_reason(spark, charge, text):
    last = _factors(_profile(spark, MonthlyCharges=charge))[-1]
    assert (text is None and "charges" not in last) or text in last


def test_actions(spark):
    df = _profile(spark)
    assert _actions(df, 0.29) == ["Low risk - maintain regular engagement"]
    assert _actions(df, 0.71) == [
        "Offer incentive to switch to annual contract",
        "Implement new customer retention program",
        "Bundle additional services with discount",
        "Review pricing and offer competitive rate",
        "Priority intervention - personal outreach recommended",
    ]
    assert len(_actions(df, 0.7)) == 4


def test_generated_ids_are_unique(accounts):
    scored = scoring.score_batch(accounts.drop("customerID").repartition(4), scoring.scorecard)
    assert scored.select("customer_id").distinct().count() == accounts.count()
    numbers = {int(r[0].removeprefix("customer_")) for r in scored.collect()}
    assert numbers == set(range(accounts.count()))
    one = scoring.score_batch(accounts.drop("customerID").limit(3).coalesce(1), scoring.scorecard)
    assert sorted(r[0] for r in one.collect()) == ["customer_0", "customer_1", "customer_2"]


def test_numbers_follow_the_rows_and_stay(spark, small):
    rows = spark.range(0, 1000, numPartitions=7).where("id % 3 = 0").withColumn("part", F.lit("x"))
    found = [scoring.number_rows(rows, "n").orderBy("n").collect() for _ in range(2)]
    assert found[0] == found[1]
    assert [(r["n"], r["id"]) for r in found[0]] == [(i, 3 * i) for i in range(334)]
    assert scoring.number_rows(rows.where("false"), "n").count() == 0


def test_scores_do_not_depend_on_partitions(accounts):
    a = scoring.score_batch(accounts.repartition(1), scoring.scorecard).collect()
    b = scoring.score_batch(accounts.repartition(9), scoring.scorecard).collect()
    assert sorted(a) == sorted(b)


def test_summary_of_nothing(accounts):
    nothing = scoring.score_batch(accounts.where("false"), scoring.scorecard)
    assert tuple(scoring.batch_summary(nothing).first()) == (0, 0, 0.0, 0)


# --- curves ---------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 400)
    score = np.clip(rng.normal(0.4 + 0.2 * label, 0.2), 0, 1).round(2)
    rows = [(int(y), float(s)) for y, s in zip(label, score)] + [(None, 0.5), (1, None)]
    return spark.createDataFrame(rows, "label int, score double"), label, score


@pytest.mark.parametrize("buckets", [1, 6])
def test_auc_is_the_rank_statistic(scored, buckets):
    df, label, score = scored
    gap = score[label == 1][:, None] - score[label == 0][None, :]
    wanted = (gap > 0).mean() + (gap == 0).mean() / 2
    assert evaluation.roc_auc(df, "label", "score", buckets).first()[0] == pytest.approx(wanted)


def test_curves_against_thresholding(scored):
    df, label, score = scored
    for r in evaluation.roc_curve(df, "label", "score", 5).collect():
        chosen = score >= r["threshold"]
        assert r["tpr"] == pytest.approx(chosen[label == 1].mean())
        assert r["fpr"] == pytest.approx(chosen[label == 0].mean())
    rows = evaluation.pr_curve(df, "label", "score", 5).collect()
    assert len(rows) == len(np.unique(score)) + 1
    for r in rows:
        if r["threshold"] is None:
            assert (r["precision"], r["recall"]) == (1.0, 0.0)
            continue
        chosen = score >= r["threshold"]
        assert r["precision"] == pytest.approx(label[chosen].mean())
        assert r["recall"] == pytest.approx(chosen[label == 1].mean())


def test_report_without_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, predicted int")
    report = evaluation.classification_report(df, "label", "predicted")
    rows = {r["class"]: r for r in report.collect()}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"]) == (0.0, 0.0, 0.0)
    assert rows["accuracy"]["f1"] == 0.5 and rows["0"]["support"] == 1


# --- what-if --------------------------------------------------------------


def test_unchanged_price_is_the_baseline(accounts):
    row = whatif.price_sensitivity(accounts, [1.0], scoring.scorecard).first()
    impact = whatif.revenue_impact(scoring.with_probability(accounts, scoring.scorecard)).first()
    assert row["avg_churn_rate"] == pytest.approx(impact["churn_rate"])
    assert row["total_retained_revenue"] == pytest.approx(impact["expected_retained_revenue"])


def test_revenue_parts_sum_to_the_whole(accounts):
    row = whatif.revenue_impact(scoring.with_probability(accounts, scoring.scorecard)).first()
    customers = row["expected_churners"] + row["expected_retained"]
    assert customers == pytest.approx(row["total_customers"])
    assert row["churn_rate"] + row["retention_rate"] == pytest.approx(1)
    assert row["expected_lost_revenue"] + row["expected_retained_revenue"] == pytest.approx(
        row["total_potential_revenue"]
    )


def test_revenue_needs_its_columns(accounts):
    with pytest.raises(ValueError, match="absent"):
        whatif.revenue_impact(scoring.with_probability(accounts, scoring.scorecard), "absent")


def test_best_price_prefers_the_lower_factor(spark):
    rows = [(1.2, 0.1, 5.0), (0.9, 0.1, 5.0), (1.0, 0.1, 4.0)]
    summary = spark.createDataFrame(
        rows, "price_factor double, avg_churn_rate double, total_retained_revenue double"
    )
    assert whatif.best_price(summary).first()["price_factor"] == 0.9


def test_scenarios_leave_other_rows_alone(accounts):
    rows = whatif.scenario_rows(accounts, {"dear": {"MonthlyCharges": lambda c: c * 2}})
    base = rows.where("scenario = 'Baseline'").select(*ACCOUNT_COLUMNS)
    assert sorted(base.collect()) == sorted(accounts.collect())
    total = accounts.agg(F.sum("MonthlyCharges")).first()[0]
    dear = rows.where("scenario = 'dear'").agg(F.sum("MonthlyCharges")).first()[0]
    assert dear == pytest.approx(2 * total)
    with pytest.raises(ValueError):
        whatif.scenario_rows(accounts, {"x": {"absent": lambda c: c}})


def test_profile_kinds(spark):
    rows = [(i, i % 9, "a") for i in range(40)]
    df = spark.createDataFrame(rows, "many int, few int, text string")
    assert whatif.detect_kinds(df, ["many", "few", "text"]) == {
        "many": "normal",
        "few": "choice",
        "text": "choice",
    }
    ten = spark.createDataFrame([(i % 10,) for i in range(40)], "x int")
    assert whatif.detect_kinds(ten, ["x"]) == {"x": "normal"}
    with pytest.raises(ValueError):
        whatif.column_profile(df, ["many"], {"many": "beta"})
    with pytest.raises(ValueError):
        whatif.column_profile(df, ["absent"])


@pytest.mark.parametrize(
    "row, problem",
    [
        (("f", "zeta", None, None, None, None, None, None), "unsupported kind"),
        (("f", "choice", None, None, None, None, "a", 0.5), "shares do not sum to 1"),
        (("f", "choice", None, None, None, None, "a", None), "options and shares differ in number"),
        (("f", "choice", None, None, None, None, None, None), "no options"),
        (("f", "choice", None, None, None, None, "a", 1.0), None),
        (("f", "normal", 1.0, None, None, None, None, None), "needs mean and std"),
        (("f", "uniform", None, None, 1.0, 2.0, None, None), None),
    ],
)
def test_profile_checks(spark, row, problem):
    profile = spark.createDataFrame([row], whatif.PROFILE_SCHEMA)
    assert whatif.check_profile(profile).first()["problem"] == problem


def test_shifts(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=300), np.full(200, 0.25)])
    df = spark.createDataFrame(
        [(f"c{i}", float(v)) for i, v in enumerate(x)] + [("none", None)],
        "customerID string, x double",
    )
    moved = whatif.shift_normal(df, "x", 10, 3)
    stats = moved.agg(F.avg("x"), F.stddev_samp("x"), F.count("x")).first()
    assert tuple(stats) == pytest.approx((10, 3, 500))

    even = {r["customerID"]: r["x"] for r in whatif.shift_uniform(df, "x", 0, 100).collect()}
    assert even["none"] is None and len(even) == 501
    for i in (0, 5, 299, 300, 499):
        place = ((x < x[i]).sum() + (x == x[i]).sum() / 2) / 500
        assert even[f"c{i}"] == pytest.approx(100 * place)

    drawn = whatif.shift_choice(df.withColumn("kind", F.lit("")), "kind", ["a", "b"], [0.3, 0.7])
    share = drawn.where("kind = 'a'").count() / 501
    assert share == pytest.approx(0.3, abs=0.07)
    with pytest.raises(ValueError):
        whatif.shift_choice(df, "x", ["a"], [0.5])
