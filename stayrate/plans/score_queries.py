"""Registered queries: table work, resampling, preparation, scoring and what-if."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stayrate.functions import scoring as X
from stayrate.operators import (
    distributions,
    evaluation,
    preparation,
    resampling,
    scoring,
    segments,
    table,
    whatif,
)
from stayrate.operators.scoring import scorecard
from stayrate.plans.explore_queries import cleaned, featured, labelled
from stayrate.plans.oracle_views import (
    ACCOUNTS,
    CLEANED,
    COLUMNS,
    FEATURED,
    SCORED,
    band,
)
from stayrate.plans.registry import Query, rounds
from stayrate.schema import DERIVED, NUMERIC
from stayrate.session import shared_dir
from stayrate.sources import files
from stayrate.sources.accounts import load_accounts

FACTORS = tuple(round(0.8 + 0.05 * i, 2) for i in range(15))
SCENARIOS = {
    "Price +15%": {"MonthlyCharges": lambda c: c * 1.15},
    "Price +30%": {"MonthlyCharges": lambda c: c * 1.3},
    "All one year": {"Contract": lambda c: F.lit("One year")},
}
KEYED = "customerID"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        KEYED, F.col("user_id").cast("string")
    )


def _scored(spark, sf_dir):
    """Prepared accounts with scorecard probability, label and predicted label."""
    df = scorecard(labelled(spark, sf_dir))
    return df.withColumn("predicted", (F.col("churn_probability") > 0.5).cast("int"))


def _rounded_scores(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("score", F.round("churn_probability", 4))


def _scored_variants(spark, sf_dir):
    """Scores of three models: the scorecard, half of it, and the monthly contract alone."""
    base = _scored(spark, sf_dir).select("label", "Contract", F.round("churn_probability", 4).alias("p"))
    monthly = F.when(F.col("Contract") == "Month-to-month", 0.75).otherwise(0.25)
    variants = {"scorecard": F.col("p"), "half": F.col("p") / 2, "monthly": monthly}
    pairs = [F.struct(F.lit(n).alias("model_name"), s.alias("score")) for n, s in variants.items()]
    rows = base.select("label", F.inline(F.array(*pairs)))
    return rows.withColumn("predicted", (F.col("score") > 0.5).cast("int"))


# --- table ----------------------------------------------------------------


def _scan_csv(spark, sf_dir):
    path = files.write_csv(load_accounts(spark, sf_dir), shared_dir(spark))
    return files.scan_csv(spark, path)


def _scan_all(spark, sf_dir):
    path = shared_dir(spark)
    load_accounts(spark, sf_dir).write.parquet(path)
    return files.scan_all(spark, path)


def _incoming(spark, sf_dir):
    """Accounts twice: as they are, and an earlier copy of those paying by mail."""
    rows = load_accounts(spark, sf_dir)
    earlier = rows.where("PaymentMethod = 'Mailed check'").withColumn(
        "Contract", F.lit("Month-to-month")
    )
    return rows.withColumn("arrival", F.lit(2)).unionByName(
        earlier.withColumn("arrival", F.lit(1))
    )


def _stored(spark, sf_dir):
    return load_accounts(spark, sf_dir).where("Contract = 'Two year'")


def _ingest(spark, sf_dir):
    return table.new_accounts(_incoming(spark, sf_dir), _stored(spark, sf_dir), "arrival")


def _ingest_counts(spark, sf_dir):
    path = shared_dir(spark)
    table.with_stamps(_stored(spark, sf_dir)).write.parquet(path)
    inserted, failed = table.ingest_accounts(_incoming(spark, sf_dir), path, "arrival")
    return spark.createDataFrame([(inserted, failed)], "inserted bigint, failed bigint")


def _update(spark, sf_dir):
    updates = _events(spark, sf_dir).select(
        KEYED,
        "event_id",
        F.col("event_type").alias("PaymentMethod"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("MonthlyCharges"),
    )
    return table.update_accounts(load_accounts(spark, sf_dir), updates, "event_id").select(
        KEYED, "PaymentMethod", "MonthlyCharges"
    )


def _update_to_null(spark, sf_dir):
    """Errors clear the payment method and signups the charge of the event's user."""
    fields = {"error": "PaymentMethod", "signup": "MonthlyCharges"}
    updates = _events(spark, sf_dir).select(
        KEYED,
        "event_id",
        F.when(F.col("event_type") == "click", F.lit("Clicked")).alias("PaymentMethod"),
        F.lit(None).cast("double").alias("MonthlyCharges"),
        F.array_compact(
            F.array(
                F.when(F.col("event_type").isin("error", "click"), F.lit(fields["error"])),
                F.when(F.col("event_type") == "signup", F.lit(fields["signup"])),
            )
        ).alias("given"),
    )
    found = table.update_accounts(
        load_accounts(spark, sf_dir), updates, "event_id", supplied="given"
    )
    return found.select(KEYED, "PaymentMethod", "MonthlyCharges")


def _unknown_keys(spark, sf_dir):
    """Users with events who have no account on a two-year contract."""
    return table.unknown_keys(_stored(spark, sf_dir), _events(spark, sf_dir))


def _numbered_scores(spark, sf_dir):
    """Accounts without key, scored: how many distinct ids, and the largest number."""
    scored = scoring.score_batch(load_accounts(spark, sf_dir).drop(KEYED), scorecard)
    number = F.substring_index("customer_id", "_", -1).cast("bigint")
    return scored.agg(
        F.count("*").alias("n"),
        F.count_distinct("customer_id").alias("ids"),
        F.min(number).alias("first"),
        F.max(number).alias("last"),
    )


def _delete(spark, sf_dir):
    gone = _events(spark, sf_dir).where("event_type = 'error'")
    return table.delete_accounts(load_accounts(spark, sf_dir), gone).select(KEYED, "Contract")


def _export_csv(spark, sf_dir):
    path = shared_dir(spark)
    table.export_csv(load_accounts(spark, sf_dir), path, {"Contract": "One year"})
    return files.scan_csv(spark, path)


def _run_sql(spark, sf_dir):
    return files.run_sql(
        spark,
        "SELECT Contract, count(*) AS n FROM accounts_table "
        "WHERE tenure > ? AND InternetService = ? GROUP BY Contract",
        [24, "DSL"],
        {"accounts_table": load_accounts(spark, sf_dir)},
    )


def _score_csv(spark, sf_dir):
    source = files.write_csv(load_accounts(spark, sf_dir), shared_dir(spark))
    target = files.score_csv(spark, source, shared_dir(spark), scorecard)
    return spark.read.option("header", True).csv(target, schema=_PREDICTIONS)


def _save_predictions(spark, sf_dir):
    predictions = scoring.score_batch(load_accounts(spark, sf_dir), scorecard)
    path = files.save_predictions(predictions, shared_dir(spark), "parquet")
    return spark.read.parquet(path)


_PREDICTIONS = (
    "customer_id string, churn_prediction string, churn_probability double, "
    "risk_level string, confidence double"
)


def _latest(spark, sf_dir):
    rows = load_accounts(spark, sf_dir)
    first = scoring.score_batch(rows, scorecard).withColumn(
        "timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    )
    dearer = rows.where("Contract = 'Month-to-month'").withColumn(
        "MonthlyCharges", F.col("MonthlyCharges") * 1.15
    )
    second = scoring.score_batch(dearer, scorecard).withColumn(
        "timestamp", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    )
    latest = scoring.latest_prediction(first.unionByName(second))
    return latest.select(
        "customer_id", "churn_prediction", "churn_probability", F.month("timestamp").alias("m")
    )


# --- preparation and resampling -------------------------------------------


def _one_hot(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    model = preparation.fit_one_hot(df, ["Contract"])
    names = model.stages[0].labelsArray[0]
    encoded = model.transform(df).withColumn("slots", vector_to_array("cat__Contract"))
    return encoded.select(
        KEYED, *[F.col("slots")[i].alias(f"Contract_{v}") for i, v in enumerate(names)]
    )


def _with_gaps(spark, sf_dir):
    """Cleaned accounts with unknown charges and payment for some contracts."""
    two_year = F.col("Contract") == "Two year"
    return cleaned(spark, sf_dir).withColumns(
        {
            "TotalCharges": F.when(~two_year, F.col("TotalCharges")),
            "PaymentMethod": F.when(~two_year, F.col("PaymentMethod")),
        }
    )


def _assemble(spark, sf_dir):
    df = featured(spark, sf_dir)
    out = preparation.fit_preparation(df).transform(df)
    names = preparation.feature_names(out)
    slots = out.select(KEYED, vector_to_array("features").alias("slots"))
    return slots.select(KEYED, *[F.col("slots")[i].alias(c) for i, c in enumerate(names)])


def _sorted_segments(spark, sf_dir):
    scored = scoring.with_probability(load_accounts(spark, sf_dir), scorecard)
    return segments.sorted_segments(scored, "Contract", "churn_probability")


def _explained(spark, sf_dir):
    return scoring.explain_batch(load_accounts(spark, sf_dir), scorecard)


def _joined_text(column):
    return F.array_join(column, "; ").alias(column)


def _scenario_scores(spark, sf_dir):
    rows = load_accounts(spark, sf_dir)
    return whatif.score_scenarios(rows, SCENARIOS, scorecard)


def _union_scenarios(spark, sf_dir):
    rows = load_accounts(spark, sf_dir)
    results = {
        "as is": scoring.score_batch(rows, scorecard),
        "dearer": scoring.score_batch(
            rows.withColumn("MonthlyCharges", F.col("MonthlyCharges") * 1.15), scorecard
        ),
    }
    return whatif.union_scenarios(results).select(
        "scenario", "customer_id", "risk_level", "churn_probability"
    )


def _profile(spark, sf_dir):
    return whatif.column_profile(
        cleaned(spark, sf_dir),
        ["Contract", "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"],
        {"tenure": "uniform"},
    )


def _shifted(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    df = whatif.shift_normal(df, "MonthlyCharges", 64.76, 30.09)
    df = whatif.shift_choice(
        df, "Contract", ["Month-to-month", "One year", "Two year"], [0.55, 0.24, 0.21]
    )
    df = whatif.shift_uniform(df, "tenure", 1, 72)
    return df.select(KEYED, "MonthlyCharges", "Contract", "tenure")


# --- SQL ------------------------------------------------------------------

_NUMERIC = (*NUMERIC, *DERIVED)
# The levels each encoded column has in the given tables.
_LEVELS = {
    "gender": ("Female", "Male"),
    "SeniorCitizen": ("0", "1"),
    "Partner": ("No", "Yes"),
    "Dependents": ("No", "Yes"),
    "PhoneService": ("No", "Yes"),
    "MultipleLines": ("No", "No phone service", "Yes"),
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaperlessBilling": ("No", "Yes"),
    "PaymentMethod": (
        "Bank transfer (automatic)",
        "Credit card (automatic)",
        "Electronic check",
        "Mailed check",
    ),
}

_PLACE = "substr(md5(concat(customerID, '{seed}')), 1, 13)"
_ORDERED = f"""{CLEANED}, placed AS (
    SELECT customerID, Churn, {_PLACE.format(seed=42)} AS h,
           row_number() OVER (PARTITION BY Churn ORDER BY {_PLACE.format(seed=42)}) AS rn,
           count(*) OVER (PARTITION BY Churn) AS n, count(*) OVER () AS total FROM cleaned),
    sizes AS (SELECT count(*) FILTER (Churn = 'Yes') AS yes,
                     count(*) FILTER (Churn = 'No') AS no FROM cleaned),
    mm AS (SELECT CASE WHEN no <= yes THEN 'No' ELSE 'Yes' END AS minor,
                  least(yes, no) AS n_min, greatest(yes, no) AS n_maj FROM sizes)"""
_QUOTAS = """, wanted AS (
        SELECT Churn, n, floor(exact) AS base, exact - floor(exact) AS part, w FROM (
            SELECT DISTINCT Churn, n, ceil(total * 0.2) AS w, n * ceil(total * 0.2) / total
                AS exact FROM placed)),
    quotas AS (SELECT Churn, base + CASE WHEN row_number() OVER (ORDER BY part DESC, Churn)
                   <= w - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM wanted)"""

OUTCOME = f"""customerID AS customer_id,
    CASE WHEN churn_probability > 0.5 THEN 'Yes' ELSE 'No' END AS churn_prediction,
    churn_probability, {band('churn_probability')} AS risk_level,
    greatest(churn_probability, 1 - churn_probability) AS confidence"""
_RAW = f"""{SCORED}, full_rows AS (
    SELECT c.* REPLACE (a.TotalCharges AS TotalCharges), s.churn_probability
    FROM scored s JOIN cleaned c USING (customerID) JOIN accounts a USING (customerID))"""

_FACTORS_SQL = f"""CASE WHEN Contract = 'Month-to-month'
         THEN 'Month-to-month contract (higher churn risk)' END,
    CASE WHEN coalesce(tenure, 0) < 6
         THEN concat('New customer (tenure: ', coalesce(tenure, 0), ' months)') END,
    CASE WHEN PaymentMethod = 'Electronic check'
         THEN 'Electronic check payment (associated with higher churn)' END,
    CASE WHEN InternetService IS DISTINCT FROM 'No' AND OnlineSecurity = 'No'
         THEN 'No online security service' END,
    CASE WHEN InternetService IS DISTINCT FROM 'No' AND TechSupport = 'No'
         THEN 'No tech support service' END,
    CASE WHEN coalesce(MonthlyCharges, 0) > 70
         THEN concat('High monthly charges ($', printf('%.2f', MonthlyCharges), ')')
         END"""
_ACTIONS_SQL = """CASE WHEN churn_probability < 0.3 THEN 'Low risk - maintain regular engagement'
    ELSE concat_ws('; ',
    CASE WHEN Contract = 'Month-to-month'
         THEN 'Offer incentive to switch to annual contract' END,
    CASE WHEN coalesce(tenure, 0) < 12 THEN 'Implement new customer retention program' END,
    CASE WHEN OnlineSecurity = 'No' OR TechSupport = 'No'
         THEN 'Bundle additional services with discount' END,
    CASE WHEN coalesce(MonthlyCharges, 0) > 70
         THEN 'Review pricing and offer competitive rate' END,
    CASE WHEN churn_probability > 0.7
         THEN 'Priority intervention - personal outreach recommended' END) END"""

_CURVE = f"""{SCORED}, points AS (
        SELECT round(churn_probability, 4) AS threshold,
               count(*) FILTER (Churn = 'Yes') AS pos, count(*) FILTER (Churn = 'No') AS neg
        FROM scored GROUP BY 1),
    curve AS (SELECT threshold, pos, neg,
               sum(pos) OVER (ORDER BY threshold DESC) AS cp,
               sum(neg) OVER (ORDER BY threshold DESC) AS cn,
               sum(pos) OVER () AS p, sum(neg) OVER () AS q FROM points)"""


_VARIANTS = f"""{SCORED}, variants AS (
        SELECT 'scorecard' AS model_name, Churn, round(churn_probability, 4) AS score FROM scored
        UNION ALL SELECT 'half', Churn, round(churn_probability, 4) / 2 FROM scored
        UNION ALL SELECT 'monthly', Churn,
            CASE WHEN Contract = 'Month-to-month' THEN 0.75 ELSE 0.25 END FROM scored),
    points AS (
        SELECT model_name, score AS threshold,
               count(*) FILTER (Churn = 'Yes') AS pos, count(*) FILTER (Churn = 'No') AS neg
        FROM variants GROUP BY 1, 2),
    curve AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
               sum(pos) OVER (PARTITION BY model_name) AS p,
               sum(neg) OVER (PARTITION BY model_name) AS q FROM points
               WINDOW w AS (PARTITION BY model_name ORDER BY threshold DESC))"""

_FACTOR_LIST = ", ".join(f"(CAST({f} AS DOUBLE))" for f in FACTORS)


def _price_sql(select: str) -> str:
    return f"""{ACCOUNTS}, factors AS (SELECT * FROM (VALUES {_FACTOR_LIST}) v(price_factor)),
        priced AS (SELECT a.* REPLACE (MonthlyCharges * price_factor AS MonthlyCharges),
                          price_factor FROM accounts a CROSS JOIN factors),
        {_TAIL.format(source='priced')},
        summary AS (SELECT price_factor, avg(churn_probability) AS avg_churn_rate,
            sum((1 - churn_probability) * MonthlyCharges) AS total_retained_revenue
            FROM scored GROUP BY price_factor)
        {select}"""


def _tail() -> str:
    """The view text after the accounts, reading from a named source instead."""
    tail = SCORED[SCORED.index("coerced AS (") :]
    return tail.replace("{", "{{").replace("}", "}}").replace(
        "FROM accounts)", "FROM {source})"
    )


_TAIL = _tail()

_SCENARIO_SQL = f"""{ACCOUNTS}, named AS (SELECT * FROM (VALUES ('Baseline'), ('Price +15%'),
        ('Price +30%'), ('All one year')) v(scenario)),
    tagged AS (SELECT a.* REPLACE (
            CASE scenario WHEN 'Price +15%' THEN MonthlyCharges * CAST(1.15 AS DOUBLE)
                 WHEN 'Price +30%' THEN MonthlyCharges * CAST(1.3 AS DOUBLE)
                 ELSE MonthlyCharges END AS MonthlyCharges,
            CASE scenario WHEN 'All one year' THEN 'One year' ELSE Contract END AS Contract),
        scenario FROM accounts a CROSS JOIN named),
    {_TAIL.format(source='tagged')}"""


def _dearer_sql(source: str, where: str, prefix: str) -> str:
    """Scores of accounts at +15%, as CTEs with prefixed names ending in ``<prefix>scored``."""
    tail = _TAIL.format(source=f"{prefix}priced")
    for name in ("coerced", "cleaned", "featured", "scored"):
        tail = tail.replace(f"{name} AS (", f"{prefix}{name} AS (").replace(
            f"FROM {name}", f"FROM {prefix}{name}"
        )
    return f"""{prefix}priced AS (SELECT * REPLACE (MonthlyCharges * CAST(1.15 AS DOUBLE)
        AS MonthlyCharges) FROM {source} WHERE {where}), {tail}"""


QUERIES: dict[str, Query] = {
    # table
    "scan_csv": Query(_scan_csv, f"{ACCOUNTS} SELECT {COLUMNS} FROM accounts"),
    "scan_all": Query(_scan_all, f"{ACCOUNTS} SELECT {COLUMNS} FROM accounts"),
    "lookup_account": Query(
        lambda s, d: table.lookup_account(load_accounts(s, d), "7"),
        f"{ACCOUNTS} SELECT {COLUMNS} FROM accounts WHERE customerID = '7'",
    ),
    "filter_accounts": Query(
        lambda s, d: table.filter_accounts(
            load_accounts(s, d), {"Contract": "One year", "InternetService": "DSL"}
        ),
        f"""{ACCOUNTS} SELECT {COLUMNS} FROM accounts
            WHERE Contract = 'One year' AND InternetService = 'DSL'""",
    ),
    "ingest_accounts": Query(
        _ingest,
        f"""{ACCOUNTS} SELECT * REPLACE (CASE WHEN PaymentMethod = 'Mailed check'
                THEN 'Month-to-month' ELSE Contract END AS Contract)
            FROM accounts WHERE Contract <> 'Two year'""",
    ),
    "ingest_counts": Query(
        _ingest_counts,
        f"""{ACCOUNTS} SELECT count(*) FILTER (Contract <> 'Two year') AS inserted,
                count(*) FILTER (Contract = 'Two year')
                + count(*) FILTER (PaymentMethod = 'Mailed check') AS failed FROM accounts""",
    ),
    "update_accounts": Query(
        _update,
        f"""{ACCOUNTS}, latest AS (
                SELECT CAST(user_id AS VARCHAR) AS customerID,
                       max_by(event_type, event_id) AS p,
                       max_by("value", event_id) FILTER (event_type = 'purchase') AS m
                FROM events GROUP BY user_id)
            SELECT a.customerID, coalesce(p, PaymentMethod) AS PaymentMethod,
                   coalesce(m, MonthlyCharges) AS MonthlyCharges
            FROM accounts a LEFT JOIN latest l ON a.customerID = l.customerID""",
    ),
    "update_to_null": Query(
        _update_to_null,
        f"""{ACCOUNTS}, latest AS (
                SELECT CAST(user_id AS VARCHAR) AS customerID,
                       max_by(event_type, event_id) FILTER (event_type IN ('error', 'click')) AS p,
                       count(*) FILTER (event_type = 'signup') AS m
                FROM events GROUP BY user_id)
            SELECT a.customerID, CASE p WHEN 'error' THEN NULL WHEN 'click' THEN 'Clicked'
                       ELSE PaymentMethod END AS PaymentMethod,
                   CASE WHEN m > 0 THEN NULL ELSE MonthlyCharges END AS MonthlyCharges
            FROM accounts a LEFT JOIN latest l ON a.customerID = l.customerID""",
    ),
    "unknown_keys": Query(
        _unknown_keys,
        f"""{ACCOUNTS} SELECT DISTINCT CAST(user_id AS VARCHAR) AS customerID FROM events
            WHERE CAST(user_id AS VARCHAR) NOT IN (
                SELECT customerID FROM accounts WHERE Contract = 'Two year')""",
    ),
    "score_batch_numbered": Query(
        _numbered_scores,
        f"""{ACCOUNTS} SELECT count(*) AS n, count(*) AS ids, 0::BIGINT AS first,
            count(*) - 1 AS last FROM accounts""",
    ),
    "delete_accounts": Query(
        _delete,
        f"""{ACCOUNTS} SELECT customerID, Contract FROM accounts WHERE customerID NOT IN (
            SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error')""",
    ),
    "export_csv": Query(
        _export_csv, f"{ACCOUNTS} SELECT {COLUMNS} FROM accounts WHERE Contract = 'One year'"
    ),
    "run_sql": Query(
        _run_sql,
        f"""{ACCOUNTS} SELECT Contract, count(*) AS n FROM accounts
            WHERE tenure > 24 AND InternetService = 'DSL' GROUP BY Contract""",
    ),
    "score_csv": Query(
        _score_csv,
        f"{SCORED} SELECT {OUTCOME} FROM scored",
        rounds(6, "churn_probability", "confidence"),
    ),
    "save_predictions": Query(
        _save_predictions,
        f"{SCORED} SELECT {OUTCOME} FROM scored",
        rounds(6, "churn_probability", "confidence"),
    ),
    "latest_prediction": Query(
        _latest,
        f"""{SCORED}, {_dearer_sql('accounts', "Contract = 'Month-to-month'", 'd_')}
            SELECT s.customerID AS customer_id,
                   CASE WHEN coalesce(d.churn_probability, s.churn_probability) > 0.5
                        THEN 'Yes' ELSE 'No' END AS churn_prediction,
                   coalesce(d.churn_probability, s.churn_probability) AS churn_probability,
                   CAST(CASE WHEN d.customerID IS NULL THEN 1 ELSE 2 END AS INTEGER) AS m
            FROM scored s LEFT JOIN d_scored d ON s.customerID = d.customerID""",
        rounds(6, "churn_probability"),
    ),
    # preparation
    "impute_median": Query(
        lambda s, d: preparation.impute_median(_with_gaps(s, d), ["TotalCharges"]).select(
            KEYED, "TotalCharges"
        ),
        f"""{CLEANED} SELECT customerID, CASE WHEN Contract <> 'Two year' THEN TotalCharges
                ELSE (SELECT median(TotalCharges) FROM cleaned WHERE Contract <> 'Two year')
                END AS TotalCharges FROM cleaned""",
        rounds(6, "TotalCharges"),
    ),
    "standardize": Query(
        lambda s, d: preparation.standardize(
            cleaned(s, d), ["tenure", "MonthlyCharges"]
        ).select(KEYED, "tenure", "MonthlyCharges"),
        f"""{CLEANED} SELECT customerID,
                (tenure - (SELECT avg(tenure) FROM cleaned))
                / (SELECT stddev_pop(tenure) FROM cleaned) AS tenure,
                (MonthlyCharges - (SELECT avg(MonthlyCharges) FROM cleaned))
                / (SELECT stddev_pop(MonthlyCharges) FROM cleaned) AS MonthlyCharges
            FROM cleaned""",
        rounds(6, "tenure", "MonthlyCharges"),
    ),
    "impute_mode": Query(
        lambda s, d: preparation.impute_mode(_with_gaps(s, d), ["PaymentMethod"]).select(
            KEYED, "PaymentMethod"
        ),
        f"""{CLEANED} SELECT customerID, CASE WHEN Contract <> 'Two year' THEN PaymentMethod
                ELSE (SELECT PaymentMethod FROM cleaned WHERE Contract <> 'Two year'
                      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS PaymentMethod
            FROM cleaned""",
    ),
    "one_hot": Query(
        _one_hot,
        f"""{CLEANED} SELECT customerID, """
        + ", ".join(
            f"CAST(Contract = '{v}' AS DOUBLE) AS \"Contract_{v}\""
            for v in ("Month-to-month", "One year", "Two year")
        )
        + " FROM cleaned",
    ),
    "assemble": Query(
        _assemble,
        f"""{FEATURED} SELECT customerID, {', '.join(
            f'({c} - (SELECT avg({c}) FROM featured)) / (SELECT stddev_pop({c}) FROM featured)'
            f' AS num__{c}' for c in _NUMERIC)}, {', '.join(
            f"""CAST({c} = '{v}' AS DOUBLE) AS "cat__{c}_{v}" """
            for c, values in _LEVELS.items() for v in values)} FROM featured""",
        rounds(6, *[f"num__{c}" for c in _NUMERIC]),
    ),
    # resampling
    "stratified_split": Query(
        lambda s, d: resampling.mark_test(cleaned(s, d)).select(KEYED, "Churn", "is_test"),
        f"""{_ORDERED}{_QUOTAS} SELECT customerID, p.Churn, rn <= quota AS is_test
            FROM placed p JOIN quotas q ON p.Churn = q.Churn""",
    ),
    "stratified_folds": Query(
        lambda s, d: resampling.stratified_folds(cleaned(s, d)).select(KEYED, "Churn", "fold"),
        f"""{_ORDERED} SELECT customerID, Churn, CAST((rn > n // 5) AS INTEGER)
                + CAST((rn > 2 * n // 5) AS INTEGER) + CAST((rn > 3 * n // 5) AS INTEGER)
                + CAST((rn > 4 * n // 5) AS INTEGER) AS fold FROM placed""",
    ),
    "oversample_random": Query(
        lambda s, d: resampling.oversample_random(cleaned(s, d), 1.0).select(
            KEYED, "Churn", "copy"
        ),
        f"""{_ORDERED} SELECT customerID, Churn, CAST(g.i AS INTEGER) AS copy
            FROM placed, mm, range(0, 100) g(i)
            WHERE g.i <= CASE WHEN Churn = minor THEN (n_maj - n_min) // n_min
                + CASE WHEN rn <= (n_maj - n_min) % n_min THEN 1 ELSE 0 END ELSE 0 END""",
    ),
    "undersample_random": Query(
        lambda s, d: resampling.undersample_random(cleaned(s, d), 1.0).select(KEYED, "Churn"),
        f"""{_ORDERED} SELECT customerID, Churn FROM placed, mm
            WHERE Churn = minor OR rn <= n_min""",
    ),
    "class_weights": Query(
        lambda s, d: resampling.class_weights(cleaned(s, d)).select(KEYED, "Churn", "weight"),
        f"""{CLEANED} SELECT customerID, Churn, count(*) OVER ()
                / (2 * count(*) OVER (PARTITION BY Churn)) AS weight FROM cleaned""",
        rounds(6, "weight"),
    ),
    # scoring
    "prepare_batch": Query(
        lambda s, d: scoring.prepare_batch(load_accounts(s, d)).drop("Churn"),
        f"{FEATURED} SELECT * EXCLUDE (Churn) FROM featured",
        rounds(6, "MonthlyToTotalRatio"),
    ),
    "score_batch": Query(
        lambda s, d: scoring.score_batch(load_accounts(s, d), scorecard),
        f"{SCORED} SELECT {OUTCOME} FROM scored",
        rounds(6, "churn_probability", "confidence"),
    ),
    "score_stored": Query(
        lambda s, d: scoring.score_stored(
            load_accounts(s, d), _events(s, d).select("user_id"), scorecard
        ),
        f"""{SCORED} SELECT {OUTCOME} FROM scored
            WHERE customerID IN (SELECT CAST(user_id AS VARCHAR) FROM events)""",
        rounds(6, "churn_probability", "confidence"),
    ),
    "risk_band": Query(
        lambda s, d: scoring.with_probability(load_accounts(s, d), scorecard)
        .groupBy(X.risk_band(F.col("churn_probability")).alias("risk_level"))
        .agg(F.count("*").alias("n")),
        f"""{SCORED} SELECT {band('churn_probability')} AS risk_level, count(*) AS n
            FROM scored GROUP BY 1""",
    ),
    "churn_factors": Query(
        lambda s, d: load_accounts(s, d)
        .withColumn("factors", X.churn_factors())
        .select(KEYED, _joined_text("factors")),
        f"""{ACCOUNTS} SELECT customerID, concat_ws('; ', {_FACTORS_SQL}) AS factors
            FROM accounts""",
    ),
    "retention_actions": Query(
        lambda s, d: scoring.with_probability(load_accounts(s, d), scorecard)
        .withColumn("actions", X.retention_actions(F.col("churn_probability")))
        .select(KEYED, _joined_text("actions")),
        f"{_RAW} SELECT customerID, {_ACTIONS_SQL} AS actions FROM full_rows",
    ),
    "explain_batch": Query(
        lambda s, d: _explained(s, d).withColumns(
            {
                c: F.array_join(c, "; ")
                for c in ("important_factors", "recommendations")
            }
        ),
        f"""{_RAW} SELECT {OUTCOME}, concat_ws('; ', {_FACTORS_SQL}) AS important_factors,
            {_ACTIONS_SQL} AS recommendations FROM full_rows""",
        rounds(6, "churn_probability", "confidence"),
    ),
    "batch_summary": Query(
        lambda s, d: scoring.batch_summary(scoring.score_batch(load_accounts(s, d), scorecard)),
        f"""{SCORED} SELECT count(*) AS scored,
                count(*) FILTER (churn_probability > 0.5) AS predicted_churners,
                count(*) FILTER (churn_probability > 0.5) * 100 / count(*) AS churner_percent,
                count(*) FILTER (churn_probability >= 0.6) AS high_risk FROM scored""",
        rounds(6, "churner_percent"),
    ),
    "sorted_segments": Query(
        _sorted_segments,
        f"""{SCORED} SELECT Contract, avg(churn_probability) AS avg_churn_probability
            FROM scored GROUP BY Contract""",
        rounds(6, "avg_churn_probability"),
    ),
    # evaluation
    "confusion_matrix": Query(
        lambda s, d: evaluation.confusion_matrix(_scored(s, d), "label", "predicted"),
        f"""{SCORED} SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted,
                count(customerID) AS n
            FROM range(2) x(a) CROSS JOIN range(2) y(p) LEFT JOIN scored
                 ON (Churn = 'Yes') = (a = 1) AND (churn_probability > 0.5) = (p = 1)
            GROUP BY a, p""",
    ),
    "classification_report": Query(
        lambda s, d: evaluation.classification_report(_scored(s, d), "label", "predicted"),
        f"""{SCORED}, c AS (SELECT
                count(*) FILTER (Churn = 'Yes' AND churn_probability > 0.5) AS tp,
                count(*) FILTER (Churn = 'No' AND churn_probability > 0.5) AS fp,
                count(*) FILTER (Churn = 'Yes' AND churn_probability <= 0.5) AS fn,
                count(*) FILTER (Churn = 'No' AND churn_probability <= 0.5) AS tn FROM scored),
            r AS (SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision,
                    coalesce(tn / nullif(tn + fp, 0), 0) AS recall,
                    coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1, tn + fp AS support
                  FROM c UNION ALL
                  SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0),
                    coalesce(tp / nullif(tp + fn, 0), 0),
                    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM c)
            SELECT class, precision, recall, f1, support FROM r UNION ALL
            SELECT 'macro avg', avg(precision), avg(recall), avg(f1),
                   CAST(sum(support) AS BIGINT) FROM r UNION ALL
            SELECT 'weighted avg', sum(precision * support) / sum(support),
                   sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
                   CAST(sum(support) AS BIGINT) FROM r UNION ALL
            SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn),
                   (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM c""",
        rounds(6, "precision", "recall", "f1"),
    ),
    "roc_auc": Query(
        lambda s, d: evaluation.roc_auc(_rounded_scores(s, d), "label", "score"),
        f"{_CURVE} SELECT sum(neg * (cp - pos / 2)) / max(p * q) AS roc_auc FROM curve",
        rounds(6, "roc_auc"),
    ),
    "roc_curve": Query(
        lambda s, d: evaluation.roc_curve(_rounded_scores(s, d), "label", "score"),
        f"""{_CURVE} SELECT threshold, cn / q AS fpr, cp / p AS tpr FROM curve
            UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""",
        rounds(6, "fpr", "tpr"),
    ),
    "pr_curve": Query(
        lambda s, d: evaluation.pr_curve(_rounded_scores(s, d), "label", "score"),
        f"""{_CURVE} SELECT threshold, cp / (cp + cn) AS precision, cp / p AS recall FROM curve
            UNION ALL SELECT NULL, 1.0, 0.0""",
        rounds(6, "precision", "recall"),
    ),
    "model_curves": Query(
        lambda s, d: evaluation.model_curves(
            _scored_variants(s, d), "model_name", "label", "score"
        ),
        f"""{_VARIANTS} SELECT model_name, threshold, cn / q AS fpr, cp / p AS tpr,
                cp / (cp + cn) AS precision FROM curve
            UNION ALL SELECT DISTINCT model_name, CAST('inf' AS DOUBLE), 0.0, 0.0, 1.0 FROM curve""",
        rounds(6, "threshold", "fpr", "tpr", "precision"),
    ),
    "model_metrics": Query(
        lambda s, d: evaluation.model_metrics(
            _scored_variants(s, d), "model_name", "label", "predicted", "score"
        ).withColumn("confusion_matrix", F.to_json("confusion_matrix")),
        f"""{_VARIANTS}, cells AS (
                SELECT model_name, count(*) FILTER (Churn = 'Yes' AND score > 0.5) AS tp,
                       count(*) FILTER (Churn = 'No' AND score > 0.5) AS fp,
                       count(*) FILTER (Churn = 'Yes' AND score <= 0.5) AS fn,
                       count(*) FILTER (Churn = 'No' AND score <= 0.5) AS tn
                FROM variants GROUP BY 1),
            areas AS (SELECT model_name, sum(neg * (cp - pos / 2)) / max(p * q) AS roc_auc
                      FROM curve GROUP BY 1)
            SELECT model_name, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
                   coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
                   coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
                   (tp + tn) / (tp + fp + fn + tn) AS accuracy, roc_auc,
                   '[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]' AS confusion_matrix
            FROM cells JOIN areas USING (model_name)""",
        rounds(6, "f1", "recall", "precision", "accuracy", "roc_auc"),
    ),
    # what-if
    "price_sensitivity": Query(
        lambda s, d: whatif.price_sensitivity(load_accounts(s, d), FACTORS, scorecard),
        _price_sql("SELECT * FROM summary"),
        {"avg_churn_rate": 6, "total_retained_revenue": 2},
    ),
    "best_price": Query(
        lambda s, d: whatif.best_price(
            whatif.price_sensitivity(load_accounts(s, d), FACTORS, scorecard)
        ),
        _price_sql(
            "SELECT * FROM summary ORDER BY total_retained_revenue DESC, price_factor LIMIT 1"
        ),
        {"avg_churn_rate": 6, "total_retained_revenue": 2},
    ),
    "segment_impact": Query(
        lambda s, d: whatif.segment_impact(load_accounts(s, d), FACTORS, scorecard),
        _price_sql(
            """SELECT Contract, avg(churn_probability) AS avg_churn_in_segment FROM scored
               WHERE price_factor = (SELECT price_factor FROM summary
                   ORDER BY total_retained_revenue DESC, price_factor LIMIT 1)
               GROUP BY Contract"""
        ),
        rounds(6, "avg_churn_in_segment"),
    ),
    "scenario_comparison": Query(
        lambda s, d: whatif.scenario_comparison(load_accounts(s, d), SCENARIOS, scorecard),
        f"""{_SCENARIO_SQL}, m AS (SELECT scenario, avg(churn_probability) AS a FROM scored
                GROUP BY scenario), b AS (SELECT a AS base FROM m WHERE scenario = 'Baseline')
            SELECT scenario, a AS avg_churn_rate, a - base AS churn_increase,
                   CASE WHEN base > 0 THEN (a - base) / base * 100 ELSE 0 END
                       AS relative_increase FROM m, b""",
        rounds(6, "avg_churn_rate", "churn_increase", "relative_increase"),
    ),
    "union_scenarios": Query(
        _union_scenarios,
        f"""{SCORED}, {_dearer_sql('accounts', 'true', 'd_')}
            SELECT 'as is' AS scenario, customerID AS customer_id,
                   {band('churn_probability')} AS risk_level, churn_probability FROM scored
            UNION ALL SELECT 'dearer', customerID, {band('churn_probability')},
                   churn_probability FROM d_scored""",
        rounds(6, "churn_probability"),
    ),
    "revenue_impact": Query(
        lambda s, d: whatif.revenue_impact(
            scoring.with_probability(load_accounts(s, d), scorecard)
        ),
        f"""{SCORED}, t AS (SELECT count(*) AS n, sum(churn_probability) AS c,
                sum(MonthlyCharges) AS r, sum(churn_probability * MonthlyCharges) AS l
                FROM scored)
            SELECT n AS total_customers, c AS expected_churners, n - c AS expected_retained,
                   c / n AS churn_rate, (n - c) / n AS retention_rate,
                   r AS total_potential_revenue, l AS expected_lost_revenue,
                   r - l AS expected_retained_revenue, (r - l) / r AS revenue_retention_rate
            FROM t""",
        {
            "expected_churners": 4,
            "expected_retained": 4,
            "churn_rate": 6,
            "retention_rate": 6,
            "total_potential_revenue": 2,
            "expected_lost_revenue": 2,
            "expected_retained_revenue": 2,
            "revenue_retention_rate": 6,
        },
    ),
    "histogram_density": Query(
        lambda s, d: distributions.histogram_density(
            _scenario_scores(s, d), "churn_probability", "scenario"
        ),
        f"""{_SCENARIO_SQL}, e AS (SELECT scenario, min(churn_probability) AS low,
                max(churn_probability) AS high, count(*) AS total FROM scored GROUP BY scenario),
            c AS (SELECT s.scenario, CAST(greatest(0, least(
                    floor((churn_probability - low) / ((high - low) / 30)), 29)) AS INTEGER) AS bin,
                    count(*) AS n FROM scored s JOIN e ON s.scenario = e.scenario GROUP BY ALL)
            SELECT e.scenario, CAST(g.i AS INTEGER) AS bin, low + g.i * ((high - low) / 30)
                       AS bin_start, low + (g.i + 1) * ((high - low) / 30) AS bin_end,
                   coalesce(n, 0) / (total * ((high - low) / 30)) AS density
            FROM e CROSS JOIN range(30) g(i) LEFT JOIN c ON c.scenario = e.scenario
                 AND c.bin = g.i""",
        rounds(6, "bin_start", "bin_end", "density"),
    ),
    "kde": Query(
        lambda s, d: distributions.kde(
            _scenario_scores(s, d), "churn_probability", "scenario"
        ),
        f"""{_SCENARIO_SQL}, e AS (SELECT scenario, count(*) AS total,
                min(churn_probability) AS low, max(churn_probability) AS high,
                stddev_samp(churn_probability) * pow(count(*), -0.2) AS h
                FROM scored GROUP BY scenario),
            g AS (SELECT e.*, i, low + i * (high - low) / 199 AS grid
                  FROM e CROSS JOIN range(200) r(i))
            SELECT g.scenario, CAST(i AS INTEGER) AS point, grid,
                   sum(exp(-0.5 * ((grid - churn_probability) / h) ** 2))
                       / (total * h * sqrt(2 * pi())) AS density
            FROM g JOIN scored s ON s.scenario = g.scenario
            GROUP BY g.scenario, i, grid, total, h""",
        rounds(6, "grid", "density"),
    ),
    "column_profile": Query(
        _profile,
        f"""{CLEANED}, u AS (
                SELECT 'Contract' AS feature, Contract AS value FROM cleaned
                UNION ALL SELECT 'SeniorCitizen', SeniorCitizen FROM cleaned)
            SELECT feature, 'choice' AS kind, CAST(NULL AS DOUBLE) AS mean,
                   CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min,
                   CAST(NULL AS DOUBLE) AS max, value,
                   count(*) / sum(count(*)) OVER (PARTITION BY feature) AS probability
            FROM u GROUP BY feature, value
            UNION ALL SELECT 'MonthlyCharges', 'normal', avg(MonthlyCharges),
                   stddev_samp(MonthlyCharges), NULL, NULL, NULL, NULL FROM cleaned
            UNION ALL SELECT 'TotalCharges', 'normal', avg(TotalCharges),
                   stddev_samp(TotalCharges), NULL, NULL, NULL, NULL FROM cleaned
            UNION ALL SELECT 'tenure', 'uniform', NULL, NULL, CAST(min(tenure) AS DOUBLE),
                   CAST(max(tenure) AS DOUBLE), NULL, NULL FROM cleaned""",
        {"mean": 3, "std": 3, "probability": 6},
    ),
    "check_profile": Query(
        lambda s, d: whatif.check_profile(
            _profile(s, d).withColumn(
                "std", F.when(F.col("feature") != "TotalCharges", F.col("std"))
            )
        ),
        f"""{CLEANED} SELECT * FROM (VALUES ('Contract', 'choice', NULL),
                ('SeniorCitizen', 'choice', NULL), ('tenure', 'uniform', NULL),
                ('MonthlyCharges', 'normal', NULL),
                ('TotalCharges', 'normal', 'needs mean and std')) v(feature, kind, problem)
            WHERE (SELECT count(*) FROM cleaned) > 0""",
    ),
    "shift_column": Query(
        _shifted,
        f"""{CLEANED}, m AS (SELECT avg(MonthlyCharges) AS a, stddev_samp(MonthlyCharges) AS s
                FROM cleaned),
            t AS (SELECT tenure AS v, sum(count(*)) OVER (ORDER BY tenure) - count(*) / 2 AS mid
                  FROM cleaned GROUP BY tenure),
            d AS (SELECT *, CAST(CAST(concat('0x', substr(md5(concat(customerID, 'Contract42')),
                  1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM cleaned)
            SELECT customerID, 64.76 + (MonthlyCharges - a) / s * 30.09 AS MonthlyCharges,
                   CASE WHEN u < 0.55 THEN 'Month-to-month' WHEN u < 0.55 + 0.24 THEN 'One year'
                        ELSE 'Two year' END AS Contract,
                   1 + mid / (SELECT count(*) FROM cleaned) * 71 AS tenure
            FROM d, m, t WHERE d.tenure = t.v""",
        rounds(6, "MonthlyCharges", "tenure"),
    ),
}
