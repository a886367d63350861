"""Registered queries: cleaning, quality and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayrate.functions.cleaning import NUMBER_PATTERN
from stayrate.operators import association, cleaning, distributions, quality, segments
from stayrate.plans.oracle_views import ACCOUNTS, CLEANED, COLUMNS, FEATURED
from stayrate.plans.registry import Query, rounds
from stayrate.schema import ADDONS, CATEGORICAL, DERIVED, FEATURE_COLUMNS, SERVICES
from stayrate.sources.accounts import load_accounts


def cleaned(spark, sf_dir):
    return cleaning.clean_accounts(load_accounts(spark, sf_dir))


def featured(spark, sf_dir):
    return cleaning.derive_features(cleaned(spark, sf_dir))


def labelled(spark, sf_dir):
    return cleaning.binary_label(featured(spark, sf_dir))


def _on(source, operator, *args, **kwargs):
    return lambda spark, sf_dir: operator(source(spark, sf_dir), *args, **kwargs)


def _medians(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    medians = cleaning.median_values(df, ("tenure", "MonthlyCharges", "TotalCharges"))
    return spark.createDataFrame(list(medians.items()), "column string, median double")


def _features_only(spark, sf_dir):
    features, rows = cleaning.split_features_target(featured(spark, sf_dir))
    return rows.select(*features)


def _text_rows(spark, sf_dir):
    df = load_accounts(spark, sf_dir)
    return df.select(*[F.col(c).cast("string") for c in df.columns])


def _subset(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    return segments.internet_users(df.where("Churn = 'Yes'")).select(
        "customerID", "InternetService", "Contract", "tenure"
    )


def _trend(spark, sf_dir):
    points = segments.churn_rate_by(featured(spark, sf_dir), "NumAdditionalServices")
    return segments.trend_line(points, "NumAdditionalServices", "churn_rate")


def _add_stamps(df):
    return df.withColumns(
        {"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
    )


def _flawed(spark, sf_dir):
    """Accounts with every kind of issue: a column absent, nulls, a wrong type, odd values."""
    df = cleaning.coerce_total(load_accounts(spark, sf_dir)).drop("PaymentMethod")
    known = F.when(F.col("Contract") != "One year", F.col("SeniorCitizen"))
    return df.withColumns({"SeniorCitizen": known, "MultipleLines": F.col("InternetService")})


_YES = "CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END"
_RATE = f"avg({_YES}) * 100"
_BAND = (
    "CASE WHEN tenure > 0 AND tenure <= 12 THEN '0-12' WHEN tenure > 12 AND tenure <= 24 "
    "THEN '13-24' WHEN tenure > 24 AND tenure <= 48 THEN '25-48' "
    "WHEN tenure > 48 AND tenure <= 72 THEN '49-72' END"
)
_BANDS = "(VALUES ('0-12'), ('13-24'), ('25-48'), ('49-72')) AS b(band)"


def _per_band_sql(value: str, name: str) -> str:
    return f"""{CLEANED}, banded AS (SELECT {_BAND} AS band, {value} AS v FROM cleaned)
        SELECT b.band, avg(v) AS {name} FROM {_BANDS}
        LEFT JOIN banded ON banded.band = b.band GROUP BY b.band"""


def _long_sql(columns, where="true") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS service, {c} AS value, {_YES} AS churned FROM cleaned WHERE {where}"
        for c in columns
    )


def _histogram_sql(source: str, ranges: str, bins: int) -> str:
    """Counts per Churn and bin, given a CTE prefix and a (Churn, low, high) query."""
    return f"""{source}, ranges AS (
            SELECT Churn, CASE WHEN low = high THEN low - 0.5 ELSE low END AS low,
                   CASE WHEN low = high THEN high + 0.5 ELSE high END AS high FROM ({ranges})),
        binned AS (
            SELECT v.Churn, CAST(greatest(0, least(
                floor((x - low) / ((high - low) / {bins})), {bins - 1})) AS INTEGER) AS bin
            FROM vals v JOIN ranges r ON v.Churn = r.Churn),
        counted AS (SELECT Churn, bin, count(*) AS n FROM binned GROUP BY ALL)
        SELECT r.Churn, CAST(g.i AS INTEGER) AS bin,
               low + g.i * ((high - low) / {bins}) AS bin_start,
               low + (g.i + 1) * ((high - low) / {bins}) AS bin_end,
               coalesce(n, 0) AS n
        FROM ranges r CROSS JOIN range({bins}) g(i)
        LEFT JOIN counted c ON c.Churn = r.Churn AND c.bin = g.i"""


_VALS = f"{CLEANED}, vals AS (SELECT Churn, MonthlyCharges AS x FROM cleaned)"
_TENURES = f"{CLEANED}, vals AS (SELECT Churn, CAST(tenure AS DOUBLE) AS x FROM cleaned)"
_CORR_SOURCE = f"""{CLEANED}, recoded AS (
    SELECT CAST({_YES} AS DOUBLE) AS Churn, CAST(tenure AS DOUBLE) AS tenure, MonthlyCharges,
           TotalCharges, CAST(SeniorCitizen AS DOUBLE) AS SeniorCitizen,
           CASE WHEN Partner = 'Yes' THEN 1.0 ELSE 0.0 END AS Partner,
           CASE WHEN Dependents = 'Yes' THEN 1.0 ELSE 0.0 END AS Dependents FROM cleaned)"""
_CORR_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation FROM recoded"
    for a in association.CORRELATED
    for b in association.CORRELATED
)
_LABELLED = f"{FEATURED}, labelled AS (SELECT *, {_YES} AS label FROM featured)"


def _t_sql(c: str) -> str:
    return f"""
        SELECT '{c}' AS feature, m1 AS mean_churned, m0 AS mean_not_churned,
               (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)
                                * (1.0 / n1 + 1.0 / n0)) AS t_statistic,
               CAST(n1 + n0 - 2 AS DOUBLE) AS dof
        FROM (SELECT count({c}) FILTER (label = 1) AS n1, count({c}) FILTER (label = 0) AS n0,
                     avg({c}) FILTER (label = 1) AS m1, avg({c}) FILTER (label = 0) AS m0,
                     var_samp({c}) FILTER (label = 1) AS v1,
                     var_samp({c}) FILTER (label = 0) AS v0 FROM labelled)"""


def _box_sql() -> str:
    return f"""{_VALS}, q AS (
            SELECT Churn, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                   quantile_cont(x, 0.75) AS q3 FROM vals GROUP BY Churn)
        SELECT q.Churn, q1, median, q3,
               min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
                   AS whisker_low,
               max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
                   AS whisker_high,
               count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
                   AS outliers
        FROM vals JOIN q ON vals.Churn = q.Churn GROUP BY ALL"""


def _quintile_sql() -> str:
    return f"""{FEATURED}, e AS (
            SELECT unnest(list_sort(list_distinct(quantile_cont(MonthlyToTotalRatio,
                   [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])))) AS edge FROM featured),
        ends AS (SELECT CAST(row_number() OVER (ORDER BY edge) AS INTEGER) AS bin,
                        edge AS bin_start, lead(edge) OVER (ORDER BY edge) AS bin_end FROM e)
        SELECT bin, bin_start, bin_end, count(Churn) AS n, {_RATE} AS churn_rate
        FROM ends LEFT JOIN featured ON MonthlyToTotalRatio <= bin_end
             AND (MonthlyToTotalRatio > bin_start OR (bin = 1 AND MonthlyToTotalRatio = bin_start))
        WHERE bin_end IS NOT NULL GROUP BY ALL"""


def _describe_sql(columns) -> str:
    return f"{FEATURED} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean,
            stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
            CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q25,
            CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS q50,
            CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q75, CAST(max({c}) AS DOUBLE) AS max
            FROM featured"""
        for c in columns
    )


_REASON = f"""
    CASE WHEN NOT regexp_matches(trim(TotalCharges), '{NUMBER_PATTERN}')
              THEN 'TotalCharges: not a number'
         WHEN TRY_CAST(trim(TotalCharges) AS DOUBLE) < 0 THEN 'TotalCharges: negative' END"""

_DQ_MISSING = [c for c in (*ADDONS, "InternetService")]
_NULL_SQL = " UNION ALL ".join(
    f"SELECT 'missing_values' AS category, '{c}' AS \"column\", 'null' AS detail, "
    f"count(*) FILTER ({c} IS NULL) AS n FROM coerced"
    for c in ("customerID", "tenure", "MonthlyCharges", "TotalCharges", "Churn")
)

QUERIES: dict[str, Query] = {
    # cleaning and features
    "coerce_total": Query(
        lambda s, d: cleaning.coerce_total(load_accounts(s, d)).select(
            "customerID", "TotalCharges"
        ),
        f"{CLEANED} SELECT customerID, TotalCharges FROM coerced",
    ),
    "impute_total": Query(
        lambda s, d: cleaning.impute_total(
            cleaning.coerce_total(load_accounts(s, d))
        ).select("customerID", "TotalCharges"),
        f"{CLEANED} SELECT customerID, TotalCharges FROM cleaned",
        rounds(6, "TotalCharges"),
    ),
    "senior_to_string": Query(
        lambda s, d: cleaning.senior_to_string(load_accounts(s, d)).select(
            "customerID", "SeniorCitizen"
        ),
        f"{CLEANED} SELECT customerID, SeniorCitizen FROM cleaned",
    ),
    "clean_accounts": Query(
        cleaned,
        f"{CLEANED} SELECT {COLUMNS} FROM cleaned",
    ),
    "monthly_to_total_ratio": Query(
        lambda s, d: cleaning.with_charge_ratio(cleaned(s, d)).select(
            "customerID", "MonthlyToTotalRatio"
        ),
        f"{FEATURED} SELECT customerID, MonthlyToTotalRatio FROM featured",
        rounds(6, "MonthlyToTotalRatio"),
    ),
    "num_additional_services": Query(
        lambda s, d: cleaning.with_addon_count(cleaned(s, d)).select(
            "customerID", "NumAdditionalServices"
        ),
        f"{FEATURED} SELECT customerID, NumAdditionalServices FROM featured",
    ),
    "has_internet": Query(
        lambda s, d: cleaning.with_internet_flag(cleaned(s, d)).select(
            "customerID", "HasInternetService"
        ),
        f"{FEATURED} SELECT customerID, HasInternetService FROM featured",
    ),
    "derive_features": Query(
        featured,
        f"{FEATURED} SELECT {', '.join(FEATURE_COLUMNS)} FROM featured",
        rounds(6, "MonthlyToTotalRatio"),
    ),
    "cap_outliers": Query(
        lambda s, d: cleaning.cap_outliers(
            cleaned(s, d), ("tenure", "MonthlyCharges", "TotalCharges")
        ).select("customerID", "tenure", "MonthlyCharges", "TotalCharges"),
        f"""{CLEANED}, q AS (SELECT
                quantile_cont(tenure, 0.01) AS tl, quantile_cont(tenure, 0.99) AS th,
                quantile_cont(MonthlyCharges, 0.01) AS ml,
                quantile_cont(MonthlyCharges, 0.99) AS mh,
                quantile_cont(TotalCharges, 0.01) AS cl,
                quantile_cont(TotalCharges, 0.99) AS ch FROM cleaned)
            SELECT customerID, greatest(tl, least(th, CAST(tenure AS DOUBLE))) AS tenure,
                   greatest(ml, least(mh, MonthlyCharges)) AS MonthlyCharges,
                   greatest(cl, least(ch, TotalCharges)) AS TotalCharges
            FROM cleaned, q""",
        # 11 places: unit charges carry no tie there.
        {"tenure": 6, "MonthlyCharges": 11, "TotalCharges": 6},
    ),
    "median_values": Query(
        _medians,
        f"""{CLEANED} SELECT 'tenure' AS "column", CAST(median(tenure) AS DOUBLE) AS median
            FROM cleaned
            UNION ALL SELECT 'MonthlyCharges', median(MonthlyCharges) FROM cleaned
            UNION ALL SELECT 'TotalCharges', median(TotalCharges) FROM cleaned""",
        rounds(6, "median"),
    ),
    "split_features_target": Query(
        _features_only,
        f"{FEATURED} SELECT * EXCLUDE (customerID, Churn) FROM featured",
        rounds(6, "MonthlyToTotalRatio"),
    ),
    "binary_label": Query(
        lambda s, d: labelled(s, d).select("customerID", "label"),
        f"{_LABELLED} SELECT customerID, label FROM labelled",
    ),
    "recode_binary": Query(
        lambda s, d: cleaning.recode_binary(cleaned(s, d)).select(
            "customerID", *cleaning.BINARY_RECODES
        ),
        f"""{CLEANED} SELECT customerID, {', '.join(
            f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {c}"
            for c, v in cleaning.BINARY_RECODES.items())} FROM cleaned""",
    ),
    "subset_rows": Query(
        _subset,
        f"""{CLEANED} SELECT customerID, InternetService, Contract, tenure FROM cleaned
            WHERE Churn = 'Yes' AND InternetService <> 'No'""",
    ),
    "drop_nonfeatures": Query(
        lambda s, d: cleaning.drop_nonfeatures(_add_stamps(load_accounts(s, d))),
        f"{ACCOUNTS} SELECT * EXCLUDE (Churn) FROM accounts",
    ),
    "retype_columns": Query(
        lambda s, d: cleaning.retype_columns(
            featured(s, d), ("SeniorCitizen", "HasInternetService")
        ).select("customerID", "SeniorCitizen", "HasInternetService"),
        f"""{FEATURED} SELECT customerID, SeniorCitizen,
            CAST(HasInternetService AS VARCHAR) AS HasInternetService FROM featured""",
    ),
    # quality
    "dq_missing_columns": Query(
        lambda s, d: quality.missing_columns(
            featured(s, d), (*CATEGORICAL, "customerID", "Churn", *DERIVED)
        ),
        f"{ACCOUNTS} "
        + " UNION ALL ".join(
            f"SELECT 'missing_columns' AS category, '{c}' AS \"column\", 'absent' AS detail, "
            "count(*) AS n FROM accounts"
            for c in _DQ_MISSING
        ),
    ),
    "dq_null_counts": Query(
        lambda s, d: quality.null_counts(cleaning.coerce_total(load_accounts(s, d))),
        f"{CLEANED} SELECT * FROM ({_NULL_SQL}) WHERE n > 0",
    ),
    "dq_types": Query(
        lambda s, d: quality.type_issues(load_accounts(s, d)),
        f"""{ACCOUNTS}
            SELECT 'data_type_issues' AS category, 'TotalCharges' AS "column",
                   'should be numeric, is string' AS detail, count(*) AS n FROM accounts
            UNION ALL
            SELECT 'data_type_issues', 'SeniorCitizen',
                   'should be categorical, is int', count(*) FROM accounts""",
    ),
    "dq_senior_domain": Query(
        lambda s, d: quality.senior_domain(
            cleaned(s, d).withColumn("SeniorCitizen", F.expr("nullif(Contract, 'One year')"))
        ),
        f"""{CLEANED} SELECT 'value_issues' AS category, 'SeniorCitizen' AS "column",
                'not ''0'' or ''1''' AS detail, count(*) AS n FROM cleaned""",
    ),
    "dq_service_domain": Query(
        lambda s, d: quality.service_domain(
            cleaned(s, d).withColumn("MultipleLines", F.col("InternetService"))
        ),
        f"""{CLEANED} SELECT 'value_issues' AS category, 'MultipleLines' AS "column",
                InternetService AS detail, count(*) AS n FROM cleaned
            WHERE InternetService <> 'No' GROUP BY InternetService""",
    ),
    "quality_report": Query(
        lambda s, d: quality.quality_report(_flawed(s, d)),
        f"""{ACCOUNTS}, whole AS (SELECT count(*) AS n FROM accounts)
            SELECT 'missing_columns' AS category, 'PaymentMethod' AS "column",
                   'absent' AS detail, n FROM whole WHERE n > 0
            UNION ALL SELECT * FROM (
                SELECT 'missing_values', 'SeniorCitizen', 'null',
                       count(*) FILTER (Contract = 'One year') AS n FROM accounts
                UNION ALL SELECT 'missing_values', 'TotalCharges', 'null',
                       count(*) FILTER (TRY_CAST(trim(TotalCharges) AS DOUBLE) IS NULL)
                FROM accounts
                UNION ALL SELECT 'value_issues', 'SeniorCitizen', 'not ''0'' or ''1''',
                       count(*) FILTER (Contract = 'One year') FROM accounts) WHERE n > 0
            UNION ALL SELECT 'data_type_issues', 'SeniorCitizen',
                   'should be categorical, is int', n FROM whole WHERE n > 0
            UNION ALL SELECT 'value_issues', 'MultipleLines', InternetService, count(*)
            FROM accounts WHERE InternetService <> 'No' GROUP BY InternetService""",
    ),
    "valid_rows": Query(
        lambda s, d: quality.valid_rows(_text_rows(s, d)),
        f"""{ACCOUNTS} SELECT * REPLACE (
                TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges)
            FROM accounts WHERE {_REASON} IS NULL""",
    ),
    "rejected_rows": Query(
        lambda s, d: quality.rejected_rows(_text_rows(s, d)).select(
            "customerID", "TotalCharges", "reason"
        ),
        f"""{ACCOUNTS}, r AS (SELECT customerID, TotalCharges, {_REASON} AS reason FROM accounts)
            SELECT * FROM r WHERE reason IS NOT NULL""",
    ),
    # segments
    "churn_kpis": Query(
        _on(cleaned, segments.churn_kpis),
        f"""{CLEANED} SELECT count(*) AS total_customers,
                CAST(sum({_YES}) AS BIGINT) AS churned_customers,
                sum({_YES}) / count(*) * 100 AS churn_rate, avg(tenure) AS avg_tenure,
                avg(MonthlyCharges) AS avg_monthly_charges
            FROM cleaned HAVING count(*) > 0""",
        rounds(6, "churn_rate", "avg_tenure", "avg_monthly_charges"),
    ),
    "churn_by_contract": Query(
        _on(cleaned, segments.churn_by_contract),
        f"""{CLEANED} SELECT Contract, count(*) AS total, CAST(sum({_YES}) AS BIGINT) AS churned,
                sum({_YES}) / count(*) * 100 AS rate FROM cleaned GROUP BY Contract""",
        rounds(6, "rate"),
    ),
    "churn_rate_by": Query(
        _on(cleaned, segments.churn_rate_by, "PaymentMethod"),
        f"""{CLEANED} SELECT PaymentMethod, {_RATE} AS churn_rate FROM cleaned
            WHERE PaymentMethod IS NOT NULL GROUP BY PaymentMethod""",
        rounds(6, "churn_rate"),
    ),
    "value_counts": Query(
        _on(cleaned, segments.value_counts, "InternetService"),
        f"""{CLEANED} SELECT InternetService, count(*) AS n FROM cleaned
            WHERE InternetService IS NOT NULL GROUP BY InternetService""",
    ),
    "value_shares": Query(
        _on(cleaned, segments.value_shares, "Churn"),
        f"""{CLEANED} SELECT Churn, count(*) / (SELECT count(Churn) FROM cleaned) AS share
            FROM cleaned WHERE Churn IS NOT NULL GROUP BY Churn""",
        rounds(6, "share"),
    ),
    "distinct_values": Query(
        _on(cleaned, segments.distinct_values, "Contract"),
        f"{CLEANED} SELECT DISTINCT Contract FROM cleaned",
    ),
    "label_share_pivot": Query(
        _on(cleaned, segments.label_share_pivot, "Contract"),
        f"""{CLEANED} SELECT Contract, avg(CASE WHEN Churn = 'No' THEN 1 ELSE 0 END) AS "No",
                avg({_YES}) AS "Yes" FROM cleaned GROUP BY Contract""",
        rounds(6, "No", "Yes"),
    ),
    "crosstab": Query(
        lambda s, d: segments.crosstab(labelled(s, d), "HasInternetService", "label"),
        f"""{_LABELLED} SELECT HasInternetService, label, count(*) AS n FROM labelled
            GROUP BY ALL""",
    ),
    "churned_retained": Query(
        _on(cleaned, segments.churned_retained, "Contract"),
        f"""{CLEANED} SELECT Contract, CAST(sum({_YES}) AS BIGINT) AS churned,
                CAST(sum(1 - {_YES}) AS BIGINT) AS retained FROM cleaned GROUP BY Contract""",
    ),
    "churn_by_tenure_band": Query(
        _on(cleaned, segments.churn_by_tenure_band),
        _per_band_sql(f"{_YES} * 100", "churn_rate"),
        rounds(6, "churn_rate"),
    ),
    "charges_by_tenure_band": Query(
        _on(cleaned, segments.charges_by_tenure_band),
        _per_band_sql("MonthlyCharges", "avg_monthly_charges"),
        rounds(6, "avg_monthly_charges"),
    ),
    "churn_by_service": Query(
        _on(cleaned, segments.churn_by_service),
        f"""{CLEANED} SELECT service, value, avg(churned) * 100 AS churn_rate
            FROM ({_long_sql(SERVICES)}) WHERE value IS NOT NULL GROUP BY ALL""",
        rounds(6, "churn_rate"),
    ),
    "service_impact": Query(
        _on(cleaned, segments.service_impact),
        f"""{CLEANED} SELECT service, avg(churned) FILTER (value = 'Yes') * 100 AS has_service,
                avg(churned) FILTER (value = 'No') * 100 AS no_service
            FROM ({_long_sql(segments.IMPACT_SERVICES, "InternetService <> 'No'")})
            GROUP BY service""",
        rounds(6, "has_service", "no_service"),
    ),
    "class_balance": Query(
        _on(cleaned, segments.class_balance),
        f"""{CLEANED} SELECT CAST(sum(1 - {_YES}) AS BIGINT) AS negatives,
                CAST(sum({_YES}) AS BIGINT) AS positives,
                coalesce(sum(1 - {_YES}) / nullif(sum({_YES}), 0), 1.0) AS positive_weight
            FROM cleaned""",
        rounds(6, "positive_weight"),
    ),
    "survival_curve": Query(
        _on(cleaned, segments.survival_curve),
        f"""{CLEANED} SELECT t, count(*) FILTER (Churn = 'No') AS retained, count(*) AS total,
                count(*) FILTER (Churn = 'No') / count(*) AS survival_rate
            FROM range(1, (SELECT max(tenure) + 1 FROM cleaned)) g(t)
            JOIN cleaned ON tenure >= t GROUP BY t""",
        rounds(6, "survival_rate"),
    ),
    "trend_line": Query(
        _trend,
        f"""{FEATURED}, points AS (SELECT NumAdditionalServices AS x, {_RATE} AS y
                FROM featured GROUP BY NumAdditionalServices)
            SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM points""",
        rounds(6, "slope", "intercept"),
    ),
    "head_rows": Query(
        lambda s, d: segments.head_rows(featured(s, d), "customerID").select(
            "customerID", *DERIVED
        ),
        f"""{FEATURED} SELECT customerID, {', '.join(DERIVED)} FROM featured
            ORDER BY customerID LIMIT 10""",
        rounds(6, "MonthlyToTotalRatio"),
    ),
    # distributions
    "histogram_by_class": Query(
        _on(cleaned, distributions.histogram_by_class, "MonthlyCharges"),
        _histogram_sql(
            _VALS, "SELECT Churn, min(x) AS low, max(x) AS high FROM vals GROUP BY Churn", 30
        ),
        rounds(6, "bin_start", "bin_end"),
    ),
    "histogram_shared": Query(
        _on(cleaned, distributions.histogram_shared, "tenure"),
        _histogram_sql(
            _TENURES,
            "SELECT DISTINCT Churn, (SELECT min(x) FROM vals) AS low, "
            "(SELECT max(x) FROM vals) AS high FROM vals",
            20,
        ),
        rounds(6, "bin_start", "bin_end"),
    ),
    "box_stats": Query(
        _on(cleaned, distributions.box_stats, "MonthlyCharges"),
        _box_sql(),
        rounds(6, "q1", "median", "q3", "whisker_low", "whisker_high"),
    ),
    "churn_by_ratio_quintile": Query(
        _on(featured, distributions.churn_by_quantile_bin, "MonthlyToTotalRatio"),
        _quintile_sql(),
        rounds(6, "bin_start", "bin_end", "churn_rate"),
    ),
    "describe_columns": Query(
        _on(featured, distributions.describe_columns, DERIVED),
        _describe_sql(DERIVED),
        rounds(6, "mean", "std", "min", "q25", "q50", "q75", "max"),
    ),
    # association
    "correlation_matrix": Query(
        lambda s, d: association.correlation_matrix(cleaning.recode_binary(cleaned(s, d))),
        f"{_CORR_SOURCE} {_CORR_PAIRS}",
        rounds(6, "correlation"),
    ),
    "label_correlation": Query(
        lambda s, d: association.label_correlation(labelled(s, d), DERIVED, "label"),
        f"{_LABELLED} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, corr({c}, label) AS correlation FROM labelled"
            for c in DERIVED
        ),
        rounds(6, "correlation"),
    ),
    "t_test": Query(
        lambda s, d: association.t_test(labelled(s, d), DERIVED[:2], "label").drop("p_value"),
        f"{_LABELLED} " + " UNION ALL ".join(_t_sql(c) for c in DERIVED[:2]),
        rounds(6, "mean_churned", "mean_not_churned", "t_statistic"),
    ),
    "chi_square": Query(
        lambda s, d: association.chi_square(
            labelled(s, d), "HasInternetService", "label"
        ).drop("p_value"),
        f"""{_LABELLED}, o AS (SELECT HasInternetService AS r, label AS c, count(*) AS n
                FROM labelled GROUP BY ALL),
            e AS (SELECT n, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c)
                         / sum(n) OVER () AS e FROM o)
            SELECT sum((abs(n - e) - least(0.5, abs(n - e))) ** 2 / e) AS chi2,
                   CAST(1 AS DOUBLE) AS dof FROM e""",
        rounds(6, "chi2"),
    ),
}
