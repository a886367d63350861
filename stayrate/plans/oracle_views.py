"""SQL text of the account view and what is built on it, for the oracle side."""

from __future__ import annotations

from stayrate.functions import scoring as S
from stayrate.functions.cleaning import NUMBER_PATTERN
from stayrate.schema import ACCOUNT_COLUMNS, ADDONS

_FLAGS = {
    "OnlineSecurity": "o_orderpriority = '1-URGENT'",
    "OnlineBackup": "o_orderpriority = '2-HIGH'",
    "DeviceProtection": "o_orderpriority = '3-MEDIUM'",
    "TechSupport": "o_orderpriority = '4-NOT SPECIFIED'",
    "StreamingTV": "o_orderpriority = '5-LOW'",
    "StreamingMovies": "o_orderstatus = 'P'",
}
_COUNTS = ", ".join(f"count(*) FILTER ({c}) AS f_{a}" for a, c in _FLAGS.items())
_ADDON_COLUMNS = ", ".join(
    f"CASE WHEN n % 3 = 0 THEN 'No internet service' "
    f"WHEN f_{a} % 2 = 1 THEN 'Yes' ELSE 'No' END AS {a}"
    for a in ADDONS
)

_VIEWS = {
    "history": f"""
        SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
               count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS t, {_COUNTS}
        FROM orders GROUP BY o_custkey""",
    "joined": """
        SELECT c.*, h.*, d.dmax,
               ((year(d.dmax) * 12 + month(d.dmax))
                - (year(h.first_order) * 12 + month(h.first_order)) + c_custkey) % 75 AS tenure
        FROM customer c JOIN history h ON c.c_custkey = h.o_custkey,
             (SELECT max(o_orderdate) AS dmax FROM orders) d""",
    "accounts": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS customerID,
               CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
               CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
               CASE WHEN c_nationkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
               CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
               tenure,
               CASE WHEN c_nationkey % 10 = 0 THEN 'No' ELSE 'Yes' END AS PhoneService,
               CASE WHEN c_nationkey % 10 = 0 THEN 'No phone service'
                    WHEN c_nationkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS MultipleLines,
               CASE n % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'DSL' ELSE 'Fiber optic' END
                   AS InternetService,
               {_ADDON_COLUMNS},
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'One year'
                    WHEN 'HOUSEHOLD' THEN 'Two year' ELSE 'Month-to-month' END AS Contract,
               CASE WHEN c_acctbal > 4000 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
               CASE c_custkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
                    WHEN 2 THEN 'Bank transfer (automatic)'
                    ELSE 'Credit card (automatic)' END AS PaymentMethod,
               CAST(t AS DOUBLE) / (1000 * greatest(tenure, 1)) AS MonthlyCharges,
               CASE WHEN c_custkey % 40 = 0 THEN ' ' ELSE CAST(t AS VARCHAR) END AS TotalCharges,
               CASE WHEN last_order < dmax - INTERVAL 180 DAY THEN 'Yes' ELSE 'No' END AS Churn
        FROM joined""",
    "coerced": f"""
        SELECT * REPLACE (
            CASE WHEN regexp_matches(trim(TotalCharges), '{NUMBER_PATTERN}')
                 THEN TRY_CAST(trim(TotalCharges) AS DOUBLE) END AS TotalCharges)
        FROM accounts""",
    "cleaned": """
        SELECT * REPLACE (
            coalesce(TotalCharges, MonthlyCharges * tenure) AS TotalCharges,
            CAST(SeniorCitizen AS VARCHAR) AS SeniorCitizen)
        FROM coerced""",
    "featured": f"""
        SELECT * EXCLUDE ({", ".join(ADDONS)}, InternetService),
               least(1.0, coalesce(CASE WHEN tenure = 0 THEN 1.0
                   ELSE MonthlyCharges / nullif(TotalCharges + 1e-6, 0) END, 0.0))
                   AS MonthlyToTotalRatio,
               CAST({" + ".join(f"(CASE WHEN {a} = 'Yes' THEN 1 ELSE 0 END)" for a in ADDONS)}
                   AS INTEGER) AS NumAdditionalServices,
               CASE WHEN InternetService = 'No' THEN 0 ELSE 1 END AS HasInternetService
        FROM cleaned""",
}


def _after(*names: str) -> str:
    return ", ".join(f"{n} AS ({_VIEWS[n]})" for n in names)


ACCOUNTS = f"WITH {_after('history', 'joined', 'accounts')}"
CLEANED = f"WITH {_after('history', 'joined', 'accounts', 'coerced', 'cleaned')}"
FEATURED = f"WITH {_after(*_VIEWS)}"

_CASES = " ".join(
    f"+ (CASE WHEN {c} = '{v}' THEN {w} ELSE 0.0 END)"
    for (c, v), w in S.SCORECARD_LEVELS.items()
)


def probability(**swaps: str) -> str:
    """Scorecard probability in SQL; ``swaps`` replaces columns by expressions."""
    z = f"CAST({S.SCORECARD_INTERCEPT} AS DOUBLE)"
    for c, w in S.SCORECARD_WEIGHTS.items():
        z += f" + CAST({w} AS DOUBLE) * coalesce(CAST({swaps.get(c, c)} AS DOUBLE), 0.0)"
    return f"(1.0 / (1.0 + exp(-({z} {_CASES}))))"


def band(p: str) -> str:
    cases = " ".join(f"WHEN {p} >= {floor} THEN '{name}'" for floor, name in S.RISK_BANDS)
    return f"CASE {cases} ELSE '{S.LOWEST_BAND}' END"


SCORED = f"""{FEATURED}, scored AS (
    SELECT f.*, {probability()} AS churn_probability FROM featured f)"""

COLUMNS = ", ".join(ACCOUNT_COLUMNS)
