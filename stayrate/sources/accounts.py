"""Account view over order history: one row per ordering customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.schema import ACCOUNT_COLUMNS

CUSTOMER_SCHEMA = "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string"
ORDERS_SCHEMA = (
    "o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)

# The order attribute whose odd count means an add-on is taken.
_ADDON_RULES = {
    "OnlineSecurity": "o_orderpriority = '1-URGENT'",
    "OnlineBackup": "o_orderpriority = '2-HIGH'",
    "DeviceProtection": "o_orderpriority = '3-MEDIUM'",
    "TechSupport": "o_orderpriority = '4-NOT SPECIFIED'",
    "StreamingTV": "o_orderpriority = '5-LOW'",
    "StreamingMovies": "o_orderstatus = 'P'",
}

_HISTORY = {
    "first_order": "min(o_orderdate)",
    "last_order": "max(o_orderdate)",
    "n": "count(*)",
    "t": "sum(cast(o_totalprice as decimal(12,2)))",
    **{addon: f"count_if({rule}) % 2 = 1" for addon, rule in _ADDON_RULES.items()},
}

_TENURE = (
    "(year(dmax) * 12 + month(dmax) - year(first_order) * 12 - month(first_order) "
    "+ c_custkey) % 75"
)

_COLUMNS = {
    "customerID": "cast(c_custkey as string)",
    "gender": "if(c_custkey % 2 = 0, 'Male', 'Female')",
    "SeniorCitizen": "if(c_custkey % 6 = 0, 1, 0)",
    "Partner": "if(c_nationkey % 2 = 0, 'Yes', 'No')",
    "Dependents": "if(c_custkey % 3 = 0, 'Yes', 'No')",
    "tenure": "tenure",
    "PhoneService": "if(c_nationkey % 10 = 0, 'No', 'Yes')",
    "MultipleLines": "case when c_nationkey % 10 = 0 then 'No phone service' "
    "when c_nationkey % 3 = 0 then 'Yes' else 'No' end",
    "InternetService": "case n % 3 when 0 then 'No' when 1 then 'DSL' else 'Fiber optic' end",
    **{
        addon: f"case when n % 3 = 0 then 'No internet service' "
        f"when {addon} then 'Yes' else 'No' end"
        for addon in _ADDON_RULES
    },
    "Contract": "case c_mktsegment when 'FURNITURE' then 'One year' "
    "when 'HOUSEHOLD' then 'Two year' else 'Month-to-month' end",
    "PaperlessBilling": "if(c_acctbal > 4000, 'Yes', 'No')",
    "PaymentMethod": "case c_custkey % 4 when 0 then 'Electronic check' "
    "when 1 then 'Mailed check' when 2 then 'Bank transfer (automatic)' "
    "else 'Credit card (automatic)' end",
    "MonthlyCharges": "cast(t as double) / (1000 * greatest(tenure, 1))",
    "TotalCharges": "if(c_custkey % 40 = 0, ' ', cast(t as string))",
    "Churn": "if(last_order < dmax - interval 180 day, 'Yes', 'No')",
}


def accounts_from_orders(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Raw account rows (``ACCOUNT_COLUMNS``) from customers and their orders.

    Orders are reduced per customer before the join, so the join meets at most
    one row per key on either side. Aggregates nobody asks for are pruned.
    """
    history = orders.groupBy("o_custkey").agg(
        *[F.expr(f"{rule} as {name}") for name, rule in _HISTORY.items()]
    )
    latest = orders.selectExpr("max(o_orderdate)").scalar()
    return (
        customer.join(history, F.expr("c_custkey = o_custkey"))
        .withColumn("dmax", latest)
        .selectExpr("*", f"{_TENURE} as tenure")
        .selectExpr(*[f"{_COLUMNS[c]} as {c}" for c in ACCOUNT_COLUMNS])
    )


def load_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account view over the ``customer`` and ``orders`` Parquet tables."""
    return accounts_from_orders(
        spark.read.schema(CUSTOMER_SCHEMA).parquet(f"{sf_dir}/customer.parquet"),
        spark.read.schema(ORDERS_SCHEMA).parquet(f"{sf_dir}/orders.parquet"),
    )
