"""Column expressions that clean raw account fields and derive features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spelling of a number, and the ratio's divisor guard.
# ``try_cast`` alone is too lenient: it reads '1d' as a number.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
RATIO_EPSILON = 1e-6


def text_to_number(c: Column) -> Column:
    """Number held in a text column; blank or malformed text becomes NULL."""
    text = F.trim(c)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def imputed_total(total: Column, monthly: Column, tenure: Column) -> Column:
    """Missing totals become ``monthly * tenure``, hence 0 for new accounts."""
    return F.coalesce(total, monthly * tenure)


def flag_to_string(c: Column) -> Column:
    """Whole-number flag as text, NULL kept."""
    return c.cast("int").cast("string")


def charge_ratio(monthly: Column, total: Column, tenure: Column) -> Column:
    """Monthly over total charges: 1 for new accounts, 0 if unknown, at most 1."""
    ratio = F.when(tenure == 0, 1.0).otherwise(
        F.try_divide(monthly, total + F.lit(RATIO_EPSILON))
    )
    return F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0)))


def count_yes(columns: Sequence[str]) -> Column:
    """How many of ``columns`` are 'Yes'; NULL counts as not."""
    return reduce(add, [F.col(c).eqNullSafe("Yes").cast("int") for c in columns])


def internet_flag(service: Column) -> Column:
    """0 if the service is 'No', else 1; a missing service counts as 1."""
    return (~service.eqNullSafe("No")).cast("int")


def is_yes(c: Column) -> Column:
    """1 for 'Yes', 0 for anything else including NULL."""
    return c.eqNullSafe("Yes").cast("int")
