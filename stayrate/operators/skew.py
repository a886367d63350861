"""Joins that keep frequent values out of single tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.session import settle

#: A value holding at least this share of the rows is frequent; at most
#: ``1 / HOT_SHARE`` values can be.
HOT_SHARE = 1e-3


def sized(facts: DataFrame) -> DataFrame:
    """``facts`` written first, so that their size is known where they are joined.

    Meant for one row per group: few groups then travel to the rows, which may be
    a large part of the table and stay where they are; many are shuffled.
    """
    return settle(facts)


def lookup_join(
    rows: DataFrame, facts: DataFrame, on: Sequence[str], count: str, total: Column
) -> DataFrame:
    """Left join of ``rows`` with ``facts``, one row per value of ``on``.

    ``facts[count]`` says how many rows hold the value, ``total`` how many rows
    there are (per group of values with its own total). Frequent values are few
    and travel to the rows; the others are shuffled, none of them hot.
    """
    extra = [c for c in facts.columns if c not in (*on, count)]
    marked = facts.withColumn("hot", F.col(count) >= total * HOT_SHARE).drop(count)
    hot = marked.where("hot")
    first = rows.join(F.broadcast(hot), list(on), "left")
    done = first.where("hot").drop("hot")
    rest = first.where("hot IS NULL").drop("hot", *extra)
    cold = marked.where("NOT hot").drop("hot")
    return done.unionByName(rest.join(cold, list(on), "left"))
