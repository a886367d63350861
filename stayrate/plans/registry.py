"""Registered queries: a Spark callable, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """``rounds`` maps columns to the places both sides are compared at."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rounds: Mapping[str, int] = field(default_factory=dict)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)
        if not self.rounds:
            return df
        # Adding zero turns a rounded -0.0 into 0.0.
        return df.withColumns({c: F.round(c, n) + 0.0 for c, n in self.rounds.items()})

    def oracle(self) -> str | None:
        if self.sql is None or not self.rounds:
            return self.sql
        columns = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in self.rounds.items())
        return f"SELECT * REPLACE ({columns}) FROM ({self.sql})"


def rounds(places: int, *columns: str) -> dict[str, int]:
    return {c: places for c in columns}
