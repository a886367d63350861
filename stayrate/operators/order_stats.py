"""Exact order statistics without sorting or shuffling the rows.

Every round is one aggregate over all requested columns. A bracket around each
wanted rank shrinks by the accuracy of ``percentile_approx`` per round until
few enough values lie inside to pick from; only counts and a bounded number of
values ever reach the driver. Correctness rests on the exact counts, not on the
sketch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values per bracket that may be gathered into one row.
GATHER_LIMIT = 200_000
ACCURACY = 20_000


@dataclass
class _Bracket:
    """Where one wanted rank lies: strictly inside (low, high) unless found."""

    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0  # values <= low
    inside: int = 0  # values strictly between
    value: float | None = None


def _inside(b: _Bracket) -> Column:
    c = F.col(b.column)
    bounds = F.lit(True)
    if b.low is not None:
        bounds = bounds & (c > b.low)
    if b.high is not None:
        bounds = bounds & (c < b.high)
    return F.when(bounds & c.isNotNull(), c)


def _pick(data: DataFrame, brackets: list[_Bracket]) -> None:
    """Read the wanted values out of brackets that hold few values."""
    row = data.agg(
        *[
            F.element_at(
                F.sort_array(F.collect_list(_inside(b))), b.rank - b.below + 1
            ).alias(f"v{i}")
            for i, b in enumerate(brackets)
        ]
    ).first()
    for i, b in enumerate(brackets):
        b.value = row[f"v{i}"]


def _narrow(data: DataFrame, brackets: list[_Bracket]) -> None:
    """Shrink every bracket around its rank, by sketch first and exact counts after."""
    margin = 2.0 / ACCURACY
    sketches = []
    for i, b in enumerate(brackets):
        share = (b.rank - b.below) / max(b.inside - 1, 1)
        probs = [max(0.0, share - margin), min(1.0, share + margin)]
        sketches.append(
            F.percentile_approx(_inside(b), probs, ACCURACY).alias(f"s{i}")
        )
    row = data.agg(*sketches).first()
    guesses = [row[f"s{i}"] for i in range(len(brackets))]

    counts = []
    for i, (b, (lo, hi)) in enumerate(zip(brackets, guesses)):
        c = _inside(b)
        for name, condition in (
            ("lt", c < lo),
            ("lo", c == lo),
            ("mid", (c > lo) & (c < hi)),
            ("hi", (c == hi) & F.lit(lo < hi)),
        ):
            counts.append(F.count_if(condition).alias(f"{name}{i}"))
    row = data.agg(*counts).first()

    for i, (b, (lo, hi)) in enumerate(zip(brackets, guesses)):
        at_lo = b.below + row[f"lt{i}"]
        after_lo = at_lo + row[f"lo{i}"]
        after_mid = after_lo + row[f"mid{i}"]
        after_hi = after_mid + row[f"hi{i}"]
        end = b.below + b.inside
        if b.rank < at_lo:
            b.high, b.inside = lo, row[f"lt{i}"]
        elif b.rank < after_lo:
            b.value = lo
        elif b.rank < after_mid:
            b.low, b.high, b.below, b.inside = lo, hi, after_lo, row[f"mid{i}"]
        elif b.rank < after_hi:
            b.value = hi
        else:
            b.low, b.below, b.inside = hi, after_hi, end - after_hi


def values_at_ranks(
    df: DataFrame,
    columns: Mapping[str, Column],
    ranks: Callable[[dict[str, int]], Mapping[str, Sequence[int]]],
    gather_limit: int = GATHER_LIMIT,
) -> tuple[dict[str, int], dict[str, dict[int, float]]]:
    """Non-null counts per column, and the values at the 0-based ranks asked for.

    ``ranks`` is told all counts and names the ranks per column. Ranks outside
    a column are ignored. NaN counts as null.
    """
    names = list(columns)
    if not names:
        return {}, {}
    internal = {name: f"c{i}" for i, name in enumerate(names)}
    # Only these numbers are kept, so later rounds do not redo what made them.
    data = df.select(
        *[
            F.nanvl(columns[name].cast("double"), F.lit(None)).alias(internal[name])
            for name in names
        ]
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = data.agg(*[F.count(c).alias(c) for c in internal.values()]).first()
        sizes = {name: row[internal[name]] for name in names}
        brackets = {
            (name, r): _Bracket(internal[name], r, inside=sizes[name])
            for name, wanted in ranks(sizes).items()
            for r in set(wanted)
            if 0 <= r < sizes[name]
        }
        pending = list(brackets.values())
        while pending:
            few = [b for b in pending if b.inside <= gather_limit]
            if few:
                _pick(data, few)
            wide = [b for b in pending if b.value is None]
            if wide:
                _narrow(data, wide)
            pending = [b for b in wide if b.value is None]
    finally:
        data.unpersist()
    found: dict[str, dict[int, float]] = {name: {} for name in names}
    for (name, r), b in brackets.items():
        found[name][r] = b.value
    return sizes, found


def quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    gather_limit: int = GATHER_LIMIT,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation; None for a column of nulls."""

    def wanted(sizes: dict[str, int]) -> dict[str, list[int]]:
        places = {name: [(n - 1) * q for q in probs] for name, n in sizes.items() if n}
        return {
            name: [r for h in found for r in (math.floor(h), math.ceil(h))]
            for name, found in places.items()
        }

    sizes, values = values_at_ranks(df, columns, wanted, gather_limit)
    result: dict[str, list[float | None]] = {}
    for name, n in sizes.items():
        result[name] = []
        for q in probs:
            if not n:
                result[name].append(None)
                continue
            h = (n - 1) * q
            low, high = values[name][math.floor(h)], values[name][math.ceil(h)]
            result[name].append(low + (high - low) * (h - math.floor(h)))
    return result
