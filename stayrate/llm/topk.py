"""Exact top-k inner products by vector-approximation files.

The approximation holds each component as a small cell number. A scan over the
cells bounds every score from both sides; exact vectors are read in the order of
their bound, until no bound left can change the k-th result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from stayrate.session import settle

SCALE = 1024
CELL_BITS = 6
#: Queries of one scan; bounds what travels to the tasks.
QUERY_BLOCK = 4096
BLOCK_ROWS = 4096
READ_AT_ONCE = 32
#: Largest component for which 64-bit sums over 1,024 components cannot overflow.
EXACT_BELOW = 1 << 26


#: A block of the approximation: where its vectors are, their cells, the cells' bounds.
BLOCK = (
    "block long, width int, places array<long>, ids array<long>, cells binary, "
    "low array<long>, step array<long>"
)
Queries = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _blocks(bits: int) -> Callable:
    """Packs rows into blocks of cells; a block is named by its first row's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids, vectors = (
                batch.column(c).to_pylist() for c in ("place", "vec_id", "vector")
            )
            groups: dict[int, list] = {}
            for row in zip(places, ids, vectors):
                groups.setdefault(len(row[2]), []).append(row)
            for width, rows in groups.items():
                for start in range(0, len(rows), BLOCK_ROWS):
                    some = rows[start : start + BLOCK_ROWS]
                    exact = np.array([v for _, _, v in some], np.int64).reshape(len(some), width)
                    low = exact.min(axis=0) if width else np.zeros(0, np.int64)
                    high = exact.max(axis=0) if width else np.zeros(0, np.int64)
                    step = (high - low) // (1 << bits) + 1
                    cells = ((exact - low) // step).astype(np.uint8)
                    longs = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([some[0][0]], pa.int64()),
                            "width": pa.array([width], pa.int32()),
                            "places": pa.array([[p for p, _, _ in some]], longs),
                            "ids": pa.array([[i for _, i, _ in some]], longs),
                            "cells": pa.array([cells.tobytes()], pa.binary()),
                            "low": pa.array([low.tolist()], longs),
                            "step": pa.array([step.tolist()], longs),
                        }
                    )

    return run


def bounds(
    queries: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of every query with every cell.

    With x in its cell, q . x lies within |q| . (step - 1) / 2 of q . centre.
    """
    centres = low + cells * step + (step - 1) / 2
    scores = queries.astype(np.float64) @ centres.T
    spread = np.abs(queries).astype(np.float64) @ ((step - 1) / 2)
    size = np.abs(queries).astype(np.float64) @ np.abs(centres).max(axis=0, initial=0.0)
    # Covers the rounding of the sums in the approximation.
    spread += size * 1e-12 + 1e-6
    return scores - spread[:, None], scores + spread[:, None]


def best_of(
    query: np.ndarray,
    upper: np.ndarray,
    least: float,
    ids: np.ndarray,
    exact: np.ndarray,
    wide: bool,
    k: int,
) -> list[tuple[int, int]]:
    """(-score, id) of the query's best k, exactly; vectors bounded below ``least`` are none.

    Exact vectors are looked at in the order of their bound, until no bound left
    can change the k-th score or, among equal scores, its id.
    """
    order = np.argsort(-upper, kind="stable")
    best: list[tuple[int, int]] = []
    for at in range(0, len(order), READ_AT_ONCE):
        some = order[at : at + READ_AT_ONCE]
        if upper[some[0]] < (-best[k - 1][0] if len(best) >= k else least):
            break
        if wide:
            found = [int(sum(map(int.__mul__, v, query.tolist()))) for v in exact[some].tolist()]
        else:
            found = (exact[some] @ query).tolist()
        best = sorted(best + [(-s, int(i)) for s, i in zip(found, ids[some])])[:k]
    return best


def _cells(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, cells, low and step of a block."""
    ids = np.asarray(row.ids, np.int64)
    cells = np.frombuffer(row.cells, np.uint8).reshape(len(ids), row.width).astype(np.int64)
    return ids, cells, np.asarray(row.low, np.int64), np.asarray(row.step, np.int64)


def _least_scores(queries: Queries, k: int) -> Callable:
    """From cells alone: each query's k greatest lower bounds in a block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for frame in frames for r in frame.itertuples(index=False)):
            if row.width not in queries:
                continue
            numbers, query_ids, vectors = queries[row.width]
            ids, cells, low, step = _cells(row)
            lower, _ = bounds(vectors, cells, low, step)
            lower[query_ids[:, None] == ids] = -np.inf
            if len(ids) > k:
                lower = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k :]
            out = pd.DataFrame(
                {"query": np.repeat(numbers, lower.shape[1]), "least": lower.ravel()}
            )
            yield out[out["least"] > -np.inf]

    return run


def _wanted(queries: Queries, least: dict[int, float]) -> Callable:
    """From cells alone: what is left of a block, its vectors some query has to see."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for frame in frames for r in frame.itertuples(index=False)):
            if row.width not in queries:
                continue
            numbers, query_ids, vectors = queries[row.width]
            ids, cells, low, step = _cells(row)
            _, upper = bounds(vectors, cells, low, step)
            floor = np.array([least.get(int(n), -np.inf) for n in numbers])
            open_ = (upper >= floor[:, None]) & (query_ids[:, None] != ids)
            seen = open_.any(axis=0)
            if seen.any():
                yield pd.DataFrame(
                    {
                        "block": [row.block],
                        "width": [row.width],
                        "places": [np.asarray(row.places, np.int64)[seen]],
                        "ids": [ids[seen]],
                        "cells": [cells[seen].astype(np.uint8).tobytes()],
                        "low": [row.low],
                        "step": [row.step],
                        "asking": [numbers[open_.any(axis=1)]],
                    }
                )

    return run


def _exact_scores(queries: Queries, least: dict[int, float], k: int) -> Callable:
    """The best k of a block for each query that asks, from its cells and the vectors read."""
    limits = np.iinfo(np.int64)

    def run(blocks: pd.DataFrame, read: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples(index=False):
            numbers, query_ids, vectors = queries[row.width]
            ids, cells, low, step = _cells(row)
            by_place = dict(zip(read["place"], read["vector"]))
            exact = np.array([by_place[p] for p in row.places], np.int64)
            exact = exact.reshape(len(ids), row.width)
            asking = np.isin(numbers, row.asking)
            _, upper = bounds(vectors[asking], cells, low, step)
            largest = max(np.abs(exact).max(initial=0), np.abs(vectors).max(initial=0))
            wide = int(largest) >= EXACT_BELOW
            for q, n, identity, bound in zip(
                vectors[asking], numbers[asking], query_ids[asking], upper
            ):
                other = ids != identity
                floor = least.get(int(n), -np.inf)
                best = best_of(q, bound[other], floor, ids[other], exact[other], wide, k)
                out += [(identity, i, min(max(-s, limits.min), limits.max)) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def scaled_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Id and ``vector`` (array of long): floor(1024 x) of vectors that take part."""
    raw = F.col(vector_col).cast("array<double>")
    inside = F.lit(2.0**61 / SCALE)
    usable = F.forall(
        raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inside)
    )
    scaled = F.transform(raw, lambda x: F.floor(x * F.lit(float(SCALE))).cast("long"))
    return vectors.where(F.col(vector_col).isNotNull() & usable & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), scaled.alias("vector")
    )


def exact_top_k(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bits: int = CELL_BITS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's k best others.

    Queries are the rows whose id is divisible by ``every``, candidates all rows
    with another id; scores are integer inner products of floor(1024 x), ties go
    to the smaller id. Vectors that are null, or hold a null, a non-finite
    component or one of 2**51 and more, take no part, nor do rows without id; a
    score beyond 64 bits counts as the largest or smallest 64-bit number.
    Vectors of another length than the query are no candidates. A repeated row
    is one query, and as many candidates as there are rows. An empty table gives no rows.

    Cells and exact vectors are written apart, once. Queries go over them in
    blocks of bounded size: a scan of the cells gives every query the k-th
    greatest lower bound over all blocks, a second one the vectors that can still
    reach it for some query. Only these are read, each once, and every block
    keeps k rows a query. Copies of one vector are read once each at most.
    """
    spark = vectors.sparkSession
    usable = settle(
        scaled_vectors(vectors, id_col, vector_col).withColumn(
            "place", F.monotonically_increasing_id()
        )
    )
    blocks = settle(usable.mapInArrow(_blocks(bits), BLOCK))
    asked = settle(
        usable.where(F.col("vec_id") % every == 0)
        .select("vec_id", "vector")
        .repartitionByRange("vec_id")
        .sortWithinPartitions("vec_id")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = [spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")]
    after: int | None = None
    while True:
        rest = asked if after is None else asked.where(F.col("vec_id") > after)
        some = rest.orderBy("vec_id").limit(QUERY_BLOCK).collect()
        if not some:
            break
        if len(some) == QUERY_BLOCK:
            # Rows of one id stay together: they are asked in the block they end in.
            whole = [r for r in some if r.vec_id < some[-1].vec_id]
            last = some[-1].vec_id
            some = whole or asked.where(F.col("vec_id") == last).collect()
        after = some[-1].vec_id
        wanted, least, queries = open_vectors(blocks, some, k)
        wanted = settle(wanted)
        read = usable.join(
            wanted.select(F.col("block").alias("of"), F.explode("places").alias("place")), "place"
        ).select("of", "place", "vector")
        found = (
            wanted.groupBy("block")
            .cogroup(read.groupBy("of"))
            .applyInPandas(
                _exact_scores(queries, least, k), "query_id long, vec_id long, score long"
            )
        )
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        parts.append(settle(ranked.select("query_id", "rank", "vec_id", "score")))
    return reduce(DataFrame.unionAll, parts)


def open_vectors(
    blocks: DataFrame, asked: Sequence[Row], k: int
) -> tuple[DataFrame, dict[int, float], Queries]:
    """Blocks cut to the vectors some query has to see; each query's least k-th score; queries.

    ``asked`` holds the queries' ``vec_id`` and ``vector``; equal ones are one.
    """
    by_width: dict[int, dict[tuple, int]] = {}
    for row in asked:
        of_width = by_width.setdefault(len(row.vector), {})
        of_width.setdefault((row.vec_id, tuple(row.vector)), len(of_width))
    queries, first = {}, 0
    for width, rows in by_width.items():
        queries[width] = (
            np.arange(first, first + len(rows)),
            np.array([i for i, _ in rows], np.int64),
            np.array([v for _, v in rows], np.int64).reshape(len(rows), width),
        )
        first += len(rows)
    lowest = blocks.mapInPandas(_least_scores(queries, k), "query long, least double")
    ordered = Window.partitionBy("query").orderBy(F.desc("least"))
    kth = lowest.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") == k)
    least = {r["query"]: r["least"] for r in kth.collect()}
    return (
        blocks.mapInPandas(_wanted(queries, least), f"{BLOCK}, asking array<long>"),
        least,
        queries,
    )
