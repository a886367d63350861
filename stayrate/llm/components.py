"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v != m")
    return others.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def _rounds(links: DataFrame, most: int | None = None) -> DataFrame:
    """Links after large-star and small-star rounds in turn, until they no longer change."""
    edges = links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    before, done = None, 0
    while most is None or done < most:
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1)))
        ).first()
        if state[0] == 0 or tuple(state) == before:
            break
        before, done = tuple(state), done + 1
        edges = settle(_small_star(_large_star(edges)).distinct())
    return edges


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) for links with columns a, b.

    Large-star and small-star rounds in turn, each written to the shared
    folder, until the links no longer change: then every node is linked to the
    least of its component. Nodes without a link to another are left out, and
    no links give no rows. No node's neighbours are gathered anywhere. ``links``
    is best a written table, as it is read more than once.
    """
    edges = _rounds(links)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def partial_components(links: DataFrame, rounds: int) -> DataFrame:
    """``node`` and ``component`` after a few rounds: some smaller node of its component.

    Nodes with equal components are connected; those with different ones may be
    too. A node without row is its own component.
    """
    edges = _rounds(links, rounds)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
