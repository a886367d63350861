"""Rebalancing by synthetic rows: SMOTE, ADASYN, SMOTEN and cluster centroids.

All work on encoded rows ``(key, features vector, label 0/1)`` and on distinct
vectors with their number of copies, so a vector that many rows share is one
point with a large quota. Randomness is a hash of the point and draw number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.operators.neighbours import BLOCK, assign_cells, choose_pivots, nearest
from stayrate.operators.resampling import (
    SEED,
    _cutoffs,
    _up_to,
    class_counts,
    extra_rows,
    kept_rows,
)
from stayrate.operators.skew import lookup_join
from stayrate.schema import KEY
from stayrate.session import settle

CLASSES = (0, 1)
#: Synthetic rows one task makes from one point before the work is spread.
CHUNK = 10_000
#: Further cells of the first round of a search; a round costs more than a few cells do.
FIRST_CELLS = 8
#: Most centres fitted in one block.
MAX_CENTROIDS = 1_000


def _vectors(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        F.col(key).cast("string").alias("key"),
        vector_to_array("features").alias("vec"),
        F.col("label").cast("int").alias("label"),
    )


def _with_quota(
    rows: DataFrame, n_minor: int, extra: int, minor: int, seed: int
) -> DataFrame:
    """Minority rows with how many synthetic rows each starts."""
    whole, rest = divmod(extra, n_minor)
    _, cutoffs = _cutoffs(rows, "key", seed, "label", [minor], lambda _: {minor: [rest]})
    more = _up_to(cutoffs, "label", "key", seed).cast("bigint")
    return rows.where(F.col("label") == minor).withColumn("quota", F.lit(whole) + more)


def _distinct(rows: DataFrame, *sums: Column) -> DataFrame:
    return rows.groupBy("vec").agg(F.min("key").alias("vid"), *sums)


def _neighbour_vectors(k: int) -> Column:
    """The ``k`` nearest rows' vectors: copies of the point first, then others."""
    copies = F.array_repeat(F.col("vec"), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    others = F.flatten(
        F.transform(
            "neighbours",
            lambda x: F.array_repeat(x["vec"], F.least(x["n"], F.lit(k)).cast("int")),
        )
    )
    return F.slice(F.concat(copies, others), 1, k)


def _draws(points: DataFrame) -> DataFrame:
    """Each point repeated ``quota`` times with the draw number.

    A point with a large quota is cut into chunks that different tasks expand.
    """
    points = points.where("quota > 0")
    top = points.agg(F.max("quota")).first()[0] or 0
    zero, chunk = F.lit(0).cast("bigint"), F.lit(CHUNK).cast("bigint")
    chunks = points.withColumn(
        "first", F.explode(F.sequence(zero, F.col("quota") - 1, chunk))
    )
    if top > CHUNK:
        chunks = chunks.repartition("vid", "first")
    last = F.least(F.col("first") + CHUNK, F.col("quota")) - 1
    return chunks.withColumn("draw", F.explode(F.sequence("first", last)))


def _hash_unit(name: str, seed: int) -> Column:
    text = F.concat_ws("|", "vid", F.col("draw").cast("string"), F.lit(f"{name}|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def _interpolated(points: DataFrame, neighbours: DataFrame, k: int, seed: int) -> DataFrame:
    """Synthetic ``(vid, draw, vec)`` between points and a drawn neighbour."""
    drawn = _draws(
        points.join(neighbours.hint("merge"), "vid", "left")
        .withColumn("neighbours", F.coalesce("neighbours", F.array()))
        .withColumn("near", _neighbour_vectors(k))
        .select("vid", "vec", "quota", "near")
    )
    pick = F.floor(_hash_unit("pick", seed) * F.size("near")).cast("int") + 1
    step = _hash_unit("step", seed)
    return (
        drawn.where(F.size("near") > 0)
        .withColumn("target", F.element_at("near", pick))
        .withColumn("step", step)
        .select(
            "vid",
            "draw",
            F.zip_with("vec", "target", lambda a, b: a + F.col("step") * (b - a)).alias("vec"),
        )
    )


def _keep(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        F.col(key).cast("string").alias(key), "features", F.col("label").cast("int")
    )


def _with_synthetic(df: DataFrame, synthetic: DataFrame, label: int, key: str) -> DataFrame:
    """Original rows and the synthetic ones, as ``(key, features, label)``."""
    made = synthetic.select(
        F.concat_ws("_", F.lit("synthetic"), "vid", "draw").alias(key),
        array_to_vector("vec").alias("features"),
        F.lit(label).cast("int").alias("label"),
    )
    return _keep(df, key).unionByName(made)


def minority_neighbours(df: DataFrame, k: int, key: str = KEY) -> DataFrame:
    """``vid`` and the ``k`` nearest others of every distinct minority vector.

    The first of them are the neighbours for a smaller ``k``, so that one search
    serves several runs of SMOTE on the same rows.
    """
    counts = class_counts(df, "label", CLASSES)
    minor, _ = extra_rows(counts, 1.0, False)
    rows = _vectors(df, key).where(F.col("label") == minor)
    points = settle(_distinct(rows, F.count("*").alias("n")))
    return nearest(points, points, k, ["n"], FIRST_CELLS)


def smote(
    df: DataFrame,
    ratio: float = 1.0,
    k: int = 5,
    key: str = KEY,
    seed: int = SEED,
    strict: bool = True,
    neighbours: DataFrame | None = None,
) -> DataFrame:
    """Add minority points drawn between a point and one of its ``k`` neighbours.

    ``neighbours`` are those of ``minority_neighbours`` on the same rows, for
    ``k`` or more.
    """
    counts = class_counts(df, "label", CLASSES)
    minor, extra = extra_rows(counts, ratio, strict)
    if extra == 0:
        return _keep(df, key)
    if counts[minor] < 2:
        raise ValueError("needs at least two minority rows")
    rows = _with_quota(_vectors(df, key), counts[minor], extra, minor, seed)
    points = settle(
        _distinct(rows, F.count("*").alias("n"), F.sum("quota").alias("quota"))
    )
    near = nearest(points, points, k, ["n"], FIRST_CELLS) if neighbours is None else neighbours
    near = near.select("vid", F.slice("neighbours", 1, k).alias("neighbours"))
    return _with_synthetic(df, _interpolated(points, near, k, seed), minor, key)


def adasyn(
    df: DataFrame,
    ratio: float = 1.0,
    k: int = 5,
    key: str = KEY,
    seed: int = SEED,
    strict: bool = True,
) -> DataFrame:
    """SMOTE with more points where more neighbours are of the majority.

    Among equally near rows, minority rows of a vector come before majority ones.
    """
    counts = class_counts(df, "label", CLASSES)
    minor, extra = extra_rows(counts, ratio, strict)
    if extra == 0:
        return _keep(df, key)
    everyone = settle(
        _distinct(
            _vectors(df, key),
            F.count_if(F.col("label") == minor).alias("n"),
            F.count_if(F.col("label") != minor).alias("against"),
        )
    )
    mine = everyone.where("n > 0")
    around = nearest(mine, everyone, k, ["n", "against"])

    friends = F.least(F.col("n") - 1, F.lit(k))
    foes = F.least(F.lit(k) - friends, F.col("against"))
    start = F.struct((k - friends - foes).alias("left"), foes.alias("foes"))

    def step(seen, x):
        mates = F.least(seen["left"], x["n"])
        rivals = F.least(seen["left"] - mates, x["against"])
        return F.struct(
            (seen["left"] - mates - rivals).alias("left"),
            (seen["foes"] + rivals).alias("foes"),
        )

    walked = F.aggregate("neighbours", start, step)
    difficulty = settle(
        mine.join(around.hint("merge"), "vid", "left")
        .withColumn("neighbours", F.coalesce("neighbours", F.array()))
        .select("vid", "vec", "n", (walked["foes"] / k).alias("hard"))
    )
    total = difficulty.agg(F.sum(F.col("n") * F.col("hard"))).first()[0]
    if not total:
        raise ValueError("no minority row has a majority neighbour")
    per_row = F.rint(F.col("hard") / F.lit(total) * extra).cast("bigint")
    points = difficulty.withColumn("quota", F.col("n") * per_row)
    neighbours = nearest(difficulty, difficulty, k, ["n"])
    return _with_synthetic(df, _interpolated(points, neighbours, k, seed), minor, key)


def _embedded(rows: DataFrame, minor: int) -> DataFrame:
    """Distinct vectors placed by how each entry's value shifts the class odds.

    With two classes the value-difference distance of two vectors is the
    Euclidean distance of twice the minority shares of their entries' values.
    """
    points = settle(
        _distinct(
            rows,
            F.count("*").alias("all"),
            F.count_if(F.col("label") == minor).alias("n"),
        )
    )
    entries = points.select("vid", "all", "n", F.posexplode("vec").alias("slot", "x"))
    facts = entries.groupBy("slot", "x").agg(
        F.sum("all").alias("rows"), (2 * F.sum("n") / F.sum("all")).alias("place")
    )
    total = points.agg(F.count("*")).scalar()
    held = entries.groupBy("slot", "x").agg(F.count("*").alias("held"))
    facts = facts.join(held, ["slot", "x"]).drop("rows")
    placed = lookup_join(
        entries.where("n > 0").select("vid", "slot", "x"), facts, ["slot", "x"], "held", total
    )
    # The list has one entry per slot, hence a fixed length.
    place = placed.groupBy("vid").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("slot", "place"))), lambda e: e["place"]
        ).alias("place")
    )
    return points.where("n > 0").join(place.hint("merge"), "vid").select("vid", "vec", "n", "place")


def smoten(
    df: DataFrame,
    ratio: float = 1.0,
    k: int = 5,
    key: str = KEY,
    seed: int = SEED,
    strict: bool = True,
) -> DataFrame:
    """Add minority points whose every entry is the commonest among ``k`` neighbours.

    Entries are categories; vectors that differ only in ways that leave the
    class shares alike are at distance 0.
    """
    counts = class_counts(df, "label", CLASSES)
    minor, extra = extra_rows(counts, ratio, strict)
    if extra == 0:
        return _keep(df, key)
    rows = _vectors(df, key)
    quotas = _with_quota(rows, counts[minor], extra, minor, seed)
    quota = quotas.groupBy("vec").agg(F.sum("quota").alias("quota")).where("quota > 0")
    points = settle(_embedded(rows, minor).join(quota.hint("merge"), "vec", "left"))

    placed = points.select("vid", F.col("place").alias("vec"), F.col("vec").alias("source"), "n")
    around = nearest(placed, placed, k, ["n", "source"]).withColumn(
        "neighbours",
        F.transform(
            "neighbours",
            lambda x: F.struct(x["source"].alias("vec"), x["n"].alias("n")),
        ),
    )

    def commonest(i):
        values = F.transform("near", lambda v: F.element_at(v, i))
        ranked = F.transform(
            F.array_distinct(values),
            lambda x: F.struct(
                (-F.size(F.filter(values, lambda y: y == x))).alias("votes"), x.alias("x")
            ),
        )
        return F.array_min(ranked)["x"]

    voted = (
        points.join(around.hint("merge"), "vid", "left")
        .withColumn("neighbours", F.coalesce("neighbours", F.array()))
        .withColumn("near", _neighbour_vectors(k))
        .where((F.size("near") > 0) & F.col("quota").isNotNull())
        .withColumn("vec", F.transform(F.sequence(F.lit(1), F.size("vec")), commonest))
        .select("vid", "vec", "quota")
    )
    return _with_synthetic(df, _draws(voted), minor, key)


def _local_centres(x: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """Lloyd's algorithm on one bounded block."""
    if k >= len(x):
        return x
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def cluster_centroids(
    df: DataFrame,
    ratio: float = 1.0,
    key: str = KEY,
    seed: int = SEED,
    strict: bool = True,
) -> DataFrame:
    """Replace the majority by as many cluster centres as the ratio asks for.

    Centres are fitted in bounded blocks of nearby rows, each with its share of
    the centres, so their number may grow with the data. The same rows give the
    same centres however they are laid out.
    """
    counts = class_counts(df, "label", CLASSES)
    major, wanted = kept_rows(counts, ratio, strict)
    crowd = df.where(F.col("label") == major)
    made = _block_centres(_vectors(crowd, key), counts[major], wanted, seed)
    return _with_synthetic(df.where(F.col("label") != major), made, major, key)


def _block_centres(rows: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
    points = rows.select(F.col("key").alias("vid"), "vec")
    cells = settle(assign_cells(points, choose_pivots(points, n)))
    # A block is bounded in rows and in centres.
    share = F.lit(float(wanted)) / n
    most = F.greatest(F.col("size") / BLOCK, F.col("size") * share / MAX_CENTROIDS)
    blocks = F.greatest(F.ceil(most), F.lit(1))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size"))
    blocked = cells.join(F.broadcast(sizes), "cell").withColumn(
        "block", F.pmod(F.xxhash64("vid"), blocks).cast("int")
    )
    # Cumulative shares, rounded down at both ends, add up to ``wanted``.
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")
    )
    upto = Window.partitionBy("cell").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    quotas = (
        blocked.groupBy("cell", "block")
        .agg(F.count("*").alias("rows"))
        .withColumn("end", F.sum("rows").over(upto))
        .join(F.broadcast(offsets), "cell")
        .withColumn("end", F.col("before") + F.col("end"))
        .select(
            "cell",
            "block",
            (
                F.floor(F.col("end") * share + 1e-6)
                - F.floor((F.col("end") - F.col("rows")) * share + 1e-6)
            )
            .cast("int")
            .alias("k"),
        )
    )

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        if not first["k"]:
            return pd.DataFrame({"vid": [], "draw": [], "vec": []})
        x = np.stack([np.asarray(v, dtype=float) for v in group.sort_values("vid")["vec"]])
        place = seed + int(first["cell"]) * 7919 + int(first["block"])
        found = _local_centres(x, int(first["k"]), place)
        return pd.DataFrame(
            {
                "vid": f"{first['cell']}_{first['block']}",
                "draw": range(len(found)),
                "vec": list(found),
            }
        )

    return (
        blocked.join(quotas, ["cell", "block"])
        .select("cell", "block", "k", "vid", "vec")
        .groupBy("cell", "block")
        .applyInPandas(centres, "vid string, draw int, vec array<double>")
    )

