"""Mixing sources to target weights by histograms over document hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import word_count
from stayrate.session import settle

HASH_DIGITS = 15
HASH_BITS = 4 * HASH_DIGITS
LEVEL_BITS = 10


def document_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the md5 of id and text."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(text_col)))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def source_targets(
    sized: DataFrame, weights: Sequence[int], share: float, most: float
) -> DataFrame:
    """``source``, ``source_size`` and ``target``, one row per source.

    Sources in code point order, null last, take the weights in turn. Targets
    divide ``share`` times all sizes by weight; none passes ``most`` times its
    source, and what is over goes to the others by weight. Sorted by the level
    at which each source is full, the sources that are full come first, and
    the rest share what is left at one common level.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    filled = everything.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    weighed = sums.withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)) + 1),
            "cap": F.col("source_size") * F.lit(float(most)),
        }
    )
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(
        F.sum("cap").over(filled), F.lit(0.0)
    )
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    levels = weighed.withColumn("level", left / rest).withColumn(
        "open", F.col("cap") > F.col("weight") * F.col("level")
    )
    # Levels fall from the first open source on, so the first has the largest.
    common = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.when(F.col("open"), F.col("weight") * common).otherwise(F.col("cap"))
    return levels.select("source", "source_size", target.alias("target"))


def _thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``source`` and ``below``: documents with a smaller hash are taken once more.

    Each round sums sizes by source and hash bucket, finds the bucket in which
    the budget ends, and goes on with the documents of that bucket alone.
    """
    need = plan.where("extra > 0").select(
        F.col("source").alias("s"), F.col("extra").alias("need")
    )
    edge = sized.join(need, sized["source"].eqNullSafe(need["s"])).drop("s")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("hash", shift)
        sums = edge.groupBy("source", "need", bucket.alias("bucket")).agg(
            F.sum("size").alias("held"),
            F.min("hash").alias("low"),
            F.max("hash").alias("high"),
        )
        order = Window.partitionBy("source").orderBy("bucket")
        before = F.sum("held").over(order) - F.col("held")
        cuts = settle(
            sums.withColumn("before", before)
            .where("before < need and need <= before + held")
            .select(
                F.col("source").alias("s"),
                "low",
                "high",
                "held",
                (F.col("need") - F.col("before")).alias("within"),
            )
        )
        if cuts.where("low < high").isEmpty():
            break
        edge = settle(
            edge.join(
                cuts, edge["source"].eqNullSafe(cuts["s"]) & edge["hash"].between(cuts["low"], cuts["high"])
            ).select("source", "hash", "size", F.col("within").alias("need"))
        )
    taken = F.col("within") >= F.col("held") / 2
    return cuts.select("s", (F.col("low") + taken.cast("long")).alias("below"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``.

    ``size`` counts words (null text: 0). Each source takes all its documents
    as often as its target holds the source, and once more those whose hash
    lies below the source's threshold, so that its words come as near to the
    target as whole documents allow. The hash is of id and text: repeats of a
    row are taken alike, and reruns agree. A null source is a source like any
    other, and one without words has target 0. An empty table gives no rows;
    other columns are not read.
    """
    sized = settle(_sized(docs, id_col, text_col, source_col))
    facts = source_facts(sized, weights, share, most)
    again = F.coalesce(F.col("hash") < F.col("below"), F.lit(False)).cast("long")
    return sized.join(facts, sized["source"].eqNullSafe(facts["p"])).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("rounds") + again)).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix of ``mix_sources`` takes it.

    Texts stay where they are read; only the facts of the sources travel.
    Documents without words, null texts included, are in no mix; a null source is
    a source like any other, a repeated row is taken as often as each of its
    repeats, and an empty table gives no rows. Columns may have any names.
    """
    sized = settle(_sized(docs, id_col, text_col, source_col))
    facts = source_facts(sized, weights, share, most).select("p", "rounds", "below")
    again = F.coalesce(F.col("hash") < F.col("below"), F.lit(False)).cast("int")
    times = F.col("rounds").cast("int") + again
    # The caller's row is one column, so that its names meet none of these.
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(source_col).alias("from_source"),
        word_count(text_col).alias("size"),
        document_hash(id_col, text_col).alias("hash"),
    )
    joined = rows.join(facts, F.col("from_source").eqNullSafe(F.col("p")))
    taken = joined.where((F.col("size") > 0) & (times > 0))
    copies = F.explode(F.array_repeat(F.lit(True), times)).alias("copy")
    return taken.select("row", copies).select("row.*")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        document_hash(id_col, text_col).alias("hash"),
    )


def source_facts(
    sized: DataFrame, weights: Sequence[int], share: float, most: float
) -> DataFrame:
    """Per source ``p``: its size and target, whole rounds, and the hash threshold."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    plan = settle(
        source_targets(sized, weights, share, most)
        .withColumn("rounds", F.coalesce(rounds, F.lit(0)).cast("long"))
        .withColumn("extra", F.col("target") - F.col("rounds") * F.col("source_size"))
    )
    below = _thresholds(sized, plan)
    return plan.join(below, plan["source"].eqNullSafe(below["s"]), "left").select(
        F.col("source").alias("p"), "source_size", "target", "rounds", "below"
    )
