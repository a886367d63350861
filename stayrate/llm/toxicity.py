"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the other texts of the sample count as
unlabelled, whatever their label says. With p the share of toxic texts, the risk
of calling clean texts toxic is that of the unlabelled minus p times that of the
positives; an estimate below zero is a sign of overfitting, and the step then
goes the other way.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import type_of
from stayrate.session import settle

FEATURES = 1 << 18
GRAM = 4
#: Most labelled rows of either kind a fit takes; it grows no further with the table.
SAMPLE = 5_000
#: Fits that are averaged; each leaves out another share of the texts.
MEMBERS = 5
EPOCHS = 15
BATCH = 256
RATE = 0.2
SPARSITY = 3e-3
REMEMBERED = 300_000
WORD = regex.compile(r"\p{L}+")


def word_features(word: str) -> list[int]:
    """Places of a word and of the pieces of four letters in it, ends marked."""
    marked = f"^{word}$"
    grams = {marked[i : i + GRAM] for i in range(max(1, len(marked) - GRAM + 1))}
    return [zlib.crc32(x.encode()) % FEATURES for x in sorted(grams | {marked})]


def text_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a text: how many distinct words have the feature, damped."""
    places = [p for w in text_words(text) for p in word_features(w)]
    found, counts = np.unique(np.array(places, np.int64), return_counts=True)
    return found.astype(np.int32), np.minimum(counts, 3).astype(np.float32)


class Scorer:
    """Logistic score of a text."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights = weights.astype(np.float32)
        self.bias = float(bias)

    def __call__(self, text: str) -> float:
        found, counts = text_features(text)
        z = self.bias + float(self.weights[found].astype(np.float64) @ counts)
        return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))


def risk_slopes(z: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Slope of the non-negative risk for each score; the first ``n`` are positives.

    The risk is the prior times the positives' loss as toxic, plus what the
    unlabelled lose as clean beyond the prior times what positives lose as clean.
    Where that excess is negative its slope is followed back up instead.
    """
    toxic = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    m = len(z) - n
    clean = np.logaddexp(0, z)
    slope = np.empty(len(z))
    if clean[n:].mean() >= prior * clean[:n].mean():
        slope[:n] = -prior / n
        slope[n:] = toxic[n:] / m
    else:
        slope[:n] = prior * toxic[:n] / n
        slope[n:] = -toxic[n:] / m
    return slope


Features = tuple[np.ndarray, np.ndarray]


def fit(
    positive: list[Features],
    unlabelled: list[Features],
    prior: float,
    epochs: int = EPOCHS,
    rate: float = RATE,
    sparsity: float = SPARSITY,
    members: int = MEMBERS,
) -> Scorer:
    """Mean of ``members`` linear fits, each with its bias set on texts it has not seen.

    The unlabelled texts are cut into as many parts. A member sets one part aside,
    takes none of its texts as a positive either, and moves its bias so that the
    prior's share of the part scores a half or more. One fit depends on the order
    of its steps; the mean does so less, and every text has a say in it. With
    fewer unlabelled texts than members nothing is set aside and no bias moved.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not positive or not unlabelled:
        return Scorer(np.zeros(FEATURES), np.log(prior / (1 - prior)))
    draw = np.random.default_rng(7)
    shown = draw.permutation(len(unlabelled))
    edges = [len(shown) * m // members if len(shown) >= members else 0 for m in range(members + 1)]
    weights, bias = np.zeros(FEATURES), 0.0
    for low, high in zip(edges, edges[1:]):
        aside = [unlabelled[i] for i in shown[low:high]]
        hidden = {places.tobytes() for places, _ in aside}
        rest = [unlabelled[i] for i in np.r_[shown[:low], shown[high:]]]
        known = [row for row in positive if row[0].tobytes() not in hidden] or positive
        one, its_bias = _fit_one(known, rest, prior, epochs, rate, sparsity, draw)
        if len(aside) > 1:
            z = np.sort([its_bias + one[p] @ v for p, v in aside])[::-1]
            at = min(max(round(prior * len(z)), 1), len(z) - 1)
            its_bias -= (z[at - 1] + z[at]) / 2
        weights += one / members
        bias += its_bias / members
    return Scorer(weights, bias)


def _fit_one(
    positive: list[Features],
    unlabelled: list[Features],
    prior: float,
    epochs: int,
    rate: float,
    sparsity: float,
    draw: np.random.Generator,
) -> tuple[np.ndarray, float]:
    """Weights and bias: dual averaging on the corrected risk, logistic loss and an L1 term.

    The L1 term keeps all weights at exactly zero whose mean slope stays below
    it, so that the many chance words of a long text add nothing to its score.
    """
    slopes, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    bias_slope, bias_square = 0.0, 1e-6
    start = np.log(prior / (1 - prior))
    steps = -(-len(unlabelled) // BATCH)
    share = -(-len(positive) // steps)
    done = 0

    def weight(at: np.ndarray | slice) -> np.ndarray:
        mean = slopes[at] / max(done, 1)
        kept = np.sign(mean) * np.maximum(np.abs(mean) - sparsity, 0)
        return -rate * done * kept / np.sqrt(squares[at])

    for _ in range(epochs):
        order_p, order_u = draw.permutation(len(positive)), draw.permutation(len(unlabelled))
        for step in range(steps):
            some_p = [positive[i] for i in order_p[step * share : (step + 1) * share]]
            some_p = some_p or [positive[i] for i in order_p[:share]]
            some_u = [unlabelled[i] for i in order_u[step * BATCH : (step + 1) * BATCH]]
            rows = some_p + some_u
            places = np.concatenate([r[0] for r in rows])
            values = np.concatenate([r[1] for r in rows]).astype(np.float64)
            owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
            bias = start - rate * bias_slope / np.sqrt(bias_square)
            z = bias + np.bincount(owner, weight(places) * values, len(rows))
            slope = risk_slopes(z, len(some_p), prior)
            gradient = np.bincount(places, slope[owner] * values, FEATURES)
            used = np.flatnonzero(gradient)
            slopes[used] += gradient[used]
            squares[used] += gradient[used] ** 2
            bias_slope += slope.sum()
            bias_square += slope.sum() ** 2
            done += 1
    return weight(slice(None)), start - rate * bias_slope / np.sqrt(bias_square)


def _decoded(value: pa.Scalar) -> str:
    raw = value.as_py()
    return "" if raw is None else raw.decode("utf-8", "replace")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_features(_decoded(t)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("toxic"),
                pa.array([f.tobytes() for f, _ in found], pa.binary()),
                pa.array([c.astype(np.uint8).tobytes() for _, c in found], pa.binary()),
            ],
            names=["toxic", "places", "counts"],
        )


def _scores(scorer: Scorer) -> Callable:
    """Scores of whole texts; equal to ``Scorer`` but for remembered word features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for value in batch.column("text"):
                parts = []
                for word in text_words(_decoded(value)):
                    part = remembered.get(word)
                    if part is None:
                        if len(remembered) >= REMEMBERED:
                            remembered.clear()
                        part = np.array(word_features(word), np.int32).tobytes()
                        remembered[word] = part
                    parts.append(part)
                places = np.sort(np.frombuffer(b"".join(parts), np.int32))
                if len(places):
                    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
                    counts = np.minimum(np.diff(np.r_[first, len(places)]), 3)
                    z = scorer.weights[places[first]].astype(np.float64) @ counts
                else:
                    z = 0.0
                out.append(1 / (1 + np.exp(-np.clip(scorer.bias + z, -30.0, 30.0))))
            at = batch.schema.get_field_index("text")
            yield batch.remove_column(at).append_column("score", pa.array(out, pa.float64()))

    return run


def held_out(id_column: Column) -> Column:
    """Rows kept from training: crc32 of the id as text divisible by 5."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Scorer:
    """Fits a scorer on labelled rows outside the held-out fifth.

    Positives are at most ``sample`` rows labelled 1; the unlabelled texts are at
    most ``sample`` of all labelled rows, taken without regard to their label.
    Both are the rows with the smallest id hash, so that reruns agree. The class
    prior is the share of 1 over all labelled training rows. Rows without label
    or id do not count, and conflicting labels of an id count as 1. Of several
    texts of an id one is taken, that with the least hash, so that the bound holds
    for rows too. Without positives every text gets the prior as its score.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .where(~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .withColumn("place", F.xxhash64("id"))
    )
    known = settle(known)
    total, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not total:
        return fit([], [], 0.5)
    positive = known.where("toxic = 1").orderBy("place").limit(sample)
    unlabelled = known.orderBy(F.xxhash64("place")).limit(sample)
    chosen = positive.select("id", F.lit(1).alias("toxic")).unionAll(
        unlabelled.select("id", F.lit(0).alias("toxic"))
    )
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    texts = texts.join(F.broadcast(settle(chosen)), "id").groupBy("id", "toxic")
    texts = texts.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")
    rows = settle(texts.mapInArrow(_extract, "toxic int, places binary, counts binary"))
    sides: dict[int, list] = {0: [], 1: []}
    ordered = rows.orderBy("toxic", F.xxhash64("places"))
    for row in ordered.toLocalIterator():
        sides[row.toxic].append(
            (np.frombuffer(row.places, np.int32), np.frombuffer(row.counts, np.uint8))
        )
    return fit(sides[1], sides[0], (toxic or 0) / total)


def score(
    docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of every document.

    A null text counts as empty and gets the score of no words; a null id is
    hashed as an empty text. Repeated rows give repeated rows, an empty table
    none; other columns are not read.
    """
    kind = type_of(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    scored = rows.mapInArrow(_scores(scorer), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean_documents(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns as they are."""
    return docs.mapInArrow(_filter(scorer, text_col), docs.schema)


def _filter(scorer: Scorer, text_col: str) -> Callable:
    score_batch = _scores(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col).cast(pa.binary())
            one = pa.RecordBatch.from_arrays([text], names=["text"])
            scores = next(score_batch(iter([one]))).column("score").to_numpy()
            yield batch.filter(pa.array(scores < 0.5))

    return run
