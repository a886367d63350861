"""Product codes of vectors, with norm-of-sum bounds between the rounds.

Every vector is cut into parts, and every part is replaced by the nearest entry
of its codebook. Between rounds each part keeps two bounds: one from above on the
distance to its entry, one from below on the distance to any other. Each bound
carries the round it was measured in. All codebooks are retained, so that a bound
is carried on by the distance between its entry of that round and of now: the
norm of the summed movements, which is never more than the sum of their norms.
Only parts that the bounds leave open are compared with entries again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import type_of
from stayrate.operators.skew import lookup_join
from stayrate.session import release, settle

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Covers the rounding of distances and of their sums, many times over.
SLACK = 1e-5
#: Base of the limbs in which components too large for 64-bit sums are totalled.
LIMB = 31
LONG = np.iinfo(np.int64)

#: One array (entries, components) per part.
Codebook = list[np.ndarray]


def integers(rows: list[list[int]], width: int) -> np.ndarray:
    """Rows as an array of 64-bit numbers, or of Python's where those are too small."""
    wide = any(not -(1 << 62) < x < 1 << 62 for row in rows for x in row)
    return np.array(rows, object if wide else np.int64).reshape(len(rows), width)


def scaled(x: float) -> int:
    """floor(SCALE * x), whatever the size of x."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def cuts(width: int) -> list[slice]:
    """The components of each part; parts are equal where the width allows it."""
    return [slice(i * width // PARTS, (i + 1) * width // PARTS) for i in range(PARTS)]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of c, exactly."""
    if x.dtype != object and c.dtype != object:
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
        most = 4 * top * top * max(1, x.shape[1])
        if most < 1 << 53:
            a, b = x.astype(np.float64), c.astype(np.float64)
            found = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
            return found.astype(np.int64)
        if most < 1 << 63:
            return ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    found = [[sum((p - q) ** 2 for p, q in zip(a, b)) for b in c.tolist()] for a in x.tolist()]
    return np.array(found, object).reshape(len(x), len(c))


def own_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from the same rows of c, exactly."""
    if x.dtype != object and c.dtype != object:
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
        if 4 * top * top * max(1, x.shape[1]) < 1 << 63:
            return ((x - c) ** 2).sum(axis=1)
    rows = zip(x.tolist(), c.tolist())
    return np.array([sum((p - q) ** 2 for p, q in zip(a, b)) for a, b in rows], object)


def roots(found: np.ndarray) -> np.ndarray:
    """Square roots as floats; infinite beyond them."""
    if found.dtype != object:
        return np.sqrt(found.astype(np.float64))
    whole = [math.isqrt(int(d)) for d in found.ravel()]
    near = [float(r) if r < 1 << 1000 else math.inf for r in whole]
    # The whole root is short of the true one by less than one.
    near = [math.sqrt(d) if r < 1 << 26 else r for r, d in zip(near, found.ravel())]
    return np.array(near, np.float64).reshape(found.shape)


def _up(bound: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(bound.astype(np.float32), np.float32(np.inf))


def _down(bound: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


@dataclass
class Bounds:
    """Of one part of many vectors: entry, both bounds, and the rounds they were measured in."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    upper_round: np.ndarray
    lower_round: np.ndarray


def scan(x: np.ndarray, entries: np.ndarray, now: int) -> Bounds:
    """Compares every row with every entry; ties go to the lower index."""
    found = squares(x, entries)
    code = np.argmin(found, axis=1).astype(np.uint8) if len(x) else np.zeros(0, np.uint8)
    near = roots(found)
    rows = np.arange(len(x))
    upper = near[rows, code]
    near[rows, code] = np.inf
    stamp = np.full(len(x), now, np.uint8)
    return Bounds(code, _up(upper), _down(near.min(axis=1, initial=np.inf)), stamp, stamp.copy())


def carry(x: np.ndarray, held: Bounds, history: list[np.ndarray]) -> tuple[Bounds, int]:
    """Bounds against the last of the codebooks, and how many rows were scanned for it.

    An entry's displacement since a bound's round is the distance between its
    places then and now. What that does not settle is measured against its own
    entry, and what is still open against all of them.
    """
    now = len(history) - 1
    moved = np.stack([roots(own_squares(history[now], old)) for old in history])
    first = moved.argmax(axis=1)
    # The largest displacement of any entry but the own one.
    rest = moved.copy()
    rest[np.arange(len(history)), first] = 0.0
    second = rest.max(axis=1, initial=0.0)
    most = moved[np.arange(len(history)), first]

    def below(code: np.ndarray, lower: np.ndarray, stamp: np.ndarray) -> np.ndarray:
        away = np.where(first[stamp] == code, second[stamp], most[stamp])
        with np.errstate(invalid="ignore"):
            return np.where(np.isinf(away), 0.0, lower - away * (1 + SLACK))

    def settled(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return upper * (1 + SLACK) + SLACK < lower * (1 - SLACK)

    code = held.code
    upper = held.upper + moved[held.upper_round, code] * (1 + SLACK)
    lower = below(code, held.lower, held.lower_round)
    out = Bounds(
        code.copy(),
        held.upper.copy(),
        held.lower.copy(),
        held.upper_round.copy(),
        held.lower_round.copy(),
    )
    left = np.flatnonzero(~settled(upper, lower))
    tight = roots(own_squares(x[left], history[now][code[left]]))
    out.upper[left], out.upper_round[left] = _up(tight), now
    left = left[~settled(tight, lower[left])]
    fresh = scan(x[left], history[now], now)
    for name in ("code", "upper", "lower", "upper_round", "lower_round"):
        getattr(out, name)[left] = getattr(fresh, name)
    return out, len(left)


STATE = (
    "vector binary, wide array<string>, code binary, upper binary, lower binary, stamps binary"
)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The integer vectors of a batch of state rows."""
    narrow, wide = batch.column("vector"), batch.column("wide")
    if wide.null_count == len(wide):
        raw = b"".join(v.as_py() for v in narrow)
        return np.frombuffer(raw, np.int32).reshape(len(batch), width).astype(np.int64)
    rows = [
        np.frombuffer(v.as_py(), np.int32).tolist() if w is None else list(map(int, w))
        for v, w in zip(narrow, wide.to_pylist())
    ]
    return integers(rows, width)


def _bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _table(column: pa.Array, kind: type, width: int) -> np.ndarray:
    raw = b"".join(v.as_py() for v in column)
    return np.frombuffer(raw, kind).reshape(len(column), width)


def _state(bounds: list[Bounds]) -> list[pa.Array]:
    def side(name: str) -> np.ndarray:
        return np.stack([getattr(b, name) for b in bounds], axis=1)

    return [
        _bytes(side("code")),
        _bytes(side("upper")),
        _bytes(side("lower")),
        _bytes(np.concatenate([side("upper_round"), side("lower_round")], axis=1)),
    ]


def _held(batch: pa.RecordBatch) -> list[Bounds]:
    code = _table(batch.column("code"), np.uint8, PARTS)
    upper = _table(batch.column("upper"), np.float32, PARTS)
    lower = _table(batch.column("lower"), np.float32, PARTS)
    stamps = _table(batch.column("stamps"), np.uint8, 2 * PARTS)
    return [
        Bounds(code[:, p], upper[:, p], lower[:, p], stamps[:, p], stamps[:, PARTS + p])
        for p in range(PARTS)
    ]


def _begin(book: Codebook, width: int) -> Callable:
    """Scales the vectors and scans the first codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[scaled(v) for v in row] for row in batch.column("raw").to_pylist()]
            x = integers(rows, width)
            fits = [all(-(1 << 31) <= v < 1 << 31 for v in row) for row in rows]
            vector = [np.array(r, np.int32).tobytes() if f else None for r, f in zip(rows, fits)]
            wide = [None if f else list(map(str, r)) for r, f in zip(rows, fits)]
            bounds = [scan(x[:, cut], c, 0) for cut, c in zip(cuts(width), book)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array(vector, pa.binary()),
                    pa.array(wide, pa.list_(pa.string())),
                    *_state(bounds),
                ],
                names=["vec_id", "label", "vector", "wide", "code", "upper", "lower", "stamps"],
            )

    return run


def _again(history: list[Codebook], width: int) -> Callable:
    """Assigns the parts anew, carrying the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, width)
            bounds = [
                carry(x[:, cut], held, [book[p] for book in history])[0]
                for p, (cut, held) in enumerate(zip(cuts(width), _held(batch)))
            ]
            kept = [batch.column(c) for c in ("vec_id", "label", "vector", "wide")]
            yield pa.RecordBatch.from_arrays([*kept, *_state(bounds)], names=batch.schema.names)

    return run


def _finish(history: list[Codebook], width: int) -> Callable:
    """Codes against the last codebook, and their exact errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, width)
            codes, error = [], [0] * len(batch)
            for p, (cut, held) in enumerate(zip(cuts(width), _held(batch))):
                found, _ = carry(x[:, cut], held, [book[p] for book in history])
                codes.append(found.code)
                off = own_squares(x[:, cut], history[-1][p][found.code])
                error = [a + int(b) for a, b in zip(error, off)]
            code = np.stack(codes, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([row.tobytes().hex() for row in np.ascontiguousarray(code)]),
                    pa.array([min(e, int(LONG.max)) for e in error], pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def _sums(width: int) -> Callable:
    """Totals of a task's parts by entry: (part, entry, at, limb, total); at -1 counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _vectors(batch, width)
            code = _table(batch.column("code"), np.uint8, PARTS)
            limb = 0
            while True:
                rest, low = None, x
                if not all(-(1 << 31) <= v < 1 << 31 for v in (x.min(initial=0), x.max(initial=0))):
                    rest = x >> LIMB
                    low = (x - (rest << LIMB)).astype(np.int64)
                total = totals.setdefault(limb, np.zeros((ENTRIES, width), np.int64))
                for p, cut in enumerate(cuts(width)):
                    np.add.at(total[:, cut], code[:, p], low[:, cut])
                if rest is None:
                    break
                x, limb = integers(rest.tolist(), width), limb + 1
            for p in range(PARTS):
                counts[p] += np.bincount(code[:, p], minlength=ENTRIES)
        out = [
            (p, int(e), -1, 0, int(counts[p, e])) for p in range(PARTS) for e in np.flatnonzero(counts[p])
        ]
        for limb, total in totals.items():
            for p, cut in enumerate(cuts(width)):
                for e in np.flatnonzero(counts[p]):
                    for at, value in enumerate(total[e, cut].tolist()):
                        out.append((p, int(e), at, limb, value))
        names = ("part", "entry", "at", "limb", "total")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=list(names)
            )

    return run


def _moved(state: DataFrame, book: Codebook, width: int) -> Codebook:
    """Every entry replaced by the floor of its parts' mean; unused ones stay.

    The driver takes as many numbers as the codebook has.
    """
    totals = state.select("vector", "wide", "code").mapInArrow(
        _sums(width), "part int, entry int, at int, limb int, total long"
    )
    rows = totals.groupBy("part", "entry", "at", "limb").agg(F.sum("total").alias("total"))
    counts: dict[tuple[int, int], int] = {}
    sums: dict[tuple[int, int, int], int] = {}
    for part, entry, at, limb, total in rows.collect():
        if at < 0:
            counts[part, entry] = total
        else:
            key = (part, entry, at)
            sums[key] = sums.get(key, 0) + (total << (LIMB * limb))
    out = []
    for p, entries in enumerate(book):
        new = entries.tolist()
        for e in range(len(new)):
            if n := counts.get((p, e)):
                new[e] = [sums[p, e, at] // n for at in range(entries.shape[1])]
        out.append(integers(new, entries.shape[1]))
    return out


def codebooks_digest(book: Codebook) -> str:
    """SHA-256 of all entries' components by part, entry and place, comma-joined."""
    numbers = (str(int(v)) for entries in book for v in entries.ravel().tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _label_key(label: str) -> list[Column]:
    return [
        F.col(label).isNull().alias("no_label"),
        F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label_key"),
    ]


def product_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Components become floor(256 x). A vector is cut into 16 consecutive parts,
    equal ones where its width is divisible. Codebooks start as the parts of the
    64 smallest ids; two rounds assign the parts and replace each entry by the
    floor of its parts' mean; then the parts are assigned a last time. Ties go
    to the lower index.

    Vectors that are null, or hold a null or non-finite component, are dropped.
    A null id comes after all others; equal ids are ordered by their vectors, and
    a repeated row counts as often as it is there. With fewer than 64 rows there
    are as many entries. The width is that of the smallest id; vectors of another
    width are returned with null code and error and take no part. Components of
    any finite size are exact; an error beyond 64 bits counts as the largest
    number. Null labels are one label; a label without any error has a null
    total. An empty table gives no rows; other columns are not read.

    The codebooks, 64 vectors a round, are all that the driver holds. State is
    written once a round, and the one before it deleted.
    """
    raw = F.col(vector_col).cast("array<double>")
    usable = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vector_col).isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), raw.alias("raw")
    )
    order = [F.col("vec_id").asc_nulls_last(), "raw"]
    smallest = kept.orderBy(*order).select(F.size("raw")).first()
    width = smallest[0] if smallest else 0
    fitting = kept.where(F.size("raw") == width)
    seeds = [[scaled(v) for v in r.raw] for r in fitting.orderBy(*order).limit(ENTRIES).collect()]
    first = integers(seeds, width)
    history: list[Codebook] = [[first[:, cut] for cut in cuts(width)]]
    kind = type_of(kept, "label")
    schema = f"vec_id long, label {kind}, {STATE}"
    state = settle(fitting.mapInArrow(_begin(history[0], width), schema))
    for number in range(ROUNDS):
        history.append(_moved(state, history[-1], width))
        if number < ROUNDS - 1:
            before = state
            state = settle(state.mapInArrow(_again(list(history), width), schema))
            release(before)
    coded = settle(
        state.mapInArrow(
            _finish(history, width), f"vec_id long, label {kind}, code string, error long"
        )
    )
    release(state)
    others = kept.where(F.size("raw") != width).select(
        "vec_id",
        "label",
        F.lit(None).cast("string").alias("code"),
        F.lit(None).cast("long").alias("error"),
    )
    rows = coded.unionByName(others).select("*", *_label_key("label"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    top = F.lit(int(LONG.max)).cast("long")
    facts = settle(
        rows.groupBy("no_label", "label_key").agg(
            F.when(total > top, top).otherwise(total.cast("long")).alias("label_error"),
            F.count("*").alias("held"),
        )
    )
    count = facts.agg(F.sum("held")).first()[0] or 0
    return lookup_join(
        rows, facts, ["no_label", "label_key"], "held", F.lit(count)
    ).select(
        "vec_id",
        "label",
        "code",
        "error",
        "label_error",
        F.lit(codebooks_digest(history[-1])).alias("codebooks_sha256"),
    )
