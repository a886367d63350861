import hashlib
import math

import numpy as np
from pyspark.sql import types as T

from stayrate.llm import codes
from stayrate.llm.codes import product_codes

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.StringType()),
        # Columns that clash with names used inside or returned.
        T.StructField("code", T.StringType()),
        T.StructField("vector", T.StringType()),
        T.StructField("held", T.StringType()),
    ]
)


def _exact(x):
    return int(x) * 256 if abs(x) >= 2.0**53 else math.floor(x * 256)


def _brute(rows):
    """Rows (vec_id, label, code, error, label_error, digest), by plain integers."""
    kept = [
        (i, [_exact(x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1])
    fitting = [r for r in kept if len(r[1]) == width]
    edges = [p * width // 16 for p in range(17)]
    cut = [[v[a:b] for a, b in zip(edges, edges[1:])] for _, v, _ in fitting]
    book = [[list(v[p]) for v in cut[:64]] for p in range(16)]

    def assign():
        found = []
        for v in cut:
            best = []
            for p in range(16):
                off = [sum((a - b) ** 2 for a, b in zip(v[p], c)) for c in book[p]]
                best.append((min(off), off.index(min(off))))
            found.append(best)
        return found

    for _ in range(2):
        found = assign()
        for p in range(16):
            for e in range(len(book[p])):
                own = [v[p] for v, best in zip(cut, found) if best[p][1] == e]
                if own:
                    book[p][e] = [sum(c) // len(own) for c in zip(*own)]
    numbers = ",".join(str(x) for entries in book for e in entries for x in e)
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    top = 2**63 - 1
    out = []
    for (i, _, label), best in zip(fitting, assign()):
        code = "".join(f"{e:02x}" for _, e in best)
        out.append((i, label, code, min(sum(d for d, _ in best), top)))
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    out += [(i, label, None, None) for i, v, label in kept if len(v) != width]
    return [
        (*r, None if r[1] not in totals else min(totals[r[1]], top), digest) for r in out
    ]


def _found(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VECTORS).repartition(4)
    found = product_codes(df)
    assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def _same(spark, rows):
    assert _found(spark, rows) == sorted(_brute(rows), key=str)


def test_equals_brute_force(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=32).tolist(), f"l{i % 3}") for i in range(300)]
    rows += [(1000 + i, [0.25] * 32, None) for i in range(80)]  # equal vectors, no label
    rows += [(7, rows[7][1], "l1")] * 3  # repeated rows
    _same(spark, rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5] * 20, "a"), (6, None, "a"), (7, [nan] * 20, "a"), (8, [inf] * 20, None)]
    rows += [(9, [None] + [1.0] * 19, "b"), (10, [], "b"), (11, [1.0] * 3, "c")]
    rows += [(None, [-0.1] * 20, "a"), (None, [3.0] * 20, None), (12, [-0.001] * 20, "a")]
    _same(spark, rows)
    _same(spark, [(1, [], "a"), (2, [], "b")])


def test_components_of_any_size(spark):
    draw = np.random.default_rng(6)
    sizes = [1.0, 1e7, 1e9, 1e16, 1e30, 1e200]
    rows = [(i, (draw.normal(size=16) * sizes[i % 6]).tolist(), "a") for i in range(90)]
    _same(spark, rows)
    _same(spark, [(i, (draw.normal(size=16) * 1e8).tolist(), "a") for i in range(90)])


def test_nothing(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(1, None, "a")]) == []


def test_bounds_save_scans_and_net_movement_is_tighter():
    draw = np.random.default_rng(7)
    x = draw.integers(-100, 100, (4000, 4)) + 3000 * draw.integers(0, 12, (4000, 1))
    entries = x[:12].copy()
    there, back = entries + 400, entries + 3
    held = codes.scan(x, entries, 0)
    found, scanned = codes.carry(x, held, [entries, there, back])
    plain = codes.squares(x, back).argmin(axis=1)
    assert (found.code == plain).all()
    # Accumulated drifts (800 and 797) would leave far more open than the net 6.
    assert scanned < len(x) / 2
    carried = codes.scan(x, entries, 0)
    carried.lower -= np.float32(2 * 1597)
    assert codes.carry(x, carried, [entries, there, back])[1] > scanned
    assert (found.upper_round[found.upper_round > 0] == 2).all()
