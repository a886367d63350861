import math

import numpy as np
from pyspark.sql import types as T

from pyspark.sql import functions as F

from stayrate.llm.topk import BLOCK, _blocks, exact_top_k, open_vectors, scaled_vectors

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("rank", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


def _brute(rows, k, every):
    usable = [
        (i, [math.floor(1024 * x) for x in map(float, v)])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, x in {(q, tuple(x)) for q, x in usable if q % every == 0}:
        scored = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in usable if i != q and len(y) == len(x)]
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out.add((q, rank, i, -s))
    return sorted(out)


def _found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(4)
    return sorted(tuple(r) for r in exact_top_k(df, **options).collect())


def test_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    rows = [(i, np.float32(draw.normal(size=8)).tolist()) for i in range(400)]
    rows += [(500 + i, [0.5] * 8) for i in range(150)]  # ties
    assert _found(spark, rows, k=10, every=20) == _brute(rows, 10, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0])]
    rows += [(5, [0.25, -1.0]), (6, []), (10, []), (20, [1.0]), (None, [1.0, 1.0])]
    rows += [(30, [1e6, -1e6]), (31, [2e6, 3.0]), (32, [2e6, 3.0])]
    assert _found(spark, rows, k=3, every=10) == _brute(rows, 3, 10)


def test_nothing(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(1, [1.0])]) == []
    assert _found(spark, [(100, [1.0])]) == []


def test_copies_over_many_blocks(spark):
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(300)]
    rows += [(1000 + i, [float(i % 7), 0.5, -1.0]) for i in range(200)]
    assert _found(spark, rows, k=4, every=50) == _brute(rows, 4, 50)


def test_few_exact_vectors_are_read(spark):
    draw = np.random.default_rng(8)
    centre = draw.normal(size=(20, 32))
    rows = [(i, (centre[i % 20] + 0.1 * draw.normal(size=32)).tolist()) for i in range(4000)]
    usable = scaled_vectors(
        spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(4),
        "vec_id",
        "embedding",
    )
    placed = usable.withColumn("place", F.col("vec_id"))
    blocks = placed.mapInArrow(_blocks(6), BLOCK)
    asked = placed.where("vec_id % 1000 = 0").collect()
    wanted, least, _ = open_vectors(blocks, asked, 10)
    read = {i for row in wanted.collect() for i in row.ids}
    assert len(least) == len(asked) == 4
    # The four queries are of one cluster of 200: nothing outside it is read.
    assert len(read) <= 200
    found = _found(spark, rows, k=10, every=1000)
    assert found == _brute(rows, 10, 1000)
    assert {row[2] for row in found} <= read
