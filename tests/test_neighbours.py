"""Nearest neighbours and synthetic rows against brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stayrate.operators import neighbours, synthesis


def _points(spark, x):
    rows = [(f"p{i:04d}", [float(v) for v in row], i) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vid string, vec array<double>, n long")


def _brute(x, k):
    d = np.round(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    return {
        f"p{i:04d}": [f"p{j:04d}" for j in np.argsort(d[i], kind="stable")[:k]]
        for i in range(len(x))
    }


def _found(df):
    return {r["vid"]: [n["vid"] for n in r["neighbours"]] for r in df.collect()}


@pytest.mark.parametrize("block, per_cell", [(2000, 1000), (20, 25)])
def test_nearest_equals_brute_force(spark, monkeypatch, block, per_cell):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", per_cell)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(5, 0.2, (80, 3))])
    x = np.unique(x.round(1), axis=0)  # a grid has many equal distances
    points = _points(spark, x)
    assert _found(neighbours.nearest(points, points, 4, ["n"])) == _brute(x, 4)


def test_rounds_visit_fewer_cells_than_one(spark, monkeypatch):
    """Rounds find the same neighbours over several cells and narrow what is visited."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 12)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    rng = np.random.default_rng(11)
    x = np.unique(rng.normal(0, 1, (400, 3)).round(3), axis=0)
    points, seen = _points(spark, x), []
    route = neighbours._route

    def counted(*args):
        visits = neighbours.settle(route(*args))
        assert visits.columns == ["vid", "cell"]
        seen.append(visits.groupBy("vid").count().agg(F.sum("count"), F.max("count")).first())
        return visits

    monkeypatch.setattr(neighbours, "_route", counted)
    expected = _brute(x, 6)
    assert _found(neighbours.nearest(points, points, 6)) == expected
    in_rounds = sum(n or 0 for n, _ in seen)
    assert len(seen) > 2 and seen[0][1] == 1
    seen.clear()
    assert _found(neighbours.nearest(points, points, 6, first_step=10_000)) == expected
    assert in_rounds < seen[0][0]


def test_rows_of_queries_are_never_broadcast(spark, monkeypatch):
    """Joins by point stay apart from the driver, however small the files look."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 12)
    x = np.unique(np.random.default_rng(5).normal(0, 1, (200, 3)).round(3), axis=0)
    settle, plans = neighbours.settle, []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(neighbours, "settle", seen)
    points = _points(spark, x)
    assert _found(neighbours.nearest(points, points, 4)) == _brute(x, 4)
    assert any("SortMergeJoin [vid" in plan for plan in plans)
    assert not any("BroadcastHashJoin [vid" in plan for plan in plans)


def test_a_block_is_compared_in_bounded_pieces(spark, monkeypatch):
    """Equal distances, as value differences give them, are held in pieces as well."""
    distances, most = neighbours._distances, 2_000

    def bounded(a, b):
        assert len(a) * len(b) <= most
        return distances(a, b)

    monkeypatch.setattr(neighbours, "_WORKSPACE", most)
    monkeypatch.setattr(neighbours, "_distances", bounded)
    x = np.unique(np.random.default_rng(6).integers(0, 8, (400, 3)), axis=0).astype(float)
    points = _points(spark, x)
    assert _found(neighbours.nearest(points, points, 5, ["n"])) == _brute(x, 5)


def _all_compared(a, b, same, k):
    """Row, column and distance of the nearest, from the differences of all pairs."""
    d = np.round(neighbours._distances(a, b), 9)
    d[same] = np.inf
    found = [(i, j, d[i, j]) for i in range(len(a)) for j in np.argsort(d[i], kind="stable")[:k]]
    return [x for x in found if np.isfinite(x[2])]


@pytest.mark.parametrize("size, shift, places", [(1, 0, 9), (3, 0, 0), (1, 1e7, 9), (1e-8, 0, 20), (1e120, 0, 0)])
def test_products_leave_the_exact_nearest(size, shift, places):
    """Ties, far from the origin, tiny and huge values; distances are those of differences."""
    rng = np.random.default_rng(8)
    a, b = (np.round(rng.normal(size=(n, 7)) * size, places) + shift for n in (40, 90))
    same = rng.random((40, 90)) < 0.1
    rows, columns, d = neighbours._closest(a, b, same, 6)
    assert list(zip(rows, columns, d)) == _all_compared(a, b, same, 6)


def test_few_pairs_are_compared_by_differences(monkeypatch):
    """Products of matrices rule out almost all pairs of a block."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(100, 30)), rng.normal(size=(400, 30))
    none = np.zeros((100, 400), dtype=bool)
    expected = _all_compared(a, b, none, 5)

    def refused(*args):
        raise AssertionError("all pairs were compared by differences")

    monkeypatch.setattr(neighbours, "_distances", refused)
    assert list(zip(*neighbours._closest(a, b, none, 5))) == expected


def test_blocks_give_ids_and_distances_alone(spark, monkeypatch):
    """Vectors and other columns of the neighbours are looked up once, for those that are left."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 30)
    x = np.unique(np.random.default_rng(10).normal(0, 1, (120, 3)).round(2), axis=0)
    candidates, given = neighbours._candidates, []

    def seen(*args):
        given.append(candidates(*args))
        return given[-1]

    monkeypatch.setattr(neighbours, "_candidates", seen)
    found = neighbours.nearest(_points(spark, x), _points(spark, x), 3, ["n"]).collect()
    assert all(df.schema["found"].dataType.names == ["distance", "vid"] for df in given)
    for row in found:
        for n in row["neighbours"]:
            at = int(n["vid"][1:])
            assert n["vec"] == list(x[at]) and n["n"] is not None


def test_queries_apart_from_the_data(spark, monkeypatch):
    """Queries in cells without any point, and more neighbours asked for than a cell holds."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 10)
    rng = np.random.default_rng(12)
    x = np.unique(rng.normal(0, 1, (120, 2)).round(2), axis=0)
    z = np.array([[50.0, 50.0], [0.0, 0.0], [-9.0, 3.0]])
    asks = spark.createDataFrame([(f"q{i}", list(map(float, v))) for i, v in enumerate(z)], "vid string, vec array<double>")
    found = _found(neighbours.nearest(asks, _points(spark, x), 25))
    for i, v in enumerate(z):
        d = np.round(np.sqrt(((x - v) ** 2).sum(-1)), 9)
        assert found[f"q{i}"] == [f"p{j:04d}" for j in np.argsort(d, kind="stable")[:25]]


def test_merge_limits_rows_before_the_shuffle(spark):
    rows = spark.range(50).selectExpr(
        "cast(id % 2 as string) vid", "struct(double(id) as distance, cast(id as string) as vid) as found"
    )
    best = neighbours._best(rows, 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    found = {r["vid"]: [n["distance"] for n in r["neighbours"]] for r in best.collect()}
    assert found == {"0": [0.0, 2.0, 4.0], "1": [1.0, 3.0, 5.0]}


def test_nearest_with_fewer_points_than_k(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 5.0]])
    points = _points(spark, x)
    assert _found(neighbours.nearest(points, points, 5)) == _brute(x, 2)


def _rows(spark, x, label):
    rows = [(f"k{i:04d}", [float(v) for v in v], int(c)) for i, (v, c) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "customerID string, vec array<double>, label int")
    return df.select("customerID", array_to_vector("vec").alias("features"), "label")


def _split(df):
    rows = df.withColumn("vec", vector_to_array("features")).collect()
    made = [r for r in rows if r["customerID"].startswith("synthetic")]
    return [r for r in rows if r not in made], made


@pytest.fixture(scope="module")
def imbalanced():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (90, 2)), rng.normal(2, 1, (30, 2))]).round(3)
    return x, np.array([0] * 90 + [1] * 30)


def test_smote_points_lie_between_a_point_and_a_near_neighbour(spark, imbalanced):
    x, label = imbalanced
    kept, made = _split(synthesis.smote(_rows(spark, x, label), 1.0, 3))
    assert len(kept) == 120 and len(made) == 60
    minority = x[label == 1]
    near = {i: [int(p[1:]) for p in v] for i, v in enumerate(_brute(minority, 3).values())}
    for r in made:
        assert r["label"] == 1
        z = np.array(r["vec"])
        gaps = [
            abs(
                np.linalg.norm(z - minority[i])
                + np.linalg.norm(z - minority[j])
                - np.linalg.norm(minority[i] - minority[j])
            )
            for i in near
            for j in near[i]
        ]
        assert min(gaps) < 1e-9
    # Quotas are even: 60 over 30 points.
    started = [r["customerID"].split("_")[1] for r in made]
    assert {started.count(v) for v in set(started)} == {2}


def test_smote_of_a_hot_vector_repeats_it(spark):
    x = np.array([[0.0, 0.0]] * 40 + [[1.0, 1.0]] * 12 + [[9.0, 9.0]] * 2)
    label = np.array([0] * 40 + [1] * 14)
    kept, made = _split(synthesis.smote(_rows(spark, x, label), 1.0, 5))
    assert len(made) == 26
    copies = [r for r in made if r["vec"] == [1.0, 1.0]]
    assert len(copies) >= 20  # eleven copies fill all five neighbour places


def test_smote_ratio_is_exact_with_chunks(spark, imbalanced, monkeypatch):
    monkeypatch.setattr(synthesis, "CHUNK", 1)
    x, label = imbalanced
    _, made = _split(synthesis.smote(_rows(spark, x, label), 0.8, 5))
    assert len(made) == int(90 * 0.8 - 30)
    assert len({r["customerID"] for r in made}) == len(made)


def test_adasyn_quotas(spark, imbalanced):
    x, label = imbalanced
    kept, made = _split(synthesis.adasyn(_rows(spark, x, label), 1.0, 5))
    near = _brute(x, 5)
    hard = {
        i: sum(label[int(p[1:])] == 0 for p in near[f"p{i:04d}"]) / 5
        for i in np.flatnonzero(label == 1)
    }
    total = sum(hard.values())
    wanted = {f"k{i:04d}": int(np.rint(h / total * 60)) for i, h in hard.items()}
    started = [r["customerID"].split("_")[1] for r in made]
    assert {v: n for v, n in wanted.items() if n} == {
        v: started.count(v) for v in set(started)
    }
    assert len(kept) == 120


def test_smoten_takes_the_commonest_value(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 3, (80, 4)).astype(float)
    label = np.array([0] * 60 + [1] * 20)
    kept, made = _split(synthesis.smoten(_rows(spark, x, label), 1.0, 3))
    assert len(kept) == 80 and len(made) == 40
    share = [{v: label[x[:, j] == v].mean() for v in set(x[:, j])} for j in range(4)]
    rows = x[label == 1]
    distinct = np.unique(rows, axis=0)
    # A vector goes by its smallest key, whatever the class.
    keys = [min(f"k{i:04d}" for i in np.flatnonzero((x == d).all(1))) for d in distinct]
    order = np.argsort(keys)
    distinct, keys = distinct[order], [keys[i] for i in order]
    place = np.array([[2 * share[j][v] for j, v in enumerate(d)] for d in distinct])
    n = [int((rows == d).all(1).sum()) for d in distinct]
    gap = np.round(np.sqrt(((place[:, None] - place[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(gap, np.inf)
    for r in made:
        i = keys.index(r["customerID"].split("_")[1])
        near = [i] * (n[i] - 1)
        for j in np.argsort(gap[i], kind="stable")[:3]:
            near += [j] * n[j]
        votes = distinct[near[:3]]
        for slot, value in enumerate(r["vec"]):
            values = list(votes[:, slot])
            assert value == min(values, key=lambda v: (-values.count(v), v))


def test_cluster_centroids_counts(spark, imbalanced, monkeypatch):
    x, label = imbalanced
    kept, made = _split(synthesis.cluster_centroids(_rows(spark, x, label), 1.0))
    assert len(kept) == 30 and len(made) == 30
    monkeypatch.setattr(synthesis, "MAX_CENTROIDS", 5)
    monkeypatch.setattr(synthesis, "BLOCK", 20)
    kept, made = _split(synthesis.cluster_centroids(_rows(spark, x, label), 0.5))
    assert len(kept) == 30 and len(made) == 60
    crowd = x[label == 0]
    z = np.array([r["vec"] for r in made])
    assert (z.min(0) >= crowd.min(0) - 1e-9).all() and (z.max(0) <= crowd.max(0) + 1e-9).all()
    assert all(r["label"] == 0 for r in made)


@pytest.mark.parametrize("per_cell, ratio", [(4000, 1.0), (30, 0.5)])
def test_cluster_centroids_ignore_the_layout(spark, imbalanced, monkeypatch, per_cell, ratio):
    """The same rows give the same centres, with one pivot and with several."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", per_cell)
    x, label = imbalanced
    rows = _rows(spark, x, label)
    layouts = [rows.coalesce(1), rows.orderBy("label", F.desc("customerID")), rows.repartition(7)]
    found = []
    for layout in layouts:
        _, made = _split(synthesis.cluster_centroids(layout, ratio))
        found.append(sorted(tuple(r["vec"]) for r in made))
    assert len(found[0]) == 30 / ratio
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("per_cell", [4000, 30])
def test_pivots_ignore_the_layout(spark, imbalanced, monkeypatch, per_cell):
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", per_cell)
    points = _points(spark, imbalanced[0])
    layouts = [points, points.orderBy(F.desc("vid")), points.repartition(7)]
    first, *others = [neighbours.choose_pivots(p, 120).tolist() for p in layouts]
    assert all(o == first for o in others)
