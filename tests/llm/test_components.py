import random

from stayrate.llm.components import connected_components


def _brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_shapes(spark):
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    noise = [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(90)]
    links = chain + star + [(a, b) for a, b in noise if a != b] + chain[:3]
    draw.shuffle(links)
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == _brute(links)
    assert len(found) == len({r.node for r in found})


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
