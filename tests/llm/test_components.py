"""Components of random graphs, chains and stars against a plain search."""

import random

from foresail.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for e in edges for v in e}


def test_components(spark):
    rng = random.Random(2)
    graphs = [[(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 80)], [(90, k) for k in range(80)], [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)], [(5, 3), (3, 5), (5, 3)]]
    for edges in graphs:
        edges = [e for e in edges if e[0] != e[1]]
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.v: r.root for r in got} == plain(edges) and len(got) == len({v for e in edges for v in e})
    assert not components(spark.createDataFrame([], "a long, b long")).collect()
