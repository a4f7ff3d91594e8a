from __future__ import annotations

import random

import pytest

from finality.llm.graph import components


def plain(edges):
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def shuffled(nodes, seed=5):
    """Other numbers for the nodes, negative ones too, so that neighbours in a path are far apart."""
    names = random.Random(seed).sample(range(-10**12, 10**12), nodes)
    return lambda a, b: (names[a], names[b])


path, chance = shuffled(70), shuffled(60, 6)
draw = random.Random(7)
GRAPHS = {
    "none": [],
    "loops": [(3, 3), (4, 4)],
    "star": [(0, i) for i in range(1, 9)] + [(0, 1), (2, 0)],
    "path": [path(i, i + 1) for i in range(69)],
    "chance": [chance(draw.randrange(60), draw.randrange(60)) for _ in range(45)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    found = components(spark.createDataFrame(GRAPHS[name], "u long, v long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == plain(GRAPHS[name])
