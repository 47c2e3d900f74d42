import random

import pytest

from claimgrid.llm import components as C


@pytest.mark.parametrize("hub", [1000, 3])
def test_matches_union_find(spark, monkeypatch, hub):
    """Chains, a star around its least and one around its greatest node, repeated and reversed pairs; with hubs and without."""
    monkeypatch.setattr(C, "HUB", hub)
    rnd = random.Random(2)
    pairs = [(n, n + 1) for n in range(100, 140)] + [(500, 500 + n) for n in range(1, 60)] + [(900, 700 + n) for n in range(60)] + [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]
    pairs += [(b, a) for a, b in pairs[:30]] + [(130, 505)]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    found = {r.u: r.v for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: top(i) for i in root if top(i) != i}


def test_empty(spark):
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert C.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_dense_group_starts_with_few_edges(spark, monkeypatch):
    """200 nodes share 30 lesser neighbours: the first large star joins an edge or so a node, not all 6000, and joins once."""
    seen, large_star = [], C._large_star
    monkeypatch.setattr(C, "_large_star", lambda edges, most: seen.append(edges.count()) or large_star(edges, most))
    pairs = [(1000 + n, k) for n in range(200) for k in range(30)]
    found = {r.u: r.v for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {n: 0 for n in [*range(1, 30), *range(1000, 1200)]}
    assert max(seen) <= 230
