"""Connected components against a union of sets, with and without hubs."""

import random

import pytest


def by_brute_force(edges):
    name = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(name[a], name[b])
            changed |= name[a] != least or name[b] != least
            name[a] = name[b] = least
    return {x: c for x, c in name.items() if any(x in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("hubs", [500, 4, 0])
def test_components(spark, monkeypatch, hubs):
    """Hubs of each share, and none, give the same components; a hub need not be the least
    node of its component, and repeated edges, loops and both directions change nothing."""
    from docmill.llm import components

    monkeypatch.setattr(components, "HUBS", hubs)
    draw = random.Random(5)
    star = [(50, x) for x in range(60, 120)] + [(x, 200) for x in range(130, 160)]
    chain = [(x, x + 1) for x in range(300, 320)]
    loose = [(draw.randrange(400, 460), draw.randrange(400, 460)) for _ in range(30)]
    edges = [*star, (50, 3), *chain, *loose, (320, 300), (7, 7), *star[:5], *((b, a) for a, b in chain)]
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == by_brute_force(edges)


def test_no_edges(spark):
    from docmill.llm.components import connected_components

    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert connected_components(spark.createDataFrame([("x", "x")], "a string, b string")).count() == 0
