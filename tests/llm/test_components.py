"""Connected components against a plain union-find."""

import random

import pytest

from fleetlens.llm.components import components


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for x in list(root):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize(
    "links",
    [
        [(random.Random(7).randrange(90) if i % 2 else i, (i * 37) % 90) for i in range(70)],
        [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (-3, 40)],
        [(0, i) for i in range(1, 30)] + [(5, 5)],
    ],
)
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    groups = {}
    for row in found:
        groups.setdefault(row.root, set()).add(row.node)
    assert sorted(map(sorted, groups.values())) == [g for g in plain(links) if len(g) > 1]


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
