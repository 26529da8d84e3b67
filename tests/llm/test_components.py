"""Connected components against a plain union of links."""

import random

from carequeue.llm.components import components, settled


def plain(links):
    label = {n: n for pair in links for n in pair}
    for _ in label:
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
    return label


def test_components_equal_plain_union(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    other = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    links = [*chain, *star, *other, star[0], (130, 100), (300, 300)]
    df = spark.createDataFrame(links, "u long, v long")
    expected = plain([p for p in links if p[0] != p[1]])
    assert dict(map(tuple, components(df).collect())) == expected
    hung = {(u, v) for u, v in expected.items() if u != v}
    assert set(map(tuple, settled(df).collect())) == hung
    assert set(map(tuple, settled(settled(df)).collect())) == hung
    assert components(df.where("false")).count() == 0
