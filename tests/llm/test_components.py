import random

from impactlens.llm.components import connected_components


def brute(edges):
    of = {}
    for a, b in edges:
        if a != b:
            of.setdefault(a, a), of.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and of[a] != of[b]:
                of[a] = of[b] = min(of[a], of[b])
                changed = True
    return of


def test_components(spark):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, 5001 + i) for i in range(300)]
    noise = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]
    edges = path + star + noise + noise[:20] + [(7, 7), (-5, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
