"""Components of dense groups, by stars that each task makes first."""

import random

import pandas as pd

from gleanery.llm import common, odd_sketch


def _roots(edges):
    up = {x: x for e in edges for x in e}
    for _ in up:
        for u, v in edges:
            up[u] = up[v] = min(up[u], up[v])
    return up


def test_stars_hold_a_row_for_a_node(monkeypatch):
    edges = [(a, b) for a in range(40) for b in range(40) if a != b]
    (made,) = common.stars([pd.DataFrame(edges, columns=["u", "v"])])
    assert sorted(zip(made.u, made.v, strict=True)) == [(a, 0) for a in range(1, 40)]
    monkeypatch.setattr(common, "AT_ONCE", 10)
    some = pd.concat(common.stars([pd.DataFrame(edges[i : i + 10], columns=["u", "v"]) for i in range(0, 100, 10)]))
    assert _roots(list(zip(some.u, some.v, strict=True))) == _roots(edges[:100])


def test_components_are_those_of_all_edges(spark):
    r = random.Random(3)
    edges = [(r.randrange(-60, 60), r.randrange(-60, 60)) for _ in range(55)] + [(200 + a, 200 + b) for a in range(12) for b in range(12)] + [(i, i + 1) for i in range(300, 330)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    want = _roots([e for e in edges if e[0] != e[1]])
    assert {x.node: x.root for x in common.components(df).collect()} == want
    assert common.components(df.where("u > 1000")).count() == 0


def test_grown_components_take_links_once(spark, monkeypatch):
    r = random.Random(5)
    taken = []
    monkeypatch.setattr(odd_sketch, "components", lambda edges: taken.append({(x.u, x.v) for x in edges.collect()}) or common.components(edges))
    roots, every = None, []
    for n in (60, 25, 0, 12):
        before = {x.node: x.root for x in roots.collect()} if roots is not None else {}
        some = [(r.randrange(-70, 70), r.randrange(-70, 70)) for _ in range(n)]
        some = [(u, v) for u, v in some if u != v]
        every += some
        roots = odd_sketch.grown(roots, spark.createDataFrame(some, "u long, v long").repartition(3))
        assert taken[-1] == {(before.get(u, u), before.get(v, v)) for u, v in some}  # no link of an earlier turn
        got = [(x.node, x.root) for x in roots.collect()]
        assert len(got) == len(dict(got)) and dict(got) == _roots(every)
    assert len(taken) == 4
