"""Graphs: the driver's walk, the walk by joins, and a plain model must agree."""

import random

import pytest

from palimpsest import errors
from palimpsest.operators import graph as G
from palimpsest.operators.log import BRANCHES, COMMITS, Log


def make(spark, parents):
    rows = [(c, 0, p) for c, p in parents.items()]
    commits = spark.createDataFrame(rows, COMMITS)
    return Log(commits, commits, commits, spark.createDataFrame([], BRANCHES))


def model_ancestors(parents, start):
    depth, todo = {start: 0}, [start]
    for c in todo:
        for p in parents[c]:
            if p not in depth:
                depth[p] = depth[c] + 1
                todo.append(p)
    return depth


def random_graph(seed):
    rng = random.Random(seed)
    parents = {"c0": []}
    for k in range(1, 14):
        parents[f"c{k}"] = rng.sample(list(parents), min(len(parents), rng.choice((1, 1, 2))))
    return parents


@pytest.mark.parametrize("seed", range(3))
def test_walks_agree(spark, seed, monkeypatch):
    parents = random_graph(seed)
    log = make(spark, parents)
    quick = G.Graph.of(log)
    start, other = "c13", "c12"
    want = model_ancestors(parents, start)
    assert quick.ancestors(start) == want
    best = quick.best_common(start, other)
    common = want.keys() & model_ancestors(parents, other).keys()
    assert best == sorted(c for c in common if not any(c != d and c in model_ancestors(parents, d) for d in common))
    monkeypatch.setattr(G, "SMALL", 0)
    assert {r[0]: r[1] for r in G.ancestry(log, start).collect()} == want
    assert {r[0]: r[1] for r in G.lineage(log, start).collect()} == quick.lineage(start)
    assert sorted(r[0] for r in G.best_common_ancestors(log, start, other).collect()) == best


def test_merge_base_errors():
    criss = G.Graph([("r", []), ("a", ["r"]), ("b", ["r"]), ("x", ["a", "b"]), ("y", ["b", "a"]), ("z", [])])
    with pytest.raises(errors.AmbiguousMergeBase):
        criss.merge_base("x", "y")
    with pytest.raises(errors.NoCommonHistory):
        criss.merge_base("x", "z")
    with pytest.raises(errors.CommitNotFound):
        criss.ancestors("q")
    assert criss.merge_base("a", "x") == "a" and criss.merge_base("x", "x") == "x"
