"""Strongly connected components of any shape: one task, shrinking rounds, chains and colours give the same."""

import random

import pytest

from corvane.operators import graph


def plain(edges):
    """By reachability, node by node."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(v):
        seen, todo = set(), [v]
        while todo:
            for w in out.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    far = {v: reach(v) for v in out}
    return {v: min(w for w in far[v] if v in far.get(w, ())) for v in far if v in far[v]}


def random_graph(rng, n, m):
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


@pytest.mark.parametrize("core", [10**6, 30])
def test_shapes(spark, core):
    rng = random.Random(core)
    edges = random_graph(rng, 60, 70) | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(104, 200), (200, 201), (201, 202), (202, 200), (300, 300), (301, 302)}
    edges |= {(400 + i, 400 + (i + 1) % 12) for i in range(12)} | {(400 + i, 400 + (i + 2) % 12) for i in range(0, 12, 2)}
    got = graph.cyclic_components(spark.createDataFrame(sorted(edges), "src long, dst long"), core).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.scc for r in got} == plain(edges)


def test_names(spark):
    edges = [("a/x", "a/y"), ("a/y", "a/x"), ("b/z", "a/x"), ("c", "c"), ("a/y", "d/w"), ("d/w", "d/v"), ("d/v", "d/w")]
    for core in (100, 2):
        got = {r.node: r.scc for r in graph.cyclic_components(spark.createDataFrame(edges, "src string, dst string"), core).collect()}
        assert got == {"a/x": "a/x", "a/y": "a/x", "c": "c", "d/w": "d/v", "d/v": "d/v"}
    assert graph.cyclic_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_ring_with_chords_takes_few_checkpoints(spark, monkeypatch):
    """Two lanes of 5,000 nodes, one component whose diameter is thousands of hops."""
    n = 5000
    edges = [(i, (i + 1) % n) for i in range(n)] + [(i, (i + 3) % n) for i in range(0, n, 2)] + [(i, i - 2) for i in range(2, n, 5)]
    df = spark.createDataFrame(edges, "src long, dst long").cache()
    calls = []
    checkpoint = type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **k: calls.append(1) or checkpoint(self, *a, **k))
    rows = graph.cyclic_components(df).collect()
    assert {r.scc for r in rows} == {0} and len(rows) == n and len(calls) <= 60
