import random

import pytest

from ledgerloom.operators import cycles as cy

EDGES = "src string, dst string"


def plain(edges):
    """Components with a cycle, by reachability."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reach(a) for a in after}
    return {frozenset(b for b in far[a] if a in far.get(b, ())) for a in far if a in far[a]}


def found(spark, edges):
    groups = {}
    for r in cy.components(spark.createDataFrame(edges, EDGES)).collect():
        groups.setdefault(r.comp, []).append(r.id)
    assert all(len(v) == len(set(v)) for v in groups.values())
    return {frozenset(v) for v in groups.values()}


@pytest.mark.parametrize("seed,nodes,n", [(1, 12, 14), (2, 30, 36), (3, 40, 80), (4, 9, 40), (5, 60, 62)])
def test_random_graphs(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(n)]
    assert found(spark, edges) == plain(edges)


def test_nested_chains(spark):
    """Chains that become links of longer chains, rings that chains hang on, a loop at a node, and two rings with one way between them."""
    ring = lambda p, n: [(f"{p}{i}", f"{p}{(i + 1) % n}") for i in range(n)]
    edges = [*ring("a", 7), ("a2", "x1"), ("x1", "x2"), ("x2", "a5"), ("x1", "y"), ("y", "a0"), *ring("b", 5), ("a1", "b1"), ("b2", "end"), ("s", "s"), ("s", "t"), ("t", "b0"), *ring("c", 2), ("d", "c0"), (None, "c0"), ("c1", None)]
    assert found(spark, edges) == plain([e for e in edges if None not in e])


def test_no_edges(spark):
    assert cy.components(spark.createDataFrame([], EDGES)).count() == 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 100,000 and a ring of 10,000, one leading into the other."""
    chain = spark.range(100_000).selectExpr("concat('n', id) src", "concat('n', id + 1) dst")
    ring = spark.range(10_000).selectExpr("concat('r', id) src", "concat('r', (id + 1) % 10000) dst")
    graph = chain.union(ring).union(spark.createDataFrame([("n500", "r3"), ("r9", "tail")], EDGES))
    tables, kept = [], cy._kept
    monkeypatch.setattr(cy, "_kept", lambda *a, **k: tables.append(1) or kept(*a, **k))
    out = cy.components(graph)
    assert out.groupBy("comp").count().collect()[0]["count"] == 10_000 == out.count()
    assert len(tables) <= 25


def test_trimming_groups_nothing(spark, monkeypatch):
    """Ends are found by looking for edges' other ends alone: nodes are not grouped first."""
    plans, kept = [], cy._kept
    monkeypatch.setattr(cy, "_kept", lambda df, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, **k))
    edges, n = cy._trimmed(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "a"), ("h", "h")], EDGES))
    assert sorted(edges.collect()) == [("a", "b"), ("b", "a"), ("h", "h")] and n == 3
    assert "LeftSemi" in plans[0] and "Aggregate" not in plans[0]
