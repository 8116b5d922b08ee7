"""Cycles of large graphs in a number of rounds that grows with the logarithm of their paths.

Each pass takes off nodes without a way in or out, and joins chains of nodes that
have one way in and one way out to a single edge. Chains are measured by doubling:
every node points ahead twice as far each time, so that a chain of a million
nodes takes 20 steps, of which STEPS make one job. What neither is, is split by
colours: the largest node that leads to each one, and what leads back to it. Every
table has at most a row for each node or edge; no closure is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import shared_path

#: Doublings, or steps of colours, that are planned together.
STEPS = 4
#: Trimming goes on by itself as long as no more than this share of the edges is left.
SHRINKS = 0.6


def _kept(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """``df`` as a table in the shared folder, and sums over its rows, in one job."""
    path, seen = shared_path(df.sparkSession, "cycles"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in sums.items())).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges between nodes that have both a way in and a way out, looked at twice, and their number."""
    for _ in range(2):
        # An edge's first node has a way out and its second one a way in, by the edge itself: only the other two are asked for.
        into, out = edges.select(F.col("dst").alias("src")), edges.select(F.col("src").alias("dst"))
        edges = edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")
    kept, sums = _kept(edges)
    return kept, sums["n"]


def _links(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, before, after) of the nodes with one way in and one way out, and their number."""
    ways = edges.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("before"), F.col("dst").alias("after")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("before"), F.lit(None).cast("string").alias("after")))
    own = ways.groupBy("node").agg(F.count("before").alias("i"), F.count("after").alias("o"), F.min("before").alias("before"), F.min("after").alias("after"))
    kept, sums = _kept(own.where("i = 1 and o = 1").select("node", "before", "after"))
    return kept, sums["n"]


def _chains(links: DataFrame) -> DataFrame:
    """(node, last, ring): the last node of each one's chain; nodes that come round to themselves have no last, but the smallest node of their ring."""
    inner = links.select(F.col("node").alias("after"), F.lit(True).alias("_inner"))
    ahead = links.join(inner, "after", "left").select("node", F.when(F.col("_inner"), F.col("after")).alias("to"), F.when(F.col("_inner").isNull(), F.col("node")).alias("last"), F.col("node").alias("least"))
    while True:
        for _ in range(STEPS):
            there = ahead.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("last").alias("_last"), F.col("least").alias("_least"))
            # What has found its last node points nowhere any more.
            moved = (F.col("last").isNull() & F.col("_last").isNotNull()) | (F.col("_least") < F.col("least"))
            ahead = ahead.join(there, "to", "left").select("node", F.when(F.col("last").isNull(), F.col("_to")).alias("to"), F.coalesce("last", "_last").alias("last"), F.least("least", "_least").alias("least"), F.coalesce(moved, F.lit(False)).alias("moved"))
        ahead, sums = _kept(ahead, moved=F.col("moved"))
        ahead = ahead.drop("moved")
        if not sums["moved"]:
            return ahead.select("node", "last", F.when(F.col("last").isNull(), F.col("least")).alias("ring"))


def _spread(values: DataFrame, edges: DataFrame, best) -> DataFrame:
    """(node, value) after values went along edges (src, dst) until none changes; a node takes the ``best`` of its own and those that reach it."""
    now = values
    while True:
        for _ in range(STEPS):
            sent = edges.join(now.select(F.col("node").alias("src"), "value"), "src").select(F.col("dst").alias("node"), "value", F.lit(False).alias("own"))
            both = now.select("node", "value", F.lit(True).alias("own")).unionByName(sent)
            now = both.groupBy("node").agg(best("value").alias("value"), best(F.when(F.col("own"), F.col("value"))).alias("_before"))
        now, sums = _kept(now, changed=~F.col("value").eqNullSafe(F.col("_before")))
        now = now.drop("_before")
        if not sums["changed"]:
            return now


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, comp) of the strongly connected components that hold the largest node leading to them, and the edges that are left within colours."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    colour = _spread(nodes.withColumn("value", F.col("node")), edges, F.max)
    for end in ("src", "dst"):
        edges = edges.join(colour.select(F.col("node").alias(end), F.col("value").alias(f"_{end}")), end)
    within = _kept(edges.where("_src = _dst").select("src", "dst"))[0]
    back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = _spread(colour.select("node", F.when(F.col("node") == F.col("value"), F.col("value")).alias("value")), back, F.max).where("value is not null")
    done = found.select("node", F.col("value").alias("comp"))
    for end in ("src", "dst"):
        within = within.join(done.select(F.col("node").alias(end)), end, "left_anti")
    return done, _kept(within)[0]


def components(graph: DataFrame) -> DataFrame:
    """(id, comp): the strongly connected components of edges (src, dst) that have a cycle, under the name of one of their nodes. Edges with a null end are not looked at."""
    edges = graph.where("src is not null and dst is not null").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    self_loops = lambda e: e.where("src = dst").select(F.col("src").alias("node"))
    edges, sums = _kept(edges)
    loops = self_loops(edges)
    left, known, chains = edges.where("src <> dst"), None, []
    add = lambda a, b: b if a is None else a.unionByName(b)
    before, size = -1, sums["n"]
    while True:
        left, n = _trimmed(left)
        if not n:
            break
        if n <= SHRINKS * size:  # as long as trimming alone takes off a good part, that is a logarithm of rounds, too
            size = n
            continue
        size = n
        links, m = _links(left)
        if m:
            members = _chains(links)
            known = add(known, members.where("ring is not null").select("node", F.col("ring").alias("comp")))
            # A chain's edge goes from what leads into its first node to what its last node leads to.
            last = members.where("last is not null")
            own = links.join(last, "node")
            into = own.join(links.select(F.col("node").alias("before"), F.lit(True).alias("_inner")), "before", "left").where("_inner is null").select("last", F.col("before").alias("src"))
            ends, _ = _kept(into.join(own.where("node = last").select("last", F.col("after").alias("dst")), "last"))
            chains.append((last.select("node", "last"), ends))
            loops = loops.unionByName(self_loops(ends))
            inner = links.select("node")
            direct = left.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
            left = direct.unionByName(ends.where("src <> dst").select("src", "dst")).distinct()
        elif n == before:
            done, left = _coloured(left)
            known = add(known, done)
        before = n if not m else -1
    # Nodes with an edge to themselves, or a chain back to themselves, are a component, if of no larger one.
    loops = loops.distinct().withColumn("comp", F.col("node"))
    known = loops if known is None else known.unionByName(loops.join(known.select("node"), "node", "left_anti"))
    for members, ends in reversed(chains):
        known = _kept(known)[0]
        for end in ("src", "dst"):
            ends = ends.join(known.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}")), end)
        known = known.unionByName(members.join(ends.where("_src = _dst").select("last", F.col("_src").alias("comp")), "last").select("node", "comp"))
    several = known.groupBy("comp").agg((F.count(F.lit(1)) > 1).alias("_several"))
    out = known.join(several, "comp").join(loops.select("node", F.lit(True).alias("_loop")), "node", "left")
    return out.where("_several or _loop").select(F.col("node").alias("id"), "comp")
