"""Coreness, by peeling where a part of the graph is small and by H-index iteration elsewhere; the skeleton of a graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.relational import both_ways, induced, traffic
from weftgraph.plans import bounded
from weftgraph.plans.iterate import fixpoint, materialise
from weftgraph.schema import PropertyGraph


def _peeled(table: pa.Table) -> pa.Table:
    """(id, core) of links (a, b) given once each: nodes leave in order of what is left of their degree."""
    ids, (a, b) = bounded.coded(table, "a", "b")
    near = bounded.neighbours(len(ids), np.concatenate([a, b]), np.concatenate([b, a]))
    degree = [len(x) for x in near]
    waiting: list[list[int]] = [[] for _ in range(max(degree) + 1)]
    for node, d in enumerate(degree):
        waiting[d].append(node)
    core, level = [-1] * len(ids), 0
    while level < len(waiting):
        if not waiting[level]:
            level += 1
            continue
        node = waiting[level].pop()
        if core[node] >= 0 or degree[node] > level:
            continue  # has left, or an entry of an earlier degree
        core[node] = level
        for other in near[node]:
            if core[other] < 0 and degree[other] > level:
                degree[other] -= 1
                waiting[degree[other]].append(other)
    return pa.table({"id": pa.array(ids.tolist(), table.schema.field("a").type), "core": pa.array(core, pa.int64())})


def coreness(graph: PropertyGraph, limit: int = bounded.LIMIT) -> DataFrame:
    """(id, core): the largest k for which a node is in the k-core; neighbours are distinct
    and undirected, isolated nodes have 0.

    Weak components within ``limit`` links are peeled in a task each.  In larger ones values
    start from degrees, and each round a node takes the H-index of its neighbours' values, read
    off counts of (node, value), until nothing changes: rounds grow with the depth of the peeling."""
    ids = graph.nodes.select("id").distinct()
    near = both_ways(graph.edges).distinct().join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    once = materialise(near.filter("a < b"))
    kind = once.schema["a"].dataType.simpleString()
    found, rest = bounded.settle(once, _peeled, f"id {kind}, core long", limit, "a", "b")
    if rest is not None:
        rest = rest.drop("component")
        near = materialise(rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))))

        def step(state: DataFrame) -> DataFrame:
            values = near.join(state.withColumnRenamed("id", "b"), "b").groupBy("a", "core").agg(F.count(F.lit(1)).alias("n"))
            above = F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("core")))  # a row a distinct value
            return values.select("a", F.least("core", above).alias("h")).groupBy(F.col("a").alias("id")).agg(F.max("h").alias("core"))

        found = found.unionByName(fixpoint(step, near.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("core")), "id", "core"))
    return ids.join(found, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core"))


def skeleton(graph: PropertyGraph, budget: int = 400) -> DataFrame:
    """(id): load-bearing nodes within a budget; every node if all fit.

    Traffic comes out first; then the smallest k whose core fits, else the deepest core."""
    if graph.nodes.count() <= budget:
        return graph.nodes.select("id")
    structural = graph.nodes.select("id").join(traffic(graph).select("id"), "id", "left_anti")
    shells = coreness(induced(graph, structural)).persist()
    sizes = sorted((r["core"], r["n"]) for r in shells.groupBy("core").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a shell
    deepest = sizes[-1][0] if sizes else 0
    k = next((k for k in range(1, deepest + 1) if sum(n for core, n in sizes if core >= k) <= budget), deepest)
    return shells.filter(F.col("core") >= k).select("id")
