"""Strongly connected components.

Graphs within ``plans.bounded.LIMIT`` edges, and in larger graphs all weak components
within it, are decomposed by one depth-first search each, in one task each.  What is
left is worked on by joins.  Trimming drops edges at nodes without in- or out-edges.
Chains of nodes with one in- and one out-edge are contracted by pointer doubling, in
as many rounds as the logarithm of their length; a ring of nothing else is a component
as it stands.  Then passes follow.  Of each weak component, up to 64 pivots are drawn by hash,
and every node learns, as the bits of two words, which of them reach it and which it
reaches.  Nodes that share a pivot both ways are its component; the others are split by
their two words, as no component lies across two different pairs, and the edges between the parts are dropped.
A pass settles the largest component almost surely and leaves parts with pivots of their own, so
that their number grows from pass to pass.  A round of a pass sends only words that have changed; rounds
follow the longest of the shortest paths from a pivot.

A component is named by its least id; single nodes are not components, with or
without a self-loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import cuts
from weftgraph.plans import bounded
from weftgraph.plans.iterate import materialise

#: edges of a component that is searched for its best cut
CUT_LIMIT = 1 << 20


def search(following: list[list[int]]) -> list[int]:
    """Component number of every node, by one depth-first search that keeps its own stack."""
    n = len(following)
    index, low, component, place = [0] * n, [0] * n, [-1] * n, [0] * n
    path: list[int] = []
    order = count = 0
    for start in range(n):
        work = [start] if not index[start] else []
        while work:
            node = work[-1]
            if not index[node]:
                order += 1
                index[node] = low[node] = order
                path.append(node)
            ends, k = following[node], place[node]
            while k < len(ends) and index[ends[k]]:
                if component[ends[k]] < 0:
                    low[node] = min(low[node], low[ends[k]])
                k += 1
            place[node] = k
            if k < len(ends):
                work.append(ends[k])
                continue
            work.pop()
            if low[node] == index[node]:
                while True:
                    component[path[-1]] = count
                    if path.pop() == node:
                        break
                count += 1
    return component


def _members(table: pa.Table) -> pa.Table:
    """(id, scc) of the components of two nodes or more of edges (src, dst)."""
    ids, (src, dst) = bounded.coded(table, "src", "dst")
    found = np.array(search(bounded.neighbours(len(ids), src, dst)))
    sizes = np.bincount(found)
    least = np.full(len(sizes), len(ids))
    np.minimum.at(least, found, np.arange(len(ids)))
    own = np.flatnonzero(sizes[found] > 1)
    kind = table.schema.field("src").type
    return pa.table({"id": pa.array(ids[own].tolist(), kind), "scc": pa.array(ids[least[found[own]]].tolist(), kind)})


def _trim(edges: DataFrame, rounds: int = 1) -> DataFrame:
    """Leaves out edges that cannot lie on a cycle, for a bounded number of rounds."""
    for _ in range(rounds):
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = materialise(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
    return edges


def _jump(pointers: DataFrame) -> DataFrame:
    """Every pointer to a chain node moves on to where that node points."""
    step = pointers.select(F.col("id").alias("end"), F.col("end").alias("e2"), F.col("last").alias("l2"), F.col("least").alias("m2"))
    return pointers.join(step, "end", "left").select(
        "id", F.coalesce("e2", "end").alias("end"), F.coalesce("l2", "last").alias("last"), F.least("least", F.coalesce("m2", "least")).alias("least"), F.col("e2").isNotNull().alias("moved")
    )


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges without chain nodes, chains (id, last, start, end), rings (id, scc))."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"), F.min("dst").alias("next"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("into"))
    inner = materialise(out.join(into, "id").filter("out = 1 and into = 1").select("id", "next"))
    pointers = inner.select("id", F.col("next").alias("end"), F.col("id").alias("last"), F.col("id").alias("least"))
    for _ in range(max(1, inner.count()).bit_length() + 1):
        jumped = materialise(_jump(pointers))
        pointers = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            break
    closed = pointers.join(inner.select(F.col("id").alias("end")), "end", "left_semi")
    rings = closed.select("id", F.col("least").alias("scc"))
    opened = pointers.join(closed.select("id"), "id", "left_anti")
    entries = edges.join(opened.select(F.col("id").alias("dst"), "last", "end"), "dst").join(inner.select(F.col("id").alias("src")), "src", "left_anti")
    starts = entries.select("last", F.col("src").alias("start"), "end")
    plain = edges.join(inner.select(F.col("id").alias("src")), "src", "left_anti").join(inner.select(F.col("id").alias("dst")), "dst", "left_anti")
    rest = plain.unionByName(starts.filter("start <> end").select(F.col("start").alias("src"), F.col("end").alias("dst"))).distinct()
    return materialise(rest), materialise(opened.select("id", "last").join(starts, "last")), rings


PIVOTS = 64


def _signatures(edges: DataFrame) -> DataFrame:
    """(id, part, ahead, back, pivot): for the nodes of edges (src, dst, part), which pivots of their part reach them and
    which they reach, as bits, and the number of the pivot that a node is."""
    ids = edges.select(F.col("src").alias("id"), "part").unionByName(edges.select(F.col("dst").alias("id"), "part")).distinct()
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("id"), "id"))
    pivots = ids.withColumn("pivot", place - 1).filter(F.col("pivot") < PIVOTS)  # a bounded rank is cut before the shuffle
    state = ids.join(pivots.select("id", "pivot"), "id", "left")
    own = F.coalesce(F.expr("shiftleft(1L, pivot)"), F.lit(0).cast("long"))
    state = materialise(state.select("id", "part", "pivot", own.alias("ahead"), own.alias("back"), F.col("pivot").isNotNull().alias("changed")))
    none = F.lit(0).cast("long")
    while not (news := state.filter("changed").select("id", "ahead", "back")).isEmpty():
        ahead = edges.join(news, edges["src"] == news["id"]).select(F.col("dst").alias("id"), "ahead", none.alias("back"))
        back = edges.join(news, edges["dst"] == news["id"]).select(F.col("src").alias("id"), none.alias("ahead"), "back")
        sent = ahead.unionByName(back).groupBy("id").agg(F.bit_or("ahead").alias("a"), F.bit_or("back").alias("b"))
        now = [F.col(c).bitwiseOR(F.coalesce(x, none)).alias(c) for c, x in (("ahead", "a"), ("back", "b"))]
        more = F.coalesce((F.col("a").bitwiseAND(F.bitwise_not("ahead")) != 0) | (F.col("b").bitwiseAND(F.bitwise_not("back")) != 0), F.lit(False))
        state = materialise(state.join(sent, "id", "left").select("id", "part", "pivot", *now, more.alias("changed")))
    return state.drop("changed")


def _pass(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components (id, scc) that the pivots of edges (src, dst, part) lie in, edges (src, dst) that may lie in others)."""
    known = _signatures(edges)
    both = F.col("ahead").bitwiseAND(F.col("back"))
    below = F.coalesce(F.try_subtract(both, F.lit(1)), F.lit((1 << 63) - 1))  # of the sign bit alone, all other bits
    least = F.bit_count(F.bitwise_not(both).bitwiseAND(below))  # place of the lowest bit
    found = known.filter(both != 0).select("id", "part", least.alias("pivot"))
    roots = known.filter("pivot is not null").select("part", "pivot", F.col("id").alias("scc"))
    settled = materialise(found.join(roots, ["part", "pivot"]).select("id", "scc"))
    left = materialise(known.filter(both == 0).select("id", F.xxhash64("part", "ahead", "back").alias("part")))
    ends = edges.join(left.select(F.col("id").alias("src"), F.col("part").alias("ps")), "src").join(left.select(F.col("id").alias("dst"), F.col("part").alias("pd")), "dst")
    sizes = settled.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return settled.join(sizes, "scc").select("id", "scc"), ends.filter("ps = pd").select("src", "dst")


def strongly_connected(edges: DataFrame, limit: int = bounded.LIMIT) -> DataFrame:
    """(id, scc) of every node in a component of two nodes or more; edges (src, dst)."""
    edges = materialise(edges.select("src", "dst").filter("src <> dst").distinct())
    kind = edges.schema["src"].dataType.simpleString()
    schema = f"id {kind}, scc {kind}"
    if edges.count() <= limit:
        return materialise(bounded.whole(edges, _members, schema))
    edges = _trim(edges, 2)
    rest, chains, rings = _chains(edges)
    found = rest.select(F.col("src").alias("id"), F.col("src").alias("scc")).limit(0)
    while True:
        rest = _trim(rest)
        settled, rest = bounded.settle(rest, _members, schema, limit)
        found = materialise(found.unionByName(settled))
        if rest is None:
            break
        settled, rest = _pass(materialise(rest.withColumnRenamed("component", "part")))
        found = materialise(found.unionByName(settled))
        rest = materialise(rest)
    # chains between two nodes of one component, or from a node back to itself, belong to it
    tagged = chains.join(found.select(F.col("id").alias("start"), F.col("scc").alias("s1")), "start", "left").join(found.select(F.col("id").alias("end"), F.col("scc").alias("s2")), "end", "left")
    tagged = tagged.filter("start = end or s1 = s2").select("id", "start", F.coalesce("s1", "start").alias("scc"))
    members = found.unionByName(tagged.select("id", "scc")).unionByName(tagged.select(F.col("start").alias("id"), "scc")).distinct()
    members = members.unionByName(rings)
    names = members.groupBy("scc").agg(F.min("id").alias("name"))
    return materialise(members.join(names, "scc").select("id", F.col("name").alias("scc")))


def cycles(edges: DataFrame) -> DataFrame:
    """(scc, size): components of two nodes or more."""
    return strongly_connected(edges).groupBy("scc").agg(F.count(F.lit(1)).alias("size"))


def tangled(edges: DataFrame) -> DataFrame:
    """(tangled): number of nodes on cycles."""
    return strongly_connected(edges).agg(F.count(F.lit(1)).alias("tangled"))


def inside(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(scc, src, dst): distinct edges with both ends in one component.  ``members``: the components, if known."""
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    members = strongly_connected(edges) if members is None else members
    ends = edges.join(members.select(F.col("id").alias("src"), "scc"), "src").join(members.select(F.col("id").alias("dst"), F.col("scc").alias("other")), "dst")
    return materialise(ends.filter("scc = other").select("scc", "src", "dst"))


def too_large(within: DataFrame, limit: int = CUT_LIMIT) -> DataFrame:
    """(scc) of the components of more than ``limit`` edges ``within`` (scc, src, dst)."""
    return within.groupBy("scc").agg(F.count(F.lit(1)).alias("edges")).filter(F.col("edges") > limit).select("scc")


def best_cuts(edges: DataFrame, members: DataFrame | None = None, within: DataFrame | None = None, limit: int = CUT_LIMIT) -> DataFrame:
    """(scc, size, src, dst, frees): of each component, the edge whose removal frees most nodes
    (ties: least src, dst); a component that no single edge breaks has none.

    All edges of a component are judged at once (``cuts``), in one task and in memory of a few
    hundred bytes an edge; components ``too_large`` for that are not searched.  ``members``,
    ``within``: the components and the edges inside them, if known."""
    within = inside(edges, members) if within is None else within
    kind = within.schema["src"].dataType.simpleString()
    searched = within.join(too_large(within, limit), "scc", "left_anti")
    return searched.groupBy("scc").applyInArrow(cuts.best_cut, f"scc {kind}, size long, src {kind}, dst {kind}, frees long")
