"""What a view of a graph shows: messages by node, states, sentences and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.cores import skeleton
from weftgraph.operators.relational import degrees
from weftgraph.operators.scc import best_cuts, strongly_connected
from weftgraph.schema import PropertyGraph

# fixed values: the first state that holds for a node decides
PRECEDENCE = ("doomed", "stranded", "broken", "arrived", "added", "removed", "path", "impact", "violated", "lit")


def messages(violations: DataFrame, of: str = "node_ids") -> DataFrame:
    """(id, messages): the violations of each node, or with ``edge_ids`` of each edge, in order."""
    each = violations.select(F.explode(F.array_distinct(of)).alias("id"), "message")
    return each.groupBy("id").agg(F.array_sort(F.collect_list("message")).alias("messages"))


def states(graph: PropertyGraph, sets: dict[str, DataFrame]) -> DataFrame:
    """(id, state): the first of ``PRECEDENCE`` whose set (id) holds the node, else ``rest``."""
    if unknown := set(sets) - set(PRECEDENCE):
        raise ValueError(f"no such states: {sorted(unknown)}")
    marks = graph.nodes.sparkSession.createDataFrame([], "id string, place int")
    for name, ids in sets.items():
        marks = marks.unionByName(ids.select("id", F.lit(PRECEDENCE.index(name)).alias("place")))
    first = marks.groupBy("id").agg(F.min("place").alias("place"))
    names = F.array(*(F.lit(n) for n in PRECEDENCE))
    return graph.nodes.select("id").join(first, "id", "left").select("id", F.coalesce(F.get(names, F.col("place")), F.lit("rest")).alias("state"))


def impact_status(graph: PropertyGraph, reached: DataFrame) -> DataFrame:
    """(status): one sentence; the node itself is not something that would break."""
    seen = reached.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n"))
    total = graph.nodes.agg(F.count(F.lit(1)).alias("total"))
    return seen.crossJoin(total).select(F.format_string("%d of %d nodes depend on it", "n", "total").alias("status"))  # both are one row


def path_status(graph: PropertyGraph, path: DataFrame) -> DataFrame:
    """(status): the labels of a path (hop, id); null for less than two nodes."""
    named = path.join(graph.nodes.select("id", "label"), "id", "left").select("hop", F.coalesce("label", "id").alias("label"))
    steps = named.agg(F.array_sort(F.collect_list(F.struct("hop", "label"))).alias("s"))  # a row a hop
    return steps.select(F.when(F.size("s") > 1, F.concat(F.lit("shortest way: "), F.array_join(F.col("s.label"), " - "))).alias("status"))


def deletion_status(report: DataFrame) -> DataFrame:
    """(status): one sentence on a row of ``doctor.simulate_delete``."""
    return report.select(F.format_string("without it: %d broken, %d orphaned, %d cycles fewer", "broken", "orphaned", "cycles_resolved").alias("status"))


def frame_status(frames: DataFrame, ord_: int) -> DataFrame:
    """(status): one sentence on a frame of a timeline (ord, nodes, edges, added, removed)."""
    return frames.filter(F.col("ord") == ord_).select(F.format_string("frame %d: %d nodes, %d edges, %d came, %d went", "ord", "nodes", "edges", "added", "removed").alias("status"))


def screen(graph: PropertyGraph, shown: DataFrame) -> DataFrame:
    """(files, folders) of the nodes (id) on screen."""
    seen = graph.nodes.join(shown.select("id").distinct(), "id", "left_semi")
    return seen.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("cluster").alias("folders"))


def opening(graph: PropertyGraph, budget: int = 400) -> DataFrame:
    """(id, scc): where to stand first: of the weightiest cycle that touches the skeleton, the
    member of the skeleton with most neighbours (ties: least id).  Empty without such a cycle."""
    members = strongly_connected(graph.edges)
    sizes = members.groupBy("scc").agg(F.count(F.lit(1)).alias("size"))
    weights = sizes.join(best_cuts(graph.edges, members=members).select("scc", "frees"), "scc", "left").select("scc", F.coalesce("frees", "size").alias("impact"))
    firm = members.join(skeleton(graph, budget), "id").join(weights, "scc").join(degrees(graph).select("id", "neighbours"), "id")
    return firm.orderBy(F.desc("impact"), "scc", F.desc("neighbours"), "id").limit(1).select("id", "scc")


def district_radius(files: Column) -> Column:
    """Radius of a folder of so many files."""
    return F.round(2.2 + 1.5 * F.sqrt(files), 9)


def link_radius(weight: Column) -> Column:
    """Radius of a link between folders."""
    return F.round(F.least(0.12 + 0.14 * F.log2(weight + 1), F.lit(0.85)), 9)
