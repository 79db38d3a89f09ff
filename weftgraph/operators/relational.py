"""Relational questions about a graph: degrees, roll-ups, subgraphs, orphans, modularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import PropertyGraph

# fixed values: names a framework or tool calls, so that nothing needs to import them
ENTRY_NAMES = r"(?i)\A(main|index|app|root|setup|vite-env|middleware|instrumentation)\z"
ROUTER_NAMES = (
    r"(?i)\A(route|page|layout|template|default|loading|error|global-error|not-found|manifest|sitemap|robots|icon|apple-icon|opengraph-image|twitter-image)\z"
)
TOOL_SUFFIX = r"(?i)\.(config|setup|d)\z"
RUN_FROM_OUTSIDE = r"(?i)(\A|/)(scripts|bin|tests?|e2e|__tests__|playwright|cypress)/"
CLUSTER_COLOURS = ("#89b4fa", "#a6e3a1", "#cba6f7", "#fab387", "#94e2d5", "#f5c2e7", "#f9e2af", "#b4befe")
SYNTHETIC = ("api", "query-key")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): every edge in both directions, self-loops left out, repeats kept."""
    ends = edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(graph: PropertyGraph) -> DataFrame:
    """(id, imports, used_by, neighbours): out-edges, in-edges, distinct other ends.

    The edges are read once and become a row an unordered pair first, with the number of edges each way, so that a pair
    of opposite edges is one neighbour; then both ends of a pair are counted."""
    ahead = F.coalesce(F.col("src") <= F.col("dst"), F.lit(False))
    pairs = graph.edges.select(F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("b"), ahead.alias("ahead"))
    pairs = pairs.repartition(graph.parts, "a", "b") if graph.parts else pairs
    ways = pairs.groupBy("a", "b").agg(F.count_if("ahead").alias("there"), F.count_if(~F.col("ahead")).alias("back"))
    near = F.when(F.col("a") != F.col("b"), 1).otherwise(0).alias("near")
    ends = F.explode(F.array(*(F.struct(F.col(end).alias("id"), F.col(out).alias("out"), F.col(into).alias("into"), near) for end, out, into in (("a", "there", "back"), ("b", "back", "there")))))
    found = ways.select(ends.alias("e")).select("e.*").groupBy("id").agg(F.sum("out").alias("imports"), F.sum("into").alias("used_by"), F.sum("near").alias("neighbours"))
    joined = graph.nodes.select("id").join(found, "id", "left")
    return joined.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("imports", "used_by", "neighbours")))


def filter_edges(graph: PropertyGraph, *kinds: str) -> DataFrame:
    return graph.edges.filter(F.col("type").isin(*kinds)) if kinds else graph.edges


def folder_rollup(graph: PropertyGraph, *kinds: str) -> DataFrame:
    """(src_cluster, dst_cluster, weight): edges between different folders.

    Edges are counted by folder and target before the target is looked up, so that a hub is a row a folder.  Nodes grow
    with the edges and are merged at any size, never broadcast."""
    cluster = graph.nodes.select("id", "cluster").hint("merge")
    out = filter_edges(graph, *kinds).join(cluster.select(F.col("id").alias("src"), F.col("cluster").alias("src_cluster")), "src")
    ends = out.groupBy("src_cluster", "dst").agg(F.count(F.lit(1)).alias("n")).join(cluster.select(F.col("id").alias("dst"), F.col("cluster").alias("dst_cluster")), "dst")
    return ends.filter("src_cluster <> dst_cluster").groupBy("src_cluster", "dst_cluster").agg(F.sum("n").alias("weight"))


def clusters(graph: PropertyGraph) -> DataFrame:
    """(cluster, size, colour): folders, largest first (ties by name), eight colours in turn."""
    sizes = graph.nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    place = F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1  # one row a folder
    colour = F.element_at(F.array(*map(F.lit, CLUSTER_COLOURS)), place % len(CLUSTER_COLOURS) + 1)
    return sizes.select("cluster", "size", colour.alias("colour"))


def type_counts(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def base_name(path: Column) -> Column:
    """Last piece of a path without its script extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[jt]sx?\z", "")


def orphans(graph: PropertyGraph) -> DataFrame:
    """(id): nodes nothing imports and no convention explains."""
    base = base_name(F.col("id"))
    silent = ~F.col("type").isin("page", *SYNTHETIC) & ~F.col("file").rlike(RUN_FROM_OUTSIDE)
    silent = silent & ~base.rlike(ENTRY_NAMES) & ~base.rlike(ROUTER_NAMES) & ~base.rlike(TOOL_SUFFIX)
    reached = graph.edges.select(F.col("dst").alias("id")).distinct()  # combined before the shuffle, so that a hub is one row a task
    return graph.nodes.filter(silent).join(reached, "id", "left_anti").select("id")


def induced(graph: PropertyGraph, ids: DataFrame, without: str | None = None) -> PropertyGraph:
    """The graph on a set of ids (id), optionally without one edge id."""
    ids = ids.select("id").distinct()
    edges = graph.edges if without is None else graph.edges.filter(F.col("id") != without)
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return PropertyGraph(graph.nodes.join(ids, "id", "left_semi"), kept.select(graph.edges.columns), graph.meta)


def without_node(graph: PropertyGraph, node: str) -> PropertyGraph:
    return PropertyGraph(graph.nodes.filter(F.col("id") != node), graph.edges.filter((F.col("src") != node) & (F.col("dst") != node)), graph.meta)


def changed_scope(graph: PropertyGraph) -> DataFrame:
    """(id): nodes that a diff added or removed, and their neighbours."""
    changed = graph.nodes.filter("diff is not null and diff <> 'same'").select("id")
    near = both_ways(graph.edges).join(changed.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id"))
    return changed.unionByName(near).distinct()


def lit_set(graph: PropertyGraph, node: str) -> DataFrame:
    """(id): a node and its direct neighbours."""
    near = both_ways(graph.edges).filter(F.col("a") == node).select(F.col("b").alias("id"))
    return graph.nodes.filter(F.col("id") == node).select("id").unionByName(near).distinct()


def edges_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in a set (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def traffic(graph: PropertyGraph, share: float = 0.03, least: int = 20) -> DataFrame:
    """(id, degree): nodes with so many edges that paths through them say nothing:
    max(``least``, round half up of ``share`` of the nodes)."""
    bound = graph.nodes.agg(F.greatest(F.lit(least).cast("double"), F.floor(F.count(F.lit(1)) * share + 0.5).cast("double")).alias("bound"))
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).filter("id is not null")
    counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).join(graph.nodes.select("id"), "id", "left_semi")
    return counted.join(F.broadcast(bound), F.col("degree") >= F.col("bound")).select("id", "degree")  # the bound is one row


def node_sizes(graph: PropertyGraph) -> DataFrame:
    """(id, size): min(0.65 + 0.22 * sqrt(neighbours), 1.7)."""
    return degrees(graph).select("id", F.round(F.least(0.65 + 0.22 * F.sqrt("neighbours"), F.lit(1.7)), 9).alias("size"))


def tour(graph: PropertyGraph, least: int = 3) -> DataFrame:
    """(id): nodes with at least so many neighbours."""
    return degrees(graph).filter(F.col("neighbours") >= least).select("id")


def search(graph: PropertyGraph, text: str) -> DataFrame:
    """(id, label): nodes whose label or id holds the text, whatever the case."""
    return graph.nodes.filter(F.contains(F.lower(F.concat_ws(" ", "label", "id")), F.lit(text.lower()))).select("id", "label")


def undirected_weights(edges: DataFrame) -> DataFrame:
    """(a, b, w): unordered pairs of different ends, and the number of edges between them."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("w"))


def modularity(graph: PropertyGraph, membership: DataFrame) -> DataFrame:
    """(quality): of a partition (id, community) of source files; 0 without edges.

    Sums are of whole numbers; only the last step is in doubles."""
    weights = graph.edges.filter("src <> dst")
    own = membership.select("id", "community")
    ends = weights.join(own.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(own.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    parts = ends.select(F.col("cs").alias("community"), F.lit(1).alias("t"), F.when(F.col("cs") == F.col("cd"), 1).otherwise(0).alias("i")).unionByName(
        ends.select(F.col("cd").alias("community"), F.lit(1).alias("t"), F.lit(0).alias("i"))
    )
    sums = parts.groupBy("community").agg(F.sum("t").alias("t"), F.sum("i").alias("i"))
    total = sums.agg(F.sum("i").alias("i"), F.sum("t").alias("t2"), F.sum(F.col("t").cast("decimal(38,0)") * F.col("t")).cast("double").alias("tt"))
    m = F.col("t2") / 2
    return total.select(F.round(F.when(F.coalesce(m, F.lit(0)) == 0, 0.0).otherwise(F.col("i") / m - F.col("tt") / (F.col("t2").cast("double") * F.col("t2"))), 9).alias("quality"))


def folders_as_membership(graph: PropertyGraph) -> DataFrame:
    return graph.nodes.filter(~F.col("type").isin(*SYNTHETIC)).select("id", F.col("cluster").alias("community"))


def disagreements(graph: PropertyGraph, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where folders and communities disagree, worst first by ``rank``.

    split (folder, community, files, rank): parts of 3 files and 15 % of a folder or more, in
    folders with two such parts at least; folders rank by the size of their second part.
    merged (community, folder, files, rank): folders of two files or more in communities with
    two such folders at least; communities rank by their number of such files.  Ties go by name."""
    counts = graph.nodes.select("id", "cluster").join(membership, "id").groupBy("cluster", "community").agg(F.count(F.lit(1)).alias("files"))
    whole = counts.groupBy("cluster").agg(F.sum("files").alias("whole"))
    parts = counts.join(whole, "cluster").filter("files >= 3 and files * 100 >= whole * 15")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("files"), "community"))  # six parts of 15 % at most
    second = parts.withColumn("place", place).filter("place = 2").select("cluster", F.col("files").alias("second"))
    ranked = second.select("cluster", F.row_number().over(Window.orderBy(F.desc("second"), "cluster")).cast("long").alias("rank"))  # a row a folder
    split = parts.join(ranked, "cluster").select(F.col("cluster").alias("folder"), "community", "files", "rank")
    firm = counts.filter("files > 1")
    joined = firm.groupBy("community").agg(F.count(F.lit(1)).alias("folders"), F.sum("files").alias("all")).filter("folders > 1")
    ranked = joined.select("community", F.row_number().over(Window.orderBy(F.desc("all"), "community")).cast("long").alias("rank"))  # a row a community
    merged = firm.join(ranked, "community").select("community", F.col("cluster").alias("folder"), "files", "rank")
    return split, merged
