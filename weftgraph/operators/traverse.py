"""Reachability, shortest paths and neighbourhoods by frontiers.

A round joins the frontier with the edges and leaves out what has been seen;
the number of rounds is the depth reached."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.relational import both_ways, traffic
from weftgraph.plans.iterate import drop_folder, folders_in, materialise, shared_folder
from weftgraph.schema import PropertyGraph

NO_ID = "id string, depth int"


def reachable(steps: DataFrame, starts: DataFrame, most: int | None = None, stop: DataFrame | None = None, until: str | None = None) -> DataFrame:
    """(root, id, depth): breadth-first depth of everything reachable from each start over steps (a, b).

    ``starts`` (id): any number of roots, searched at once.  ``stop`` (id): reached but not
    travelled through, unless a root.  ``until``: ends once this id has been reached."""
    steps = materialise(steps.select("a", "b").distinct())
    frontier = materialise(starts.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    seen, depth = frontier, 0
    while most is None or depth < most:
        depth += 1
        via = frontier if stop is None or depth == 1 else frontier.join(stop.select("id"), "id", "left_anti")
        grown = via.join(steps, via["id"] == steps["a"]).select("root", F.col("b").alias("id")).distinct()
        frontier = materialise(grown.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)).select("root", "id", "depth"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # of materialised rounds; cut again now and then
        if depth % 16 == 0:
            seen = materialise(seen)
        if until is not None and not frontier.filter(F.col("id") == until).isEmpty():
            break
    return seen


def importers(graph: PropertyGraph) -> DataFrame:
    """(a, b): from an item to what imports it."""
    return graph.edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))


def impact(graph: PropertyGraph, node: str) -> DataFrame:
    """(id, depth): what depends on a node, itself included at 0."""
    start = graph.nodes.filter(F.col("id") == node).select("id")
    return reachable(importers(graph), start).select("id", "depth")


def levels(parts: DataFrame, steps: DataFrame) -> tuple[DataFrame, int]:
    """((part, level) of the parts of an acyclic graph: no step (a, b) leads to the same or a lower level; number of levels).

    A round takes out the steps from parts that no other step leads to."""
    left, rounds = steps.select("a", "b"), []
    while not left.isEmpty():
        ends = left.select(F.col("b").alias("a")).distinct().withColumn("held", F.lit(True))
        split = materialise(left.join(ends, "a", "left"))
        rounds.append(split.filter("held is null").select("a", "b", F.lit(len(rounds)).alias("level")))
        left = split.filter("held").select("a", "b")
    known = parts.select("part", F.lit(0).alias("level"))
    for taken in rounds:  # of materialised rounds
        known = known.unionByName(taken.select(F.col("b").alias("part"), (F.col("level") + 1).alias("level")))
    return materialise(known.groupBy("part").agg(F.max("level").alias("level"))), len(rounds) + 1


def _folded(parts: DataFrame, steps: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(sizes (part, reached) of all that those parts reach under which the graph is a tree; the other parts and what
    several steps lead to (part, size), each with the trees under it folded in, and the steps between them, if there are any).  ``parts`` (part, size), ``steps`` (a, b) without cycles.

    Under a part that one step leads to, nothing is reached from elsewhere but through it: sums go up from such parts by
    pointer doubling, in as many rounds as the logarithm of the depth, and with them the number of steps into parts that several lead to."""
    into = materialise(steps.groupBy(F.col("b").alias("part")).agg(F.count(F.lit(1)).alias("into"), F.min("a").alias("up")))
    several = into.filter("into > 1").select(F.col("part").alias("b"))
    crossing = steps.join(several, "b", "left_semi").groupBy(F.col("a").alias("part")).agg(F.count(F.lit(1)).alias("crossing"))
    first = parts.join(into.filter("into = 1").select("part", "up"), "part", "left").join(crossing, "part", "left")
    first = materialise(first.select("part", "size", "up", F.coalesce("crossing", F.lit(0)).cast("long").alias("crossing")))
    state = first.select("part", "up", F.col("size").alias("reached"), "crossing")
    while not (moving := state.filter("up is not null")).isEmpty():
        sent = moving.groupBy(F.col("up").alias("part")).agg(F.sum("reached").alias("r"), F.sum("crossing").alias("c"))
        after = moving.select(F.col("part").alias("up"), F.col("up").alias("next"))
        summed = state.join(sent, "part", "left").join(after, "up", "left")
        state = materialise(summed.select("part", F.col("next").alias("up"), *((F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("reached", "r"), ("crossing", "c")))))
    trees = state.filter("crossing = 0").select("part", "reached")
    if several.isEmpty():
        return trees, None
    # parts that several steps lead to are counted by words, though what they reach may be a tree
    shared = state.filter("crossing > 0").select("part").unionByName(several.withColumnRenamed("b", "part")).distinct()
    below = first.filter("up is not null").join(trees, "part").groupBy(F.col("up").alias("part")).agg(F.sum("reached").alias("below"))
    core = first.join(shared, "part", "left_semi").join(below, "part", "left").select("part", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size"))
    core = materialise(core)
    return trees, (core, materialise(steps.join(core.select(F.col("part").alias("b")), "b", "left_semi").select("a", "b")))


def _reached(parts: DataFrame, steps: DataFrame, asked: DataFrame, placed: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(part, reached): size of all that each asked part (part, number) reaches, itself included.  ``parts`` (part, size),
    ``steps`` (a, b) without cycles, ``placed``: their ``levels``, if known.

    64 numbers make a block.  A part's row of a block is one word: which of the block's parts reach it.  Words go
    along the levels of the graph; what is sent waits, as Parquet by the level it is meant for, so that every word is
    written once, and a level adds up 64 sums a block."""
    spark = parts.sparkSession
    placed, depth = levels(parts, steps) if placed is None else placed
    placed = materialise(placed.join(parts, "part"))
    onward = materialise(steps.join(placed.select(F.col("part").alias("b"), F.col("level").alias("to")), "b").select("a", "b", "to"))
    own = materialise(
        asked.join(placed, "part").select("part", "level", F.shiftright("number", 6).alias("block"), F.expr("shiftleft(1L, cast(number & 63 as int))").alias("word"))
    )
    folder, shape, counts = f"{shared_folder(spark)}/reach-{uuid.uuid4().hex}", "part long, block long, word long", None
    for level in range(depth):
        words = own.filter(F.col("level") == level).select("part", "block", "word")
        if level in (waiting := {int(n.rpartition("=")[2]) for n in folders_in(spark, f"{folder}/sent")}):
            words = words.unionByName(spark.read.schema(shape).parquet(f"{folder}/sent/to={level}"))
        elif words.isEmpty():
            continue
        words = words.groupBy("part", "block").agg(F.bit_or("word").alias("word"))  # read twice, a word for each step that led here
        sent = words.join(onward, words["part"] == onward["a"]).groupBy(F.col("b").alias("part"), "block", "to").agg(F.bit_or("word").alias("word"))
        sent.write.partitionBy("to").mode("append").parquet(f"{folder}/sent")
        sums = [F.sum(F.when(F.expr(f"word & shiftleft(1L, {k}) <> 0"), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(64)]
        here = words.join(placed.select("part", "size"), "part").groupBy("block").agg(*sums).select("block", F.array(*(f"s{k}" for k in range(64))).alias("sums"))
        here = materialise(here)
        counts = here if counts is None else counts.unionByName(here)
        if level in waiting:
            drop_folder(spark, f"{folder}/sent/to={level}")
    if counts is None:
        return asked.select("part", F.lit(0).cast("long").alias("reached")).limit(0)
    each = counts.select("block", F.posexplode("sums").alias("bit", "n")).groupBy((F.col("block") * 64 + F.col("bit")).alias("number")).agg(F.sum("n").alias("reached"))
    return materialise(asked.join(each, "number").select("part", "reached"))


def _condensed(graph: PropertyGraph) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
    """((id, part) of every node; what ``_folded`` makes of the parts).  Nodes of one cycle reach the same and are one part."""
    from weftgraph.operators.scc import strongly_connected  # which uses this module

    edges = materialise(graph.sound().edges.select("src", "dst"))
    part = graph.nodes.select("id").distinct().join(strongly_connected(edges), "id", "left").select("id", F.coalesce("scc", "id").alias("name"))
    named = part.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    named = materialise(named.withColumn("part", F.monotonically_increasing_id()))
    part = materialise(part.join(named, "name").select("id", "part"))
    steps = importers(PropertyGraph(graph.nodes, edges)).join(part.select(F.col("id").alias("a"), F.col("part").alias("pa")), "a").join(part.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b")
    steps = materialise(steps.filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    return part, *_folded(named.select("part", "size"), steps)


def _counted(wanted: DataFrame, core: tuple[DataFrame, DataFrame], placed: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(id, reached: itself included) of the wanted nodes (id, part), whose parts lie in the core."""
    asked = materialise(wanted.select("part").distinct().withColumn("number", F.monotonically_increasing_id()))
    return wanted.join(_reached(*core, asked, placed), "part").select("id", "reached")


def impact_counts(graph: PropertyGraph, roots: DataFrame | None = None) -> DataFrame:
    """(id, reached): exact number of dependents of every node, or of the nodes asked for (id).

    Nodes of one cycle reach the same, so components are searched and their sizes added up; where the graph of components is a
    tree, so are sums.  Elsewhere the state is a word for every component and every 64 components asked for that reach it; rounds
    follow the longest path."""
    part, trees, core = _condensed(graph)
    wanted = part if roots is None else materialise(part.join(roots.select("id").distinct(), "id", "left_semi"))
    found = wanted.join(trees, "part").select("id", "reached")
    if core is not None:
        found = found.unionByName(_counted(wanted.join(trees, "part", "left_anti"), core))
    return found.select("id", (F.col("reached") - 1).alias("reached"))


def shortest_path(graph: PropertyGraph, source: str, target: str) -> DataFrame:
    """(hop, id): an undirected shortest path; at every hop back from the target the least id
    goes on.  Empty if there is none."""
    steps = both_ways(graph.edges).distinct()
    seen = reachable(steps, graph.nodes.filter(F.col("id") == source).select("id"), until=target)
    last = seen.filter(F.col("id") == target).select("depth").first()
    if last is None:
        return seen.filter("false").select(F.col("depth").alias("hop"), "id")
    rows, here = [(last["depth"], target)], target  # one row a hop
    for depth in range(last["depth"] - 1, -1, -1):
        here = seen.filter(F.col("depth") == depth).join(steps.filter(F.col("a") == here).select(F.col("b").alias("id")), "id").agg(F.min("id")).first()[0]
        rows.append((depth, here))
    return graph.nodes.sparkSession.createDataFrame(sorted(rows), "hop int, id string")


def path_edges(graph: PropertyGraph, path: DataFrame) -> DataFrame:
    """(hop, edge): of each hop of a path, the edge in either direction with the least id."""
    pairs = path.select("hop", F.col("id").alias("a")).join(path.select((F.col("hop") - 1).alias("hop"), F.col("id").alias("b")), "hop")
    ways = pairs.unionByName(pairs.select("hop", F.col("b").alias("a"), F.col("a").alias("b")))
    found = graph.edges.join(ways.select("hop", F.col("a").alias("src"), F.col("b").alias("dst")), ["src", "dst"])
    return found.groupBy("hop").agg(F.min("id").alias("edge"))


def neighbourhood(graph: PropertyGraph, focus: str, hops: int, blocked: DataFrame | None = None) -> DataFrame:
    """(id, depth): within so many undirected hops; blocked ids are shown, not travelled through."""
    start = graph.nodes.filter(F.col("id") == focus).select("id")
    return reachable(both_ways(graph.edges), start, hops, blocked).select("id", "depth")


def fitting_neighbourhood(graph: PropertyGraph, focus: str, budget: int = 150, widest: int = 3) -> DataFrame:
    """(id, depth): the widest of 1..``widest`` hops within the budget; one hop always."""
    seen = neighbourhood(graph, focus, widest, traffic(graph).select("id"))
    sizes = {r["depth"]: r["n"] for r in seen.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a hop
    hops = 1
    for h in range(2, widest + 1):
        if sum(n for d, n in sizes.items() if d <= h) <= budget:
            hops = h
    return seen.filter(F.col("depth") <= hops)


def farthest(graph: PropertyGraph, node: str) -> DataFrame:
    """(id, depth): the farthest undirected ring's least id."""
    seen = reachable(both_ways(graph.edges), graph.nodes.filter(F.col("id") == node).select("id"))
    return seen.select("id", "depth").orderBy(F.desc("depth"), "id").limit(1)


def subject(graph: PropertyGraph, batch: int = 1024) -> DataFrame:
    """(id, score): the node whose neighbourhood is closest to 0.3 of the graph and whose
    reach is largest: -3 * |neighbours / n - 0.3| + dependents / n.

    The first term is known of all nodes, the second is below 1.  Dependents are known at once where the graph of components is a tree;
    of the others, they are counted for the best by the first term, ``batch`` nodes and then twice as many each time, until no
    other node can win.  Components and levels are those of the whole graph, found once."""
    count = graph.nodes.count()
    n = F.lit(max(count, 1)).cast("double")
    near = both_ways(graph.edges).distinct().groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("near"))
    first = (-3 * F.abs(F.coalesce("near", F.lit(0)) / n - 0.3)).alias("first")
    part, trees, core = _condensed(graph)
    open_ = materialise(part.join(near, "id", "left").select("id", "part", first))
    score = F.round(F.col("first") + (F.col("reached") - 1) / n, 9).alias("score")
    top = lambda df: materialise(df.orderBy(F.desc("score"), "id").limit(1))
    best = top(open_.join(trees, "part").select("id", score))
    if core is None:
        return best
    placed = levels(*core)
    open_ = open_.join(trees, "part", "left_anti")
    while True:
        least = best.first()
        open_ = materialise(open_ if least is None else open_.filter(F.round(F.col("first") + 1, 9) >= least["score"]))
        if open_.isEmpty():
            return best
        tried = materialise(open_.orderBy(F.desc("first"), "id").limit(batch))
        best = top(best.unionByName(_counted(tried.select("id", "part"), core, placed).join(tried, "id").select("id", score)))
        open_ = open_.join(tried.select("id"), "id", "left_anti")
        batch *= 2
