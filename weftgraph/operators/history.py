"""Differences between graphs, timelines of snapshots, and searches through history."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.scc import strongly_connected
from weftgraph.plans.iterate import materialise
from weftgraph.schema import PropertyGraph

GHOST_COLOUR = "#6c7086"


def tag_difference(base: DataFrame, head: DataFrame) -> DataFrame:
    """Head rows as ``same`` or ``added``, and the rows that head dropped as ``removed``, by id."""
    base, head = base.drop("diff"), head.drop("diff")
    known = base.select("id").withColumn("_base", F.lit(True))
    tagged = head.join(known, "id", "left").withColumn("diff", F.when(F.col("_base"), "same").otherwise("added")).drop("_base")
    gone = base.join(head.select("id"), "id", "left_anti").withColumn("diff", F.lit("removed"))
    return tagged.unionByName(gone, allowMissingColumns=True)


def diff_graphs(base: PropertyGraph, head: PropertyGraph) -> PropertyGraph:
    """Both graphs in one, every node and edge tagged; its meta says that it is a diff."""
    meta = head.meta | {"project": f"{head.meta.get('project', '')} (diff)"}
    return PropertyGraph(tag_difference(base.nodes, head.nodes), tag_difference(base.edges, head.edges), meta)


def diff_counts(diff: PropertyGraph) -> DataFrame:
    """(added_nodes, removed_nodes, added_edges, removed_edges)."""
    rows = diff.nodes.select("diff", F.lit("n").alias("of")).unionByName(diff.edges.select("diff", F.lit("e").alias("of")))
    count = lambda status, of: F.count_if((F.col("diff") == status) & (F.col("of") == of))
    return rows.agg(count("added", "n").alias("added_nodes"), count("removed", "n").alias("removed_nodes"), count("added", "e").alias("added_edges"), count("removed", "e").alias("removed_edges"))


def diff_clusters(base: PropertyGraph, head: PropertyGraph, base_colours: DataFrame, head_colours: DataFrame) -> DataFrame:
    """(cluster, size, colour) of a diff, ghosts included; base's colour wins where both have one."""
    sizes = tag_difference(base.nodes, head.nodes).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    found = sizes.join(base_colours.select("cluster", F.col("colour").alias("b")), "cluster", "left").join(head_colours.select("cluster", F.col("colour").alias("h")), "cluster", "left")
    return found.select("cluster", "size", F.coalesce("b", "h", F.lit(GHOST_COLOUR)).alias("colour"))


def deltas(snapshots: DataFrame, key: list[str], values: list[str] | None = None) -> DataFrame:
    """(ord, change, *key, *values): added, removed and changed rows of each frame against the one before.

    ``snapshots`` (ord, *key, *values) holds every frame whole; frames are consecutive by their rank."""
    values = values or []
    ranks = snapshots.select("ord").distinct().withColumn("frame", F.row_number().over(Window.orderBy("ord")).cast("long") - 1)  # one row a frame
    rows = snapshots.select("ord", *key, *values).dropDuplicates(["ord", *key]).join(F.broadcast(ranks), "ord").drop("ord")
    last = ranks.agg(F.max("frame").alias("last"))
    before = rows.select((F.col("frame") + 1).alias("frame"), *key, F.struct(F.lit(1).alias("_"), *values).alias("old")).join(F.broadcast(last), F.col("frame") <= F.col("last")).drop("last")
    now = rows.select("frame", *key, F.struct(F.lit(1).alias("_"), *values).alias("new"))
    both = now.join(before, ["frame", *key], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    kept = both.withColumn("change", change).filter("change is not null")
    return kept.join(F.broadcast(ranks), "frame").select("ord", "change", *key, *(F.coalesce(F.col("new"), F.col("old"))[v].alias(v) for v in values))


def skip_log(changes: DataFrame, ords: DataFrame, key: list[str], values: list[str] | None = None) -> DataFrame:
    """(level, span, change, *key, *values): ``deltas`` merged over spans of 2**level frames, so that any frame is
    put together from the first and as many spans as its number has bits.

    ``ords`` (ord) has every frame, those without a change too.  Level -1 holds the first frame whole; span i of level j leads
    from frame i * 2**j to frame (i + 1) * 2**j and has the last change of each row in between."""
    values = values or []
    ranks = ords.select("ord").distinct().withColumn("frame", F.row_number().over(Window.orderBy("ord")).cast("int") - 1)  # one row a frame
    rows = changes.join(F.broadcast(ranks), "ord")
    first = rows.filter("frame = 0").select(F.lit(-1).alias("level"), F.lit(0).alias("span"), "change", *key, *values)
    most = ranks.agg(F.greatest(F.max("frame") - 1, F.lit(0)).alias("most"))  # one row
    placed = rows.filter("frame > 0").join(F.broadcast(most)).select("*", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("most") + 1)).cast("int"))).alias("level"))
    placed = placed.withColumn("span", F.expr("shiftright(frame - 1, level)"))
    last = placed.groupBy("level", "span", *key).agg(F.max_by(F.struct("change", *values), "frame").alias("last"))
    return first.unionByName(last.select("level", "span", "last.change", *key, *(F.col("last")[v].alias(v) for v in values)))


def spans_to(frame: int) -> list[tuple[int, int]]:
    """(level, span) of the spans that lead from the first frame to ``frame``, in order."""
    found, at = [], 0
    for level in range(frame.bit_length() - 1, -1, -1):
        if frame >> level & 1:
            found.append((level, at >> level))
            at += 1 << level
    return found


def frame_at(log: DataFrame, frame: int, key: list[str]) -> DataFrame:
    """Rows of frame 0, 1, ... from a ``skip_log``: each key's last change on the way to it, unless a removal."""
    way = [(-1, 0), *spans_to(frame)]
    place = F.when(F.lit(False), 0)
    for k, (level, span) in enumerate(way):
        place = place.when((F.col("level") == level) & (F.col("span") == span), k)
    wanted = reduce(lambda a, b: a | b, ((F.col("level") == level) & (F.col("span") == span) for level, span in way))
    others = [c for c in log.columns if c not in ("level", "span", *key)]
    last = log.filter(wanted).groupBy(*key).agg(F.max_by(F.struct(*others), place).alias("last")).filter("last.change <> 'removed'")
    return last.select(*key, *(F.col("last")[c].alias(c) for c in others if c != "change"))


def frames(snapshots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(ord, nodes, edges, added, removed): sizes of each frame (ord, src, dst), and how many
    nodes came and went.  ``nodes`` (ord, id): the nodes, where they are more than the ends of edges."""
    edges = snapshots.select("ord", "src", "dst").distinct()
    nodes = nodes.select("ord", "id").distinct() if nodes is not None else edges.select("ord", F.col("src").alias("id")).unionByName(edges.select("ord", F.col("dst").alias("id"))).distinct()
    moved = deltas(nodes, ["id"]).groupBy("ord").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    first = nodes.agg(F.min("ord").alias("first"))  # the first frame is whole: nothing is added in it
    out = nodes.groupBy("ord").agg(F.count(F.lit(1)).alias("nodes")).join(edges.groupBy("ord").agg(F.count(F.lit(1)).alias("edges")), "ord", "left").join(moved, "ord", "left")
    whole = F.col("ord") == F.col("first")
    return out.join(F.broadcast(first)).select("ord", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), *(F.when(whole, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("added", "removed")))


def pick_evenly(n: int, budget: int) -> list[int]:
    """Ordinals of an even sample with both ends; less than two: the newest."""
    if n == 0:
        return []
    if budget < 2:
        return [n - 1]
    if n <= budget:
        return list(range(n))
    stride = (n - 1) / (budget - 1)
    return list(dict.fromkeys([*(int(i * stride + 0.5) for i in range(budget)), n - 1]))


def sample_even(commits: DataFrame, budget: int) -> DataFrame:
    """The rows of an even sample of ``commits`` (ord: 0 upwards)."""
    return commits.filter(F.col("ord").isin(*pick_evenly(commits.count(), budget)))


def first_where(n: int, fact: Callable[[int], bool]) -> tuple[int | None, int]:
    """(first ordinal at which a lasting fact holds, probes): None if it does not hold at the
    end, or held at the beginning already; otherwise by bisection."""
    if n == 0 or not fact(n - 1):
        return None, min(n, 1)
    if n == 1:
        return None, 1
    if fact(0):
        return None, 2
    low, high, probes = 0, n - 1, 2
    while high - low > 1:
        middle = (low + high) // 2
        probes += 1
        low, high = (low, middle) if fact(middle) else (middle, high)
    return high, probes


def first_ord(facts: DataFrame, by: list[str], frames: DataFrame) -> DataFrame:
    """(*by, first_ord) when every frame is at hand: of facts (*by, ord: a frame in which it holds),
    the least ordinal; null if that is the first of ``frames`` (ord)."""
    start = frames.agg(F.min("ord").alias("start"))  # one row
    found = facts.groupBy(*by).agg(F.min("ord").alias("at")).join(F.broadcast(start))
    return found.select(*by, F.when(F.col("at") > F.col("start"), F.col("at")).alias("first_ord"))


def _tagged(edges: DataFrame) -> DataFrame:
    """Edges (ord, src, dst) of all frames as one graph, whose ids carry the frame."""
    tag = lambda c: F.concat_ws("\u0001", F.col("ord").cast("string"), c).alias(c)
    return edges.select(tag("src"), tag("dst"))


def frame_components(edges: DataFrame) -> DataFrame:
    """(ord, id, scc) of the cycles of every frame (ord, src, dst), all frames at once."""
    part = lambda c, k: F.split(c, "\u0001", 2)[k]
    return strongly_connected(_tagged(edges)).select(part("id", 0).cast("long").alias("ord"), part("id", 1).alias("id"), part("scc", 1).alias("scc"))


def timeline(edges: DataFrame, commits: DataFrame, shared: int = 1, nodes: DataFrame | None = None, broken: DataFrame | None = None) -> DataFrame:
    """(ord, sha, date, subject, nodes, edges, added, removed, cycles, violations) of every frame (ord, src, dst).

    ``commits`` (ord, sha, date, subject) gives names, shas cut to 8 characters.  ``nodes`` (ord, id): as for ``frames``.
    ``violations`` counts the rows of ``broken`` (ord), or else the targets of more than ``shared`` edges."""
    cycles = frame_components(edges).groupBy("ord").agg(F.count_distinct("scc").alias("cycles"))
    if broken is None:
        broken = edges.select("ord", "src", "dst").distinct().groupBy("ord", "dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shared)
    broken = broken.groupBy("ord").agg(F.count(F.lit(1)).alias("violations"))
    named = commits.select("ord", F.substr("sha", F.lit(1), F.lit(8)).alias("sha"), "date", "subject")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = frames(edges, nodes).join(named, "ord", "left").join(cycles, "ord", "left").join(broken, "ord", "left")
    return found.select("ord", "sha", "date", "subject", "nodes", "edges", "added", "removed", none("cycles"), none("violations"))


def blame(today: DataFrame, edges_of: Callable[[list[int]], DataFrame], n: int, shared: int = 1, broken_of: Callable[[list[int]], DataFrame] | None = None) -> DataFrame:
    """(what, subject, size, first_ord): of today's cycles, and of today's targets of more than ``shared``
    edges, the first of frames 0 to n - 1 in which all members lie in one cycle, or the target has as
    many; null if that is the first frame, or never.

    ``broken_of`` ordinals gives (ord, what, subject, size) of the violations of those frames; with it, these are
    blamed instead of shared targets, each since the first frame from which on it holds.

    Bisection, for all findings at once: a round asks for the frames (``edges_of`` ordinals gives ord,
    src, dst) that any finding needs next, and decomposes them together; rounds grow with log n."""
    today = today.select("src", "dst").distinct()
    members = materialise(strongly_connected(today))
    kind = members.schema["id"].dataType.simpleString()
    cycles = members.groupBy("scc").agg(F.count(F.lit(1)).alias("size"))
    if broken_of is None:
        others = today.groupBy(F.col("dst").alias("subject")).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > shared).withColumn("what", F.lit("shared"))
    elif n:
        others = broken_of([n - 1])
    else:
        others = today.sparkSession.createDataFrame([], "what string, subject string, size long")
    found = cycles.select(F.lit("cycle").alias("what"), F.col("scc").alias("subject"), "size").unionByName(others.select("what", "subject", "size"))
    if n == 0:
        return found.withColumn("first_ord", F.lit(None).cast("long"))
    # low: last frame known not to hold it (-1: none), high: first known to
    state = materialise(found.withColumns({"low": F.lit(-1).cast("long"), "high": F.lit(None).cast("long"), "ask": F.lit(n - 1).cast("long")}))
    while wanted := sorted(r["ask"] for r in state.select("ask").distinct().filter("ask is not null").collect()):  # ordinals: n at most
        edges = materialise(edges_of(wanted).select("ord", "src", "dst").distinct())
        seen = frame_components(edges).select("ord", "id", F.col("scc").alias("then"))
        held = members.join(seen, "id").groupBy("ord", "scc", "then").agg(F.count(F.lit(1)).alias("n")).join(cycles, "scc").filter("n = size")
        facts = held.select(F.lit("cycle").alias("what"), F.col("scc").alias("subject"), "ord")
        if broken_of is None:
            many = edges.groupBy("ord", "dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shared)
            many = many.select(F.lit("shared").alias("what"), F.col("dst").alias("subject"), "ord")
        else:
            many = broken_of(wanted).select("what", "subject", "ord").distinct()
        facts = facts.unionByName(many).withColumn("holds", F.lit(True))
        asked = state.join(facts.withColumnRenamed("ord", "ask"), ["what", "subject", "ask"], "left").withColumn("holds", F.coalesce("holds", F.lit(False)))
        moved = asked.select(
            "what", "subject", "size", "ask",
            F.when(F.col("ask").isNotNull() & ~F.col("holds"), F.col("ask")).otherwise(F.col("low")).alias("low"),
            F.when(F.col("ask").isNotNull() & F.col("holds"), F.col("ask")).otherwise(F.col("high")).alias("high"),
        )
        # the last frame first, then the first one, then between them
        following = F.when(F.col("ask").isNull() | F.col("high").isNull() | (F.col("high") == 0) | (F.col("high") - F.col("low") <= 1), None)
        following = following.when(F.col("low") < 0, F.lit(0)).otherwise(F.floor((F.col("low") + F.col("high")) / 2)).cast("long")
        state = materialise(moved.withColumn("ask", following))
    return state.select("what", F.col("subject").cast(kind).alias("subject"), "size", F.when(F.col("high") > 0, F.col("high")).alias("first_ord"))
