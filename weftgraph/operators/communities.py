"""Communities by Louvain moves, with one result at every size.

A level moves nodes between communities in steps.  In a step, every node that would gain
modularity elsewhere names the neighbouring community where it gains most (ties: the least), and all
these candidates are ordered by a draw from their ids, made anew each step.  A candidate moves if it
would still gain were all candidates before it to move as well, or not, whichever is worse for it:
neighbours that may have left its goal do not count, those that may have come to its own
community do, and what may have come to the goal, or left its own community, weighs on it.  So the moves
of one step, made one after another in that order, each raise modularity; hence hubs, cliques and
swaps need no special case, and a step is a fixed number of jobs.  The weights on goals are added up
by 64 ranges of the draw, so that the candidates for one community are never gathered.

After the steps, communities fall apart into what is connected within them, and these parts are
the nodes of the next level.  Ratings are whole numbers, so that nothing depends on the order of sums:
links within ``plans.bounded.LIMIT`` are worked off in one task by the same steps, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.components import connected_components
from weftgraph.operators.relational import SYNTHETIC, undirected_weights
from weftgraph.plans import bounded
from weftgraph.plans.iterate import materialise
from weftgraph.schema import PropertyGraph


def _turn(step: int) -> int:
    """Bits by which the hashes of ids are rotated in a step."""
    return step * 11 % 63 + 1


# -- by joins ------------------------------------------------------------------------


def _candidates(links: DataFrame, state: DataFrame, two_m: int, step: int) -> DataFrame:
    """(id, k, draw, now, goal, to_goal, to_now, goal_total, now_total) of the nodes that gain elsewhere."""
    totals = state.groupBy("community").agg(F.sum("k").alias("total"))
    near = links.filter("a <> b").join(state.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("w"))
    own = state.select("id", "community").withColumn("w", F.lit(0).cast("long"))
    options = near.unionByName(own).groupBy("id", "community").agg(F.sum("w").alias("w")).join(totals, "community").join(state.select("id", "k", F.col("community").alias("now")), "id")
    stays = F.col("community") == F.col("now")
    rated = options.select("id", "k", "now", "community", "w", "total", stays.alias("stays"), _rating(F.col("w"), F.col("total") - F.when(stays, F.col("k")).otherwise(0), F.col("k"), two_m).alias("rating"))
    here, there = F.when(F.col("stays"), F.struct("rating", "w", "total")), F.when(~F.col("stays"), F.struct((-F.col("rating")).alias("minus"), "community", "w", "total"))
    best = rated.groupBy("id", "k", "now").agg(F.max(here).alias("here"), F.min(there).alias("there")).filter(-F.col("there.minus") > F.col("here.rating"))
    turn = _turn(step)
    draw = F.shiftleft(F.xxhash64("id"), turn).bitwiseOR(F.shiftrightunsigned(F.xxhash64("id"), 64 - turn))
    return best.select(
        "id", "k", draw.alias("draw"), "now", F.col("there.community").alias("goal"), F.col("there.w").alias("to_goal"), F.col("here.w").alias("to_now"),
        F.col("there.total").alias("goal_total"), F.col("here.total").alias("now_total"),
    )


def _rating(weight: Column, total: Column, k: Column, two_m: int) -> Column:
    """Whole number that orders a node's communities as modularity does."""
    wide = lambda c: c.cast("decimal(19,0)")
    return wide(weight) * F.lit(two_m).cast("decimal(18,0)") - wide(total) * k.cast("decimal(18,0)")


def _moves(links: DataFrame, asking: DataFrame, two_m: int) -> DataFrame:
    """(id, community) of the candidates that move."""
    mine = asking.select(F.col("id").alias("a"), F.col("now").alias("a_now"), F.col("goal").alias("a_goal"), F.col("draw").alias("a_draw"))
    theirs = asking.select(F.col("id").alias("b"), F.col("now").alias("b_now"), F.col("goal").alias("b_goal"), F.col("draw").alias("b_draw"))
    before = links.join(mine, "a").join(theirs, "b").filter(F.struct("b_draw", "b") < F.struct("a_draw", "a"))
    weighed = lambda where: F.sum(F.when(where, F.col("w")).otherwise(0))
    linked = before.groupBy(F.col("a").alias("id")).agg(weighed(F.col("b_now") == F.col("a_goal")).alias("left"), weighed(F.col("b_goal") == F.col("a_now")).alias("come"))
    placed = asking.withColumn("part", F.shiftright("draw", 58))
    so_far = lambda c, name: placed.groupBy(F.col(c), "part").agg(F.sum("k").alias("k")).select(c, "part", F.sum("k").over(Window.partitionBy(c).orderBy("part")).alias(name))  # noqa: E731  64 rows a community
    first = asking.agg(F.min(F.struct("draw", "id")).alias("first"))  # one row: it moves in any case
    judged = placed.join(linked, "id", "left").join(so_far("goal", "coming"), ["goal", "part"]).join(so_far("now", "leaving"), ["now", "part"]).join(F.broadcast(first))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    there = _rating(F.col("to_goal") - none("left"), F.col("goal_total") + F.col("coming") - F.col("k"), F.col("k"), two_m)
    here = _rating(F.col("to_now") + none("come"), F.col("now_total") - F.col("leaving"), F.col("k"), two_m)
    return judged.filter((there > here) | (F.col("id") == F.col("first.id"))).select("id", F.col("goal").alias("community"))


def _level(links: DataFrame, steps: int) -> DataFrame:
    """(id, community) after the steps over links (a, b, w) given both ways, self-links once."""
    links = materialise(links)
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum(F.col("w") * F.when(F.col("a") == F.col("b"), 2).otherwise(1)).alias("k"))
    state = materialise(degree.select("id", "k", F.col("id").alias("community")))
    two_m = state.agg(F.sum("k")).first()[0] or 0
    for step in range(steps):
        asking = materialise(_candidates(links, state, two_m, step))
        if asking.isEmpty():
            break
        moved = _moves(links, asking, two_m).withColumnRenamed("community", "to")
        state = materialise(state.join(moved, "id", "left").select("id", "k", F.coalesce("to", "community").alias("community")))
    ends = links.join(state.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(state.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    parts = connected_components(ends.filter("ca = cb"), "a", "b", 0)
    return state.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("community"))


# -- in one task ---------------------------------------------------------------------


def _sums(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(size, values.dtype)
    np.add.at(out, at, values)
    return out


def _step(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, community: np.ndarray, draw: np.ndarray) -> np.ndarray | None:
    """The communities after one step over links given both ways (none to itself); None if no node gains elsewhere."""
    n, two_m = len(k), k.sum()
    total = _sums(n, community, k)
    pairs, at = np.unique(a * n + community[b], return_inverse=True)
    weight = _sums(len(pairs), at, w)
    node, other = np.divmod(pairs, n)
    here = other == community[node]
    to_now = _sums(n, node[here], weight[here])
    stay = to_now * two_m - (total[community] - k) * k
    node, other, weight = node[~here], other[~here], weight[~here]
    rating = weight * two_m - total[other] * k[node]
    order = np.lexsort((other, -rating, node))
    node, other, weight, rating = node[order], other[order], weight[order], rating[order]
    best = np.flatnonzero(np.diff(node, prepend=-1))
    best = best[rating[best] > stay[node[best]]]
    if not len(best):
        return None
    asking, goal = node[best], np.full(n, -1)
    goal[asking] = other[best]
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), draw))] = np.arange(n)
    before = (goal[a] >= 0) & (goal[b] >= 0) & (rank[b] < rank[a])
    left, come = before & (community[b] == goal[a]), before & (goal[b] == community[a])
    left, come = _sums(n, a[left], w[left])[asking], _sums(n, a[come], w[come])[asking]
    part, own, now = (draw[asking] >> 58) + 32, k[asking], community[asking]

    def so_far(c: np.ndarray) -> np.ndarray:
        found, at = np.unique(c, return_inverse=True)
        table = _sums(len(found) * 64, at * 64 + part, own).reshape(-1, 64).cumsum(axis=1)
        return table[at, part]

    there = (weight[best] - left) * two_m - (total[other[best]] + so_far(other[best]) - own) * own
    at_home = (to_now[asking] + come) * two_m - (total[now] - so_far(now)) * own
    moves = (there > at_home) | (rank[asking] == rank[asking].min())
    community = community.copy()
    community[asking[moves]] = other[best][moves]
    return community


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each connected part."""
    least = np.arange(n)
    while True:
        lower = least.copy()
        np.minimum.at(lower, a, least[b])
        np.minimum.at(lower, b, least[a])
        lower = lower[lower]
        if (lower == least).all():
            return least
        least = lower


def _sequential(table: pa.Table, levels: int, steps: int) -> pa.Table:
    """(id, community: its least id) of links (a, b, w, ha, hb: hashes of the ends), each pair once."""
    ids, (a, b) = bounded.coded(table, "a", "b")
    n, w = len(ids), table["w"].to_numpy()
    hashes = np.zeros(n, np.int64)
    hashes[a], hashes[b] = table["ha"].to_numpy(), table["hb"].to_numpy()
    if int(w.sum()) >= 1 << 29:  # ratings may leave 64 bits
        w = w.astype(object)
    member = np.arange(n)
    for _ in range(levels):
        x, y = member[a], member[b]
        pairs, at = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_inverse=True)
        weight = _sums(len(pairs), at, w)
        x, y = np.divmod(pairs, n)
        k, loop = _sums(n, x, weight) + _sums(n, y, weight), x == y
        u, v, both = np.concatenate([x[~loop], y[~loop]]), np.concatenate([y[~loop], x[~loop]]), np.tile(weight[~loop], 2)
        community: np.ndarray | None = np.arange(n)
        for step in range(steps if len(u) else 0):
            turn = _turn(step)
            draw = (hashes << turn) | (hashes.view(np.uint64) >> np.uint64(64 - turn)).view(np.int64)
            following = _step(u, v, both, k, community, draw)
            if following is None:
                break
            community = following
        same = community[u] == community[v]
        grouped = _connected(n, u[same], v[same])
        if (grouped[member] == member).all():
            break
        member = grouped[member]
    kind = table.schema.field("a").type
    return pa.table({"id": pa.array(ids.tolist(), kind), "community": pa.array(ids[member].tolist(), kind)})


# -- both ----------------------------------------------------------------------------


def _grouped(links: DataFrame, levels: int, steps: int, limit: int) -> DataFrame:
    """(id, community: its least id) of links (a, b, w), each pair once."""
    links = materialise(links.select("a", "b", F.col("w").cast("long").alias("w")))
    kind = links.schema["a"].dataType.simpleString()
    member = None
    for level in range(levels):
        few = links.count() <= limit
        if few:
            hashed = links.withColumns({"ha": F.xxhash64("a"), "hb": F.xxhash64("b")})
            found = bounded.whole(hashed, lambda table: _sequential(table, levels - level, steps), f"id {kind}, community {kind}")  # noqa: B023
        else:
            found = _level(links.unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), steps)
        found = materialise(found)
        if member is None:
            member = found
        else:
            renamed = found.select(F.col("id").alias("community"), F.col("community").alias("next"))
            member = materialise(member.join(renamed, "community", "left").select("id", F.coalesce("next", "community").alias("community")))
        if few or found.filter("id <> community").isEmpty():
            break
        links = materialise(_lifted(links, found).groupBy("a", "b").agg(F.sum("w").alias("w")))
    return member


def louvain(graph: PropertyGraph, levels: int = 10, steps: int = 20, limit: int = bounded.LIMIT) -> DataFrame:
    """(id, community) of source files; a community is connected and named by its least id."""
    real = graph.nodes.filter(~F.col("type").isin(*SYNTHETIC)).select("id").distinct()
    kept = graph.edges.join(real.withColumnRenamed("id", "src"), "src", "left_semi").join(real.withColumnRenamed("id", "dst"), "dst", "left_semi")
    member = _grouped(undirected_weights(kept), levels, steps, limit)
    return real.join(member, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _lifted(links: DataFrame, member: DataFrame) -> DataFrame:
    """(a, b, w): links between the communities of their ends, the lesser first."""
    ends = links.join(member.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    return ends.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w")


def coarsen(graph: PropertyGraph, steps: int = 8, limit: int = bounded.LIMIT) -> DataFrame:
    """(a, b, w): one level of grouping; links between groups, those within dropped."""
    pairs = materialise(undirected_weights(graph.edges))
    return _lifted(pairs, _grouped(pairs, 1, steps, limit)).filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))


def best_merge(graph: PropertyGraph, member: DataFrame) -> DataFrame:
    """(gain): the most modularity that joining two linked communities would gain (0 without any)."""
    own = member.select("id", "community")
    pairs = undirected_weights(graph.edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi"))
    links = _lifted(pairs, own).groupBy("a", "b").agg(F.sum("w").alias("w"))
    ends = links.select(F.col("a").alias("community"), "w").unionByName(links.select(F.col("b").alias("community"), "w"))  # a link within counts twice
    total = ends.groupBy("community").agg(F.sum("w").cast("double").alias("k"))
    both = links.filter("a <> b").join(total.select(F.col("community").alias("a"), F.col("k").alias("ka")), "a").join(total.select(F.col("community").alias("b"), F.col("k").alias("kb")), "b")
    two_m = total.agg(F.sum("k").alias("two_m"))  # one row
    gain = 2 * F.col("w") / F.col("two_m") - 2 * F.col("ka") * F.col("kb") / (F.col("two_m") * F.col("two_m"))
    return both.join(F.broadcast(two_m)).agg(F.coalesce(F.max(gain), F.lit(0.0)).alias("gain"))
