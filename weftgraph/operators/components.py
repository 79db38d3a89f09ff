"""Connected components by alternating large-star and small-star steps.

Both steps replace each link by links to the least neighbour; the number of
rounds grows with the logarithm of the size, whatever the diameter.  Minima are
combined before the shuffle, and no neighbourhood is ever gathered, so a hub is
one key of an aggregate and one skewed side of a join, which AQE splits.  Links
within ``plans.bounded.LIMIT`` are joined up in one task, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import bounded
from weftgraph.plans.iterate import fixpoint, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _least(table: pa.Table) -> pa.Table:
    """(u, v: the least id of its part) of links (u, v), for all ids that are not themselves the least."""
    ids, (u, v) = bounded.coded(table, "u", "v")
    least = np.arange(len(ids))
    while True:  # both ends take the lower label, then labels take their own labels
        lower = least.copy()
        np.minimum.at(lower, least[u], least[v])
        np.minimum.at(lower, least[v], least[u])
        while (lower != lower[lower]).any():
            lower = lower[lower]
        if (lower == least).all():
            break
        least = lower
    own = np.flatnonzero(least != np.arange(len(ids)))
    kind = table.schema.field("u").type
    return pa.table({"u": pa.array(ids[own].tolist(), kind), "v": pa.array(ids[least[own]].tolist(), kind)})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", limit: int = bounded.LIMIT) -> DataFrame:
    """(id, component) of every id on a link; the component is its least id.

    Self-links keep an id that has no other link; nulls are dropped."""
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).na.drop()
    links = materialise(ends.filter("u <> v").distinct())
    if links.count() <= limit:
        kind = links.schema["u"].dataType.simpleString()
        stars = materialise(bounded.whole(links, _least, f"u {kind}, v {kind}"))
    else:
        stars = fixpoint(lambda e: _small_star(_large_star(e)), links, "u", "v")
    members = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    ids = ends.select(F.col("u").alias("id")).unionByName(ends.select(F.col("v").alias("id"))).distinct()
    return ids.join(members, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
