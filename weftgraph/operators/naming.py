"""Names and places: telling equal labels apart, folder cohesion, label overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.iterate import materialise
from weftgraph.schema import PropertyGraph


def disambiguate(graph: PropertyGraph) -> DataFrame:
    """(id, name): the label, or for a label that several nodes bear, the fewest path pieces
    from the end (without extension) that tell all of them apart; the whole path if none does."""
    nodes = graph.nodes.select("id", "label")
    clash = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("bearers")).filter("bearers > 1")
    plain = F.split(F.regexp_replace("id", r"\.[jt]sx?\z", ""), "/")
    shared = nodes.join(clash, "label").withColumn("pieces", plain)
    deep = shared.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("pieces"))))
    tail = F.array_join(F.slice("pieces", F.greatest(F.size("pieces") - F.col("depth") + 1, F.lit(1)), F.col("depth")), "/")
    named = deep.select("id", "label", "bearers", "depth", tail.alias("name"))
    # a path shorter than the depth keeps its whole self
    most = named.groupBy("label").agg(F.max("depth").alias("most"))
    longest = named.groupBy("id", "label", "bearers").agg(F.max(F.struct("depth", "name")).alias("l"))
    filled = longest.join(most, "label").withColumn("depth", F.explode(F.sequence(F.lit(1), F.col("most")))).filter("depth > l.depth")
    named = named.unionByName(filled.select("id", "label", "bearers", "depth", F.col("l.name").alias("name")))
    told = named.groupBy("label", "depth", "bearers").agg(F.count_distinct("name").alias("names")).filter("names = bearers")
    best = told.groupBy("label").agg(F.min("depth").alias("depth"))
    chosen = named.join(best, ["label", "depth"]).select("id", "name")
    whole = longest.select("id", F.col("l.name").alias("whole"))
    return nodes.join(chosen, "id", "left").join(whole, "id", "left").select("id", F.coalesce("name", "whole", "label").alias("name"))


MOST_PIVOTS = 256
#: allowance for the rounding of distances where the triangle inequality rules a point out
SLACK = 1e-9


def _around(points: DataFrame, pivots: np.ndarray, every: bool) -> DataFrame:
    """(id, position, cell: the nearest pivot, r: the distance to it) of points, and with ``every`` the distances to all pivots."""
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at in range(0, len(x), 1024):
                d = np.sqrt(((x[at : at + 1024, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
                part = batch.slice(at, len(d))
                columns = [*part.columns, pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(list(d))] if every else [])], names=["id", "position", "cell", "r", "all"][: 4 + every])

    return points.select("id", "position").mapInArrow(run, f"id {kind}, position array<double>, cell int, r double" + ", all array<double>" * every)


def nearest_pairs(points: DataFrame, queries: DataFrame, most_pivots: int = MOST_PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Two tables (id, d2, other) of the pairs that are compared: those within the query's own cell, and those of other
    cells that may be as near as the best of the first.

    Cells are those of about as many pivots as the root of the number of points, ``most_pivots`` at most, drawn by hash.  By the
    triangle inequality, a cell holds nothing nearer than the distance of its pivot less its radius, and a point of it nothing
    nearer than the difference of its own distance to the pivot and the query's."""
    whole = lambda df: df.select("id", F.transform("position", lambda x: x.cast("double")).alias("position")).filter(F.forall("position", lambda x: x.isNotNull()))
    points, queries = whole(points), whole(queries)
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(max(1, min(most_pivots, math.isqrt(points.count())))).collect()  # MOST_PIVOTS rows
    pivots = np.array([r["position"] for r in drawn], np.float64).reshape(len(drawn), -1)
    held = materialise(_around(points, pivots, False).withColumnsRenamed({"id": "other", "position": "q"}))
    asked = materialise(_around(queries, pivots, True).withColumnRenamed("position", "p"))
    d2 = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x).alias("d2")
    own = asked.join(held.drop("r"), "cell").filter("id <> other").select("id", d2, "other")
    first = own.groupBy("id").agg(F.min(F.struct("d2", "other")).alias("b"))
    bound = F.coalesce(F.sqrt("b.d2") * (1 + SLACK), F.lit(float("inf"))).alias("bound")
    radius = {r["cell"]: r["radius"] for r in held.groupBy("cell").agg(F.max("r").alias("radius")).collect()}  # a row a pivot
    radii = F.array(*(F.lit(float(radius.get(c, -1.0))) for c in range(len(pivots))))
    open_ = asked.join(first, "id", "left").select("id", "p", F.col("cell").alias("home"), bound, F.posexplode("all").alias("cell", "far")).withColumn("radius", radii[F.col("cell")])
    open_ = open_.filter((F.col("cell") != F.col("home")) & (F.col("radius") >= 0) & (F.col("far") * (1 - SLACK) - F.col("radius") <= F.col("bound")))
    others = open_.join(held, "cell").filter((F.col("id") != F.col("other")) & (F.abs(F.col("far") - F.col("r")) - SLACK * F.col("far") <= F.col("bound"))).select("id", d2, "other")
    return own, others


def nearest(points: DataFrame, queries: DataFrame, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(id, nearest, d2): of each query point (id, position array) the nearest other point (ties: the least id);
    exact.  Points without a position, or with a null in it, are near to none; all positions have one length."""
    own, others = nearest_pairs(points, queries, most_pivots)
    best = own.unionByName(others).groupBy("id").agg(F.min(F.struct("d2", "other")).alias("best"))
    return best.select("id", F.col("best.other").alias("nearest"), F.col("best.d2").alias("d2"))


def cohesion(points: DataFrame, sample: int = 40) -> DataFrame:
    """(folder, sampled, share): how often the nearest point to a sampled member (every
    ceil-free n div ``sample``-th by id) is of the same folder; points (id, folder, position)."""
    place = Window.partitionBy("folder").orderBy("id")
    sized = points.withColumn("i", F.row_number().over(place) - 1).join(points.groupBy("folder").agg(F.count(F.lit(1)).alias("n")), "folder")
    queries = sized.filter(F.col("i") % F.greatest(F.floor(F.col("n") / sample), F.lit(1)) == 0).select("id", "folder", "position")
    folder = points.select(F.col("id").alias("nearest"), F.col("folder").alias("of"))
    found = nearest(points, queries).join(folder, "nearest").join(queries.select("id", "folder"), "id")
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("sampled"), F.round(F.avg((F.col("folder") == F.col("of")).cast("double")), 9).alias("share"))


def upper_median(values: Column, accuracy: int = 10_000) -> Column:
    """Order statistic at index floor(n / 2) as an aggregate, in one pass and bounded memory: the lower median of
    the negated values; off by a rank of n / ``accuracy`` at most.  ``order_statistic`` is exact."""
    return -F.percentile_approx(-values, 0.5, accuracy)


BINS = 1024


def order_statistic(values: DataFrame, by: list[str], column: str, share: float) -> DataFrame:
    """(*by, value): of each group, the value at index floor(n * share) of its values in order (the last at most); exact.

    Selection by rounds of histograms: a round counts the values between the bounds of each group in equal bins, and takes the
    bounds of the bin that holds the place sought as the next ones, until they are one value.  A round keeps
    ``BINS`` rows a group at most and sorts nothing; nulls and NaN are left out."""
    rows = values.select(*by, F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)").withColumn("_one", F.lit(0))
    keys = [*by, "_one"]  # a column even where there are no groups
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    goal, done = materialise(whole.select(*keys, at.alias("at"), "low", "high")), None
    while True:
        found = goal.filter("low = high").select(*by, F.col("low").alias("value"))
        done = found if done is None else done.unionByName(found)
        wide = goal.filter("low < high")
        if wide.isEmpty():
            return done
        inside = rows.join(F.broadcast(wide) if not by else wide, keys).filter("v between low and high")
        width = F.col("high") / BINS - F.col("low") / BINS  # neither can leave the range of doubles
        place = F.when(F.col("v") == F.col("high"), BINS - 1).when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") / BINS - F.col("low") / BINS) / width * BINS))).otherwise(0)
        # where bins would be too narrow to tell values apart, the least value is told from the others
        place = F.when(F.col("v") == F.col("low"), -1).otherwise(place.cast("int"))
        counted = inside.withColumn("bin", place).groupBy(*keys, "bin").agg(F.first("at").alias("at"), F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BINS rows a group
        chosen = counted.withColumn("before", before).filter("before <= at and at < before + m")
        goal = materialise(chosen.select(*keys, (F.col("at") - F.col("before")).alias("at"), "low", "high"))


def spreads(points: DataFrame) -> DataFrame:
    """(folder, n, mean, median, p90, furthest): distances of a folder's points (folder, x, y, z) from their mean."""
    means = points.groupBy("folder").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    d = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"))
    gaps = materialise(points.join(means, "folder").select("folder", d.alias("d")))
    out = gaps.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.max("d").alias("furthest"))
    for name, share in (("median", 0.5), ("p90", 0.9)):
        out = out.join(order_statistic(gaps, ["folder"], "d", share).withColumnRenamed("value", name), "folder", "left")
    return out.select("folder", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "furthest")))


def folder_anchors(points: DataFrame, least_share: float = 0.5, lift: float = 3.5) -> DataFrame:
    """(folder, anchor, height): of folders of two members or more whose cohesion is high
    enough, the member nearest to the mean, and the median distance from the mean plus a lift.
    Points (id, folder, x, y, z)."""
    means = points.groupBy("folder").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), F.count(F.lit(1)).alias("n"))
    d = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"))
    gaps = points.join(means.filter("n > 1"), "folder").withColumn("d", d)
    firm = cohesion(points.select("id", "folder", F.array(*"xyz").alias("position"))).filter(F.col("share") >= least_share).select("folder")
    gaps = materialise(gaps.select("folder", "id", "d"))
    found = gaps.groupBy("folder").agg(F.min(F.struct("d", "id")).alias("a")).join(order_statistic(gaps, ["folder"], "d", 0.5).withColumnRenamed("value", "median"), "folder")
    return found.join(firm, "folder", "left_semi").select("folder", F.col("a.id").alias("anchor"), F.round(F.col("median") + lift, 9).alias("height"))


def reach(points: DataFrame) -> DataFrame:
    """(x, y, z, spread): centre of points (x, y, z), and max(40, min(furthest, 2.5 * median)) of
    the distances from it; the origin and 60 without points."""
    centre = points.agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    d = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"))
    gaps = materialise(points.crossJoin(F.broadcast(centre)).select(d.alias("d")))  # the centre is one row
    spread = gaps.agg(F.max("d").alias("far")).crossJoin(F.broadcast(order_statistic(gaps, [], "d", 0.5).agg(F.max("value").alias("mid"))))  # one row each
    size = F.when(F.col("far").isNull(), 60.0).otherwise(F.greatest(F.lit(40.0), F.least("far", F.col("mid") * 2.5)))
    return centre.crossJoin(F.broadcast(spread)).select(*(F.coalesce(f"m{c}", F.lit(0.0)).alias(c) for c in "xyz"), size.alias("spread"))


def label_box(text: Column, font: Column) -> tuple[Column, Column]:
    """Width and height of a label."""
    return F.char_length(text) * font * 0.6 + 10, font + 8
