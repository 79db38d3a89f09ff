"""What is kept about nodes from one version of a graph to the next: places, pins, choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carried(changes: DataFrame, present: DataFrame, values: list[str]) -> DataFrame:
    """(id, since, *values) of the nodes of the last version: what was last said of each in ``changes`` (version, id, *values)
    while it was there without a break; nulls where nothing was said.

    ``present`` (version, id) has the nodes of every version.  What was said of a node before it was deleted is not taken up
    again when its id comes back; changes of ids that are not there are dropped.  ``since``: the version of the last change."""
    ranks = present.select("version").distinct().withColumn("rank", F.row_number().over(Window.orderBy("version")))  # one row a version
    there = present.select("version", "id").distinct().join(F.broadcast(ranks), "version")
    # in a run without a break, the rank less the row's place stays the same: a row an id and run, without its versions
    runs = there.withColumn("run", F.col("rank") - F.row_number().over(Window.partitionBy("id").orderBy("rank")))
    runs = runs.groupBy("id", "run").agg(F.min("version").alias("first"), F.max("rank").alias("last"))
    final = ranks.agg(F.max("rank").alias("final"))  # one row
    alive = runs.join(F.broadcast(final), runs["last"] == F.col("final")).select("id", "first")
    said = changes.select("id", "version", *values).join(alive, "id").filter("version >= first")
    newest = said.groupBy("id").agg(F.max_by(F.struct("version", *values), F.struct("version", *values)).alias("s"))
    return alive.join(newest, "id", "left").select("id", F.col("s.version").alias("since"), *(F.col("s")[v].alias(v) for v in values))
