"""Watching a graph: every batch of changed files gives a new version.

Graph answers are not monotone (an edge less can end a cycle), so a version is
computed anew; what streams is the arrival of files.  A version that fails
leaves the last good one in place, with the error beside it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.plans.build import Staged
from weftgraph.plans.iterate import drop_folder, folders_in
from weftgraph.sources import files

VERSION = "version long, nodes long, edges long, violations long, error string"
#: good versions, and looks at a tree, that stay
KEPT = 3
Build = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
#: number of violations of a graph's nodes and edges
Measure = Callable[[DataFrame, DataFrame], int]


def latest_files(store: DataFrame) -> DataFrame:
    """(path, text): the newest version of each file; a null text is a deletion."""
    newest = store.groupBy("path").agg(F.max_by("text", "version").alias("text"))
    return newest.filter("text is not null")


def publish(spark: SparkSession, rows: DataFrame, folder: str, version: int, build: Build, measure: Measure | None = None) -> None:
    """Writes the graph of some files (path, text) as a version, or the error that kept it from being built.
    Of the good versions the last ``KEPT`` stay, so that a reader of the last one is not cut off."""
    error, counts = None, (None, None, None)
    try:
        nodes, edges = build(rows)
        nodes.write.mode("overwrite").parquet(f"{folder}/nodes/version={version}")
        edges.write.mode("overwrite").parquet(f"{folder}/edges/version={version}")
        nodes, edges = (spark.read.parquet(f"{folder}/{part}/version={version}") for part in ("nodes", "edges"))
        counts = (nodes.count(), edges.count(), measure(nodes, edges) if measure else None)
    except Exception as e:  # a half-written file must not end the watch
        error = str(e)[:500]
    spark.createDataFrame([(version, *counts, error)], VERSION).write.mode("overwrite").parquet(f"{folder}/versions/batch={version}")
    if error is None:
        good = [r["version"] for r in spark.read.parquet(f"{folder}/versions").filter("error is null").select("version").collect()]  # a row a version
        for part in ("nodes", "edges"):
            drop_before(spark, f"{folder}/{part}", sorted(good)[-KEPT:][0])


def drop_before(spark: SparkSession, folder: str, version: int) -> None:
    """Removes the versions of a table that are older than one."""
    for name in folders_in(spark, folder):
        kind, _, number = name.partition("=")
        if kind == "version" and int(number) < version:
            drop_folder(spark, f"{folder}/{name}")


def watch(changes: DataFrame, folder: str, build: Build, checkpoint: str, interval: str | None = "2.5 seconds", measure: Measure | None = None) -> StreamingQuery:
    """Applies a stream of files (path, text) and writes ``folder``/{files,nodes,edges,versions}.

    ``build`` turns the files of a version into nodes and edges.  ``interval`` None: what is
    there now, then stop."""

    def step(batch: DataFrame, version: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch.select("path", "text", F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{folder}/files/batch={version}")
        publish(spark, latest_files(spark.read.parquet(f"{folder}/files")), folder, version, build, measure)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


LISTING = "path string, modified long, size long"


def listing(root: str, exclude: Iterable[str] | None = None) -> list[tuple[str, int, int]]:
    """(path below the root, time of change in ns, size) of the scripts of a local tree."""
    exclude = files.EXCLUDED if exclude is None else tuple(exclude)
    found = []
    for folder in files.pruned_folders(root, exclude):
        for name in sorted(os.listdir(folder)):
            path = os.path.relpath(os.path.join(folder, name), root)
            if name.endswith((".ts", ".tsx")) and not name.endswith(".d.ts") and not any(x in path for x in exclude):
                try:
                    seen = os.stat(os.path.join(folder, name))
                except FileNotFoundError:  # gone since it was listed
                    continue
                found.append((path, seen.st_mtime_ns, seen.st_size))
    return found


def tree_step(spark: SparkSession, root: str, folder: str, build: Build, exclude: Iterable[str] | None = None, measure: Measure | None = None) -> int | None:
    """One look at a source tree: a new version under ``folder`` if a script was added, changed or
    deleted since the last look, else None.  Only what changed is read again, and with a ``Staged`` build only that is
    scanned, and what was found is kept instead of the texts; a version has a row for every file, so that no look
    reads more than one version."""
    staged = isinstance(build, Staged)
    exclude = files.EXCLUDED if exclude is None else tuple(exclude)
    numbers = sorted(int(n.partition("=")[2]) for n in os.listdir(f"{folder}/looks")) if os.path.isdir(f"{folder}/looks") else []
    version = numbers[-1] + 1 if numbers else 0
    now = spark.createDataFrame(listing(root, exclude), LISTING)
    if numbers:
        before = spark.read.parquet(f"{folder}/looks/version={numbers[-1]}")
        old, kept = before.select("path", "modified", "size"), now.join(before, ["path", "modified", "size"], "left_semi").select("path")
        if now.exceptAll(old).isEmpty() and old.exceptAll(now).isEmpty():
            return None
        held = before.join(kept, "path", "left_semi")
    else:
        held = None
    fresh = now if held is None else now.join(held.select("path"), "path", "left_anti")
    texts = files.source_files(spark, files.pruned_folders(root, exclude), root, exclude).join(fresh.select("path"), "path", "left_semi").select("path", "text")
    rows = fresh.join(build.scan(texts) if staged else texts, "path")
    (rows if held is None else held.unionByName(rows)).write.mode("overwrite").parquet(f"{folder}/looks/version={version}")
    drop_before(spark, f"{folder}/looks", version - KEPT + 1)
    rows = spark.read.parquet(f"{folder}/looks/version={version}").drop("modified", "size")
    publish(spark, rows, folder, version, build.assemble if staged else build, measure)
    return version


def watch_tree(spark: SparkSession, root: str, folder: str, build: Build, checkpoint: str, exclude: Iterable[str] | None = None, interval: str = "2.5 seconds", measure: Measure | None = None) -> StreamingQuery:
    """Looks at a tree at every tick of a stream, one look after another.  A file source would see a
    path once only; comparing listings also sees edits and deletions."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, _: tree_step(batch.sparkSession, root, folder, build, exclude, measure)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()


def last_good(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int] | None:
    """Nodes and edges of the last version without an error, and its number."""
    row = spark.read.parquet(f"{folder}/versions").filter("error is null").agg(F.max("version")).first()
    if row is None or row[0] is None:
        return None
    return spark.read.parquet(f"{folder}/nodes/version={row[0]}"), spark.read.parquet(f"{folder}/edges/version={row[0]}"), row[0]


def version_steps(versions: DataFrame) -> DataFrame:
    """(version, nodes, node_change, violations, violation_change): what each good version has, and the change
    from the one before."""
    before = Window.orderBy("version")  # one row a version
    change = lambda c, name: (F.col(c) - F.lag(c).over(before)).alias(name)
    return versions.filter("error is null").select("version", "nodes", change("nodes", "node_change"), "violations", change("violations", "violation_change"))
