"""A graph kept up to date from a stream of what each node links to, by state of keys.

Counts that add up (callers, orphans, shared targets) follow from what a change takes away and
brings, so that a batch costs as much as its changes.  Cycles do not add up; ``streaming.watch``
computes them anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftgraph.plans.iterate import drop_folder, folders_in

#: a node as it was last told; null links: it is gone
TOLD = "version long, silent boolean, links array<string>"
#: what a node's change adds to counts of its own and of its targets
CHANGE = "id string, node long, silent long, callers long"
COUNTS = "node long, silent long, callers long"
#: a node before and after a batch
STEP = "id string, was_node long, was_orphan long, was_shared long, node long, orphan long, shared long, callers long"
VERSION = "version long, nodes long, node_change long, orphans long, orphan_change long, violations long, violation_change long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: batches whose rows are merged into one base table
MERGED = 32


class Told(StatefulProcessor):
    """Keyed by node: holds what it last linked to and gives the difference.  Of all rows of a node the greatest by
    (version, not gone, links, silent) stands, in whatever order and however often they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("told", TOLD)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        id_, before = key[0], _rank(*self.held.get()) if self.held.exists() else None
        now = max((_rank(r["version"], r["silent"], r["links"]) for r in rows), default=before)
        if before is not None:
            now = max(now, before)
        if now == before:
            return
        version, there, links, silent = now
        self.held.update((version, silent, list(links) if there else None))
        _, was_there, old, was_silent = before or (None, False, (), False)
        if (was_there, was_there and was_silent) != (there, there and silent):
            yield Row(id=id_, node=there - was_there, silent=(there and silent) - (was_there and was_silent), callers=0)
        for target in set(old) ^ set(links):
            yield Row(id=target, node=0, silent=0, callers=1 if target in links else -1)


def _rank(version: int, silent: bool | None, links: list[str] | None) -> tuple[int, bool, tuple[str, ...], bool]:
    return version, links is not None, tuple(sorted({x for x in links or () if x is not None})), bool(silent)


class Counted(StatefulProcessor):
    """Keyed by node, or by a target that is not there yet: holds its counts and gives them before and after."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("counts", COUNTS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        before = tuple(self.held.get()) if self.held.exists() else (0, 0, 0)
        node, silent, callers = before
        for r in rows:
            node, silent, callers = node + r["node"], silent + r["silent"], callers + r["callers"]
        if (node, silent, callers) == before:
            return
        if node or callers:
            self.held.update((node, silent, callers))
        else:
            self.held.clear()
        was, now = _facts(*before), _facts(node, silent, callers)
        yield Row(id=key[0], was_node=was[0], was_orphan=was[1], was_shared=was[2], node=now[0], orphan=now[1], shared=now[2], callers=callers)


def _facts(node: int, silent: int, callers: int) -> tuple[int, int, int]:
    return node, int(node and silent and not callers), int(node and callers > 1)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a target and Arrow batch, so that a target of a third of all links is few rows for the task of its key."""
    for rows in batches:
        yield rows.groupby("id", sort=False, as_index=False).sum()[["id", "node", "silent", "callers"]]


def steps(changes: DataFrame) -> DataFrame:
    """``STEP`` of every node whose counts a batch moved, of a stream (id, version, silent, links).

    ``silent``: it is an orphan if nothing links to it (null: no).  Rows without an id or a version are ignored; null links:
    the node is gone.  A target named twice by one node has one caller there; links to targets that are not there wait for
    them; a node's link to itself counts.  What was told of a deleted node stays, so that late rows do not revive it."""
    told = changes.select("id", "version", "silent", "links").filter("id is not null and version is not null")
    moved = told.groupBy("id").transformWithState(Told(), CHANGE, "append", "none")
    return moved.mapInPandas(_summed, CHANGE).groupBy("id").transformWithState(Counted(), STEP, "append", "none")


def watch_links(changes: DataFrame, folder: str, checkpoint: str, interval: str | None = "2.5 seconds", partitions: int | None = None) -> StreamingQuery:
    """Writes ``folder``/{steps,base,versions}: the steps of each batch, merged now and then, and a row a batch with the
    numbers of nodes, orphans and violations (targets of more than one caller) and their changes.  A batch that is
    repeated after a failure writes the same again.  ``interval`` None: what is there now, then stop.  ``partitions`` of the
    state stay what they were at the first start (None: those of the session's shuffles)."""

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/steps/batch={number}")
        moved = spark.read.schema(STEP).parquet(f"{folder}/steps/batch={number}")
        change = moved.agg(*(F.coalesce(F.sum(F.col(c) - F.col(f"was_{c}")), F.lit(0)).alias(c) for c in ("node", "orphan", "shared"))).first()
        before = (0, 0, 0)
        if folders_in(spark, f"{folder}/versions"):
            last = spark.read.parquet(f"{folder}/versions").filter(F.col("version") < number).orderBy(F.desc("version")).select("nodes", "orphans", "violations").first()
            before = tuple(last) if last else before
        row = (number, *(x for was, by in zip(before, change) for x in (was + by, by)))
        spark.createDataFrame([row], VERSION).write.mode("overwrite").parquet(f"{folder}/versions/batch={number}")
        if number % MERGED == MERGED - 1:
            _merge(spark, folder, number)

    spark = changes.sparkSession
    wanted = {PROVIDER: ROCKSDB} | ({PARTITIONS: str(partitions)} if partitions else {})  # the only store that holds such state
    held = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:  # a query keeps the settings it was started with
        writer = steps(changes).writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _merge(spark: SparkSession, folder: str, number: int) -> None:
    """One base table instead of the steps up to a batch.  The batch before a repeated one is merged already or still there."""
    _newest(spark, folder, number).filter("node > 0 or callers > 0").write.mode("overwrite").parquet(f"{folder}/base/batch={number}")
    for part, spared in (("steps", number + 1), ("base", number)):
        for name in folders_in(spark, f"{folder}/{part}"):
            kind, _, at = name.partition("=")
            if kind == "batch" and int(at) < spared:
                drop_folder(spark, f"{folder}/{part}/{name}")


def _newest(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    told = spark.createDataFrame([], f"batch int, {STEP}")
    for part in ("base", "steps"):
        if folders_in(spark, f"{folder}/{part}"):
            told = told.unionByName(spark.read.schema(f"{STEP}, batch int").parquet(f"{folder}/{part}"))
    if upto is not None:
        told = told.filter(F.col("batch") <= upto)
    fields = [c for c in told.columns if c not in ("batch", "id")]
    newest = told.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    return newest.select("id", *(F.col("s")[c].alias(c) for c in fields))


def present(spark: SparkSession, folder: str) -> DataFrame:
    """(id, callers, orphan, shared) of the nodes that are there after the last batch."""
    return _newest(spark, folder).filter("node > 0").select("id", "callers", (F.col("orphan") > 0).alias("orphan"), (F.col("shared") > 0).alias("shared"))
