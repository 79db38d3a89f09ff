"""What iterative plans share: reliable lineage cuts and fixpoints."""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts within the one that spark.checkpoint.dir names; a folder of our
    own only where that is unset and all work is on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder.

    A checkpoint keeps the size that was estimated for its plan, and joins multiply estimates: after
    some rounds the number alone fills the driver's memory.  The rows are taken up without it."""
    shared_folder(df.sparkSession)
    cut, session = df.checkpoint(eager=True)._jdf, df.sparkSession
    release(session)
    return DataFrame(session._jsparkSession.internalCreateDataFrame(cut.queryExecution().toRdd(), cut.schema(), False), session)


_CUTS = itertools.count(1)
#: lineage cuts after which the driver's memory is cleared of what is not referred to any more
CLEARED = 5


def release(spark: SparkSession) -> None:
    """Now and then lets the driver collect its garbage: the shuffle files, and with
    spark.cleaner.referenceTracking.cleanCheckpoints the checkpoints, of tables that nothing refers to are
    removed only then, and many rounds would otherwise keep all of theirs on disk."""
    if next(_CUTS) % CLEARED == 0:
        gc.collect()
        spark._jvm.System.gc()


class Versions:
    """Versions of one table, as Parquet in the shared folder: where a round rewrites wide rows, which
    Parquet compresses.  Writing a version removes the one before it, from which it was made."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        if self.count:
            drop_folder(self.spark, f"{self.folder}/{self.count - 1}")
        self.count += 1
        return self.spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours from the store that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in one of ours; none if it is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()] if store.exists(at) else []


def fingerprint(df: DataFrame, *columns: str) -> tuple:
    """Row count and order-free hash sum: equal for equal multisets of rows."""
    total = F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))
    return tuple(df.agg(F.count(F.lit(1)), total).first())


def fixpoint(step: Callable[[DataFrame], DataFrame], state: DataFrame, *columns: str) -> DataFrame:
    """Repeats ``step`` until the rows stay the same; each round is materialised."""
    state = materialise(state)
    before = fingerprint(state, *columns)
    while True:
        state = materialise(step(state))
        now = fingerprint(state, *columns)
        if now == before:
            return state
        before = now
