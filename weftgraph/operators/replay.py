"""A replay: the first frame of a history and what changed after it, from which any frame is put together."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.history import deltas, frame_at, skip_log
from weftgraph.schema import EDGES, NODES, PropertyGraph

PARTS = ("frames", "nodes", "edges")


@dataclass(frozen=True)
class Replay:
    """``frames`` (frame, sha, date, subject, author, nodes, edges, added, removed, cycles, violations); ``nodes`` and ``edges``:
    the changes as ``history.skip_log`` merges them."""

    frames: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def at(self, frame: int) -> PropertyGraph | None:
        """The graph of a frame, its sizes in its meta; None before the first and past the last, and without a first frame."""
        row = self.frames.filter(F.col("frame") == frame).select("sha", "nodes", "edges").first()
        if row is None or self.nodes.filter("level = -1").isEmpty():
            return None
        meta = {"frame": str(frame), "sha": row["sha"], "nodeCount": str(row["nodes"]), "edgeCount": str(row["edges"])}
        return PropertyGraph(frame_at(self.nodes, frame, ["id"]), frame_at(self.edges, frame, ["id"]), meta)

    def moved(self, frame: int) -> DataFrame:
        """(id, change): the nodes that came (``added``) and went (``removed``) with a frame; none with the first, which is whole."""
        return self.nodes.filter(F.col("level") == 0).filter((F.col("span") == frame - 1) & F.col("change").isin("added", "removed")).select("id", "change")

    def span(self) -> tuple[str, str]:
        """Dates of the first and the last frame; empty without frames."""
        row = self.frames.agg(F.min_by("date", "frame"), F.max_by("date", "frame")).first()
        return row[0] or "", row[1] or ""

    def write(self, folder: str) -> None:
        """As Parquet; changes lie by level and span, so that a frame reads no others."""
        self.frames.write.mode("overwrite").parquet(f"{folder}/frames")
        for part in PARTS[1:]:
            getattr(self, part).write.mode("overwrite").partitionBy("level", "span").parquet(f"{folder}/{part}")


@dataclass(frozen=True)
class View:
    """What is looked at: the present, or a frame of a replay while the present is parked.  Views do not change; each step
    gives another."""

    graph: PropertyGraph
    replay: Replay | None = None
    frame: int | None = None
    present: PropertyGraph | None = None

    def enter(self, replay: Replay) -> View:
        """Parks the present and goes to the first frame.  From within a replay, what was parked stays parked; a replay
        without a first frame is entered, but shows what was there."""
        return replace(self, replay=replay, frame=None, present=self.present or self.graph).show(0)

    def show(self, frame: int) -> View:
        """To a frame; outside a replay, and for frames that are not there, the view stays as it is."""
        graph = self.replay.at(frame) if self.replay else None
        return replace(self, graph=graph, frame=frame) if graph else self

    def leave(self) -> View:
        """Back to the present, without marks."""
        return View(self.present or self.graph)

    def marks(self) -> DataFrame:
        """(id, state): ``added`` and ``rest`` of the nodes shown, and ``removed`` for those that went with this frame."""
        ids = self.graph.nodes.select("id")
        if self.frame is None:
            return ids.withColumn("state", F.lit("rest"))
        moved = self.replay.moved(self.frame)
        shown = ids.join(moved.filter("change = 'added'"), "id", "left").select("id", F.coalesce("change", F.lit("rest")).alias("state"))
        return shown.unionByName(moved.filter("change = 'removed'").withColumnRenamed("change", "state"))


def make(timeline: DataFrame, nodes: DataFrame, edges: DataFrame) -> Replay:
    """Of a timeline (ord, sha, ...), nodes (ord, id, ...) and edges (ord, id, ...) of every frame whole."""
    from pyspark.sql import Window

    frames = timeline.withColumn("frame", F.row_number().over(Window.orderBy("ord")).cast("int") - 1)  # one row a frame
    logs = []
    for whole in (nodes, edges):
        values = [c for c in whole.columns if c not in ("ord", "id")]
        logs.append(skip_log(deltas(whole, ["id"], values), timeline, ["id"], values))
    return Replay(frames, *logs)


def read(spark: SparkSession, folder: str) -> Replay:
    """What ``Replay.write`` wrote."""
    return Replay(*(spark.read.parquet(f"{folder}/{part}") for part in PARTS))


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


_FILE_EDGES = T.StructType([_field({"src": "source", "dst": "target"}.get(f.name, f.name), f.dataType) for f in EDGES])
_WHOLE = T.StructType([_field("nodes", T.ArrayType(NODES)), _field("edges", T.ArrayType(_FILE_EDGES))])
_DELTA = T.StructType(
    [_field(f"{c}Nodes", T.ArrayType(NODES)) for c in ("added", "changed")] + [_field("removedNodes", T.ArrayType(T.StringType()))]
    + [_field(f"{c}Edges", T.ArrayType(_FILE_EDGES)) for c in ("added", "changed")] + [_field("removedEdges", T.ArrayType(T.StringType()))]
)
_FRAME = T.StructType(
    [_field(c, T.StringType()) for c in ("sha", "date", "subject", "author")] + [_field(c, T.LongType()) for c in ("nodeCount", "edgeCount", "violations", "cycles")]
    + [_field(c, T.ArrayType(T.StringType())) for c in ("added", "removed")] + [_field("graph", _WHOLE), _field("delta", _DELTA)]
)
FILE = T.StructType([_field("frames", T.ArrayType(_FRAME))])


def read_file(spark: SparkSession, path: str) -> Replay:
    """A replay file: one JSON object whose frames hold the first graph and then differences, or, in older files, every
    graph whole.  Anything without a list of frames is an error."""
    raw = spark.read.schema(FILE).option("multiLine", True).json(path)
    if raw.isEmpty() or not raw.filter("frames is null").isEmpty():
        raise ValueError(f"{path} holds no replay: frames must be a list")
    each = raw.select(F.posexplode("frames").alias("ord", "f"))
    frames = each.select(
        F.col("ord").alias("frame"), F.col("ord").cast("long").alias("ord"), "f.sha", "f.date", "f.subject", "f.author", F.col("f.nodeCount").alias("nodes"), F.col("f.edgeCount").alias("edges"),
        F.coalesce(F.size("f.added"), F.lit(0)).cast("long").alias("added"), F.coalesce(F.size("f.removed"), F.lit(0)).cast("long").alias("removed"), "f.cycles", "f.violations",
    )
    whole = each.filter("ord > 0 and f.delta is null and f.graph is not null")
    logs = []
    for part, schema in (("Nodes", NODES), ("Edges", EDGES)):
        renamed = {"source": "src", "target": "dst"} if part == "Edges" else {}
        rows = lambda df, field: df.select("ord", F.inline(field)).withColumnsRenamed(renamed)  # noqa: B023, E731
        values = [f.name for f in schema if f.name != "id"]
        first = rows(each, f"f.graph.{part.lower()}")
        if whole.isEmpty():
            gone = each.select("ord", F.explode(f"f.delta.removed{part}").alias("id")).withColumn("change", F.lit("removed"))
            later = [rows(each.filter("ord > 0"), f"f.delta.{kind}{part}").withColumn("change", F.lit(kind)) for kind in ("added", "changed")]
            changes = later[0].unionByName(later[1])
            changes = first.filter("ord = 0").withColumn("change", F.lit("added")).unionByName(changes).unionByName(gone.filter("ord > 0"), allowMissingColumns=True)
        else:
            changes = deltas(first, ["id"], values)
        logs.append(skip_log(changes, frames, ["id"], values))
    return Replay(frames, *logs)
