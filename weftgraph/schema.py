"""The property graph: nodes and edges as DataFrames, with fixed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the kinds of nodes, edges and differences
NODE_TYPES = ("page", "component", "hook", "api", "query-key", "context", "store", "module")
EDGE_TYPES = ("import", "api-call", "query-key", "component", "context")
DIFF_STATUSES = ("same", "added", "removed")

META = T.StructType([T.StructField(c, T.StringType()) for c in ("queryKey", "endpoint", "method")])
NODES = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("label", "type", "file")]
    + [T.StructField("line", T.IntegerType()), T.StructField("cluster", T.StringType()), T.StructField("diff", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in "xyz"]
    + [T.StructField("meta", META)]
)
EDGES = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("src", "dst", "type", "diff")]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("ctrl1", "ctrl2")]
)


@dataclass(frozen=True)
class PropertyGraph:
    """nodes (id, label, type, file, line, cluster, ...), edges (id, src, dst, type, ...).

    ``parts``: among how many parts a grouping of all edges is dealt out, if that is known."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)
    parts: int | None = None

    def sound(self) -> PropertyGraph:
        """Without edges whose ends are missing."""
        ids = self.nodes.select("id")
        kept = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, edges=kept.select(self.edges.columns))

    def anonymous(self) -> PropertyGraph:
        """Without the place the graph was read from."""
        return replace(self, meta={k: v for k, v in self.meta.items() if k != "root"})


def edge_type_for(target_type):
    """What an import means, by the type of what is imported."""
    kinds = {"component": "component", "api": "api-call", "context": "context", "query-key": "query-key"}
    out = F.lit("import")
    for kind, edge in kinds.items():
        out = F.when(target_type == kind, edge).otherwise(out)
    return out
