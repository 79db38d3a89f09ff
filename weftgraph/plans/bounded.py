"""Exact work on graphs, or parts of graphs, that are known to be small.

Graph kernels (components of cycles, peeling, moves) take many rounds as joins.  Where
all links number ``LIMIT`` at most, counted first, one task does them at once; in a larger
graph every weak component within the limit is a group of its own, and what lies in larger
components is left to the distributed rounds.  No task ever holds more than ``LIMIT`` links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.iterate import materialise

LIMIT = 1 << 17
Kernel = Callable[[pa.Table], pa.Table]


def whole(links: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """The kernel on all links, which are few, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held and sum(b.num_rows for b in held):
            yield from kernel(pa.Table.from_batches(held)).to_batches()

    return links.repartition(1).mapInArrow(run, schema)


def settle(links: DataFrame, kernel: Kernel, schema: str, limit: int = LIMIT, src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame | None]:
    """(results of the kernel on all parts within the limit; if there are any, links of the other parts with their ``component``)."""
    from weftgraph.operators.components import connected_components  # which uses this module

    count = links.count()
    if count <= limit:
        return materialise(whole(links, kernel, schema)), None
    part = materialise(connected_components(links, src, dst, min(limit, LIMIT)).withColumnRenamed("id", src))
    sizes = links.groupBy(src).agg(F.count(F.lit(1)).alias("links")).join(part, src).groupBy("component").agg(F.sum("links").alias("links"))
    large = sizes.filter(F.col("links") > limit).select("component", F.lit(True).alias("large"))  # count / limit at most
    # told to ids, then to links by their ends: by component, all links of the largest would meet in one task
    dealt = materialise(links.join(part.join(F.broadcast(large) if limit else large, "component", "left"), src))
    few, many = dealt.filter("large is null"), dealt.filter("large")
    # small parts share tasks: about half the limit each, and one part at least
    task = F.pmod(F.xxhash64("component"), F.lit(2 * count // max(limit, 1) + 1)).alias("task")
    done = materialise(few.select(task, *links.columns).groupBy("task").applyInArrow(lambda table: kernel(table.drop_columns(["task"])), schema))
    return done, None if many.isEmpty() else many.select(*links.columns, "component")


def coded(table: pa.Table, *columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids in order, the columns as places in them)."""
    parts = [np.array(table.column(c).to_pylist(), object) for c in columns]
    ids, at = np.unique(np.concatenate(parts), return_inverse=True)
    return ids, np.split(at, len(columns))


def neighbours(n: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    """Ends of the links that begin at each node, in order."""
    order = np.lexsort((dst, src))
    ends = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    flat = dst[order].tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
