"""Frames of a history read by content: a content is read and scanned once, however many commits hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.rules import Rule, violations
from weftgraph.plans.build import build_frames, scanned
from weftgraph.plans.iterate import materialise
from weftgraph.schema import PropertyGraph
from weftgraph.sources import files


class Frames:
    """Graphs of the commits (ord, sha) of a repository, many at a time.

    What was read stays for the next request, so that a search through history reads no content twice;
    ``reads`` counts the contents read."""

    def __init__(self, commits: DataFrame, repository: str, exclude: tuple[str, ...] = files.EXCLUDED, packages: list[str] | None = None, aliases: dict[str, str] | None = None) -> None:
        self.commits, self.repository, self.exclude, self.packages, self.aliases = commits, repository, exclude, packages, aliases
        spark = commits.sparkSession
        self.texts = spark.createDataFrame([], "blob string, text string")
        self.found = spark.createDataFrame([], "blob string, kind string, ord int, line int, value string, extra string")
        self.reads, self.last = 0, ([], None)

    def graphs(self, ordinals: list[int]) -> tuple[DataFrame, DataFrame]:
        """(nodes (frame, id, ...), edges (frame, id, src, dst, type)) of the commits of these ordinals."""
        if self.last[0] == ordinals:
            return self.last[1]
        listing = materialise(files.listed_at(self.commits.filter(F.col("ord").isin(ordinals)), self.repository, self.exclude))
        new = listing.select("blob").distinct().join(self.texts.select("blob"), "blob", "left_anti")
        texts = materialise(files.blob_texts(new, self.repository))
        if read := texts.count():
            self.reads += read
            self.texts = materialise(self.texts.unionByName(texts))
            self.found = materialise(self.found.unionByName(scanned(texts.withColumnRenamed("blob", "path")).withColumnRenamed("path", "blob")))
        nodes, edges = build_frames(listing, self.texts, self.found, self.packages, self.aliases)
        self.last = (list(ordinals), (materialise(nodes), materialise(edges)))
        return self.last[1]


def as_one(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    """All frames as one graph, whose ids carry the frame."""
    tag = lambda c: F.concat_ws("\u0001", F.col("frame").cast("string"), c).alias(c)
    return PropertyGraph(nodes.select(tag("id"), "label", "type", "file", "line", "cluster"), edges.select(tag("id"), tag("src"), tag("dst"), "type"))


def violations_of(nodes: DataFrame, edges: DataFrame, config: list[Rule]) -> DataFrame:
    """(ord, what, subject, size) of the violations of every frame, all frames at once; ``what``: type and place of the rule."""
    found = violations(as_one(nodes, edges), config)
    plain = F.regexp_replace("subject", "(\\A|→ )[0-9]+\u0001", "$1")  # an edge names its frame at both ends
    return found.select(F.split("subject", "\u0001", 2)[0].cast("long").alias("ord"), F.concat_ws(" ", "rule", F.col("place").cast("string")).alias("what"), plain.alias("subject"), "size")
