"""From source text to a property graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import lexer
from weftgraph.functions.text import classify, cluster_for, collapsed, first_export_line, label_for, normalise_endpoint, query_key_label
from weftgraph.plans.iterate import materialise
from weftgraph.schema import PropertyGraph, edge_type_for

_SCAN = "path string, kind string, ord int, line int, value string, extra string"


def scanned(files: DataFrame) -> DataFrame:
    """(path, kind, ord, line, value, extra): imports, HTTP calls and query keys of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(path, "import", i, 0, s, None) for i, s in enumerate(lexer.specifiers(text or ""))]
                rows += [(path, kind, i, line, value, extra) for i, (kind, line, value, extra) in enumerate(lexer.calls(text or ""))]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "kind", "ord", "line", "value", "extra"])

    return files.select("path", "text").mapInArrow(run, _SCAN)


def _normal_path(path: Column) -> Column:
    """Without ``.`` and ``..`` pieces; null when it leaves the root."""
    step = lambda acc, p: (
        F.when(acc.isNull() | ((p == "..") & (F.size(acc) == 0)), F.lit(None)).when(p == "..", F.slice(acc, 1, F.size(acc) - 1)).when(p.isin(".", ""), acc).otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved_imports(found: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, src, dst): imports that reach another known file; the first candidate that exists counts.
    ``keys``: columns of both tables that tell graphs apart."""
    folder = F.regexp_replace("path", r"[^/]*\z", "")
    target = F.when(F.col("value").startswith("."), F.concat(folder, "value"))
    for prefix, place in (aliases or {}).items():
        target = target.when(F.col("value").startswith(prefix), F.concat(F.lit(place), F.substr("value", F.lit(len(prefix) + 1))))
    places = found.filter("kind = 'import'").select(*keys, F.col("path").alias("src"), "ord", _normal_path(target).alias("at")).filter("at is not null")
    bare = F.regexp_replace("at", r"\.jsx?\z", "")
    options = F.array(F.col("at"), *(F.concat(c, F.lit(e)) for c in (F.col("at"), bare) for e in (".ts", ".tsx", "/index.ts", "/index.tsx")))
    tried = places.select(*keys, "src", "ord", F.posexplode(options).alias("rank", "dst"))
    known = tried.join(files.select(*keys, F.col("path").alias("dst")), [*keys, "dst"], "left_semi")
    best = known.groupBy(*keys, "src", "ord").agg(F.min(F.struct("rank", "dst")).alias("b"))
    return best.select(*keys, "src", F.col("b.dst").alias("dst")).filter("src <> dst").distinct()


def package_of(files: DataFrame, packages: list[str]) -> DataFrame:
    """(path, package): name of the nearest package folder above each file."""
    if not packages:
        return files.select("path", F.lit(None).cast("string").alias("package"))
    pieces = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), "/"))).alias("folder"))
    rows = files.sparkSession.createDataFrame([(p,) for p in packages], "folder string")
    return above.join(rows, "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder")).select("path", F.element_at(F.split("folder", "/"), -1).alias("package"))


def _attributes(own: DataFrame) -> tuple[Column, ...]:
    """Of files (path, text, package): the columns of their nodes but the id."""
    rooted = F.concat(F.lit("/"), F.col("path"))  # the patterns look for whole folders
    return (
        label_for(F.col("path")).alias("label"), classify(rooted, F.col("text")).alias("type"), F.col("path").alias("file"),
        first_export_line(F.col("text")).cast("int").alias("line"), F.coalesce("package", cluster_for(F.col("path"))).alias("cluster"),
    )


def _assembled(nodes: DataFrame, found: DataFrame, files: DataFrame, aliases: dict[str, str] | None, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graphs told apart by ``keys``: nodes (*keys, id, ...) of files (*keys, path), and what was
    ``found`` in them (*keys, path, kind, ord, line, value, extra)."""
    imports = resolved_imports(found, files, aliases, keys).join(nodes.select(*keys, F.col("id").alias("dst"), F.col("type").alias("kind")), [*keys, "dst"])
    imports = imports.select(*keys, "src", "dst", edge_type_for(F.col("kind")).alias("type"), F.lit(0).alias("pass"))
    endpoint = normalise_endpoint(F.col("value"))
    api = found.filter("kind = 'api'").select(*keys, "path", "line", "ord", F.concat(F.lit("api:"), "extra", F.lit(" "), endpoint).alias("id"), F.concat("extra", F.lit(" "), endpoint).alias("label"), F.lit("api").alias("type"), F.lit("api").alias("cluster"), F.length(endpoint).alias("n")).filter("n > 0").drop("n")
    key = collapsed(F.col("value"))
    queries = found.filter("kind = 'query'").select(*keys, "path", "line", "ord", F.concat(F.lit("qk:"), key).alias("id"), query_key_label(key).alias("label"), F.lit("query-key").alias("type"), F.lit("queries").alias("cluster"))
    usages = api.unionByName(queries)
    first = F.min(F.struct(F.col("path").alias("file"), "line", "ord", "label", "type", "cluster")).alias("first")  # a row is kept for each task, not for each usage
    synthetic = usages.groupBy(*keys, "id").agg(first).select(*keys, "id", *(F.col(f"first.{c}").alias(c) for c in ("label", "type", "file", "line", "cluster")))
    called = usages.select(*keys, F.col("path").alias("src"), F.col("id").alias("dst"), F.when(F.col("type") == "api", "api-call").otherwise("query-key").alias("type"), F.when(F.col("type") == "api", 1).otherwise(2).alias("pass"))
    edges = imports.unionByName(called).groupBy(*keys, "src", "dst").agg(F.min(F.struct("pass", "type")).alias("k"))
    return nodes.unionByName(synthetic), edges.select(*keys, F.concat("src", F.lit("->"), "dst").alias("id"), "src", "dst", F.col("k.type").alias("type"))


def build_graph(files: DataFrame, packages: list[str] | None = None, aliases: dict[str, str] | None = None, project: str = "") -> PropertyGraph:
    """Files (path, text), their imports, the endpoints they call and the query keys they use.

    Of several usages the first file and line stands for an endpoint or key; an ordered
    pair has one edge, imports before calls before keys."""
    own = files.join(package_of(files, packages or []), "path", "left")
    nodes = own.select(F.col("path").alias("id"), *_attributes(own))
    return PropertyGraph(*_assembled(nodes, materialise(scanned(files)), files, aliases), {"project": project})


@dataclass(frozen=True)
class Staged:
    """Building a graph in two steps: what is found in each file, which only a change of that file can change, and the
    graph of all files, from what was found."""

    packages: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)

    def scan(self, files: DataFrame) -> DataFrame:
        """(path, label, type, file, line, cluster, found) of files (path, text); a row a file, without its text."""
        own = files.join(package_of(files, self.packages), "path", "left")
        known = own.select("path", *_attributes(own))
        found = scanned(files).groupBy("path").agg(F.collect_list(F.struct("kind", "ord", F.col("line").alias("at"), "value", "extra")).alias("found"))  # of one file
        return known.join(found, "path", "left")

    def assemble(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the rows of ``scan``."""
        nodes = rows.select(F.col("path").alias("id"), "label", "type", "file", "line", "cluster")
        found = rows.select("path", F.inline("found")).withColumnRenamed("at", "line")
        return _assembled(nodes, found, rows.select("path"), self.aliases)

    def __call__(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        return self.assemble(self.scan(files))


def build_frames(listing: DataFrame, texts: DataFrame, found: DataFrame, packages: list[str] | None = None, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (frame, id, ...), edges (frame, id, ...)) of many states of a tree at once.

    ``listing`` (frame, path, blob) says which content lies where; ``texts`` (blob, text) and what was ``found`` in them (blob,
    kind, ord, line, value, extra) are there once a content, however many frames hold it."""
    pairs = listing.select("path", "blob").distinct()  # a file is classified by its path and text
    own = pairs.join(package_of(pairs.select("path").distinct(), packages or []), "path", "left").join(texts, "blob")
    known = own.select("path", "blob", *_attributes(own))
    nodes = materialise(listing.join(known, ["path", "blob"]).select("frame", F.col("path").alias("id"), "label", "type", "file", "line", "cluster"))
    here = listing.join(found, "blob").select("frame", "path", "kind", "ord", "line", "value", "extra")
    return _assembled(nodes, here, listing, aliases, ("frame",))
