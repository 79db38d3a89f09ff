"""Command line: parse, check, doctor, modules, diff, watch, replay, blame.

python -m weftgraph.cli doctor --src path/to/tree [--config rules.json]
"""

from __future__ import annotations

import argparse
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import communities, doctor, history, relational, replay, rules, scc
from weftgraph.plans.build import Staged, build_graph
from weftgraph.plans.frames import Frames, violations_of
from weftgraph.plans.iterate import materialise
from weftgraph.schema import PropertyGraph
from weftgraph.sinks import diagrams
from weftgraph.sources import files

FORMATS = ("json", "mermaid", "dot", "markdown")
SHOWN = 12


def parse(spark: SparkSession, source: str, exclude: tuple[str, ...] = ()) -> PropertyGraph:
    """The graph of a source tree."""
    pruned = (*files.EXCLUDED, *exclude)
    if warning := files.workspace_warning(source):
        print(warning, file=sys.stderr)
    rows = files.source_files(spark, files.pruned_folders(source, pruned), source, pruned)
    graph = build_graph(rows, files.package_folders(source, pruned), files.path_aliases(source), source.rstrip("/").rpartition("/")[2])
    return PropertyGraph(graph.nodes.persist(), graph.edges.persist(), graph.meta | {"root": source})


def _rendered(graph: PropertyGraph, form: str, config: list[rules.Rule]) -> str:
    if form == "mermaid":
        return diagrams.text(diagrams.mermaid(graph))
    if form == "dot":
        return diagrams.text(diagrams.dot(graph))
    members = scc.strongly_connected(graph.edges).join(graph.nodes.select("id", "label"), "id")
    walks = members.groupBy("scc").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("w")).select("scc", F.col("w.label").alias("labels"))
    return diagrams.markdown(graph, rules.evaluate(graph, config), walks, relational.orphans(graph))


def _history(spark: SparkSession, args: argparse.Namespace, config: list[rules.Rule] | None = None, exclude: tuple[str, ...] = ()) -> int:
    """Replay: a timeline of frames as JSON lines, and all frames as Parquet beside it.  Blame: since when each cycle and
    violation is there (without a configuration: each shared target).  Packages and aliases are those of the tree as it is."""
    commits = files.list_commits(spark, args.src, args.since)
    n = commits.count()
    if not n:
        print("no commits", file=sys.stderr)
        return 0
    pruned = (*files.EXCLUDED, *exclude)
    frames = Frames(commits, args.src, pruned, files.package_folders(args.src, pruned), files.path_aliases(args.src))
    links = lambda edges: edges.select(F.col("frame").alias("ord"), "src", "dst")
    if args.command == "replay":
        nodes, edges = frames.graphs(history.pick_evenly(n, max(2, args.max_frames)))
        broken = violations_of(nodes, edges, config) if config else None
        found = history.timeline(links(edges), commits, nodes=nodes.select(F.col("frame").alias("ord"), "id"), broken=broken)
        found = materialise(found.join(commits.select("ord", "author"), "ord", "left"))
        with open(args.out or "timeline.jsonl", "w", encoding="utf-8") as f:
            for row in found.orderBy("ord").toJSON().toLocalIterator():
                f.write(row + "\n")
        if args.out:
            replay.make(found, *(whole.withColumnRenamed("frame", "ord") for whole in (nodes, edges))).write(args.out + ".replay")
        return 0
    lasting = [r for r in config or [] if r.type != "no-cycles"]  # cycles are blamed by their members in any case
    shas = {r["ord"]: (r["sha"][:8], r["date"], r["subject"]) for r in commits.collect()}  # a row a commit
    edges_of = lambda ordinals: links(frames.graphs(ordinals)[1])
    broken_of = (lambda ordinals: violations_of(*frames.graphs(ordinals), lasting)) if config else None
    for r in history.blame(edges_of([n - 1]), edges_of, n, broken_of=broken_of).orderBy("what", "subject").collect():
        print(r["what"], r["subject"], r["size"], *(shas[r["first_ord"]] if r["first_ord"] is not None else ("older than the history read",)))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftgraph")
    parser.add_argument("command", choices=("parse", "check", "doctor", "modules", "diff", "watch", "replay", "blame"), nargs="?", default="parse")
    parser.add_argument("--src", default=".")
    parser.add_argument("--base", help="a graph file to compare with (diff)")
    parser.add_argument("--config")
    parser.add_argument("--format", choices=FORMATS, default="json")
    parser.add_argument("--out")
    parser.add_argument("--since", default="1 year ago", help="how far back history is read (replay, blame)")
    parser.add_argument("--max-frames", type=int, default=40)
    parser.add_argument("--anonymous", action="store_true")
    args = parser.parse_args(argv)
    try:
        place = args.config or files.find_config(args.src)
        config, exclude = files.read_config(place) if place else ([], ())
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("weftgraph").config("spark.ui.enabled", "false").getOrCreate()
    began = time.time()
    if args.command in ("replay", "blame"):
        return _history(spark, args, config, exclude)
    graph = parse(spark, args.src, exclude)
    if args.command == "diff":
        if not args.base:
            parser.error("diff needs --base")
        graph = history.diff_graphs(files.read_graph(spark, args.base), graph)
    if args.anonymous:
        graph = graph.anonymous()
    if args.command == "check":
        found = rules.evaluate(graph, config).collect()
        for v in found:
            print(f"{v['rule']}: {v['message']}")
        return 1 if found or not config else 0
    if args.command == "doctor":
        found = doctor.diagnose(graph, rules.evaluate(graph, config))
        for r in found.limit(SHOWN).collect():
            print(f"{r['title']}\n  {r['fix']}")
        if (more := found.count() - SHOWN) > 0:
            print(f"... and {more} more")
        return 0
    if args.command == "modules":
        member = communities.louvain(graph)
        for name, m in (("found", member), ("folders", relational.folders_as_membership(graph))):
            print(f"modularity, {name}: {relational.modularity(graph, m).first()[0]}")
        for part, rows in zip(("split", "merged"), relational.disagreements(graph, member), strict=True):
            for r in rows.filter(F.col("rank") <= SHOWN).orderBy("rank", F.desc("files")).collect():
                print(part, *r)
        return 0
    if args.command == "watch":
        from weftgraph.streaming.watch import watch_tree

        folder = args.out or tempfile.mkdtemp(prefix="graph-")
        build = Staged(files.package_folders(args.src, (*files.EXCLUDED, *exclude)), files.path_aliases(args.src))
        measure = lambda nodes, edges: rules.violations(PropertyGraph(nodes, edges), config).count()
        watch_tree(spark, args.src, folder, build, f"{folder}/checkpoint", (*files.EXCLUDED, *exclude), measure=measure).awaitTermination()
        return 0
    out = args.out or {"json": "graph.json", "mermaid": "graph.mmd", "dot": "graph.dot", "markdown": "graph.md"}[args.format]
    if args.format == "json":
        diagrams.to_json(graph, out)
    else:
        with open(out, "w", encoding="utf-8") as f:
            f.write(_rendered(graph, args.format, config) + "\n")
    members = scc.strongly_connected(graph.edges)
    broken, lonely = rules.evaluate(graph, config).count(), relational.orphans(graph).count()
    for r in relational.type_counts(graph).orderBy(F.desc("n"), "type").collect():
        print(f"{r['type']:12}{r['n']}")
    print(f"{out}: {graph.nodes.count()} nodes, {graph.edges.count()} edges, {members.select('scc').distinct().count()} cycles, {lonely} orphans, {broken} violations, {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
