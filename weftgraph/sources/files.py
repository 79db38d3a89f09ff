"""Source trees, graph files, configurations and commit lists as DataFrames."""

from __future__ import annotations

import json
import os
import re
import subprocess
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.rules import Rule, parse_rule, problems
from weftgraph.schema import EDGES, NODES, PropertyGraph

# fixed values: paths that hold any of these are left out
EXCLUDED = ("node_modules", "dist", ".test.", ".spec.", ".stories.", "__tests__", "__mocks__")
GRAPH = T.StructType(
    [
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("nodes", T.ArrayType(NODES)),
        T.StructField(
            "edges",
            T.ArrayType(
                T.StructType(
                    [T.StructField(c, T.StringType()) for c in ("id", "source", "target", "type", "diff")]
                    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("ctrl1", "ctrl2")]
                )
            ),
        ),
    ]
)
CONFIG_NAME = "weftgraph.config.json"
COMMIT_SEPARATOR = "\x1f"


def pruned_folders(root: str, exclude: tuple[str, ...] = EXCLUDED) -> list[str]:
    """Folders under a local root that hold sources; excluded ones are not entered, links not followed."""
    found = []
    for folder, inner, names in os.walk(root, followlinks=False):
        inner[:] = sorted(d for d in inner if not any(x in os.path.join(folder, d) for x in exclude) and not os.path.islink(os.path.join(folder, d)))
        if any(n.endswith((".ts", ".tsx")) for n in names):
            found.append(folder)
    return found


def source_files(spark: SparkSession, folders: list[str], root: str, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path relative to the root, text) of the scripts directly in some folders; declaration files are left out."""
    schema = "path string, text string"
    if not folders:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ts,tsx}").load(folders)
    full = F.regexp_replace("path", r"\Afile:/*", "/")
    kept = files.select(full.alias("full"), F.decode("content", "UTF-8").alias("text"))
    # Spark's file sources pass over files of no length; they are files all the same
    hollow = [(os.path.join(d, n), "") for d in folders for n in sorted(os.listdir(d)) if n.endswith((".ts", ".tsx")) and os.path.getsize(os.path.join(d, n)) == 0]
    if hollow:
        kept = kept.unionByName(spark.createDataFrame(hollow, "full string, text string"))
    for part in exclude:
        kept = kept.filter(~F.contains(F.substr("full", F.lit(len(root.rstrip("/")) + 1)), F.lit(part)))
    kept = kept.filter(~F.col("full").endswith(".d.ts"))
    return kept.select(F.substr("full", F.lit(len(root.rstrip("/")) + 2)).alias("path"), "text")


def package_folders(root: str, exclude: tuple[str, ...] = EXCLUDED) -> list[str]:
    """Folders below a local root, relative to it, that hold a package.json."""
    found = []
    for folder, inner, names in os.walk(root, followlinks=False):
        inner[:] = [d for d in inner if not any(x in d for x in exclude)]
        if "package.json" in names and folder != root:
            found.append(os.path.relpath(folder, root))
    return sorted(found)


def read_jsonc(path: str) -> dict:
    """A JSON file that may hold comments and commas before a closing bracket."""
    text = open(path, encoding="utf-8-sig").read()
    text = re.sub(r'("(?:[^"\\\\]|\\\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:[^"\\\\]|\\\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text))


def compiler_options(path: str, seen: tuple[str, ...] = ()) -> dict:
    """compilerOptions of a tsconfig file and of those that it extends, the nearer first; the folder that
    baseUrl and paths are relative to is that of the file that has them (``pathsFolder``).  Packages are looked for
    in node_modules of the folders above; one that is missing, or that extends itself, adds nothing."""
    folder, value = os.path.dirname(path), read_jsonc(path)
    options, bases = {}, value.get("extends", [])
    for base in [bases] if isinstance(bases, str) else bases:  # later ones win
        places = [os.path.join(folder, base)] if base.startswith((".", "/")) else []
        above = folder
        while not base.startswith((".", "/")):
            places.append(os.path.join(above, "node_modules", base))
            if above == os.path.dirname(above):
                break
            above = os.path.dirname(above)
        tries = [os.path.normpath(p + e) for p in places for e in ("", ".json", "/tsconfig.json")]
        if place := next((p for p in tries if os.path.isfile(p) and p not in seen), None):
            options |= compiler_options(place, (*seen, path))
    own = value.get("compilerOptions", {})
    if "baseUrl" in own:
        own = own | {"baseUrl": os.path.join(folder, own["baseUrl"])}
    if "paths" in own:
        own = own | {"pathsFolder": folder}
    return options | own


def path_aliases(root: str) -> dict[str, str]:
    """Prefixes of compilerOptions.paths of the nearest tsconfig.json at or above a root, with
    the folder each stands for, relative to the root.  A file that cannot be read gives none, and a warning."""
    folder = os.path.abspath(root)
    while not os.path.exists(at := os.path.join(folder, "tsconfig.json")):
        if folder == os.path.dirname(folder):
            return {}
        folder = os.path.dirname(folder)
    try:
        options = compiler_options(at)
    except ValueError as e:
        warnings.warn(f"{at} is not read: {e}", stacklevel=2)
        return {}
    base = options.get("baseUrl", options.get("pathsFolder", folder))
    pairs = {k.rstrip("*"): v[0].rstrip("*") for k, v in options.get("paths", {}).items() if v}
    return {k: os.path.relpath(os.path.join(base, v), os.path.abspath(root)).rstrip("/") + "/" * k.endswith("/") for k, v in pairs.items()}


def workspace_warning(root: str) -> str | None:
    """Why links across packages may be missing, if they may."""
    manifest = os.path.join(root, "package.json")
    workspace = os.path.exists(os.path.join(root, "pnpm-workspace.yaml")) or (os.path.exists(manifest) and "workspaces" in json.loads(open(manifest, encoding="utf-8").read()))
    if workspace and not os.path.isdir(os.path.join(root, "node_modules")):
        return "this is a workspace without installed packages: imports across packages cannot be resolved"
    return None


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph file; anything without lists of nodes and edges is an error."""
    raw = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    if not raw.filter("nodes is null or edges is null").isEmpty() or raw.isEmpty():
        raise ValueError(f"{path} holds no graph: nodes and edges must be lists")
    meta = raw.select("meta").first()["meta"] or {}
    edges = raw.select(F.inline("edges")).withColumnsRenamed({"source": "src", "target": "dst"})
    return PropertyGraph(raw.select(F.inline("nodes")), edges, dict(meta))


def find_config(root: str) -> str | None:
    """The configuration file of a tree, if it has one."""
    place = os.path.join(root, CONFIG_NAME)
    return place if os.path.exists(place) else None


def read_config(path: str) -> tuple[list[Rule], tuple[str, ...]]:
    """Rules and additional exclusions of a JSON configuration; all problems in one error."""
    value = json.loads(open(path, encoding="utf-8").read())
    if found := problems(value):
        raise ValueError(f"{path}:\n" + "\n".join(found))
    return [parse_rule(r) for r in value.get("rules", [])], tuple(value.get("exclude", []))


def list_commits(spark: SparkSession, repository: str, since: str = "1 year ago") -> DataFrame:
    """(ord, sha, date, subject, author), oldest first."""
    form = "%x1f".join(("%H", "%cI", "%an", "%s"))
    out = subprocess.run(["git", "-C", repository, "log", "-z", "--reverse", f"--since={since}", f"--format={form}"], capture_output=True, check=True).stdout
    rows = [line.decode("utf-8", "replace").split(COMMIT_SEPARATOR, 3) for line in out.split(b"\0") if line]  # a subject may hold any separator but NUL
    return spark.createDataFrame([(i, sha, date, subject, author) for i, (sha, date, author, subject) in enumerate(rows)], "ord long, sha string, date string, subject string, author string")


def listed_at(commits: DataFrame, repository: str, exclude: Iterable[str] = EXCLUDED) -> DataFrame:
    """(frame, path, blob): where the scripts of each commit (ord, sha) lie below the folder ``repository`` and which content
    they have; one process a commit, and no content is read.  A commit that cannot be read yields
    nothing.  The repository must be at the same path for every executor."""
    exclude = tuple(exclude)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                done = subprocess.run(["git", "-C", repository, "ls-tree", "-r", "-z", sha], capture_output=True, check=False)
                entries = [e.split(b"\t", 1) for e in done.stdout.split(b"\0") if e] if done.returncode == 0 else []
                found = [(path.decode("utf-8", "replace"), about.split()) for about, path in entries]
                kept = [(path, about[2].decode()) for path, about in found if about[1] == b"blob" and path.endswith((".ts", ".tsx")) and not path.endswith(".d.ts") and not any(x in path for x in exclude)]
                columns = [pa.array([frame] * len(kept), pa.int64()), pa.array([p for p, _ in kept], pa.string()), pa.array([b for _, b in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["frame", "path", "blob"])

    return commits.select("ord", "sha").repartition(max(1, min(commits.count(), 1000)), "ord").mapInArrow(run, "frame long, path string, blob string")


def blob_texts(blobs: DataFrame, repository: str) -> DataFrame:
    """(blob, text) of distinct contents (blob), through one process a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            with subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
                for name in names:  # one at a time: neither side waits with a full pipe
                    git.stdin.write(f"{name}\n".encode())
                    git.stdin.flush()
                    about = git.stdout.readline().split()
                    text = git.stdout.read(int(about[2]) + 1)[:-1].decode("utf-8", "replace") if len(about) == 3 else ""
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([text], pa.string())], names=["blob", "text"])

    return blobs.select("blob").repartition("blob").mapInArrow(run, "blob string, text string")
