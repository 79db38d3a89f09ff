"""Shapes of small graphs with known answers, and source text to graph."""

import json
import random
import struct
import subprocess
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import cli, queries
from weftgraph.functions import lexer
from weftgraph.functions import text as fx
from weftgraph.operators import communities, components, cores, cuts, doctor, history, lens, naming, relational, replay, rules, scc, traverse
from weftgraph.plans import bounded
from weftgraph.plans.build import Staged, build_graph
from weftgraph.plans.frames import Frames
from weftgraph.plans.iterate import materialise
from weftgraph.schema import PropertyGraph
from weftgraph.sinks import diagrams
from weftgraph.sources import files, tables
from weftgraph.streaming import attributes, live, watch


def make(spark, links, nodes=(), kind="module", cluster="src"):
    pairs = [tuple(x.split(">")) for x in links.split()] if isinstance(links, str) else list(links)
    ids = list(dict.fromkeys([*nodes, *(e for p in pairs for e in p)]))
    kinds = kind if callable(kind) else lambda i: kind
    clusters = cluster if callable(cluster) else lambda i: cluster
    n = spark.createDataFrame([(i, i.rpartition("/")[2], kinds(i), i, 1, clusters(i)) for i in ids], "id string, label string, type string, file string, line int, cluster string")
    e = spark.createDataFrame([(f"e{k}", a, b, "import") for k, (a, b) in enumerate(pairs)], "id string, src string, dst string, type string")
    return PropertyGraph(n, e, {"project": "p"})


def groups(df, key="scc"):
    out = defaultdict(set)
    for r in df.collect():
        out[r[key]].add(r["id"])
    return {k: v for k, v in out.items()}


def ids(df):
    return {r["id"] for r in df.collect()}


@pytest.mark.parametrize(
    ("links", "want"),
    [
        ("a>b b>c", []),
        ("a>b b>a", ["ab"]),
        ("entry>a a>b b>c c>a", ["abc"]),
        ("a>b b>a x>y y>x", ["ab", "xy"]),
        ("a>a", []),
        ("a>b b>c c>a c>d d>e e>c", ["abcde"]),
    ],
)
def test_cycles(spark, links, want):
    assert sorted(map(sorted, groups(scc.strongly_connected(make(spark, links).edges)).values())) == [list(w) for w in want]


def test_cycles_of_a_long_ring_and_of_random_graphs(spark):
    n = 20_000
    ring = spark.range(n).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", (F.col("id") + 1) % n).alias("dst"))
    assert [(r["scc"], r["size"]) for r in scc.cycles(ring).collect()] == [("n00000", n)]
    rng = random.Random(3)
    names = [f"v{k:02}" for k in range(30)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(45)}
    reach = {v: {v} for v in names}
    for _ in names:
        for a, b in edges:
            for v in names:
                if a in reach[v]:
                    reach[v] |= {b}
    want = {frozenset(w for w in names if w in reach[v] and v in reach[w]) for v in names}
    found = groups(scc.strongly_connected(spark.createDataFrame(sorted(edges), "src string, dst string")))
    assert {frozenset(x) for x in found.values()} == {w for w in want if len(w) > 1}
    assert all(k == min(v) for k, v in found.items())


def jobs_of(spark, work):
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        result = work()
    finally:
        spark.sparkContext.setJobGroup("rest", "")
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_acyclic_graphs_end_in_a_fixed_number_of_jobs(spark):
    n = 1000
    name = lambda p, c: F.format_string(f"{p}%04d", c)
    ids = spark.range(n)
    rail = lambda p, q: ids.select(name(p, F.col("id")).alias("src"), name(q, F.col("id") + 1).alias("dst"))
    ladder = rail("a", "a").unionByName(rail("b", "b")).unionByName(rail("a", "b"))
    caterpillar = rail("a", "a").unionByName(ids.select(name("a", F.col("id")).alias("src"), name("leaf", F.col("id")).alias("dst")))
    used = set()
    for edges in (ladder, caterpillar, rail("a", "a")):
        found, jobs = jobs_of(spark, lambda edges=edges: scc.strongly_connected(edges).count())
        assert found == 0 and jobs < 20
        used.add(jobs)
    assert len(used) == 1


@pytest.mark.parametrize("limit", [0, 6, 40])
def test_cycles_by_joins_where_parts_exceed_the_limit(spark, limit):
    rng = random.Random(limit)
    names = [f"v{k:02}" for k in range(26)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(45)} | {(f"x{k}", f"x{(k + 1) % 5}") for k in range(5)} | {(f"y{k}", f"y{k + 1}") for k in range(6)})
    table = spark.createDataFrame(edges, "src string, dst string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(scc.strongly_connected(table, limit)) == rows(scc.strongly_connected(table))


def test_passes_of_pivots_settle_what_they_share(spark):
    rng = random.Random(12)
    rings = [(f"r{k:02}", size) for k, size in enumerate([2, 3, 5, 9, 4, 2, 7])]
    edges = {(f"{p}_{i}", f"{p}_{(i + 1) % n}") for p, n in rings for i in range(n)}
    edges |= {(f"{p}_{rng.randrange(n)}", f"{p}_{rng.randrange(n)}") for p, n in rings for _ in range(n)}
    order = [p for p, _ in rings]
    edges |= {(f"{a}_{rng.randrange(dict(rings)[a])}", f"{b}_{rng.randrange(dict(rings)[b])}") for k, a in enumerate(order) for b in order[k + 1 :]}  # forwards only
    edges = sorted(e for e in edges if e[0] != e[1])
    table = spark.createDataFrame([(*e, 0) for e in edges], "src string, dst string, part long")
    settled, rest = scc._pass(table)
    assert {frozenset(v) for v in groups(settled).values()} == {frozenset(f"{p}_{i}" for i in range(n)) for p, n in rings}
    assert rest.isEmpty()
    few = scc.PIVOTS
    try:
        scc.PIVOTS = 1
        settled, rest = scc._pass(table)
        assert len(groups(settled)) == 1 and 0 < rest.count() < len(edges)
        assert {frozenset(v) for v in groups(scc.strongly_connected(table, limit=0)).values()} == {frozenset(f"{p}_{i}" for i in range(n)) for p, n in rings}
    finally:
        scc.PIVOTS = few


def test_a_component_that_shares_the_last_pivot_alone(spark):
    few = spark.createDataFrame([(f"v{k:02}",) for k in range(scc.PIVOTS + 6)], "id string")
    names = [r["id"] for r in few.orderBy(F.xxhash64("id"), "id").collect()]
    hub, mate = names[scc.PIVOTS - 1], names[-1]
    edges = [(hub, mate), (mate, hub)] + [(hub, v) for v in names if v not in (hub, mate)]
    settled, rest = scc._pass(spark.createDataFrame([(*e, 0) for e in edges], "src string, dst string, part long"))
    assert set(groups(settled)) == {hub} and groups(settled)[hub] == {hub, mate} and rest.isEmpty()


def test_orphans(spark):
    paths = (
        "src/main.ts src/index.tsx src/App.tsx lib/lonely.ts app/page.tsx app/route.ts app/not-found.tsx vitest.config.ts playwright/auth.setup.ts env.d.ts "
        "middleware.ts scripts/run.ts tests/helper.ts app/api/links/helpers.ts app/api/links/route.ts"
    ).split()
    assert ids(relational.orphans(make(spark, "", paths))) == {"lib/lonely.ts", "app/api/links/helpers.ts"}
    kinds = {"p": "page", "a": "api", "q": "query-key", "m": "module"}
    assert ids(relational.orphans(make(spark, "", kinds, kinds.get))) == {"m"}


def test_rules(spark):
    out = rules.unique_caller(make(spark, "a>t b>t"), rules.Rule("unique-caller", "one")).collect()
    assert [(r["message"], r["node_ids"], len(r["edge_ids"])) for r in out] == [("one (t: 2 callers)", ["t", "a", "b"], 2)]
    typed = make(spark, "page>store hook>store", kind=lambda i: i)
    assert rules.unique_caller(typed, rules.Rule("unique-caller", "one", rules.Match(edge_type="api-call"))).isEmpty()
    out = rules.no_direct_import(typed, rules.Rule("no-direct-import", "no", rules.Match(source_type="page"))).collect()
    assert [(r["message"], r["node_ids"]) for r in out] == [("no (page → store)", ["page", "store"])]
    ring = make(spark, "a>b b>a")
    out = rules.evaluate(ring, [rules.Rule("no-cycles", "loop"), rules.Rule("unique-caller", "one")]).collect()
    assert [(r["message"], len(r["edge_ids"])) for r in out] == [("loop (a → b → a)", 2)]
    assert rules.evaluate(ring, []).isEmpty()


def test_config_problems():
    assert rules.problems({"rules": [{"type": "no-cycles", "message": "x"}], "exclude": ["a"]}) == []
    bad = {"rule": [], "rules": [{"type": "no-cycle", "message": " ", "match": {"edgeType": "imports", "kind": 1}}, 3], "exclude": "x"}
    found = rules.problems(bad)
    assert [p.split(":")[0] for p in found] == ["rule", "exclude", "rules[0].type", "rules[0].message", "rules[0].match.edgeType", "rules[0].match.kind", "rules[1]"]
    assert rules.problems([]) and rules.problems({"rules": {}})


def test_best_cut_and_dead_weight(spark):
    cut = lambda links: [(r["src"], r["dst"], r["frees"]) for r in scc.best_cuts(make(spark, links).edges).collect()]
    assert cut("main>a a>b b>a") == [("a", "b", 2)]
    assert cut("main>a a>b b>a a>c c>b") == [("b", "a", 3)]
    weight = lambda links, start: ids(doctor.dead_weight(make(spark, links, ["main", start]), spark.createDataFrame([(start,)], "id string")))
    assert weight("widow>helper helper>deep", "widow") == {"helper", "deep"}
    assert weight("widow>shared main>shared", "widow") == set()
    assert weight("widow>a a>b b>a", "widow") == set()


def test_dead_weight_of_random_graphs(spark):
    """Starts may be imported themselves; edges may repeat and lead back."""
    rng = random.Random(5)
    names = [f"v{k:02}" for k in range(60)]
    links = [(names[a], names[b]) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(62)) if a <= b or rng.random() < 0.2]
    links += links[:5]
    starts = {v for v in names if all(b != v for _, b in links)} | {names[30], names[31]}
    into = defaultdict(set)
    for a, b in links:
        into[b].add(a)
    want = set()
    for s in starts:
        gone, size = {s}, 0
        while size < len(gone):
            size = len(gone)
            gone |= {v for v in names if into[v] and into[v] <= gone}
        want |= {(s, v) for v in gone if v != s}
    found = doctor.dead_weight(make(spark, links, names), spark.createDataFrame([(s,) for s in starts], "id string"))
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > len(starts) / 2
    g = make(spark, links, names)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(doctor.dead_weight(g)) == rows(doctor.dead_weight(g, relational.orphans(g))) != []


def frees_by_search(n, edges):
    """Of every edge: nodes on no cycle without it, by one search each."""
    out = []
    for cut in edges:
        near = [[b for a, b in edges if a == v and (a, b) != cut] for v in range(n)]
        found = Counter(scc.search(near))
        out.append(n - sum(size for size in found.values() if size > 1))
    return out


def test_every_cut_of_random_components():
    rng = random.Random(8)
    for _ in range(250):
        n = rng.randrange(2, 24)
        order = rng.sample(range(n), n)
        edges = {(order[k], order[k - 1]) for k in range(n)} if n > 1 else set()
        for _ in range(rng.randrange(0, min(2 * n, 60 - n))):
            a, b = rng.randrange(n), rng.randrange(n)
            edges |= {(a, b)} if a != b else set()
        edges = sorted(edges)
        assert cuts.freed(n, *np.array(edges).T).tolist() == frees_by_search(n, edges)
    for _ in range(60):  # several loops that share nodes
        n, edges = 1, set()
        while len(edges) < 50:
            size, at = rng.randrange(1, 6), rng.randrange(n)
            ring = [at, *range(n, n + size)]
            edges |= {(ring[k - 1], ring[k]) for k in range(len(ring))}
            n += size
        edges = sorted(edges)
        assert cuts.freed(n, *np.array(edges).T).tolist() == frees_by_search(n, edges)


def test_cuts_of_large_components(spark):
    ring = make(spark, [(f"n{k:03}", f"n{(k + 1) % 401:03}") for k in range(401)] + [("x", "y"), ("y", "x"), ("x", "z"), ("z", "x")])
    out = {r["scc"]: tuple(r)[1:] for r in scc.best_cuts(ring.edges).collect()}
    assert out == {"n000": (401, "n000", "n001", 401), "x": (3, "x", "y", 1)}
    fix = {r["subject"]: r["fix"] for r in doctor.diagnose(ring).filter("kind = 'cycle'").collect()}
    assert fix["n000"] == "Cutting n000 -> n001 takes 401 nodes out of it."
    within = scc.inside(ring.edges)
    assert {r["scc"] for r in scc.too_large(within, 400).collect()} == {"n000"}
    assert {r["scc"] for r in scc.best_cuts(ring.edges, within=within, limit=400).collect()} == {"x"}


def test_doctor_ranks_cycles_first(spark):
    found = doctor.diagnose(make(spark, "a>b b>a w>x x>y y>z")).collect()
    assert [r["kind"] for r in found] == ["cycle", "orphan"]
    assert found[0]["impact"] == 2 and (found[1]["subject"], found[1]["nodes"]) == ("w", 4)
    g = make(spark, "a>b b>a w>x x>y y>z")
    assert groups(doctor.involved(g), "subject") == {"a": {"a", "b"}, "w": {"w", "x", "y", "z"}}


def test_what_if(spark):
    g = make(spark, "a>b b>c c>a a>leaf d>a")
    r = doctor.simulate_delete(g, "a", [rules.Rule("unique-caller", "one")]).first()
    assert (r["orphaned"], r["broken"], r["cycles_resolved"], r["violations_before"], r["violations_after"]) == (2, 2, 1, 1, 0)
    assert doctor.simulate_delete(g, "none").isEmpty()
    assert groups(doctor.deletion_touches(g, "a"), "effect") == {"orphaned": {"b", "leaf"}, "broken": {"c", "d"}}
    assert "2 broken, 2 orphaned" in lens.deletion_status(doctor.simulate_delete(g, "a")).first()[0]


def test_traversal(spark):
    g = make(spark, "a>b b>c a>logger z>logger c>d")
    blocked = spark.createDataFrame([("logger",)], "id string")
    assert ids(traverse.neighbourhood(g, "b", 1, blocked)) == {"a", "b", "c"}
    assert ids(traverse.neighbourhood(g, "a", 2, blocked)) == {"a", "b", "c", "logger"}
    assert {(r["id"], r["depth"]) for r in traverse.impact(g, "d").collect()} == {("d", 0), ("c", 1), ("b", 2), ("a", 3)}
    path = traverse.shortest_path(g, "d", "z")
    assert [r["id"] for r in path.orderBy("hop").collect()] == ["d", "c", "b", "a", "logger", "z"]
    assert traverse.path_edges(g, path).count() == 5
    assert traverse.shortest_path(make(spark, "a>b x>y"), "a", "x").isEmpty()
    assert groups(components.connected_components(make(spark, "a>b c>b x>y").edges), "component") == {"a": {"a", "b", "c"}, "x": {"x", "y"}}


def test_reach_counts_by_words(spark):
    rng = random.Random(21)
    names = [f"v{k:03}" for k in range(80)]
    edges = {(names[a], names[b]) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(85)) if a < b or rng.random() < 0.15} | {(names[k], names[k + 1]) for k in range(8)}
    g = make(spark, sorted(e for e in edges if e[0] != e[1]), [*names, "alone"])
    back = defaultdict(set)
    for a, b in edges:
        back[b].add(a)

    def dependents(v):
        seen, more = {v}, [v]
        while more:
            fresh = back[more.pop()] - seen
            seen |= fresh
            more += fresh
        return len(seen) - 1

    want = {v: dependents(v) for v in [*names, "alone"]}
    assert {r["id"]: r["reached"] for r in traverse.impact_counts(g).collect()} == want
    few = spark.createDataFrame([(names[3],), (names[70],), ("alone",), ("missing",)], "id string")
    assert {r["id"]: r["reached"] for r in traverse.impact_counts(g, few).collect()} == {v: want[v] for v in (names[3], names[70], "alone")}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    score = {v: round(-3 * abs(len(near[v]) / 81 - 0.3) + want[v] / 81, 9) for v in want}
    best = min(score, key=lambda v: (-score[v], v))
    assert tuple(traverse.subject(g, batch=20).first()) == (best, score[best])
    assert traverse.impact_counts(make(spark, "", [])).isEmpty() and traverse.subject(make(spark, "", [])).isEmpty()


def test_the_supplier_graph_is_counted_once():
    read = []
    once = lambda *args, **more: read.append(args) or PropertyGraph("nodes", "edges")
    kept, cut = queries.tables.graph, queries.materialise
    try:
        queries.tables.graph, queries.materialise = once, lambda df: f"{df}, cut"
        assert queries.G2(None, "folder", 1).edges == "edges, cut" and len(read) == 1
    finally:
        queries.tables.graph, queries.materialise = kept, cut


def test_reach_counts_over_all_followers(spark, tmp_path):
    """Orders whose suppliers follow each other twice along a chain, and once to a side branch that one follower each would drop."""
    orders = [(1, 2), (1, 2), (2, 3), (2, 3), (1, 4), (4, 5), (4, 5), (4, 2), (3, 6), (6, 7, 6), (8, 8), (9,)]
    lines = [(o, n, 1, s) for o, order in enumerate(orders) for n, s in enumerate(order, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"s{k}", k % 2) for k in range(1, 10)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "n0", 0), (1, "n1", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    back = defaultdict(set)
    for order in orders:
        for a, b in zip(order, order[1:], strict=False):
            if a != b:
                back[b].add(a)
    want = {}
    for v in range(1, 10):
        seen, more = set(), [v]
        while more:
            fresh = back[more.pop()] - seen
            seen |= fresh
            more += fresh
        want[f"supplier/{v}"] = len(seen - {v})
    found = {r["id"]: r["reached"] for r in queries.QUERIES["impact_counts_all"](spark, str(tmp_path)).collect()}
    assert found == want == {f"supplier/{k + 1}": n for k, n in enumerate((0, 2, 3, 1, 2, 5, 5, 0, 0))}
    with duckdb.connect() as c:
        for name in ("lineitem", "supplier", "nation"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert dict(c.execute(queries.ORACLE_SQL["impact_counts_all"]).fetchall()) == want
    assert {r["id"]: r["reached"] for r in queries.QUERIES["impact_counts"](spark, str(tmp_path)).collect()} != want


def test_reach_counts_of_trees_take_few_jobs(spark):
    """Sums go up a chain of 60 in rounds of its logarithm; trees under a part of several callers are folded."""
    chain = [(f"c{k:02}", f"c{k + 1:02}") for k in range(60)]
    g = make(spark, chain + [(f"leaf{k}", "c30") for k in range(5)])
    found, jobs = jobs_of(spark, lambda: {r["id"]: r["reached"] for r in traverse.impact_counts(g).collect()})
    assert found == {f"c{k:02}": k + 5 * (k >= 30) for k in range(61)} | {f"leaf{k}": 0 for k in range(5)}
    assert jobs < 100
    assert tuple(traverse.subject(g).first()) == ("c59", round(-3 * abs(2 / 66 - 0.3) + 64 / 66, 9))
    forked = make(spark, "x>b x>a b>t a>t t>top y>x z>x z>side w>b")
    assert {r["id"]: r["reached"] for r in traverse.impact_counts(forked).collect()} == {"y": 0, "z": 0, "w": 0, "x": 2, "side": 1, "a": 3, "b": 4, "t": 6, "top": 7}


def test_components_of_a_long_path(spark):
    path = spark.range(300).select(F.format_string("n%04d", "id").alias("src"), F.format_string("n%04d", F.col("id") + 1).alias("dst"))
    for limit in (0, 1000):
        assert [r["component"] for r in components.connected_components(path, limit=limit).select("component").distinct().collect()] == ["n0000"]
    rng = random.Random(2)
    some = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(7, 7), (None, 3), (500, 500)], "src long, dst long")
    rows = lambda limit: sorted(map(tuple, components.connected_components(some, limit=limit).collect()))
    assert rows(0) == rows(1000) and (500, 500) in rows(0)


def test_cores_and_skeleton(spark):
    core = lambda g: {r["id"]: r["core"] for r in cores.coreness(g).collect()}
    assert set(core(make(spark, "a>b b>c c>d d>e e>f")).values()) == {1}
    assert set(core(make(spark, "a>b a>c a>d b>c b>d c>d")).values()) == {3}
    assert core(make(spark, [("hub", f"l{k}") for k in range(50)]))["hub"] == 1
    assert core(make(spark, "a>b b>c", ["alone"]))["alone"] == 0
    k12 = [(f"k{i:02}", f"k{j:02}") for i in range(12) for j in range(i)]
    long = make(spark, [(f"p{k:04}", f"p{k + 1:04}") for k in range(1000)] + [("p0000", "t1"), ("t1", "t2"), ("t2", "p0000")])
    assert {v for k, v in core(long).items() if k[0] == "p" and k != "p0000"} == {1} and core(long)["t1"] == 2
    mixed = make(spark, k12 + [("k00", "x1"), ("x1", "x2"), ("y1", "y2"), ("y2", "y3"), ("y3", "y1")])
    by_joins = {r["id"]: r["core"] for r in cores.coreness(mixed, 4).collect()}  # one part by joins, one peeled
    assert by_joins == core(mixed) and (by_joins["k03"], by_joins["x1"], by_joins["y2"]) == (11, 1, 2)
    fringe = [(f"f{i}", f"f{i + 1}") for i in range(60)]
    assert ids(cores.skeleton(make(spark, k12 + fringe + [("f0", "k00")]), 20)) == {f"k{i:02}" for i in range(12)}
    k14 = [(f"k{i:02}", f"k{j:02}") for i in range(14) for j in range(i)]
    busy = k14 + [(f"leaf{i}", "logger") for i in range(90)] + [(f"k{i:02}", "logger") for i in range(14)]
    assert ids(cores.skeleton(make(spark, busy), 20)) == {f"k{i:02}" for i in range(14)}
    assert cores.skeleton(make(spark, "a>b"), 5).count() == 2


def test_communities(spark):
    clique = lambda p, n: [(f"{p}{i}", f"{p}{j}") for i in range(n) for j in range(i)]
    two = make(spark, clique("a", 4) + clique("b", 4) + [("a1", "b1")])
    member = communities.louvain(two)
    assert sorted(map(sorted, groups(member, "community").values())) == [[f"{p}{i}" for i in range(4)] for p in "ab"]
    assert relational.modularity(two, member).first()[0] > 0.3
    one = make(spark, clique("a", 5))
    assert relational.modularity(one, communities.louvain(one)).first()[0] < 0.1
    assert relational.modularity(make(spark, "", ["a"]), spark.createDataFrame([("a", "a")], "id string, community string")).first()[0] == 0
    split = make(spark, clique("a", 3) + clique("b", 3), cluster="utils")
    found = relational.disagreements(split, communities.louvain(split))
    assert found[0].count() == 2 and found[1].isEmpty() and {r["rank"] for r in found[0].collect()} == {1}
    for g in (two, one, split):
        assert communities.best_merge(g, communities.louvain(g)).first()[0] <= 1e-9
    assert communities.coarsen(two).count() == 1 and communities.coarsen(two).first()["w"] == 1


def test_communities_are_the_same_by_joins_and_in_one_task(spark):
    rng = random.Random(4)
    planted = {(f"v{6 * rng.randrange(15) + g:03}", f"v{6 * rng.randrange(15) + g:03}") for g in range(6) for _ in range(60)}
    planted |= {(f"v{rng.randrange(90):03}", f"v{rng.randrange(90):03}") for _ in range(60)}
    shapes = [sorted(p for p in planted if p[0] != p[1]), [("hub", f"l{k:02}") for k in range(40)], [(f"r{k:02}", f"r{(k + 1) % 40:02}") for k in range(40)]]
    rows = lambda df: sorted(map(tuple, df.collect()))
    for links in shapes:
        g = make(spark, links)
        member = rows(communities.louvain(g))
        assert rows(communities.louvain(g, limit=0)) == member
        assert rows(communities.coarsen(g)) == rows(communities.coarsen(g, limit=0))
        parts = {m: {i for i, c in member if c == m} for _, m in member}
        for m, own in parts.items():  # each is connected
            seen, more = {m}, [m]
            while more:
                at = more.pop()
                found = {y for x, y in links + [(y, x) for x, y in links] if x == at and y in own} - seen
                seen |= found
                more += found
            assert seen == own
    assert len({c for _, c in rows(communities.louvain(make(spark, shapes[0])))}) == 6


def test_every_step_raises_modularity():
    rng = np.random.default_rng(1)
    for n in (12, 40, 200):
        a, b = rng.integers(0, n, (2, 4 * n))
        a, b = np.append(a[a != b], np.zeros(n - 1, int)), np.append(b[a != b], np.arange(1, n))  # and a hub
        w = rng.integers(1, 5, len(a))
        u, v, both = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(w, 2)
        k = np.bincount(u, both).astype(int)
        quality = lambda c: int(both[c[u] == c[v]].sum()) * int(k.sum()) - int((np.bincount(c, k) ** 2).sum())  # noqa: B023, E731
        community, best = np.arange(n), None
        for _ in range(30):
            following = communities._step(u, v, both, k, community, rng.integers(-(1 << 63), (1 << 63) - 1, n))
            if following is None:
                break
            assert quality(following) > quality(community)
            community, best = following, quality(following)
        else:
            raise AssertionError("still moving")
        assert best is not None


def test_history(spark):
    base, head = make(spark, "a>b a>c"), make(spark, "a>b a>d")
    edges = lambda g: PropertyGraph(g.nodes, g.edges.withColumn("id", F.concat_ws("->", "src", "dst")))
    diff = history.diff_graphs(edges(base), edges(head))
    assert {(r["id"], r["diff"]) for r in diff.nodes.collect()} == {("a", "same"), ("b", "same"), ("c", "removed"), ("d", "added")}
    assert tuple(history.diff_counts(diff).first()) == (1, 1, 1, 1)
    assert ids(relational.changed_scope(diff)) == {"a", "c", "d"}
    rows = [(0, "a", 1), (0, "b", 1), (1, "a", 2), (1, "b", 1), (1, "c", 1), (5, "b", 1), (5, "c", 1)]
    changes = history.deltas(spark.createDataFrame(rows, "ord long, id string, line int"), ["id"], ["line"])
    assert {tuple(r) for r in changes.collect()} == {(0, "added", "a", 1), (0, "added", "b", 1), (1, "changed", "a", 2), (1, "added", "c", 1), (5, "removed", "a", 2)}
    log = history.skip_log(changes, spark.createDataFrame(rows, "ord long, id string, line int"), ["id"], ["line"])
    for frame, ord_ in enumerate((0, 1, 5)):
        assert {tuple(r) for r in history.frame_at(log, frame, ["id"]).collect()} == {(i, n) for o, i, n in rows if o == ord_}


def test_even_sample():
    for n in (0, 5, 14, 43, 100, 1000, 5000):
        for budget in (40, 14, 12, 11, 1):
            got = history.pick_evenly(n, budget)
            assert got == sorted(set(got)) and len(got) <= max(budget, 1)
            assert not n or got[-1] == n - 1
            assert budget < 2 or n == 0 or got[0] == 0


def test_first_where():
    assert history.first_where(100, lambda k: k >= 42)[0] == 42
    at, probes = history.first_where(5000, lambda k: k >= 3771)
    assert at == 3771 and probes < 16
    assert history.first_where(9, lambda k: True) == (None, 2)
    assert history.first_where(9, lambda k: False) == (None, 1)
    assert history.first_where(0, lambda k: True) == (None, 0)
    assert history.first_where(1, lambda k: True)[0] is None
    assert history.first_where(64, lambda k: k >= 63)[0] == 63 and history.first_where(64, lambda k: k >= 1)[0] == 1


def test_blame(spark):
    links = [("a", "b", 0), ("b", "a", 0), ("x", "y", 1), ("y", "x", 3), ("p", "t", 0), ("q", "t", 4), ("r", "z", 0), ("s", "z", 0)]  # since which frame
    history_ = spark.createDataFrame([(k, a, b) for k in range(6) for a, b, since in links if k >= since], "ord long, src string, dst string")
    asked = []

    def edges_of(ordinals):
        asked.append(list(ordinals))
        return history_.filter(F.col("ord").isin(ordinals))

    out = {(r["what"], r["subject"]): r["first_ord"] for r in history.blame(edges_of([5]), edges_of, 6).collect()}
    assert out == {("cycle", "a"): None, ("cycle", "x"): 3, ("shared", "t"): 4, ("shared", "z"): None}
    assert asked[1:3] == [[5], [0]] and len(asked) < 8
    assert history.blame(edges_of([5]), edges_of, 0).filter("first_ord is not null").isEmpty()
    commits = spark.createDataFrame([(k, f"{k}" * 40, f"2024-01-0{k + 1}", f"change {k}") for k in range(6)], "ord long, sha string, date string, subject string")
    frames = {r["ord"]: r for r in history.timeline(history_, commits).collect()}
    assert [frames[k]["cycles"] for k in range(6)] == [1, 1, 1, 2, 2, 2] and [frames[k]["violations"] for k in range(6)] == [1, 1, 1, 1, 2, 2]
    assert frames[3]["sha"] == "33333333" and frames[1]["added"] == 2 and frames[0]["added"] == 0
    assert lens.frame_status(history.frames(history_), 1).first()[0] == "frame 1: 9 nodes, 6 edges, 2 came, 0 went"


def test_names(spark):
    paths = "billing/pay/Service.ts shop/pay/Service.ts lib/zod.ts app/index.ts".split()
    g = make(spark, "", paths)
    g = PropertyGraph(g.nodes.withColumn("label", fx.label_for(F.col("id"))), g.edges)
    assert {r["id"]: r["name"] for r in naming.disambiguate(g).collect()} == {
        "billing/pay/Service.ts": "billing/pay/Service", "shop/pay/Service.ts": "shop/pay/Service", "lib/zod.ts": "zod", "app/index.ts": "app",
    }
    points = spark.createDataFrame([(k, "left" if k < 5 else "right", [float(k // 5 * 100 + k), 0.0]) for k in range(10)], "id long, folder string, position array<double>")
    assert {(r["folder"], r["share"]) for r in naming.cohesion(points).collect()} == {("left", 1.0), ("right", 1.0)}


def test_a_path_under_two_schemes_is_named_twice(spark, tmp_path):
    urls = ["http://a.org/x/1", "https://a.org/x/1", "http://b.org/x/2", "http://c.org/x/3", "http://d.org/y/3"]
    spark.createDataFrame([(k, u, "") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(tuple, queries.disambiguate(spark, str(tmp_path)).collect()))
    assert found == [("a.org/x/1", "a.org/x/1"), ("a.org/x/1", "a.org/x/1"), ("b.org/x/2", "2"), ("c.org/x/3", "x/3"), ("d.org/y/3", "y/3")]


def test_attributes_survive_versions_but_no_deletion(spark):
    present = {0: "abc", 1: "abd", 2: "abcd", 5: "acd"}
    changes = [(0, "a", 1.0, True), (0, "c", 2.0, True), (0, "b", 3.0, True), (1, "a", 4.0, False), (2, "d", 5.0, True), (2, "x", 6.0, True), (5, "d", None, None)]
    table = spark.createDataFrame([(v, i) for v, found in present.items() for i in found], "version long, id string")
    out = attributes.carried(spark.createDataFrame(changes, "version long, id string, x double, pinned boolean"), table, ["x", "pinned"])
    assert sorted(map(tuple, out.collect())) == [("a", 1, 4.0, False), ("c", None, None, None), ("d", 5, None, None)]
    assert attributes.carried(out.select(F.lit(1).alias("version"), "id", "x").limit(0), table.limit(0), ["x"]).isEmpty()


def test_long_calls_and_units_of_hashes(spark):
    wide = "fetch('/long', { body: [" + "'x, y', (1), " * 200_000 + "], method: 'PUT' })\nfetch('/open'"
    assert lexer.calls(wide) == [("api", 1, "'/long'", "PUT")]
    names = ["src/a.ts", "é", "𝄞 clef", ""]

    def slot(text):
        h = 0
        for unit in struct.unpack(f">{len(text.encode('utf-16-be')) // 2}H", text.encode("utf-16-be")):
            h = (h * 31 + unit) & 0xFFFFFFFF
        return h % 24

    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", fx.arrival_slot(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == {n: slot(n) for n in names}


@pytest.mark.parametrize("shape", ["groups", "ball", "same", "few"])
def test_nearest_points_without_all_pairs(spark, shape):
    rng = np.random.default_rng(5)
    if shape == "groups":
        x = rng.normal(size=(30, 3))[rng.integers(0, 30, 1500)] * 50 + rng.normal(size=(1500, 3))
    elif shape == "ball":
        x = rng.normal(size=(400, 8))
    elif shape == "same":
        x = np.round(rng.normal(size=(200, 2)))
    else:
        x = np.array([[0.0, 1.0], [0.0, 1.0], [5.0, 5.0]])
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, None), (9998, [None] * x.shape[1])], "id long, position array<double>")
    asked = list(range(0, len(x), 7))
    d = ((x[asked][:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    d[np.arange(len(asked)), asked] = np.inf
    queries = points.filter(F.col("id").isin(asked))
    out = {r["id"]: r["nearest"] for r in naming.nearest(points, queries).collect()}
    if shape == "ball":
        assert out == {i: int(row.argmin()) for i, row in zip(asked, d, strict=True)}
    else:  # ties go to the least id
        assert out == {i: int(np.flatnonzero(row <= row.min() * (1 + 1e-12)).min()) for i, row in zip(asked, d, strict=True)}
    if shape == "groups":
        own, others = naming.nearest_pairs(points, queries)
        assert own.count() + others.count() < len(asked) * len(x) / 10


def test_order_statistics_are_exact(spark):
    rng = random.Random(3)
    shapes = {
        "one": [5.0], "same": [2.5] * 40, "two": [1.0, 2.0] * 9, "spread": [rng.gauss(0, 1) for _ in range(700)], "steep": [2.0 ** rng.randrange(-1000, 1000) * rng.choice([1, -1]) for _ in range(300)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1e-323], "near": [1.0 + k * 2.0**-52 for k in range(50)] * 3,
    }
    rows = [(g, v) for g, vs in shapes.items() for v in vs] + [("spread", None), ("spread", float("nan")), ("none", None)]
    table = spark.createDataFrame(rows, "folder string, d double")
    for share in (0.5, 1.0):
        out = {r["folder"]: r["value"] for r in naming.order_statistic(table, ["folder"], "d", share).collect()}
        assert out == {g: sorted(vs)[min(int(len(vs) * share), len(vs) - 1)] for g, vs in shapes.items()}
    every = sorted(v for vs in shapes.values() for v in vs)
    assert [tuple(r) for r in naming.order_statistic(table, [], "d", 0.5).collect()] == [(every[len(every) // 2],)]
    assert naming.order_statistic(table.limit(0), ["folder"], "d", 0.5).isEmpty()
    assert tuple(naming.reach(spark.createDataFrame([], "x double, y double, z double")).first()) == (0.0, 0.0, 0.0, 60.0)


def test_labels_and_kinds(spark):
    paths = {"src/theme.ts": "theme", "src/Button/index.tsx": "Button", "app/page.tsx": "app/page", "app/layout.tsx": "app/layout", "app/about/page.tsx": "about/page"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", fx.label_for(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in rows} == paths
    cases = [
        ("/a/x.tsx", "createContext(1)", "context"), ("/a/s.ts", "import { create } from 'zustand'\ncreate((set) => 1)", "store"), ("/a/useIt.ts", "", "hook"), ("/a/HomePage.tsx", "", "page"),
        ("/pages/x.ts", "", "page"), ("/app/layout.tsx", "", "page"), ("/a/x.tsx", "", "component"), ("/a/x.ts", "fetch('/u')", "api"), ("/a/apiThing.ts", "", "api"), ("/a/x.ts", "", "module"),
    ]
    got = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "i int, p string, t string").select("i", fx.classify(F.col("p"), F.col("t")).alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == [k for *_, k in cases]
    clusters = {"src/features/auth/login/x.ts": "auth", "lib/x.ts": "lib", "x.ts": "src", "features/x.ts": "features"}
    got = spark.createDataFrame([(p,) for p in clusters], "p string").select("p", fx.cluster_for(F.col("p")).alias("c")).collect()
    assert {r["p"]: r["c"] for r in got} == clusters


SOURCES = {
    "main.ts": "import { a } from './lib/a'\nimport type { T } from '@/types'\nimport x from 'react'\nexport * from './ui/Button.js'\n// import z from './dead'\nexport const v = 1\n",
    "lib/a.ts": "export const a = () => fetch(`/users/${id}/x`, { method: 'post' })\naxios.get(\"/items\")\n",
    "lib/index.ts": "import '../main'\n",
    "ui/Button.tsx": "import lib from '../lib'\nuseQuery({ queryKey: ['users',\n  id], queryFn: f })\n",
    "types.ts": "export type T = 1",
    "dead.ts": "",
}


def test_lexer():
    assert lexer.specifiers(SOURCES["main.ts"]) == ["./lib/a", "@/types", "react", "./ui/Button.js"]
    assert lexer.calls(SOURCES["lib/a.ts"]) == [("api", 1, "`/users/${id}/x`", "POST"), ("api", 2, '"/items"', "GET")]
    assert lexer.calls(SOURCES["ui/Button.tsx"]) == [("query", 2, "['users',\n  id]", "useQuery")]
    assert lexer.calls("fetch(url); notfetch('/x'); /* fetch('/y') */") == []


def test_build_graph(spark, tmp_path):
    rows = spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    g = build_graph(rows, ["ui"], {"@/": ""}, "demo")
    edges = {(r["src"], r["dst"], r["type"]) for r in g.edges.collect()}
    assert edges == {
        ("main.ts", "lib/a.ts", "api-call"), ("main.ts", "types.ts", "import"), ("main.ts", "ui/Button.tsx", "component"), ("lib/index.ts", "main.ts", "import"), ("ui/Button.tsx", "lib/index.ts", "import"),
        ("lib/a.ts", "api:POST /users/:param/x", "api-call"), ("lib/a.ts", "api:GET /items", "api-call"), ("ui/Button.tsx", "qk:['users', id]", "query-key"),
    }
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert nodes["main.ts"]["line"] == 4 and nodes["ui/Button.tsx"]["cluster"] == "ui" and nodes["api:GET /items"]["cluster"] == "api"
    assert "flowchart LR" in diagrams.text(diagrams.mermaid(g)) and diagrams.text(diagrams.dot(g)).endswith("}")
    path = str(tmp_path / "graph.json")
    diagrams.to_json(g, path)
    assert files.read_graph(spark, path).edges.count() == len(edges)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_graph(spark, str(tmp_path / "bad.json"))
    empty = spark.createDataFrame([], "scc string, labels array<string>")
    report = diagrams.markdown(g, rules.evaluate(g, []), empty, relational.orphans(g))
    assert "8 edges" in report and "`dead.ts`" in report and "Rules hold" in report


def test_source_tree_and_watch(spark, tmp_path):
    for name, text in SOURCES.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    (tmp_path / "tree/node_modules/x").mkdir(parents=True)
    (tmp_path / "tree/node_modules/x/i.ts").write_text("")
    (tmp_path / "tree/t.d.ts").write_text("")
    root = str(tmp_path / "tree")
    rows = files.source_files(spark, files.pruned_folders(root), root)
    assert {r["path"] for r in rows.collect()} == set(SOURCES)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"path": p, "text": t}) for p, t in SOURCES.items()))
    out = str(tmp_path / "out")
    build = lambda f: (lambda g: (g.nodes, g.edges))(build_graph(f))
    run = lambda: watch.watch(spark.readStream.schema("path string, text string").json(str(tmp_path / "in")), out, build, out + "/checkpoint", None).awaitTermination()
    run()
    assert watch.last_good(spark, out)[0].count() == 9
    (tmp_path / "in/2.json").write_text(json.dumps({"path": "dead.ts", "text": None}))
    run()
    nodes, _, version = watch.last_good(spark, out)
    assert version == 1 and nodes.count() == 8


def test_watch_follows_a_real_tree(spark, tmp_path):
    root, out = tmp_path / "tree", str(tmp_path / "out")
    (root / "node_modules/x").mkdir(parents=True)
    (root / "node_modules/x/i.ts").write_text("export const i = 1")
    (root / "a.ts").write_text("import './b'\n")
    (root / "b.ts").write_text("export const b = 1\n")
    (root / "t.d.ts").write_text("")
    build = lambda f: (lambda g: (g.nodes, g.edges))(build_graph(f))
    config = [rules.Rule("unique-caller", "one")]
    measure = lambda n, e: rules.violations(PropertyGraph(n, e), config).count()
    look = lambda: watch.tree_step(spark, str(root), out, build, None, measure)
    now = lambda: (lambda g: (ids(g[0]), {(r["src"], r["dst"]) for r in g[1].collect()}))(watch.last_good(spark, out))
    assert look() == 0 and now() == ({"a.ts", "b.ts"}, {("a.ts", "b.ts")})
    assert look() is None
    (root / "c.ts").write_text("import { b } from './b'\n")
    (root / "a.ts").write_text("import './c' // changed\n")
    assert look() == 1 and now() == ({"a.ts", "b.ts", "c.ts"}, {("a.ts", "c.ts"), ("c.ts", "b.ts")})
    (root / "b.ts").unlink()
    (root / "node_modules/x/j.ts").write_text("")
    assert look() == 2 and now() == ({"a.ts", "c.ts"}, {("a.ts", "c.ts")})
    assert look() is None
    steps = lambda: {r["version"]: tuple(r)[1:] for r in watch.version_steps(spark.read.parquet(out + "/versions")).collect()}
    assert steps() == {0: (2, None, 0, None), 1: (3, 1, 0, 0), 2: (2, -1, 0, 0)}
    (root / "d.ts").write_text("")
    stream = watch.watch_tree(spark, str(root), out, build, out + "/ticks", interval="1 second")
    try:
        for _ in range(60):
            if watch.last_good(spark, out)[2] == 3:
                break
            time.sleep(1)
    finally:
        stream.stop()
    assert now()[0] == {"a.ts", "c.ts", "d.ts"}
    (root / "d.ts").write_text("import './c'\n")  # renamed, and a second caller
    (root / "d.ts").rename(root / "e.ts")
    assert look() == 4 and now() == ({"a.ts", "c.ts", "e.ts"}, {("a.ts", "c.ts"), ("e.ts", "c.ts")})
    assert steps()[4] == (3, 0, 1, None) and steps()[3][2] is None  # the stream did not measure
    assert {n.name for n in (tmp_path / "out/nodes").iterdir() if n.is_dir()} == {f"version={k}" for k in (2, 3, 4)}
    assert {n.name for n in (tmp_path / "out/looks").iterdir() if n.is_dir()} == {f"version={k}" for k in (2, 3, 4)}


def test_any_frame_from_few_spans(spark):
    rng = random.Random(6)
    held, rows = {}, []
    for frame in range(21):
        if frame not in (7, 8):  # nothing happens
            for key in rng.sample("abcdefghij", 3):
                held[key] = rng.randrange(3)
            for key in rng.sample(sorted(held), min(2, len(held) - 1)):
                del held[key]
        rows.append(dict(held))
    table = spark.createDataFrame([(10 * f, k, v) for f, held in enumerate(rows) for k, v in held.items()], "ord long, id string, n int")
    log = materialise(history.skip_log(history.deltas(table, ["id"], ["n"]), table, ["id"], ["n"]))
    for frame in range(21):
        way = history.spans_to(frame)
        assert len(way) == bin(frame).count("1") and [i << j for j, i in way] + [frame] == [0, *((i + 1) << j for j, i in way)]
        assert {r["id"]: r["n"] for r in history.frame_at(log, frame, ["id"]).collect()} == rows[frame]
    assert log.groupBy("level", "span", "id").count().filter("count > 1").isEmpty()


def test_watch_scans_changed_files_only(spark, tmp_path):
    root, out = tmp_path / "tree", str(tmp_path / "out")
    root.mkdir()
    seen = []

    class Counted(Staged):
        def scan(self, rows):
            seen.append(sorted(r["path"] for r in rows.collect()))
            return super().scan(rows)

    build = Counted()

    def look():
        version = watch.tree_step(spark, str(root), out, build)
        g = build_graph(files.source_files(spark, files.pruned_folders(str(root)), str(root)))
        rows = lambda df: sorted(map(tuple, df.collect()))
        nodes, edges, good = watch.last_good(spark, out)
        assert good == version and rows(nodes.select(g.nodes.columns)) == rows(g.nodes) and rows(edges.select(g.edges.columns)) == rows(g.edges)

    (root / "a.ts").write_text("import './b'\nfetch('/x')\nuseQuery({ queryKey: ['k', 1] })\n")
    (root / "useC.ts").write_text("import './a'\nfetch('/x')\n")
    look()
    (root / "b.ts").write_text("export const b = 1\n")  # an import that led nowhere finds it
    look()
    (root / "a.ts").write_text("\nimport './b'\nfetch('/y', { method: 'post' })\n")
    look()
    (root / "useC.ts").rename(root / "useD.ts")
    (root / "b.ts").unlink()
    look()
    assert seen == [["a.ts", "useC.ts"], ["b.ts"], ["a.ts"], ["useD.ts"]]


def repository(path, states):
    """A repository with a commit for each state (name to text)."""
    git = lambda *a: subprocess.run(["git", "-C", str(path), "-c", "user.name=n", "-c", "user.email=e@example.org", *a], check=True, capture_output=True)
    path.mkdir()
    git("init", "-q")
    for k, (subject, state) in enumerate(states):
        for old in path.glob("*.ts*"):
            old.unlink()
        for name, text in state.items():
            (path / name).write_text(text)
        (path / "count.txt").write_text(str(k))
        git("add", "-A", ".")
        git("commit", "-q", "-m", subject)
    return str(path)


def test_live_counts_equal_a_rebuild_after_every_batch(spark, tmp_path, monkeypatch):
    """Edits, deletions, nodes that come back, targets that come later, rows out of order and sent twice, null ids, null
    and repeated links, and steps merged in between."""
    monkeypatch.setattr(live, "MERGED", 2)
    rnd, names, told, late = random.Random(4), [f"n{i}" for i in range(10)], {}, []
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    before = (0, 0, 0)
    for version in range(3):
        rows = [{"id": i, "version": version, "silent": i != "n0", "links": None if rnd.random() < 0.25 else [*rnd.choices(names, k=3), None]} for i in rnd.sample(names, 6)]
        told.update({r["id"]: r for r in rows})
        text = "\n".join(map(json.dumps, [*rows, *late, rows[-1], {"id": None, "version": version, "links": ["n1"]}, {"id": "n1", "version": None, "links": ["n2"]}]))
        (tmp_path / f"in/{version}.json").write_text(text)
        late = rows
        changes = spark.readStream.schema("id string, version long, silent boolean, links array<string>").json(str(tmp_path / "in"))
        live.watch_links(changes, out, out + "/checkpoint", None, 2).awaitTermination()
        there = {i: {x for x in r["links"] if x} for i, r in told.items() if r["links"] is not None}
        callers = {i: sum(i in links for links in there.values()) for i in there}
        want = {i: (n, n == 0 and i != "n0", n > 1) for i, n in callers.items()}
        assert {r["id"]: tuple(r)[1:] for r in live.present(spark, out).collect()} == want
        now = (len(want), sum(w[1] for w in want.values()), sum(w[2] for w in want.values()))
        row = spark.read.parquet(out + "/versions").filter(F.col("version") == version).drop("batch").first()
        assert tuple(row) == (version, *(x for a, b in zip(now, before) for x in (a, a - b)))
        before = now
    assert spark.conf.get(live.PARTITIONS) == "4"


def test_replay_and_blame_of_a_repository(spark, tmp_path, capsys):
    base = {"a.ts": "import './b'\n", "useStore.ts": "export const s = 1\n", "x.d.ts": "export {}\n"}
    states = [
        ("b is empty", base | {"b.ts": ""}),
        ("b imports\u2028a", base | {"b.ts": "import './a'\n"}),
        ("c uses the store", base | {"b.ts": "import './a'\n", "c.ts": "import './useStore'\n"}),
        ("d, too", base | {"b.ts": "import './a'\n", "c.ts": "import './useStore'\n", "d.ts": "import './useStore'\n"}),
    ]
    root = repository(tmp_path / "r", states)
    assert [r["subject"] for r in files.list_commits(spark, root).orderBy("ord").collect()] == [s for s, _ in states]
    args = cli.argparse.Namespace(src=root, since="1 year ago", max_frames=40, command="replay", out=str(tmp_path / "t.jsonl"))
    config = [rules.Rule("unique-caller", "one"), rules.Rule("no-direct-import", "no hooks", rules.Match(target_type="hook")), rules.Rule("no-cycles", "loop")]
    assert cli._history(spark, args) == 0
    rows = [json.loads(line) for line in open(args.out)]
    assert [(r["cycles"], r["violations"], r["nodes"], r["subject"]) for r in rows] == [(0, 0, 3, states[0][0]), (1, 0, 3, states[1][0]), (1, 0, 4, states[2][0]), (1, 1, 5, states[3][0])]
    assert cli._history(spark, args, config) == 0
    assert [json.loads(line)["violations"] for line in open(args.out)] == [0, 1, 2, 4]
    held = replay.read(spark, args.out + ".replay")
    for frame, (_, state) in enumerate(states):
        g = held.at(frame)
        assert ids(g.nodes) == {n for n in state if not n.endswith(".d.ts")} and g.meta["nodeCount"] == str(g.nodes.count()) and g.edges.count() == int(g.meta["edgeCount"])
    assert held.at(4) is None and held.at(-1) is None and held.span()[0] <= held.span()[1]
    args.command = "blame"
    assert cli._history(spark, args) == 0
    assert "cycle a.ts 2" in capsys.readouterr().out
    assert cli._history(spark, args, config) == 0
    since = {tuple(line.split(" 20")[0].split()[:-2]): line for line in capsys.readouterr().out.strip().split("\n")}
    assert [states[k][0] in line for line, k in zip(sorted(since.values()), (1, 2, 3, 3), strict=True)] == [True] * 4
    assert [line.split()[0] for line in sorted(since.values())] == ["cycle", "no-direct-import", "no-direct-import", "unique-caller"]


def test_each_content_is_read_once(spark, tmp_path):
    states = [(f"change {k}", {"a.ts": "import './b'\n", "b.ts": f"export const b = {k // 4}\n", "same.ts": f"export const b = {k // 4}\n"}) for k in range(12)]
    root = repository(tmp_path / "r", states)
    frames = Frames(files.list_commits(spark, root), root)
    nodes, edges = frames.graphs(list(range(12)))
    assert frames.reads == 4  # a.ts, and three contents that two names share
    assert nodes.count() == 36 and edges.count() == 12
    frames.graphs([3, 5])
    assert frames.reads == 4
    assert Frames(files.list_commits(spark, root), root, (*files.EXCLUDED, "same")).graphs([0])[0].count() == 2


def test_replay_files(spark, tmp_path):
    node = lambda i, line=1: {"id": i, "label": i, "type": "module", "file": i, "line": line, "cluster": "src"}
    edge = lambda a, b: {"id": f"{a}->{b}", "source": a, "target": b, "type": "import"}
    about = {"sha": "0" * 8, "date": "2024-01-01", "subject": "s", "author": "n", "violations": 0, "cycles": 0, "added": [], "removed": []}
    first = {**about, "nodeCount": 2, "edgeCount": 1, "graph": {"nodes": [node("a"), node("b")], "edges": [edge("a", "b")]}}
    none = {"addedNodes": [], "changedNodes": [], "removedNodes": [], "addedEdges": [], "changedEdges": [], "removedEdges": []}
    second = {**about, "nodeCount": 2, "edgeCount": 0, "delta": none | {"addedNodes": [node("c")], "changedNodes": [node("a", 7)], "removedNodes": ["b"], "removedEdges": ["a->b"]}}
    third = {**about, "date": "2024-02-01", "nodeCount": 2, "edgeCount": 1, "delta": none | {"addedEdges": [edge("c", "a")]}}
    (tmp_path / "new.json").write_text(json.dumps({"meta": {"project": "p"}, "frames": [first, second, third]}))
    held = replay.read_file(spark, str(tmp_path / "new.json"))
    lines = lambda g: {r["id"]: r["line"] for r in g.nodes.collect()}
    assert [lines(held.at(k)) for k in range(3)] == [{"a": 1, "b": 1}, {"a": 7, "c": 1}, {"a": 7, "c": 1}]
    assert [{(r["src"], r["dst"]) for r in held.at(k).edges.collect()} for k in range(3)] == [{("a", "b")}, set(), {("c", "a")}]
    held = replay.Replay(*map(materialise, (held.frames, held.nodes, held.edges)))
    view = replay.View(make(spark, "p>q")).enter(held)
    marks = lambda v: {r["id"]: r["state"] for r in v.marks().collect()}
    assert view.frame == 0 and view.show(3) is view and view.leave().show(1).frame is None
    assert marks(view.show(1)) == {"a": "rest", "c": "added", "b": "removed"} and marks(view.enter(held).leave()) == {"p": "rest", "q": "rest"}
    assert held.at(3) is None and held.span() == ("2024-01-01", "2024-02-01") and held.at(2).meta["nodeCount"] == "2"
    old = {**about, "nodeCount": 1, "edgeCount": 0, "graph": {"nodes": [node("b", 3)], "edges": []}}
    (tmp_path / "old.json").write_text(json.dumps({"frames": [first, old]}))
    held = replay.read_file(spark, str(tmp_path / "old.json"))
    assert [lines(held.at(k)) for k in range(2)] == [{"a": 1, "b": 1}, {"b": 3}]
    (tmp_path / "none.json").write_text(json.dumps({"frames": [{**about, "nodeCount": 0, "edgeCount": 0}]}))
    assert replay.read_file(spark, str(tmp_path / "none.json")).at(0) is None
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError, match="holds no replay"):
        replay.read_file(spark, str(tmp_path / "bad.json"))


def test_compiler_options_with_comments_and_bases(tmp_path):
    (tmp_path / "node_modules/shared").mkdir(parents=True)
    (tmp_path / "node_modules/shared/tsconfig.json").write_text('{"compilerOptions": {"paths": {"~lib/*": ["./lib/*"]}}}')
    (tmp_path / "base.json").write_text('{\n  // where sources lie\n  "compilerOptions": {"baseUrl": "./src", /* not "//" */ "paths": {"@/*": ["./*"], "url": ["http://x//y"],},},\n}')
    (tmp_path / "app").mkdir()
    place = tmp_path / "app/tsconfig.json"
    place.write_text('{"extends": "../base", "compilerOptions": {"strict": true}, }')
    assert files.path_aliases(str(tmp_path / "app")) == {"@/": "../src/", "url": "../src/http:/x/y"}
    place.write_text('{"extends": ["../base.json", "shared"]}')
    assert files.path_aliases(str(tmp_path / "app"))["~lib/"] == "../src/lib/"
    place.write_text('{"extends": "./tsconfig.json", "compilerOptions": {"paths": {"#/*": ["./own/*"]}}}')
    assert files.path_aliases(str(tmp_path / "app")) == {"#/": "own/"}
    place.write_text('{"compilerOptions": ')
    with pytest.warns(UserWarning, match="is not read"):
        assert files.path_aliases(str(tmp_path / "app")) == {}


def test_violations_as_rows(spark):
    g = make(spark, "a>t b>t c>t a>b b>a", kind=lambda i: "store" if i == "t" else "module")
    config = [rules.Rule("unique-caller", "one"), rules.Rule("no-direct-import", "no", rules.Match(target_type="store")), rules.Rule("no-cycles", "loop")]
    out = {(r["place"], r["subject"], r["size"]) for r in rules.violations(g, config).collect()}
    assert out == {(0, "t", 3), (1, "a → t", 2), (1, "b → t", 2), (1, "c → t", 2), (2, "a", 2)}
    assert len(out) == rules.evaluate(g, config).count()
    who = {(r["place"], r["subject"], r["role"], r["id"]) for r in rules.parties(g, config).collect()}
    assert {w[2:] for w in who if w[0] == 0} == {("target", "t"), ("caller", "a"), ("caller", "b"), ("caller", "c")}
    assert {w[2:] for w in who if w[:2] == (1, "b → t")} == {("source", "b"), ("target", "t")} and {w[3] for w in who if w[0] == 2} == {"a", "b"}


def test_diagram_ids_of_names_that_clash(spark):
    g = make(spark, "a-b>a_b a_b__1>a.b", cluster=lambda i: "x-y" if i == "a-b" else "x_y")
    safe = [r["safe"] for r in diagrams.safe_ids(g.nodes).collect()]
    assert len(set(safe)) == 4
    lines = [r["line"] for r in diagrams.mermaid(g).collect()]
    assert len({x for x in lines if "subgraph" in x}) == 2 and len({x.split("[")[0] for x in lines if "subgraph" in x}) == 2


def test_scalar_functions(spark):
    row = spark.range(1).select(
        fx.normalise_endpoint(F.lit("`/u/${a}/b`")).alias("e"), fx.first_export_line(F.lit("a\nb\nexport c")).alias("l"), fx.share_piece(F.lit("a b/c")).alias("s"),
        fx.query_key_label(F.lit("x" * 31)).alias("q"), fx.arrival_slot(F.lit("ab")).alias("h"),
    ).first()
    assert (row["e"], row["l"], row["s"], row["q"]) == ("/u/:param/b", 3, "a%20b%2Fc", "x" * 27 + "…")
    assert row["h"] == (97 * 31 + 98) % 24


def test_opening_stands_on_the_weightiest_cycle(spark):
    g = make(spark, "a>b b>c c>a a>x x>a p>q q>p lone>p")
    assert [tuple(r) for r in lens.opening(g, 40).collect()] == [("a", "a")]
    assert lens.opening(make(spark, "a>b b>c"), 40).collect() == []


def test_states_and_messages(spark):
    g = make(spark, "a>t b>t t>z", ["lone"])
    found = rules.unique_caller(g, rules.Rule("unique-caller", "one"))
    assert {r["id"]: r["messages"] for r in lens.messages(found).collect()} == {i: ["one (t: 2 callers)"] for i in "abt"}
    got = lens.states(g, {"violated": lens.messages(found), "lit": relational.lit_set(g, "z"), "impact": traverse.impact(g, "t")})
    assert {r["id"]: r["state"] for r in got.collect()} == {"a": "impact", "b": "impact", "t": "impact", "z": "lit", "lone": "rest"}
    with pytest.raises(ValueError):
        lens.states(g, {"unheard": g.nodes})
    assert lens.impact_status(g, traverse.impact(g, "t")).first()[0] == "2 of 5 nodes depend on it"
    assert lens.path_status(g, traverse.shortest_path(g, "a", "z")).first()[0] == "shortest way: a - t - z"
    assert lens.path_status(g, traverse.shortest_path(g, "a", "lone")).first()[0] is None
    assert tuple(lens.screen(g, relational.lit_set(g, "z")).first()) == (2, 1)


def test_views_and_places(spark):
    views = [("src/a b+c.ts", None, "impact"), ("é", "y&=z", "path"), (None, None, "none"), ("n", "", "replay")]
    rows = spark.createDataFrame(views, "node string, to string, lens string").withColumn("h", fx.view_hash(F.col("node"), F.col("to"), F.col("lens")))
    got = [(r["h"], tuple(r["v"])) for r in rows.withColumn("v", fx.view_parts(F.col("h"))).collect()]
    assert [v for _, v in got] == [("src/a b+c.ts", None, "impact"), ("é", "y&=z", "path"), (None, None, None), ("n", None, None)]
    assert got[2][0] == "" and got[0][0] == "#node=src%2Fa%20b%2Bc.ts&lens=impact"
    places = [("a.ts", "/r/", "/r/a.ts"), ("/x/a.ts", None, "/x/a.ts"), ("C:\\a.ts", "/r", "C:\\a.ts"), ("a.ts", None, None), (None, "/r", None), ("", "/r", None)]
    rows = spark.createDataFrame(places, "f string, r string, want string").withColumn("got", fx.locate(F.col("f"), F.col("r"))).collect()
    assert [r["got"] for r in rows] == [p[2] for p in places]


def test_the_median_is_the_upper_one(spark):
    for values, want in (([1.0, 2.0, 3.0, 9.0], 3.0), ([5.0, 1.0, 2.0], 2.0), ([7.0], 7.0)):
        assert spark.createDataFrame([(v,) for v in values], "v double").agg(naming.upper_median(F.col("v"))).first()[0] == want
    empty = spark.createDataFrame([], "x double, y double, z double")
    assert naming.reach(empty).first()["spread"] == 60.0
    far = spark.createDataFrame([(float(x), 0.0, 0.0) for x in (0, 0, 0, 1000)], "x double, y double, z double")
    assert naming.reach(far).first()["spread"] == 625.0


def test_degrees_of_opposite_edges_loops_and_missing_ends(spark):
    g = make(spark, [("a", "b"), ("a", "b"), ("b", "a"), ("c", "c"), ("c", "a"), ("d", ""), ("", "d")], nodes=["a", "b", "c", "d", "e"])
    some = lambda c: F.nullif(c, F.lit("")).alias(c)
    g = PropertyGraph(g.nodes.filter("id <> ''"), g.edges.select("id", some("src"), some("dst"), "type"), g.meta, 3)
    want = {"a": (2, 2, 2), "b": (1, 2, 1), "c": (2, 1, 1), "d": (1, 1, 0), "e": (0, 0, 0)}
    for graph in (g, PropertyGraph(g.nodes, g.edges)):
        assert {r["id"]: (r["imports"], r["used_by"], r["neighbours"]) for r in relational.degrees(graph).collect()} == want


def exchanges(df):
    """Lines of the plan that deal rows out, before it adapts itself."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [line for line in plan.splitlines() if "Exchange" in line]


@pytest.mark.parametrize("name", ["degree", "traffic"])
def test_lines_are_dealt_in_bounded_parts_before_they_are_grouped(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "PART", 400, raising=False)
    folder = "/root/testdata/sf0.001"
    parts = -(-tables.table(spark, folder, "lineitem").count() // 400)
    dealt = [x for x in exchanges(queries.QUERIES[name](spark, folder)) if "REPARTITION_BY_NUM" in x and f", {parts})" in x]
    assert len([x for x in dealt if "l_orderkey" in x]) == 2 and any("o_orderkey" in x for x in dealt)
    assert name == "traffic" or any("hashpartitioning(a#" in x for x in dealt)


def test_hops_and_pairs_of_suppliers_are_dealt_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 400, raising=False)
    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()))
    pairs = Counter((a[3], b[3]) for a, b in zip(want, want[1:], strict=False) if a[0] == b[0] and a[3] != b[3])
    first = {}
    for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0][1])):
        first.setdefault(a, b)
    months = queries._months(spark, folder)
    parts = -(-len(want) // 400)
    dealt = [x for x in exchanges(months) if "REPARTITION_BY_NUM" in x and f", {parts})" in x]
    assert any("l_orderkey" in x for x in dealt) and any("hashpartitioning(s#" in x for x in dealt)
    assert {(r["src"], r["dst"]) for r in months.select("src", "dst").distinct().collect()} == {(f"supplier/{a}", f"supplier/{b}") for a, b in first.items()}


def test_links_of_a_large_component_do_not_meet_in_one_task(spark):
    rings = {"a": 300, "b": 4, "c": 5, "d": 60}
    links = materialise(spark.createDataFrame([(f"{r}{k:03}", f"{r}{(k + 1) % n:03}") for r, n in rings.items() for k in range(n)], "src string, dst string"))
    for limit, small in ((50, "bc"), (80, "bcd"), (0, "")):
        done, rest = bounded.settle(links, scc._members, "id string, scc string", limit)
        assert Counter(r["scc"] for r in done.collect()) == {f"{r}000": rings[r] for r in small}
        assert Counter(r["component"] for r in rest.collect()) == {f"{r}000": n for r, n in rings.items() if r not in small}
        assert rest.columns == ["src", "dst", "component"] and not any("component" in x for x in exchanges(rest))


def test_folder_rollup_merges_nodes_and_counts_a_hub_before_it_is_looked_up(spark):
    links = [(f"x{k}", "hub") for k in range(50)] + [(f"y{k}", "hub") for k in range(30)] + [("hub", "x1"), ("x1", "x2"), ("x3", "none")]
    g = make(spark, links, cluster=lambda i: i[0])
    g = PropertyGraph(g.nodes.filter("id <> 'none'"), g.edges)
    found = relational.folder_rollup(g)
    assert sorted(map(tuple, found.collect())) == [("h", "x", 1), ("x", "h", 50), ("y", "h", 30)]
    assert not any("Broadcast" in x for x in exchanges(found))
    assert any("hashpartitioning(src_cluster" in x and "dst#" in x for x in exchanges(found))


def test_link_radii_follow_the_merged_roll_up(spark):
    found = queries.QUERIES["link_radius"](spark, "/root/testdata/sf0.001")
    weights = {(r["src_cluster"], r["dst_cluster"]): r["weight"] for r in relational.folder_rollup(queries.G1(spark, "/root/testdata/sf0.001")).collect()}
    assert not any("Broadcast" in x for x in exchanges(found))
    assert {(r["src_cluster"], r["dst_cluster"]): r["radius"] for r in found.collect()} == {k: pytest.approx(min(0.12 + 0.14 * np.log2(w + 1), 0.85)) for k, w in weights.items()}
