"""Architecture rules as data, and their violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.scc import strongly_connected
from weftgraph.schema import EDGE_TYPES, NODE_TYPES, PropertyGraph

# fixed values
RULE_TYPES = ("unique-caller", "no-direct-import", "no-cycles")
VIOLATIONS = "rule string, message string, node_ids array<string>, edge_ids array<string>"


@dataclass(frozen=True)
class Match:
    """What an edge must be; None matches all."""

    edge_type: str | None = None
    source_type: str | None = None
    target_type: str | None = None


@dataclass(frozen=True)
class Rule:
    type: str
    message: str
    match: Match = Match()


def matching(graph: PropertyGraph, match: Match) -> DataFrame:
    """(id, src, dst, type, src_label, dst_label) of the matching edges."""
    edges = graph.edges.select("id", "src", "dst", "type")
    if match.edge_type:
        edges = edges.filter(F.col("type") == match.edge_type)
    ends = graph.nodes.select("id", "label", F.col("type").alias("kind"))
    edges = edges.join(ends.select(F.col("id").alias("src"), F.col("label").alias("src_label"), F.col("kind").alias("src_kind")), "src", "left")
    edges = edges.join(ends.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"), F.col("kind").alias("dst_kind")), "dst", "left")
    if match.source_type:
        edges = edges.filter(F.col("src_kind") == match.source_type)
    if match.target_type:
        edges = edges.filter(F.col("dst_kind") == match.target_type)
    return edges


def unique_caller(graph: PropertyGraph, rule: Rule) -> DataFrame:
    """Targets of more than one matching edge."""
    found = matching(graph, rule.match).groupBy("dst", F.coalesce("dst_label", "dst").alias("label"))
    found = found.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("src", "id"))).alias("callers")).filter("n > 1")
    return found.select(
        F.lit(rule.type).alias("rule"),
        F.concat(F.lit(rule.message), F.lit(" ("), "label", F.lit(": "), F.col("n").cast("string"), F.lit(" callers)")).alias("message"),
        F.concat(F.array("dst"), F.col("callers.src")).alias("node_ids"),
        F.col("callers.id").alias("edge_ids"),
    )


def no_direct_import(graph: PropertyGraph, rule: Rule) -> DataFrame:
    """Every matching edge."""
    text = F.concat(F.lit(rule.message), F.lit(" ("), F.coalesce("src_label", "src"), F.lit(" → "), F.coalesce("dst_label", "dst"), F.lit(")"))
    return matching(graph, rule.match).select(F.lit(rule.type).alias("rule"), text.alias("message"), F.array("src", "dst").alias("node_ids"), F.array("id").alias("edge_ids"))


def no_cycles(graph: PropertyGraph, rule: Rule) -> DataFrame:
    """Every component of two nodes or more: its members in order of id, and the edges
    among consecutive members that exist."""
    members = strongly_connected(graph.edges)
    named = members.join(graph.nodes.select("id", "label"), "id", "left").select("scc", "id", F.coalesce("label", "id").alias("label"))
    rings = named.groupBy("scc").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("walk"))
    steps = rings.select("scc", F.posexplode(F.arrays_zip(F.col("walk.id").alias("a"), F.concat(F.slice(F.col("walk.id"), 2, 1 << 30), F.slice(F.col("walk.id"), 1, 1)).alias("b"))).alias("i", "s"))
    steps = steps.select("scc", "i", F.col("s.a").alias("src"), F.col("s.b").alias("dst"))
    closing = steps.join(graph.edges.groupBy("src", "dst").agg(F.min("id").alias("edge")), ["src", "dst"]).groupBy("scc").agg(F.array_sort(F.collect_list(F.struct("i", "edge"))).alias("edges"))
    text = F.concat(F.lit(rule.message), F.lit(" ("), F.array_join(F.col("walk.label"), " → "), F.lit(" → "), F.col("walk.label")[0], F.lit(")"))
    return rings.join(closing, "scc", "left").select(
        F.lit(rule.type).alias("rule"), text.alias("message"), F.col("walk.id").alias("node_ids"), F.coalesce(F.col("edges.edge"), F.array().cast("array<string>")).alias("edge_ids")
    )


_KINDS = {"unique-caller": unique_caller, "no-direct-import": no_direct_import, "no-cycles": no_cycles}


def evaluate(graph: PropertyGraph, rules: list[Rule]) -> DataFrame:
    """Violations of all rules (rule, message, node_ids, edge_ids)."""
    out = graph.nodes.sparkSession.createDataFrame([], VIOLATIONS)
    for rule in rules:
        out = out.unionByName(_KINDS[rule.type](graph, rule))
    return out


def violations(graph: PropertyGraph, rules: list[Rule], members: DataFrame | None = None) -> DataFrame:
    """(place, rule, subject, size): a row each, in which nothing is gathered.  ``place``: the rule's place in the
    list; ``subject``: the shared target, the edge's ends, or the least id of a cycle; ``size``: edges to the target, 2, or members.
    ``members`` (id, scc): the components, if known."""
    out = graph.nodes.sparkSession.createDataFrame([], "place int, rule string, subject string, size long")
    for place, rule in enumerate(rules):
        named = (F.lit(place).alias("place"), F.lit(rule.type).alias("rule"))
        if rule.type == "no-cycles":
            members = strongly_connected(graph.edges) if members is None else members
            found = members.groupBy(F.col("scc").alias("subject")).agg(F.count(F.lit(1)).alias("size"))
        else:
            edges = matching(graph, rule.match).select("src", "dst")
            if rule.type == "unique-caller":
                found = edges.groupBy(F.col("dst").alias("subject")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
            else:
                found = edges.distinct().select(F.concat("src", F.lit(" → "), "dst").alias("subject"), F.lit(2).cast("long").alias("size"))
        out = out.unionByName(found.select(*named, "subject", "size"))
    return out


def parties(graph: PropertyGraph, rules: list[Rule], members: DataFrame | None = None) -> DataFrame:
    """(place, subject, role, id): who takes part in each of the ``violations``, a row each: the ``target`` and every
    ``caller``, the ``source`` and ``target`` of an edge, every ``member`` of a cycle."""
    out = graph.nodes.sparkSession.createDataFrame([], "place int, subject string, role string, id string")
    for place, rule in enumerate(rules):
        row = lambda df, subject, role, c: df.select(F.lit(place).alias("place"), subject.alias("subject"), F.lit(role).alias("role"), F.col(c).alias("id")).distinct()  # noqa: B023, E731
        if rule.type == "no-cycles":
            members = strongly_connected(graph.edges) if members is None else members
            out = out.unionByName(row(members, F.col("scc"), "member", "id"))
            continue
        edges, subject, source = matching(graph, rule.match).select("src", "dst"), F.concat("src", F.lit(" → "), "dst"), "source"
        if rule.type == "unique-caller":
            shared = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("dst")
            edges, subject, source = edges.join(shared, "dst", "left_semi"), F.col("dst"), "caller"
        out = out.unionByName(row(edges, subject, source, "src")).unionByName(row(edges, subject, "target", "dst"))
    return out


def parse_rule(value: dict) -> Rule:
    match = value.get("match") or {}
    return Rule(value["type"], value["message"], Match(match.get("edgeType"), match.get("sourceType"), match.get("targetType")))


def problems(config: object) -> list[str]:
    """Everything wrong with a configuration, with places."""
    if not isinstance(config, dict):
        return ["the configuration must be an object"]
    found = [f"{key}: unknown key" for key in config if key not in ("rules", "exclude")]
    exclude = config.get("exclude", [])
    if not isinstance(exclude, list) or any(not isinstance(x, str) for x in exclude):
        found.append("exclude: must be a list of strings")
    rules = config.get("rules", [])
    if not isinstance(rules, list):
        return [*found, "rules: must be a list"]
    enums = {"edgeType": EDGE_TYPES, "sourceType": NODE_TYPES, "targetType": NODE_TYPES}
    for i, rule in enumerate(rules):
        at = f"rules[{i}]"
        if not isinstance(rule, dict):
            found.append(f"{at}: must be an object")
            continue
        found += [f"{at}.{key}: unknown key" for key in rule if key not in ("type", "match", "message")]
        if rule.get("type") not in RULE_TYPES:
            found.append(f"{at}.type: must be one of {', '.join(RULE_TYPES)}")
        if not isinstance(rule.get("message"), str) or not rule["message"].strip():
            found.append(f"{at}.message: must be text")
        match = rule.get("match")
        if match is None:
            continue
        if not isinstance(match, dict):
            found.append(f"{at}.match: must be an object")
            continue
        for key, value in match.items():
            if key not in enums:
                found.append(f"{at}.match.{key}: unknown key")
            elif value not in enums[key]:
                found.append(f"{at}.match.{key}: must be one of {', '.join(enums[key])}")
    return found
