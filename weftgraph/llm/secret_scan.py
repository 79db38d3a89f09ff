"""Secret scans through a trigram inverted index, with DataFrame functions only.

Method.  Each rule's regular expression is parsed (on the driver, a few short
patterns) into a Boolean query over lower-case trigrams that every match must
contain.  The index holds postings (trigram, doc_id) of the lower-cased texts.
Postings of one document are intersected as a bitmap, on which each rule's
query is evaluated; documents that satisfy it are candidates of that rule and
are verified with the rule's regular expression.  Rules without a mandatory
trigram scan every text.

Spans are code point offsets, end exclusive: the pieces between matches and the
matches themselves give every position by a running sum.  Sums and cuts run in
chunks, as appending to an array copies it, so that the work on a text of many
matches stays close to its size.

Letters "in either case" are ASCII letters in either case: no other character
folds to one of them (the long s and the Kelvin sign do not).

Defined results: null text counts as empty; texts of any length are scanned
whole; rows repeating a doc_id are each scanned (their trigrams are pooled,
which only adds candidates); an empty table gives an empty result; extra
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover - before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (leftmost, non-overlapping) whose
    ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# fixed values: the three base rules come first, their order is the order of kinds
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
BASE_KINDS = ("assign", "access", "hex")

# -- Boolean trigram queries -------------------------------------------------
Query = tuple  # ("all",) | ("has", trigram) | ("and", *queries) | ("or", *queries)
ALL: Query = ("all",)
_MOST_STRINGS = 24


def _conjunction(*parts: Query) -> Query:
    flat = {q for p in parts for q in (p[1:] if p[0] == "and" else (p,)) if q != ALL}
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", *sorted(flat, key=repr))


def _disjunction(*parts: Query) -> Query:
    if ALL in parts or not parts:
        return ALL
    flat = {q for p in parts for q in (p[1:] if p[0] == "or" else (p,))}
    needs = {q: frozenset(q[1:]) if q[0] == "and" else frozenset({q}) for q in flat if q[0] != "or"}
    flat = {q for q in flat if not any(needs[o] < needs[q] for o in needs if q in needs)}  # absorbed by a weaker one
    return next(iter(flat)) if len(flat) == 1 else ("or", *sorted(flat, key=repr))


def _of_strings(strings: set[str]) -> Query:
    return _disjunction(*(_conjunction(*(("has", s[i : i + 3]) for i in range(len(s) - 2))) for s in strings))


def _analyse(items) -> tuple[set[str] | None, Query]:
    """(all strings the items can match, if few; query every match satisfies)."""
    exact: set[str] | None = {""}
    query: Query = ALL
    for op, arg in items:
        own, q = _single(op, arg)
        if own is None or exact is None or len(own) * len(exact) > _MOST_STRINGS:
            query = _conjunction(query, q, _of_strings(exact) if exact is not None else ALL, _of_strings(own) if own is not None else ALL)
            exact = own
        else:
            exact = {a + b for a in exact for b in own}
            query = _conjunction(query, q)
    return exact, query


def _single(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 4:
            return {chr(a).lower() for _, a in arg}, ALL
        return None, ALL
    if op is sre.SUBPATTERN:
        exact, q = _analyse(arg[-1])
        return exact, q
    if op is sre.BRANCH:
        parts = [_analyse(branch) for branch in arg[1]]
        if all(e is not None for e, _ in parts):
            exact = set().union(*(e for e, _ in parts))
            if len(exact) <= _MOST_STRINGS:
                return exact, ALL
        return None, _disjunction(*(_conjunction(q, _of_strings(e) if e is not None else ALL) for e, q in parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, q = _analyse(inner)
        if low == 0:
            return ({""} | exact, ALL) if high == 1 and exact is not None else (None, ALL)
        if low == high == 1:
            return exact, q
        return None, _conjunction(q, _of_strings(exact) if exact is not None else ALL)
    if op is sre.AT:
        return {""}, ALL
    return None, ALL


def trigram_query(pattern: str) -> Query:
    """Boolean query over lower-case trigrams that every match of the pattern satisfies."""
    exact, query = _analyse(sre_parse.parse(pattern))
    return _conjunction(query, _of_strings(exact) if exact is not None else ALL)


def query_trigrams(query: Query) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*map(query_trigrams, query[1:])) if query != ALL else set()


# -- the index ------------------------------------------------------------------
def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram: its place in ``trigrams``, doc_id) of every listed trigram in every text."""
    low = docs.select("doc_id", F.lower(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(candidate_id, candidate_of: array of kinds) from the intersected postings."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALL}
    trigrams = sorted(set().union(*map(query_trigrams, queries.values())))
    words = range(-(-len(trigrams) // 62))
    bits = [
        F.coalesce(F.bit_or(F.when((F.col("trigram") >= 62 * w) & (F.col("trigram") < 62 * w + 62), F.expr(f"shiftleft(1L, trigram - {62 * w})"))), F.lit(0)).cast("long").alias(f"bits{w}")
        for w in words
    ]

    def holds(query: Query) -> Column:
        if query[0] == "has":
            i = trigrams.index(query[1])
            return F.col(f"bits{i // 62}").bitwiseAND(F.lit(1 << (i % 62))) != 0
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, map(holds, query[1:]))

    found = postings(docs, trigrams).groupBy("doc_id").agg(*bits)
    kinds = F.array_compact(F.array(*(F.when(holds(q), F.lit(kind)) for kind, q in queries.items())))
    return found.select(F.col("doc_id").alias("candidate_id"), kinds.alias("candidate_of")).filter(F.size("candidate_of") > 0)


# -- verification -----------------------------------------------------------------
def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


_SPAN = "array<struct<start:int,kind:int,end:int>>"


_CHUNK = 100


def _in_chunks(n: Column, kind: str, step, advance, prepare=None) -> Column:
    """The array of ``kind`` gathered by ``step(acc, i, ready)`` over i = 0 .. n - 1, whose accumulator is
    (at: int, out: array), and last ``at``: struct(at, out).  ``advance(at, first, last)`` is ``at`` after
    a chunk of steps, so that chunks start on their own; ``prepare(at, first, last)`` is ``ready``,
    computed once a chunk."""
    last_of = lambda c: F.least((c + 1) * _CHUNK, n) - 1
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))
    starts = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(advance(F.element_at(acc, -1), c * _CHUNK, last_of(c)))))

    def gathered(at: Column) -> Column:
        def chunk(c: Column) -> Column:
            first, last, begin = c * _CHUNK, last_of(c), F.get(at, c)
            run = lambda ready: F.aggregate(
                F.sequence(first, last), F.struct(begin.alias("at"), F.array().cast(kind).alias("out")), lambda acc, i: step(acc, i, ready), lambda acc: acc["out"]
            )
            return _bound(prepare(begin, first, last), run) if prepare else run(None)

        return F.struct(F.element_at(at, -1).alias("at"), F.flatten(F.transform(chunks, chunk)).alias("out"))

    return _bound(starts, gathered)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of the rule's matches in one text, in order."""
    pattern = F.lit(java_pattern(rule))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else None
    sizes = lambda a: F.transform(a, F.char_length)
    found = F.struct(
        sizes(F.regexp_extract_all(text, pattern, F.lit(0))).alias("m"),
        sizes(F.split(text, java_pattern(rule), -1)).alias("gap"),
        sizes(counted if counted is not None else F.array().cast("array<string>")).alias("g"),
    )

    def positions(x: Column) -> Column:
        def advance(at: Column, first: Column, last: Column) -> Column:
            total = lambda a: F.aggregate(F.slice(a, first + 1, last - first + 1), F.lit(0), lambda t, size: t + size)
            return at + total(x["gap"]) + total(x["m"])

        def step(acc: Column, i: Column, _) -> Column:
            start = acc["at"] + F.get(x["gap"], i)
            end = start + F.get(x["m"], i)
            one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end")))
            wanted = F.get(x["g" if rule.group else "m"], i) >= rule.least
            return F.struct(end.alias("at"), F.when(wanted, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.when(F.size(x["m"]) > 0, _in_chunks(F.size(x["m"]), _SPAN, step, advance)["out"]).otherwise(F.array().cast(_SPAN))

    return _bound(found, positions)


def java_pattern(rule: Rule) -> str:
    """The hex rule's runs are maximal, so its least length can stand in the pattern; others stay as they are."""
    return f"[0-9a-f]{{{rule.least},}}" if rule.pattern == "[0-9a-f]+" else rule.pattern


def either_case(pattern: str) -> str:
    """A pattern that begins with (?i) in a form for engines whose (?i) folds more than ASCII:
    every letter outside of classes and escapes as a class of its two cases."""
    if not pattern.startswith("(?i)"):
        return pattern
    pieces = re.findall(r"\\x[0-9a-f]{2}|\\.|\[[^\]]*\]|.", pattern[4:])
    return "".join(f"[{p.lower()}{p.upper()}]" if p.isascii() and p.isalpha() else p for p in pieces)


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with column ``secret_spans``: array of (start, kind: place in rules, end), in order."""
    found = candidates(docs.select("doc_id", "text"), rules)
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["candidate_id"]), "left").drop("candidate_id")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    parts = []
    for order, rule in enumerate(rules):
        scanned = trigram_query(rule.pattern) == ALL
        wanted = F.lit(True) if scanned else F.coalesce(F.array_contains("candidate_of", rule.kind), F.lit(False))
        hit = wanted & text.rlike(java_pattern(rule))
        parts.append(F.when(hit, _spans(text, rule, order)).otherwise(F.array().cast(_SPAN)))
    return joined.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop("candidate_of")


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = spans(docs.select("doc_id", "text"), rules).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE_KINDS))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)),
        F.sha2(_joined(base, rules), 256).alias("base_sha256"),
        _joined(F.col("secret_spans"), rules).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark`` (overlapping spans: once)."""
    whole = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))  # other columns may bear any name
    found = spans(whole, rules)
    # pieces of text between spans; ``at`` is the end of what has been written so far
    text = F.col("text").cast("string")

    def advance(at: Column, first: Column, last: Column) -> Column:
        return F.greatest(at, F.array_max(F.transform(F.slice("secret_spans", first + 1, last - first + 1), lambda s: s["end"])))

    def part(at: Column, first: Column, last: Column) -> Column:
        """What a chunk of spans covers: cutting from it costs no search through the whole text."""
        return F.struct(at.alias("base"), F.substr(text, at + 1, advance(at, first, last) - at).alias("part"))

    def step(acc: Column, i: Column, ready: Column) -> Column:
        s = F.get("secret_spans", i)
        gap = F.substr(ready["part"], acc["at"] - ready["base"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        covered = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap))).alias("out"))

    pieces = _in_chunks(F.size("secret_spans"), "array<string>", step, advance, part)
    clean = _bound(pieces, lambda x: F.array_join(F.concat(x["out"], F.array(F.substr(text, x["at"] + 1, F.char_length(text)))), mark))
    clean = F.when(F.size("secret_spans") > 0, clean).otherwise(F.col("text"))
    return found.select(*(clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """The same spans by scanning one text with every rule (for tests)."""
    found = []
    for order, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, m.end()))
    return [(rules[k].kind, a, b) for a, k, b in sorted(found)]
