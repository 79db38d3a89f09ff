"""Column functions over paths and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.operators.relational import base_name

# fixed values
HTTP_CLIENTS = ("axios", "ky")
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head")
SHARED_LENSES = ("impact", "path", "whatif")
QUERY_HOOKS = ("useQuery", "useSuspenseQuery", "useInfiniteQuery", "useMutation", "queryOptions", "infiniteQueryOptions")


def classify(path: Column, text: Column) -> Column:
    """Type of a source file; the first condition that holds decides."""
    base = base_name(path)
    from_zustand = text.rlike(r"""(?m)^\s*import\b[^;'"]*['"]zustand['"]""")
    return (
        F.when(text.rlike(r"createContext\s*[<(]"), "context")
        .when(from_zustand & text.rlike(r"\bcreate\s*[<(]"), "store")
        .when(text.rlike(r"\bconfigureStore\s*\("), "store")
        .when(base.rlike(r"\Ause[A-Z]"), "hook")
        .when(base.rlike(r"Page\z"), "page")
        .when(path.rlike(r"/(pages|routes)/"), "page")
        .when(path.rlike(r"/app/") & base.rlike(r"\A(page|layout)\z"), "page")
        .when(path.endswith(".tsx"), "component")
        .when(text.rlike(r"\b(fetch|axios|ky)\s*[.(]"), "api")
        .when(base.rlike(r"(?i)\A(api|client|http)") | base.rlike(r"(Api|Client)\z"), "api")
        .otherwise("module")
    )


def label_for(path: Column) -> Column:
    """Base name; of ``index`` the folder, of ``page`` and ``layout`` folder and name."""
    pieces, base = F.split(path, "/"), base_name(path)
    folder = F.when(F.size(pieces) > 1, F.element_at(pieces, -2))
    return F.when(base == "index", F.coalesce(folder, base)).when(base.isin("page", "layout") & (F.coalesce(folder, F.lit("")) != ""), F.concat_ws("/", folder, base)).otherwise(base)


def cluster_for(path: Column) -> Column:
    """Piece after the first ``features`` or ``modules`` when two more follow it at least, else
    the first folder, else ``src``."""
    pieces = F.split(path, "/")
    at = F.least(*(F.when(F.array_position(pieces, w) > 0, F.array_position(pieces, w)) for w in ("features", "modules")))
    inner = at.isNotNull() & (F.size(pieces) > at + 1)
    return F.when(inner, F.get(pieces, at.cast("int"))).when(F.size(pieces) > 1, pieces[0]).otherwise("src")


def normalise_endpoint(raw: Column) -> Column:
    """Without one quote on either side; ``${...}`` as ``:param``; trimmed."""
    bare = F.regexp_replace(raw, "\\A[`'\"]|[`'\"]\\z", "")
    return F.trim(F.regexp_replace(bare, r"\$\{[^}]*\}", ":param"))


def first_export_line(text: Column) -> Column:
    """1-based line of the first line that starts with ``export ``, else 1."""
    at = F.regexp_instr(text, F.lit(r"(?m)^export "))
    return F.when(at > 0, F.size(F.split(F.substr(text, F.lit(1), at - 1), "\n"))).otherwise(1)


def query_key_label(key: Column) -> Column:
    return F.when(F.char_length(key) > 30, F.concat(F.substr(key, F.lit(1), F.lit(27)), F.lit("…"))).otherwise(key)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def share_piece(text: Column) -> Column:
    """URL component; spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def arrival_slot(identifier: Column, slots: int = 24) -> Column:
    """Hash of the UTF-16 units with multiplier 31 in 32 bits, modulo the number of slots."""
    units = F.hex(F.encode(identifier, "UTF-16BE"))  # four digits each
    places = F.filter(F.sequence(F.lit(0), (F.char_length(units) / 4).cast("int")), lambda i: i * 4 < F.char_length(units))
    codes = F.transform(places, lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit((1 << 32) - 1)), lambda h: F.pmod(h, F.lit(slots)))


def view_hash(node: Column, to: Column, lens: Column) -> Column:
    """Fragment that names a view; parts that are null or empty are left out."""
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}="), share_piece(c)))
    parts = F.concat_ws("&", part("node", node), part("to", to), F.when(lens != "none", part("lens", lens)))
    return F.when(parts != "", F.concat(F.lit("#"), parts)).otherwise("")


def view_parts(fragment: Column) -> Column:
    """struct(node, to, lens) of a fragment; the last of repeated parts counts, unknown lenses are null."""

    def part(name: str) -> Column:
        found = F.regexp_extract_all(F.regexp_replace(fragment, r"\A#", ""), F.lit(rf"(?:\A|&){name}=([^&=]+)"), F.lit(1))
        return F.try_url_decode(F.replace(F.try_element_at(found, F.lit(-1)), F.lit("+"), F.lit("%2B")))

    lens = part("lens")
    return F.struct(part("node").alias("node"), part("to").alias("to"), F.when(lens.isin(*SHARED_LENSES), lens).alias("lens"))


def locate(file: Column, root: Column) -> Column:
    """Absolute place of a file; null when nothing tells."""
    absolute = file.startswith("/") | file.rlike(r"\A[A-Za-z]:[\\/]")
    known = F.when(file == "", None).when(absolute, file)
    return known.when(root != "", F.concat(F.regexp_replace(root, r"[/\\]\z", ""), F.lit("/"), file))
