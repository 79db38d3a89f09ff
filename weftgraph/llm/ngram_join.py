"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Method.  Texts are lower-cased runs of letters, numbers, marks and underscores;
a document's set holds its n-grams of five words (a shorter text: all its words
as one).  Documents with the same words are one class, whose representative
goes on.  Signatures are cut into bands; the number of bands and rows follows
from the wanted recall at the threshold.  Band hashes are shuffled, and each
bucket links its members to its least member, so a bucket costs as many rows as
members.  Connected buckets form candidate components.  A component of bounded
size is one block.  A larger one, which may be no more than a chain of buckets, is
clustered along its links until clusters would fill a block, and clusters are cut
into blocks; two blocks meet if some bucket has members in both, so every two
members of a bucket meet, and the ends of a chain do not.  A pair of blocks
computes all its Jaccard values on the full sets in memory: it returns a count
of links for each member and a spanning forest of the links, never the pairs.
Links join up to classes by connected components.  Within one class of texts that
are all alike, every block meets every other: links are counted exactly, so that
work grows with the square of such a class.

Documents with the same words are told by a cryptographic digest of the words;
n-grams are 64-bit hashes of hashes of words, in which no pattern cancels.

Defined results: null text counts as empty; a text without words has no
n-grams and no links; repeated rows and copies are linked to each other; null
ids are rows of their own (a class of null ids alone has a null class id); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shingles as sh
from weftgraph.llm.bpe import slices
from weftgraph.llm.common import materialise, sifted, told_apart, without
from weftgraph.operators.components import connected_components

BLOCK_MEMBERS = 256
BLOCK_GRAMS = 1 << 20


def banding(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): most rows a band such that a pair at the threshold shares a
    band with probability ``recall`` within ``most`` hash functions."""
    found = (1, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            found = (bands, rows)
    return found


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, d0, d1: digest of the words, n: n-grams with repeats, bands: band hashes)."""
    factors_seed, k = 7, bands * rows
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = sh.multipliers(k, factors_seed)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                hashes, counts, digest = sh.words_and_digests(texts[a:b])
                grams, number = sh.shingles(hashes, counts, size)
                banded = sh.band_hashes(sh.minhash(grams, number, factors), rows).view(np.int64)
                banded = pa.ListArray.from_arrays(np.arange(0, banded.size + 1, bands, dtype=np.int32), banded.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(number.astype(np.int64)), banded],
                    names=["doc_id", "d0", "d1", "n", "bands"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, d0 long, d1 long, n long, bands array<long>")


def gram_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, d0, d1, grams: sorted distinct n-gram hashes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                hashes, counts, digest = sh.words_and_digests(texts[a:b])
                grams, number = sh.shingles(hashes, counts, size)
                ends = np.cumsum(number)
                sets = [np.unique(grams[e - n : e]).view(np.int64) for e, n in zip(ends.tolist(), number.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(sets, pa.list_(pa.int64()))],
                    names=["doc_id", "d0", "d1", "grams"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, d0 long, d1 long, grams array<long>")


def block_links(table: pa.Table, threshold: float) -> pa.Table:
    """Links within one pair of blocks: for every member its weighted number of links
    (rep, null, links), and a spanning forest (rep, other, 0)."""
    reps = table.column("rep").to_numpy()
    weights = table.column("weight").to_numpy()
    blocks = table.column("block").to_numpy()
    pair = sorted({table.column("bi")[0].as_py(), table.column("bj")[0].as_py()})
    sets = table.column("grams").combine_chunks()
    offsets = sets.offsets.to_numpy()
    codes = np.unique(sets.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)[1]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    left = np.flatnonzero(blocks == pair[0])
    right = left if len(pair) == 1 else np.flatnonzero(blocks == pair[1])
    flat = np.concatenate([codes[offsets[j] : offsets[j + 1]] for j in right]) if len(right) else codes[:0]
    first = np.cumsum(sizes[right]) - sizes[right]
    links = np.zeros(len(reps), np.int64)
    parent = list(range(len(reps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest: list[tuple[int, int]] = []
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    for k, i in enumerate(left.tolist()):
        own = codes[offsets[i] : offsets[i + 1]]
        mark[own] = True
        begin = k + 1 if len(pair) == 1 else 0
        if begin < len(right):
            others = right[begin:]
            both = np.add.reduceat(mark[flat[first[begin] :]], first[begin:] - first[begin], dtype=np.int64)
            hit = others[both >= threshold * (sizes[i] + sizes[others] - both) - 1e-9]
            if len(hit):
                links[i] += weights[hit].sum()
                links[hit] += weights[i]
                for j in hit.tolist():
                    a, b = root(i), root(j)
                    if a != b:
                        parent[b] = a
                        forest.append((reps[i], reps[j]))
        mark[own] = False
    some = links > 0
    return pa.table(
        {
            "rep": pa.array(np.concatenate([reps[some], np.array([a for a, _ in forest], np.int64)]), pa.int64()),
            "other": pa.array([None] * int(some.sum()) + [int(b) for _, b in forest], pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(forest), np.int64)]), pa.int64()),
        }
    )


def _clusters(members: DataFrame, near: DataFrame, rounds: int = 6) -> DataFrame:
    """(rep, cluster) of members (rep, n): clusters below half a block join a neighbour along the links of
    ``near`` that comes before them in order, if it stays itself: larger clusters first, then those with more
    neighbours, so that the hub of a star takes all its leaves at once, then by a draw made anew each round."""
    links = materialise(near.join(members.select(F.col("rep").alias("src")), "src").select("src", "dst"))
    state = materialise(members.select("rep", "n", F.col("rep").alias("cluster")))
    for k in range(rounds):
        sizes = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"))
        small = (F.col("m") * 2 < BLOCK_MEMBERS) & (F.col("grams") * 2 < BLOCK_GRAMS)
        ends = [state.select(F.col("rep").alias(c), F.col("cluster").alias(f"c_{c}")) for c in ("src", "dst")]
        across = links.join(ends[0], "src").join(ends[1], "dst").filter("c_src <> c_dst").select(F.col("c_src").alias("cluster"), F.col("c_dst").alias("to"))
        across = materialise(across.unionByName(across.select(F.col("to").alias("cluster"), F.col("cluster").alias("to"))).distinct())
        degrees = across.groupBy("cluster").agg((-F.count(F.lit(1))).alias("fewer"))
        place = F.struct(small.alias("small"), F.coalesce("fewer", F.lit(0)).alias("fewer"), F.xxhash64("cluster", F.lit(k)).alias("draw"), "cluster").alias("place")
        order = materialise(sizes.join(degrees, "cluster", "left").select("cluster", place))
        least = across.join(order.select(F.col("cluster").alias("to"), F.col("place").alias("best")), "to").groupBy("cluster").agg(F.min("best").alias("best"))
        wishes = materialise(order.join(least, "cluster").filter("place.small and best < place").select("cluster", F.col("best.cluster").alias("to")))
        if wishes.isEmpty():
            break
        moves = wishes.join(wishes.select(F.col("cluster").alias("to")), "to", "left_anti")
        state = materialise(state.join(moves, "cluster", "left").select("rep", "n", F.coalesce("to", "cluster").alias("cluster")))
    return state.select("rep", "cluster")


def _blocks(members: DataFrame, near: DataFrame, banded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their block, (block, bi, bj): the pairs of blocks that each block takes part in)."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams"))
    sizes = materialise(sizes.withColumn("large", (F.col("m") > BLOCK_MEMBERS) | (F.col("grams") > BLOCK_GRAMS)))
    small = materialise(members.join(sizes.filter("not large").select("component"), "component").withColumn("block", F.col("component")))
    alone = small.select("block").distinct().select("block", F.col("block").alias("bi"), F.col("block").alias("bj"))
    if sizes.filter("large").isEmpty():
        return small, alone
    large = materialise(members.join(sizes.filter("large").select("component"), "component"))
    clustered = large.join(_clusters(large, near), "rep")
    parts = clustered.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("parts"))
    placed = clustered.join(parts, "cluster").withColumn("block", F.xxhash64("component", "cluster", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    placed = materialise(placed.select(*members.columns, "block"))
    own_bands = sifted(banded.withColumn("fp", F.xxhash64("rep")), placed.select(F.xxhash64("rep").alias("fp")))
    held = materialise(own_bands.join(placed.select("rep", "block"), "rep").select("band", "block").distinct())
    meet = held.join(held.select("band", F.col("block").alias("other")), "band").filter("block < other").select(F.col("block").alias("bi"), F.col("other").alias("bj")).distinct()
    own = placed.select(F.col("block").alias("bi"), F.col("block").alias("bj")).distinct()
    meet = materialise(meet.unionByName(own))
    either = meet.select(F.explode(F.array_distinct(F.array("bi", "bj"))).alias("block"), "bi", "bj")
    return small.unionByName(placed), alone.unionByName(either)


def jaccard_classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(doc_id, class_id, n_links, class_size) for every row: the class is the connected
    component of the links with Jaccard similarity ``threshold`` or more, named by its least
    doc_id; n_links counts the other documents linked to this one, copies included."""
    bands, rows = banding(threshold, recall)
    docs = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    all_rows = materialise(
        signatures(docs, size, bands, rows)
        .withColumn("rid", F.monotonically_increasing_id())
        .withColumns({"d0": F.when(F.col("n") == 0, F.col("rid")).otherwise(F.col("d0")), "d1": F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("d1"))})
    )
    # classes of documents with the same words
    copies = all_rows.groupBy("d0", "d1").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classed = materialise(all_rows.select("doc_id", "d0", "d1", "n", "bands", "rid").join(copies, ["d0", "d1"]))
    reps = classed.filter((F.col("rid") == F.col("rep")) & (F.col("n") > 0))
    # buckets, linked to their least member
    banded = reps.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("band", "hub")
    near = banded.join(buckets, "band").filter("rep <> hub").select(F.col("rep").alias("src"), F.col("hub").alias("dst")).distinct()
    near = materialise(near)
    component = materialise(connected_components(near).select(F.col("id").alias("rep"), "component"))
    members = component.join(reps.select("rep", "doc_id", "d0", "d1", "n", "weight"), "rep")
    placed, pairs = _blocks(members, near, banded)
    wanted = placed.select("doc_id").distinct()
    texts = sifted(docs.withColumn("fp", F.xxhash64("doc_id")), wanted.select(F.xxhash64("doc_id").alias("fp")))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"])).select(texts["doc_id"], "text")
    sets = gram_sets(texts, size).dropDuplicates(["d0", "d1"]).select("d0", "d1", "grams")
    meets = placed.join(pairs, "block").join(sets, ["d0", "d1"]).select("component", "bi", "bj", "block", "rep", "weight", "grams")
    found = materialise(
        meets.groupBy("component", "bi", "bj").applyInArrow(lambda table: block_links(table, threshold), "rep long, other long, links long")
    )
    counts = found.filter("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.filter("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    grouped = classed.select("doc_id", "rep", "weight").join(counts, "rep", "left").join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    grouped = grouped.select("doc_id", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    names = grouped.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return grouped.join(names, "component").select("doc_id", "class_id", "n_links", "class_size")


def dedup(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents of which one of each class stays (its least doc_id), with all their columns; where
    rows repeat id and text, one of them."""
    found = jaccard_classes(told_apart(docs, nulls_first=False), size, threshold)
    found = materialise(found.filter("class_size > 1").select("doc_id", (F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept")))
    repeated = found.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return without(docs, found.filter("not kept"), repeated)
