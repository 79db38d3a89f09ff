"""Balanced label propagation: shards of even size that keep linked documents together.

Method.  Documents start on shards dealt by hash.  Each round joins links with
the current labels; a document follows the most frequent shard among its
leaders (linked documents of higher degree, ties to the smaller id), so labels
flow one way and settle in as many rounds as the deepest chain (two for equal
texts); rounds end when no document moves.  Moves have no quota, which would
leave followers behind where most rows are linked; balance comes from the last
step: documents are ranked by (shard, place, leader, id), unlinked ones on both
ends of a shard, and the ranks are cut into equal runs, so that counts differ
by one at most and each of the borders cuts one group at most.  A group of
copies above a quarter of a shard is split beforehand into blocks with a
leader each.

Only DataFrame functions run; what the driver sees is one number a round.

Defined results: null text counts as empty (size 1); equal texts are linked;
repeated rows and null ids are rows of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import materialise


def copy_links(rows: DataFrame, key: str, capacity: int) -> DataFrame:
    """(src, dst) links of rows (rid, key): each copy to the leader of its block, each
    leader to the first one.  Linear in the rows; blocks hold a quarter of ``capacity`` at most."""
    block = max(1, capacity // 4)
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").withColumn("blocks", F.ceil(F.col("copies") / block))
    members = rows.join(groups, key).select("rid", key, F.pmod(F.xxhash64("rid"), F.col("blocks")).alias("block"))
    leaders = members.groupBy(key, "block").agg(F.min("rid").alias("leader"))
    first = leaders.groupBy(key).agg(F.min("leader").alias("first"))
    to_leader = members.join(leaders, [key, "block"]).filter("rid <> leader").select(F.col("rid").alias("src"), F.col("leader").alias("dst"))
    to_first = leaders.join(first, key).filter("leader <> first").select(F.col("leader").alias("src"), F.col("first").alias("dst"))
    return to_leader.unionByName(to_first)


def _leading(links: DataFrame) -> DataFrame:
    """(follower, leader): each link, directed to its end of higher degree (ties: smaller id)."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    ends = links.join(degree.select(F.col("src"), F.col("degree").alias("ds")), "src").join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("dd") > F.col("ds")) | ((F.col("dd") == F.col("ds")) & (F.col("dst") < F.col("src")))
    return ends.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("follower"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("leader"))


def propagate(rows: DataFrame, links: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """(rid, label, leader) of rows (rid): labels when no row moves, or after ``rounds``; leader is null for unlinked rows."""
    leading = materialise(_leading(links))
    linked = leading.select(F.col("follower").alias("rid")).unionByName(leading.select(F.col("leader").alias("rid"))).distinct()
    labels = materialise(linked.withColumn("label", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")))
    done = 0
    while rounds is None or done < rounds:
        votes = leading.join(labels.withColumnRenamed("rid", "leader"), "leader").groupBy("follower", "label").agg(F.count(F.lit(1)).alias("votes"))
        wish = votes.groupBy(F.col("follower").alias("rid")).agg(F.max(F.struct("votes", (-F.col("label")).alias("label"))).alias("best"))
        moves = materialise(labels.join(wish.select("rid", (-F.col("best.label")).alias("target")), "rid", "left").withColumn("target", F.coalesce("target", "label")))
        labels = moves.select("rid", F.col("target").alias("label"))
        done += 1
        if not moves.filter("label <> target").count():
            break
    leader = leading.groupBy(F.col("follower").alias("rid")).agg(F.min("leader").alias("leader"))
    found = labels.join(leader, "rid", "left").select("rid", "label", F.coalesce("leader", "rid").alias("leader"))
    return rows.select("rid").join(found, "rid", "left").select("rid", F.coalesce("label", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")).alias("label"), "leader")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` (0 upwards, gapless) by a total order: range partitions, their
    counts, and each row's place in its partition."""
    placed = materialise(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "place", "before")


def shard(docs: DataFrame, shards: int = 16, rounds: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); law ``rows``: counts at most one apart.

    ``links`` (src, dst: doc ids) replaces the links of equal texts."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("text_key"),
        ).withColumn("rid", F.monotonically_increasing_id())
    )
    n = rows.count()
    capacity = -(-n // shards)
    if links is None:
        edges = copy_links(rows, "text_key", capacity)
    else:
        ids = rows.select("doc_id", "rid")
        edges = (
            links.join(ids.select(F.col("doc_id").alias("src"), F.col("rid").alias("a")), "src")
            .join(ids.select(F.col("doc_id").alias("dst"), F.col("rid").alias("b")), "dst")
            .filter("a <> b")
            .select(F.col("a").alias("src"), F.col("b").alias("dst"))
        )
    labels = propagate(rows, edges, shards, rounds)
    side = F.when(F.col("leader").isNotNull(), 1).otherwise(F.pmod(F.xxhash64("rid", F.lit("side")), F.lit(2)) * 2).cast("int")
    order = rows.join(labels, "rid").select("doc_id", "size", "text_crc32", "rid", "label", side.alias("side"), F.coalesce("leader", "rid").alias("leader"))
    out = ranked(order, "label", "side", "leader", "rid")
    out = out.withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(n, 1)} as int)"))
    first = F.expr(f"(shard * cast({n} as bigint) + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
