"""What the operators share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.iterate import materialise

__all__ = ["marked", "materialise", "sifted", "told_apart", "without"]

#: 2**WORD_BITS words of 64 bits at most in a bitmap
WORD_BITS = 20


def _bits(wanted: DataFrame) -> tuple[Column, Column, DataFrame]:
    """(word, bit, bitmap of the hashes ``wanted`` (fp) over their leading bits); 2**WORD_BITS rows at most, so it is broadcast."""
    word = F.shiftrightunsigned("fp", 64 - WORD_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {58 - WORD_BITS}) & 63 as int))")
    return word, bit, F.broadcast(wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")))


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows with ``maybe``: false only where their hash ``fp`` is surely none of ``wanted`` (fp)."""
    word, bit, bitmap = _bits(wanted)
    maybe = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    return rows.withColumn("word", word).join(bitmap, "word", "left").withColumn("maybe", maybe).drop("word", "bits")


def sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose hash ``fp`` may be one of ``wanted`` (fp), by a bitmap over the hashes' leading bits.

    The bitmap has 2**WORD_BITS rows at most, whatever the input, so it is broadcast, and most of the other
    rows are dropped where they are read.  An exact inner join is to follow (a semi-join would be moved below it)."""
    word, bit, bitmap = _bits(wanted)
    return rows.withColumn("word", word).join(bitmap, "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def told_apart(docs: DataFrame, nulls_first: bool) -> DataFrame:
    """(doc_id, text) in which the id also holds a hash of the text, so that rows with a null or
    repeated id are told apart; null ids are least or greatest."""
    known = F.col("doc_id").isNotNull() if nulls_first else F.col("doc_id").isNull()
    text = docs["text"].cast("string")
    return docs.select(F.struct(known.alias("known"), F.col("doc_id").alias("own"), F.xxhash64(text).alias("hash")).alias("doc_id"), text.alias("text"))


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``dropped``, and with one row for each of ``repeated`` (both doc_id as
    made by ``told_apart``): rows that repeat both id and text are one document each time they are kept."""
    keys = lambda df: df.select(F.col("doc_id.own").alias("_own"), F.col("doc_id.hash").alias("_hash")).distinct()
    same = lambda gone: docs["doc_id"].eqNullSafe(gone["_own"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_hash"])
    if repeated.isEmpty():
        gone = keys(dropped)
        return docs.join(gone, same(gone), "left_anti")
    once = keys(repeated)
    gone = keys(dropped).unionByName(once).distinct()
    one = docs.join(once, same(once), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(gone, same(gone), "left_anti").unionByName(one)
