"""Spelling variants: words one edit apart, found by a rare-first q-gram prefix filter.

Method.  Positional bigrams of all words are ordered by the number of words that hold
them, rarest first (ties: by bigram, then position).  One edit destroys at most two
bigrams of a word and makes at most two, so two words one edit apart share, unharmed,
one of the three first of each, its places at most one apart.  Only these three are
joined.  The edit lies behind the shared bigram, and all before it is equal in both
words, or before it, and all behind is equal: a join key is therefore the whole head up
to the bigram's end, or the whole tail from its start, with the length of the longer
word, which implies the limit of positions and parts groups of common bigrams.  Within the
join, pairs are told apart by the parities of their letters first, which are 64 bits of a word, and then verified
by edit distance, so no candidate leaves it.

Native: no Python worker.  The table of bigrams has a row for each pair of letters; it
is joined, never collected.  Large groups of a key are split by skew joins.

Defined results: null text has no words; a null id stands for an empty text in
the draw of deletions; repeated rows count again; an empty table gives an empty
result; extra columns are ignored; ties go to the least word in code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"
MISSPELT = 31


def misspelt(doc_id: Column, run: Column, one_in: int = MISSPELT) -> Column:
    """``run`` without one code point, where ``one_in`` divides crc32 of ``<doc_id>:<run>``."""
    draw = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(draw, F.char_length(run)).cast("int")
    return F.when(F.pmod(draw, F.lit(one_in)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, one_in: int = MISSPELT) -> DataFrame:
    """(word, n): results of ``misspelt`` over the runs of letters of all texts.  A run below
    ``least_length`` cannot give a word, so it is not taken out of the text at all."""
    runs = F.regexp_extract_all(docs["text"].cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(docs["doc_id"], F.explode(runs).alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(misspelt(F.col("doc_id"), F.col("run"), one_in).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def rarest(words: DataFrame, kept: int = 3) -> DataFrame:
    """(word, at: places of the ``kept`` rarest bigrams of each word)."""
    last = F.char_length("word") - 2
    placed = words.select("word", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("word", i + 1, F.lit(2)))).alias("at", "gram"))
    common = placed.select("word", "gram").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    order = F.array_sort(F.collect_list(F.struct("words", "gram", "at")))  # as many as the word has letters
    return placed.join(common, "gram").groupBy("word").agg(F.slice(order, 1, kept).alias("first")).select("word", F.transform("first", lambda x: x["at"]).alias("at"))


def _parities() -> Column:
    """64 bits: of the code points with each remainder by 64, are there an odd number?  One edit turns two bits at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(bit(c)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other) both ways: words of 4 letters or more, given once each, that differ by exactly
    one inserted, deleted or replaced code point."""
    placed = rarest(words.select("word")).select("word", _parities().alias("odd"), F.char_length("word").alias("length"), F.explode("at").alias("at"))
    head = F.struct(F.lit("head").alias("kind"), F.substring(F.col("word"), F.lit(1), F.col("at") + 2).alias("part"))
    tail = F.struct(F.lit("tail").alias("kind"), F.substring(F.col("word"), F.col("at") + 1, F.col("length")).alias("part"))
    parts = placed.select("word", "odd", "length", F.explode(F.array(head, tail)).alias("part"))
    key = lambda length: F.xxhash64("part.kind", "part.part", length).alias("key")
    own = parts.select(key(F.col("length")), "word", "odd")
    others = parts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("more"), "*").select(key(F.col("length") + F.col("more")), F.col("word").alias("other"), F.col("odd").alias("other_odd"), "more")
    alike = F.bit_count(F.col("odd").bitwiseXOR(F.col("other_odd"))) <= 2
    near = alike & ((F.col("more") == 1) | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1)
    found = own.join(others, (own["key"] == others["key"]) & near).select("word", "other").distinct()
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other")))


def grouped(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    The form is the near word of largest n, if that is ``ratio`` times the word's n or more.
    Counts grow by that ratio along forms, so chains are short; roots double their reach each round."""
    words = materialise(words.select("word", "n"))
    near = near_pairs(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    held = words.join(best, "word", "left").withColumn("formed", -F.col("best.minus") >= ratio * F.col("n"))
    held = materialise(
        held.select("word", F.when(F.col("formed"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("formed"), -F.col("best.minus")).alias("form_n"))
    )
    roots, open_ = held.filter("form is not null").select("word", F.col("form").alias("root")), True
    while open_:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots, open_ = moved.select("word", "root"), not moved.filter("moved").isEmpty()
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The groups of all words of ``docs`` (doc_id, text)."""
    return grouped(word_counts(docs))
