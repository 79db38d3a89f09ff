"""Substring dedup: windows of words that an earlier document holds are removed.

Method.  A window of 13 words is named by the least hash among its runs of five words;
consecutive windows of one such run form a span, and equal windows lie in spans of the
same run.  Runs found in one document only are put aside.  The distinct spans of the
others, each with the least id that holds it, are the reference: they are dealt into
shards by run, and each shard builds a suffix automaton over its spans, whose states know
the least id among all places they stand for.  The spans are streamed over it for matching
statistics; where a match reaches the length of a window, the state of that length gives
the window's least id.  Maximal spans of windows with a lesser id than the document's
are removed.

A run whose spans are many (a common line in ever new company) would make a shard of
any size: its spans are cut into windows, of which each is its own reference, and
windows come together again afterwards.  Automata are not broadcast: a reference as large
as the corpus would have to meet every document, shard after shard; dealt by run, every span
meets the one shard that can hold it.

Defined results: null text has no words; rows with a null id keep all words and
take none from others; rows of one id take none from each other; repeated rows give
repeated results; an empty table gives an empty result; extra columns are
ignored.  Words are compared as they stand, spans by a 128-bit digest of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import marked
from weftgraph.llm.hashing import mix
from weftgraph.plans.iterate import Versions

WINDOW, RUN = 13, 5
#: spans of a shard, and of one run before it is cut into windows
SHARD, COMMON = 4096, 512
#: the bitmap of repeated runs has 2**WORD_BITS words of 64 bits
WORD_BITS = 21
#: bytes of a word that are hashed by their places, and their random numbers
PIECE = 64
DRAWN = np.random.default_rng(12).integers(0, 1 << 64, PIECE << 8, np.uint64)


class Words:
    """The words of several texts that lie one after another in UTF-8 bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        inside = (data != 32) & ((data < 9) | (data > 13))
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = offsets[:-1][np.diff(offsets) > 0]  # a text begins or ends a word, whatever its neighbour holds
        first[full] |= inside[full]
        last[full[1:] - 1] |= inside[full[1:] - 1]
        self.raw, self.starts, self.ends = data.tobytes(), np.flatnonzero(first), np.flatnonzero(last) + 1
        self.counts = np.diff(np.searchsorted(self.starts, offsets))
        self.hashes = byte_hashes(data[inside], self.ends - self.starts)
        gaps = (self.starts[1:] - self.ends[:-1] != 1) | (data[np.minimum(self.ends[:-1], len(data) - 1)] != 32) if len(self.starts) else np.zeros(0, bool)
        self.odd = np.concatenate([[0], np.cumsum(gaps)])

    def piece(self, a: int, b: int) -> bytes:
        """Words ``a`` to ``b`` - 1, joined by one space."""
        if self.odd[a] == self.odd[b - 1]:
            return self.raw[self.starts[a] : self.ends[b - 1]]
        return b" ".join(self.raw[x:y] for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True))


def byte_hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each of the consecutive runs that tile ``data`` (``sizes`` bytes each, none empty).

    Every pair of place and byte has a number drawn at random; sums over pieces of a word are scattered, and so
    are their sums, so that no pattern of letters cancels."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(data), dtype=np.int64) - np.repeat(first, sizes)
    drawn = DRAWN[(place % PIECE) << 8 | data]
    if sizes.max() <= PIECE:
        return mix(np.add.reduceat(drawn, first))
    begins = np.flatnonzero(place % PIECE == 0)
    pieces = mix(np.add.reduceat(drawn, begins) + (place[begins] // PIECE).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(pieces, np.searchsorted(begins, first)))


def word_slices(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int, Words]]:
    """(first text, text after the last, their words) of consecutive texts of about ``size`` bytes together."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def spans(hashes: np.ndarray, counts: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, hash of the run) of the spans of many texts."""
    windows = max(0, len(hashes) - window + 1)
    runs = np.zeros(max(0, len(hashes) - run + 1), np.uint64)
    for k in range(run):
        runs = runs * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(runs)]
    runs = mix(runs)
    least, at = runs[:windows].copy(), np.zeros(windows, np.int64)
    for k in range(1, window - run + 1):
        lesser = np.flatnonzero(runs[k : k + windows] < least)
        least[lesser], at[lesser] = runs[lesser + k], k
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(text[:windows] == text[window - 1 :]) if windows else np.zeros(0, np.int64)
    places = at[whole] + whole
    begins = np.flatnonzero((np.diff(places, prepend=-1) != 0) | (np.diff(whole, prepend=-2) != 1))
    first = whole[begins]
    return text[first], first - (np.cumsum(counts) - counts)[text[first]], np.diff(begins, append=len(whole)), least[first].view(np.int64)


def digest(span: bytes) -> bytes:
    return hashlib.sha256(span).digest()[:16]


def _bitmap(runs: DataFrame) -> np.ndarray:
    """Bits of the leading bits of the hashes ``run``: 2**WORD_BITS words on the driver, whatever the input."""
    word = F.shiftrightunsigned("run", 64 - WORD_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(run, {58 - WORD_BITS}) & 63 as int))")
    found = runs.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << WORD_BITS, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _marked(bits: np.ndarray, runs: np.ndarray) -> np.ndarray:
    runs = runs.view(np.uint64)
    return bits[runs >> np.uint64(64 - WORD_BITS)] >> ((runs >> np.uint64(58 - WORD_BITS)) & np.uint64(63)) & np.uint64(1) == 1


def _found(docs: DataFrame, wanted: Broadcast | None, what: str) -> DataFrame:
    """(doc_id, hash, run) of all spans; with ``wanted``, of those whose run may be repeated: their text, or
    where they start and their digest."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = {"run": "", "text": ", span string", "place": ", start int, key binary"}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in word_slices(batch.column(2)):
                own, start, number, runs = spans(words.hashes, words.counts)
                if wanted is not None:
                    kept = np.flatnonzero(_marked(wanted.value, runs))
                    own, start, number, runs = own[kept], start[kept], number[kept], runs[kept]
                columns = [batch.column(0).take(pa.array(own + a)), batch.column(1).take(pa.array(own + a)), pa.array(runs)]
                names = ["doc_id", "hash", "run"]
                if what != "run":
                    first = (np.cumsum(words.counts) - words.counts)[own] + start
                    pieces = [words.piece(x, y) for x, y in zip(first.tolist(), (first + number + WINDOW - 1).tolist(), strict=True)]
                    columns += [pa.array(pieces, pa.string())] if what == "text" else [pa.array(start.astype(np.int32)), pa.array([digest(p) for p in pieces], pa.binary())]
                    names += ["span"] if what == "text" else ["start", "key"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "hash", "text").mapInArrow(run, f"doc_id {kind}, hash long, run long{extra}")


class Automaton:
    """Suffix automaton of several sequences; each state knows the least owner among its places."""

    def __init__(self) -> None:
        self.following: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 62]

    def _split(self, state: int, symbol: int) -> int:
        """The state after ``symbol`` that is one longer than ``state``."""
        old = self.following[state][symbol]
        if self.length[old] == self.length[state] + 1:
            return old
        new = len(self.link)
        self.following.append(dict(self.following[old]))
        self.link.append(self.link[old])
        self.length.append(self.length[state] + 1)
        self.least.append(1 << 62)
        self.link[old] = new
        while state >= 0 and self.following[state].get(symbol) == old:
            self.following[state][symbol] = new
            state = self.link[state]
        return new

    def add(self, symbols: list[int], owner: int) -> None:
        last = 0
        for symbol in symbols:
            if symbol in self.following[last]:
                last = self._split(last, symbol)
            else:
                new, state = len(self.link), last
                self.following.append({})
                self.length.append(self.length[last] + 1)
                self.link.append(0)
                self.least.append(1 << 62)
                while state >= 0 and symbol not in self.following[state]:
                    self.following[state][symbol] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._split(state, symbol)
                last = new
            if owner < self.least[last]:
                self.least[last] = owner

    def settle(self) -> None:
        """A state's places are those of all states that link to it."""
        for state in np.argsort(self.length, kind="stable")[:0:-1].tolist():
            up = self.link[state]
            if self.least[state] < self.least[up]:
                self.least[up] = self.least[state]

    def statistics(self, symbols: list[int], most: int) -> tuple[list[int], list[int]]:
        """After each symbol: length of the longest match that ends there, ``most`` at most, and the least owner of it."""
        following, link, length, least = self.following, self.link, self.length, self.least
        state = matched = 0
        lengths, owners = [], []
        for symbol in symbols:
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                matched += 1
                if matched > most:
                    while length[link[state]] >= most:
                        state = link[state]
                    matched = most
            lengths.append(matched)
            owners.append(least[state])
        return lengths, owners


def shard_statistics(table: pa.Table) -> pa.Table:
    """(key, cut, found: (at, least id) of each window that a lesser id than some holder's has) of the spans of
    one shard (span, least, greatest, cut)."""
    texts, ids = table["span"].to_pylist(), table["least"].to_pylist()
    order = sorted(set(ids))
    rank = {x: k for k, x in enumerate(order)}
    codes: dict[str, int] = {}
    sequences = [[codes.setdefault(w, len(codes)) for w in t.split(" ")] for t in texts]
    automaton = Automaton()
    for sequence, owner in zip(sequences, ids, strict=True):
        automaton.add(sequence, rank[owner])
    automaton.settle()
    keys, cut, found = [], [], []
    for text, sequence, greatest, windows in zip(texts, sequences, table["greatest"].to_pylist(), table["cut"].to_pylist(), strict=True):
        owners = automaton.statistics(sequence, WINDOW)[1][WINDOW - 1 :]  # a window of the reference is always found
        held = [{"at": at, "least": order[owner]} for at, owner in enumerate(owners) if order[owner] < greatest]
        if held:
            keys.append(digest(text.encode()))
            cut.append(windows)
            found.append(held)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("least", table.schema.field("least").type)]))
    return pa.table({"key": pa.array(keys, pa.binary()), "cut": pa.array(cut, pa.bool_()), "found": pa.array(found, kind)})


def _profiles(distinct: DataFrame) -> DataFrame:
    """(key, found) of the distinct spans (run, span, least, greatest)."""
    kind = distinct.schema["least"].dataType.simpleString()
    key = lambda c: F.substring(F.unhex(F.sha2(F.col(c).cast("binary"), 256)), 1, 16).alias("key")
    common = Versions(distinct.sparkSession).write(distinct.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON).select("run"))
    few, many = distinct.join(common, "run", "left_anti"), distinct.join(common, "run", "left_semi")
    words = F.split("span", " ")
    cut = many.select("span", "least", "greatest", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))).alias("at", "window"))
    windows = cut.groupBy(F.col("window").alias("span")).agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    reference = few.withColumn("cut", F.lit(False)).unionByName(windows.withColumns({"run": F.xxhash64("span"), "cut": F.lit(True)}))
    shards = max(1, -(-distinct.count() // SHARD))
    dealt = reference.select(F.pmod(F.xxhash64("run"), F.lit(shards)).alias("shard"), "span", "least", "greatest", "cut")
    found = dealt.groupBy("shard").applyInArrow(lambda table: shard_statistics(table.drop_columns(["shard"])), f"key binary, cut boolean, found array<struct<at:int,least:{kind}>>")
    found = Versions(distinct.sparkSession).write(found)
    whole = cut.select(key("span").alias("whole"), "at", key("window")).join(found.filter("cut"), "key")
    whole = whole.groupBy(F.col("whole").alias("key")).agg(F.collect_list(F.struct("at", F.col("found")[0]["least"].alias("least"))).alias("found"))  # as many as the span has windows
    return found.filter("not cut").select("key", "found").unionByName(whole)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, windows: array of (start, mask)) of each text of which words go: first words of spans and,
    as bits, which of the windows from there on are to go.  docs (doc_id, hash, text)."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null and text is not null")
    runs = _found(docs, None, "run").groupBy("run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    runs = Versions(spark).write(runs.filter("least < greatest").select("run"))
    wanted = spark.sparkContext.broadcast(_bitmap(runs))
    distinct = _found(docs, wanted, "text").groupBy("run", "span").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    distinct = Versions(spark).write(distinct.join(runs, "run", "left_semi"))
    mask = F.aggregate(F.filter("found", lambda x: x["least"] < F.col("doc_id")), F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["at"])))
    hit = _found(docs, wanted, "place").drop("run").join(_profiles(distinct), "key").select("doc_id", "hash", "start", mask.alias("mask")).filter("mask <> 0")
    return hit.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "mask")).alias("windows"))  # as many as the text has spans


def _kept(rows: DataFrame) -> DataFrame:
    """The columns of rows (doc_id, text, windows) as ``dedup`` returns them."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    removed = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                kept, count, gone = [], [], []
                for text, windows in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()  # of bytes, at ASCII white space
                    edges: list[list[int]] = []
                    for first in sorted(w["start"] + k for w in windows or () for k in range(w["mask"].bit_length()) if w["mask"] >> k & 1):
                        if edges and first <= edges[-1][1]:
                            edges[-1][1] = first + WINDOW
                        else:
                            edges.append([first, first + WINDOW])
                    parts = [words[x:y] for x, y in zip([0, *(stop for _, stop in edges)], [*(start for start, _ in edges), len(words)], strict=True)]
                    kept.append(b" ".join(w for p in parts for w in p) if edges else b" ".join(words))
                    count.append(len(words))
                    gone.append([{"start": start, "stop": stop} for start, stop in edges])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(gone, removed)], names=["doc_id", "kept", "n_words", "removed"])

    return rows.select("doc_id", "text", "windows").mapInArrow(run, f"doc_id {kind}, kept string, n_words long, removed array<struct<start:long,stop:long>>")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, kept: the words that stay, joined by one space; n_words; removed: maximal spans (start, stop) of
    words that go) of every row of docs (doc_id, text)."""
    text = docs["text"].cast("string")
    docs = docs.select(docs["doc_id"], F.xxhash64(text).alias("hash"), text.alias("text"))
    hit = Versions(docs.sparkSession).write(repeated_windows(docs))
    split = marked(docs.withColumn("fp", F.xxhash64("doc_id", "hash")), hit.select(F.xxhash64("doc_id", "hash").alias("fp")))
    clean = split.filter("not maybe").select("doc_id", "text").withColumn("windows", F.lit(None).cast(hit.schema["windows"].dataType))
    cut = split.filter("maybe").join(hit, ["doc_id", "hash"], "left").select("doc_id", "text", "windows")
    return _kept(clean.unionByName(cut))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs (doc_id, text)."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return dedup(docs).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
