"""Language identification by cross-parsing against suffix automata.

Method.  A bounded sample of labelled texts gives each language a suffix
automaton, whose paths from the root are the substrings of the sample.  A
document is parsed greedily: from the root along the longest match, then again
from the root.  A phrase points into a sample of n symbols or spells one of a letters,
log2(n + a) bits: the number of phrases times that, by the symbols of the document,
estimates the cross-entropy between document and language.  The language that needs
the fewest normalised phrases wins, so that a longer sample alone does not.

Symbols are the lower-cased letters of the samples, all of them; other letters
share one symbol that no sample holds, and every run of non-letters is one space.
Transitions of all automata lie in one open-addressing table of (state, symbol),
which holds what the samples hold and no more, whatever the alphabet.  Parses
restart at every ``BLOCK`` symbols, so that pieces of many documents advance in
step, one table look-up a symbol.

Bounds: a language's sample has at most ``sample_chars`` characters, all samples
together ``total_chars``; a learning text longer than a language's share counts
with a slice of that length.  Texts are chosen by a hash of doc_id; only they, and
one row a language, meet the driver.  Languages are the labels of the learning
rows; none is left out.

Defined results: text that is null or has no letter is ``und`` with score 0;
ties go to the language with more learning rows, then by name; no learning
rows: every text is ``und``; rows without a label are predicted all the same;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.bpe import LETTER, _classes, slices

SAMPLE_CHARS = 40_000
TOTAL_CHARS = 1_000_000
BLOCK = 1024
UNDETERMINED = "und"


class SuffixAutomaton:
    """Smallest automaton of all substrings of a sequence of small integers."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class CrossParser:
    """Phrase counts of texts against one automaton for each language."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        self.languages = [name for name, _ in samples]
        letters = sorted({c for _, texts in samples for t in texts for c in t.lower() if _classes()[ord(c)] == LETTER})
        self.width = len(letters) + 2
        self.symbols = np.where(_classes() == LETTER, self.width - 1, 0).astype(np.int32)  # 0: between letters
        for i, c in enumerate(letters):
            self.symbols[ord(c)] = i + 1
        keys, values, self.roots, base, sizes = [], [], [], 0, []
        for _, texts in samples:
            parts = [self.normal(t) for t in texts]
            flat = np.concatenate([np.append(p, self.width - 1) for p in parts]) if parts else np.zeros(0, np.int32)
            automaton = SuffixAutomaton(flat.tolist())
            for state, following in enumerate(automaton.next):
                for c, to in following.items():
                    if c != self.width - 1:  # breaks between texts match nothing
                        keys.append((state + base) * self.width + c)
                        values.append(to + base)
            self.roots.append(base)
            base += len(automaton.next)
            sizes.append(sum(map(len, parts)))
        self.bits = np.log2(np.array(sizes, np.float64) + self.width)  # of a phrase, by language
        self._build(np.array(keys, np.int64), np.array(values, np.int32))
        symbols = np.arange(self.width)
        # what a phrase that begins with a symbol goes on to: the root's own transitions, else the root
        self.begin = [np.where((to := self._look_up(np.full(self.width, r) * self.width + symbols)) >= 0, to, r).astype(np.int32) for r in self.roots]

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._key, self._value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self._key[at] < 0
            self._key[at[free]] = keys[left[free]]
            placed = self._key[at] == keys[left]
            self._value[at[placed]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """Following state of each (state, symbol), or -1."""
        slot = self._slot(keys)
        held = self._key[slot]
        out = self._value[slot]
        todo = np.flatnonzero(held != keys)
        out[todo] = -1
        todo = todo[held[todo] >= 0]
        at = slot[todo]
        while len(todo):
            at = (at + 1) & self._mask
            held = self._key[at]
            hit = held == keys[todo]
            out[todo[hit]] = self._value[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], at[on]
        return out

    def normal(self, text: str) -> np.ndarray:
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        x = self.symbols[cps]
        return x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])] if len(x) else x

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) phrase counts, and the symbols of each text."""
        joined = "\n".join(t.lower() for t in texts) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = self.symbols[cps]
        stops = np.cumsum([len(t.lower()) + 1 for t in texts])
        keep = np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])
        before = np.concatenate([[0], np.cumsum(keep)])
        x = x[keep]
        ends = before[stops]
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        number = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), number)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        start = starts[owner] + at * BLOCK
        length = np.minimum(BLOCK, ends[owner] - start)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = np.searchsorted(-length, -np.arange(BLOCK), "left")  # pieces longer than each step
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        for k, root in enumerate(self.roots):
            state = np.full(len(owner), root, np.int64)
            count = np.ones(len(owner), np.int64)
            for j in range(int(length[0]) if len(length) else 0):
                a = active[j]
                symbol = x[start[:a] + j]
                found = self._look_up(state[:a] * self.width + symbol)
                ends_here = found < 0
                count[:a] += ends_here
                state[:a] = np.where(ends_here, self.begin[k][symbol], found)
            out[:, k] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return out, sizes


_PARSERS: dict[str, CrossParser] = {}


def _parser(key: str, samples: Broadcast) -> CrossParser:
    """The parser of this Python worker, built once for a broadcast sample."""
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples.value)
    return _PARSERS[key]


def sample_rows(docs: DataFrame, learn: Column, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> tuple[DataFrame, list[tuple[str, int]], int]:
    """((lang, draw, text) of about twice the wanted share of each language, [(language, rows)], share in characters).

    The draw is a hash of id and text, so that rows with null or equal ids are drawn apart; rows that repeat both are
    drawn once."""
    text = F.col("text").cast("string")
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("draw")
    )
    rows = rows.filter(F.char_length("text") > 0)
    languages = rows.agg(F.count_distinct("lang")).first()[0]
    share = max(1, min(sample_chars, total_chars // max(languages, 1)))
    begin = F.pmod("draw", F.greatest(F.char_length("text") - share, F.lit(0)) + 1).cast("int")
    sized = rows.withColumn("text", F.when(F.char_length("text") > share, F.substr("text", begin + 1, F.lit(share))).otherwise(F.col("text")))
    totals = sized.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.min("draw").alias("least")).collect()  # a row a language
    if not totals:
        return sized.select("lang", "draw", "text").limit(0), [], share
    # twice the wanted share by hash, and the least hash
    rate = F.create_map(*(x for r in totals for x in (F.lit(r["lang"]), F.struct(F.lit(min(1.0, 2 * share / r["chars"])).alias("rate"), F.lit(r["least"]).alias("least")))))
    own = rate[F.col("lang")]
    place = F.pmod("draw", F.lit(1 << 40)) / float(1 << 40)
    drawn = sized.filter((place < own["rate"]) | (F.col("draw") == own["least"])).select("lang", "draw", "text").distinct()
    return drawn, [(r["lang"], r["n"]) for r in totals], share


def sample(docs: DataFrame, learn: Column, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> list[tuple[str, list[str]]]:
    """[(language, texts)], the language with most learning rows first; in order of the draw until the share is met."""
    drawn, totals, share = sample_rows(docs, learn, sample_chars, total_chars)
    picked: dict[str, list] = {language: [] for language, _ in totals}
    for r in drawn.collect() if totals else ():
        picked[r["lang"]].append((r["draw"], r["text"]))
    out = []
    for language, _ in sorted(totals, key=lambda x: (-x[1], x[0])):
        texts, left = [], share
        for _, own_text in sorted(picked[language]):
            if len(own_text) <= left:
                texts.append(own_text)
                left -= len(own_text)
        out.append((language, texts))
    return out


def identify(docs: DataFrame, samples: list[tuple[str, list[str]]]) -> DataFrame:
    """(doc_id, lang_pred, score): score is the share of normalised phrases that the winner saves against the next language."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # ``total_chars`` at most
    key = hashlib.sha256(repr(samples).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(key, shared)
        names = np.array([*parser.languages, UNDETERMINED], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 4 << 20):
                counts, _ = parser.phrases(texts[a:b])
                needs = counts * parser.bits
                lettered = np.array([any(map(str.isalpha, t)) for t in texts[a:b]])
                best = np.full(b - a, len(names) - 1)
                score = np.zeros(b - a)
                if needs.shape[1]:
                    best = np.where(lettered, needs.argmin(1), best)
                    ordered = np.sort(needs, 1)
                    score = np.where(lettered, 1 - ordered[:, 0] / ordered[:, 1] if needs.shape[1] > 1 else 1.0, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
                )

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def fold(k: int, divisor: int) -> Column:
    """True where crc32 of the doc_id as text leaves ``k`` modulo ``divisor``."""
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor == k, F.lit(False))


def held_out_predictions(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learnt from the rows that are not held out."""
    found = identify(docs, sample(docs, ~fold(2, 4), sample_chars))
    return found.select("doc_id", fold(2, 4).alias("held_out"), "lang_pred", "score")
