"""Byte-level BPE encoding and decoding over Arrow batches.

Method.  Every code point is mapped to a small class through one lookup
table.  Word boundaries of the byte-level pattern (contractions, optionally
space-prefixed letter / number / symbol runs, white space that leaves its last
character to the next word) form a finite automaton over those classes; its
transition functions generate a small monoid, so the state before every
character is an associative prefix scan, done block-wise in numpy with one
composition-table gather per character.  No regular expression runs.  The
slices between boundaries are looked up by hash in a bounded word cache, and
every hit is compared with the word it stands for; the words that miss, and
those whose hash belongs to another word, are merged together, one vectorised
round per merge rank.  Token byte lengths tile each text, so offsets and
decoding are exact.

Defined results: null text counts as empty (no ids); an empty text has no ids;
texts may be arbitrarily long; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.hashing import run_hashes

# character classes
LETTER, NUMBER, OTHER, SPACE_LAST, WS_LAST, WS_MID, APOS_1, APOS_2, SEP = range(9)
# automaton states (what the previous character left behind)
S_START, S_L, S_N, S_O, S_PENDING, S_WS, S_C2, S_C1 = range(8)
_NO_RANK = np.int64(1 << 40)
_LONG_WORD = 256


def _step(state: int, cls: int) -> tuple[int, bool]:
    """Automaton: (state after the character, does a word start at it)."""
    if cls == LETTER:
        if state == S_C2:
            return S_C1, False
        if state == S_C1:
            return S_START, False
        return S_L, state not in (S_L, S_PENDING)
    if cls == NUMBER:
        return S_N, state not in (S_N, S_PENDING)
    if cls == OTHER or (cls in (APOS_1, APOS_2) and state in (S_O, S_PENDING)):
        return S_O, state not in (S_O, S_PENDING)
    if cls == APOS_1:
        return S_C1, True
    if cls == APOS_2:
        return S_C2, True
    if cls == SPACE_LAST:
        return S_PENDING, True
    if cls == WS_MID:
        return S_WS, state != S_WS
    return S_START, True  # WS_LAST, SEP


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(generator of each class, composition table, state reached from START
    and from every state by each element, start flag by state and class)."""
    gens = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    elements = list(dict.fromkeys([tuple(range(8)), *gens]))
    known = {e: i for i, e in enumerate(elements)}
    for e in elements:  # grows while iterating: closure under the generators
        for g in gens:
            f = tuple(g[s] for s in e)
            if f not in known:
                known[f] = len(elements)
                elements.append(f)
    m = len(elements)
    assert m <= 16  # one composition is one byte: left element * 16 + right element
    compose = np.zeros((m, 16), np.uint8)
    for i, e in enumerate(elements):
        for j, f in enumerate(elements):
            compose[i, j] = known[tuple(f[s] for s in e)]
    starts = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)], bool)
    return np.array([known[g] for g in gens], np.uint8), compose, np.array(elements, np.uint8), starts


_GEN, _COMPOSE, _APPLY, _STARTS = _monoid()
_COMPOSE_FLAT = _COMPOSE.ravel()


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    # the White_Space property (fixed values)
    for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = WS_MID
    return table


_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _class_table()
    return _CLASSES


def _exclusive_scan(elements: np.ndarray, width: int = 64) -> np.ndarray:
    """State before each element when starting in START: associative scan."""
    n = len(elements)
    blocks = -(-n // width)
    cols = np.zeros(blocks * width, np.uint8)
    cols[:n] = elements
    cols = np.ascontiguousarray(cols.reshape(blocks, width).T)
    acc = np.empty_like(cols)
    acc[0] = cols[0]
    for j in range(1, width):
        acc[j] = _COMPOSE_FLAT[(acc[j - 1] << 4) | cols[j]]
    entry = np.zeros(1, np.uint8) if blocks == 1 else _exclusive_scan(acc[-1], width)
    out = np.empty((width, blocks), np.uint8)
    out[0] = entry
    for j in range(1, width):
        out[j] = _APPLY[acc[j - 1], entry]
    return np.ascontiguousarray(out.T).ravel()[:n]


def word_starts(cps: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Positions (code points) at which words start; every separator position
    is a word of its own and isolates what stands on its two sides."""
    n = len(cps)
    cls = _classes()[cps]
    cls[separators] = SEP
    ws = np.flatnonzero(cls == WS_MID)
    nxt = np.full(len(ws), SEP, np.uint8)
    inner = ws + 1 < n
    nxt[inner] = cls[ws[inner] + 1]
    last = ws[(nxt != WS_MID) & (nxt != SEP)]
    ap = np.flatnonzero((cps == 39) & (cls == OTHER))
    if len(ap):
        pad = np.concatenate([np.where(cls == SEP, 0, cps), np.zeros(2, np.uint32)])
        a, b = pad[ap + 1], pad[ap + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        cls[ap[one]] = APOS_1
        cls[ap[two]] = APOS_2
    cls[last] = np.where(cps[last] == 32, SPACE_LAST, WS_LAST)
    state = _exclusive_scan(_GEN[cls])
    return np.flatnonzero(_STARTS[state, cls])


class BpeEncoder:
    """Encoder and decoder for one rank file.

    ``cache_words`` bounds the word cache of one Python worker; ``vocabulary``
    keeps the first so many ranks only."""

    def __init__(self, ranks_path: str, cache_words: int = 1_000_000, vocabulary: int | None = None):
        self.tokens: list[bytes] = []
        ranks: dict[bytes, int] = {}
        with open(ranks_path, "rb") as f:
            for line in f:
                if line.strip():
                    word, rank = line.split()
                    if vocabulary is None or int(rank) < vocabulary:
                        ranks[base64.b64decode(word)] = int(rank)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.tokens[rank] = word
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.token_bytes = np.array([len(t) for t in self.tokens], np.int64)
        self._byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        get = ranks.get
        for word, rank in ranks.items():
            for k in range(1, len(word)):
                a, b = get(word[:k]), get(word[k:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    values.append(rank)
        self._build_pairs(np.array(keys, np.uint64), np.array(values, np.int64))
        self.cache_words = cache_words
        self._clear()

    # -- pair ranks: open addressing, looked up in vectors -------------------
    def _build_pairs(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._slot_key = np.full(1 << bits, np.uint64(2**64 - 1))
        self._slot_value = np.full(1 << bits, _NO_RANK)
        slot, left, self._probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self._probes += 1
            at = slot[left]
            free = self._slot_key[at] == np.uint64(2**64 - 1)
            self._slot_key[at[free]] = keys[left[free]]
            placed = self._slot_key[at] == keys[left]
            self._slot_value[at[placed]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = ((a << 20) | b).astype(np.uint64)
        slot = self._slot(keys)
        out = np.where(self._slot_key[slot] == keys, self._slot_value[slot], _NO_RANK)
        todo = np.flatnonzero((self._slot_key[slot] != keys) & (self._slot_key[slot] != np.uint64(2**64 - 1)))
        for _ in range(1, self._probes):
            if not len(todo):
                break
            at = slot[todo] = (slot[todo] + 1) & self._mask
            held = self._slot_key[at]
            hit = held == keys[todo]
            out[todo[hit]] = self._slot_value[at[hit]]
            todo = todo[~hit & (held != np.uint64(2**64 - 1))]
        return out

    # -- word cache: words and their ids, found by 64-bit hashes in an open-addressing table --
    def _clear(self) -> None:
        self._count = self._used = self._chars_used = 0
        self._pool = np.zeros(1 << 16, np.int32)  # ids of the words
        self._chars = np.zeros(1 << 16, np.uint32)  # code points of the words
        self._word_key = np.zeros(1 << 14, np.uint64)
        self._offset, self._length = np.zeros((2, 1 << 14), np.int32)
        self._char_offset, self._char_length = np.zeros((2, 1 << 14), np.int32)
        self._table_bits = int(self.cache_words * 5 // 2).bit_length()
        self._table = np.full(1 << self._table_bits, -1, np.int32)

    def _shrink(self) -> None:
        """Past the bound: the older half of the words stays (frequent words come early)."""
        self._count //= 2
        self._used = int(self._offset[self._count - 1] + self._length[self._count - 1])
        self._chars_used = int(self._char_offset[self._count - 1] + self._char_length[self._count - 1])
        self._table.fill(-1)
        self._insert(np.arange(self._count))

    def _table_slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._table_bits)).astype(np.int64)

    def _insert(self, entries: np.ndarray) -> None:
        slot, mask = self._table_slot(self._word_key[entries]), (1 << self._table_bits) - 1
        while len(entries):
            free = self._table[slot] < 0
            self._table[slot[free]] = entries[free]
            left = self._table[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Cache entry of each word hash, or -1."""
        slot, mask = self._table_slot(keys), (1 << self._table_bits) - 1
        out = self._table[slot]
        todo = np.flatnonzero((out >= 0) & (self._word_key[out] != keys))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & mask
            out[todo] = found = self._table[at]
            on = (found >= 0) & (self._word_key[found] != keys[todo])
            todo, at = todo[on], at[on]
        return out

    def _add(self, keys: np.ndarray, words: list[str], findable: bool = True) -> np.ndarray:
        """Entries of new words; those not ``findable`` serve the batch at hand only."""
        ids, lengths = self.merge_words([w.encode("utf-8", "surrogatepass") for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        base, end = self._count, self._count + len(words)
        grow = lambda a, n: np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)]) if n > len(a) else a
        self._pool = grow(self._pool, self._used + len(ids))
        self._chars = grow(self._chars, self._chars_used + len(chars))
        self._word_key, self._offset, self._length = (grow(a, end) for a in (self._word_key, self._offset, self._length))
        self._char_offset, self._char_length = (grow(a, end) for a in (self._char_offset, self._char_length))
        self._pool[self._used : self._used + len(ids)] = ids
        self._chars[self._chars_used : self._chars_used + len(chars)] = chars
        self._word_key[base:end] = keys
        self._length[base:end], self._char_length[base:end] = lengths, sizes
        self._offset[base:end] = self._used + np.cumsum(lengths) - lengths
        self._char_offset[base:end] = self._chars_used + np.cumsum(sizes) - sizes
        self._used += len(ids)
        self._chars_used += len(chars)
        self._count = end
        added = np.arange(base, end)
        if findable:
            if end * 2 > len(self._table):  # one batch with more new words than the bound
                self._table_bits = (end * 4).bit_length()
                self._table = np.full(1 << self._table_bits, -1, np.int32)
                base = 0
            self._insert(np.arange(base, end))
        return added

    def _different(self, entry: np.ndarray, cps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """True for words that are not the word of their cache entry."""
        wrong = self._char_length[entry] != sizes
        held = self._chars.take(np.repeat(self._char_offset[entry] - starts, sizes) + np.arange(len(cps)), mode="clip")
        wrong[np.searchsorted(starts, np.flatnonzero(held != cps), "right") - 1] = True
        return wrong

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, concatenated, and the id count of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero(sizes <= _LONG_WORD)
        done: list[tuple[np.ndarray, np.ndarray]] = [
            (np.full(len(ids), i, np.int64), ids)
            for i in np.flatnonzero(sizes > _LONG_WORD)
            for ids in [np.array(self._merge_long(words[i]), np.int64)]
        ]
        data = b"".join([words[i] for i in short]) if len(short) < len(words) else b"".join(words)
        sym = self._byte_ids[np.frombuffer(data, np.uint8)]
        word = np.repeat(short, sizes[short])
        while len(sym):
            n = len(sym)
            rank = np.full(n, _NO_RANK)
            if n > 1:
                inner = np.flatnonzero(word[1:] == word[:-1])
                rank[inner] = self._pair_ranks(sym[inner], sym[inner + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, n))
            least = np.repeat(best, counts)
            over = least == _NO_RANK
            if over.any():
                done.append((word[over], sym[over]))
                keep = ~over
                sym, word, rank, least = sym[keep], word[keep], rank[keep], least[keep]
                if not len(sym):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # overlapping occurrences: leftmost first
                head = np.concatenate([[True], np.diff(at) != 1])
                run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _merge_long(self, word: bytes) -> list[int]:
        """One long word: linked list and heap, O(n log n)."""
        parts: list[bytes | None] = [bytes([b]) for b in word]
        n, get = len(parts), self.ranks.get
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, both = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if (r := get(both + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, both + parts[k]))
            if (p := prev[i]) >= 0 and (r := get(parts[p] + both)) is not None:
                heapq.heappush(heap, (r, p, parts[p] + both))
        return [self.ranks[p] for p in parts if p is not None]

    # -- public ------------------------------------------------------------------
    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated (int32), and the id count of each."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self._count > self.cache_words:
            self._shrink()
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1  # positions of the separators, one after each text
        text = "\n".join(texts) + "\n"
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = word_starts(cps, ends)
        stops = np.append(starts[1:], len(cps))
        keys = run_hashes(cps, stops - starts)
        at = np.searchsorted(starts, ends)
        entry = self._find(keys)
        entry[at] = 0
        missed = np.flatnonzero(entry < 0)
        word = lambda own: [text[a:b] for a, b in zip(starts[own].tolist(), stops[own].tolist(), strict=True)]
        if len(missed):
            new, first = np.unique(keys[missed], return_index=True)
            self._add(new, word(missed[first]))
            entry[missed] = self._find(keys[missed])
        wrong = self._different(entry, cps, starts, stops - starts)
        wrong[at] = False
        other = np.flatnonzero(wrong)
        if len(other):
            plain = {w: i for i, w in enumerate(dict.fromkeys(word(other)))}
            added = self._add(np.zeros(len(plain), np.uint64), list(plain), findable=False)
            entry[other] = added[[plain[w] for w in word(other)]]
        lengths = self._length[entry]
        lengths[at] = 0
        total = np.cumsum(lengths, dtype=np.int64)
        n = int(total[-1])
        jump = np.repeat(self._offset[entry] - total + lengths, lengths)
        ids = self._pool[jump + np.arange(n)]
        return ids, np.diff(total[at], prepend=0)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text, and the end of the last."""
        return np.concatenate([[0], np.cumsum(self.token_bytes[ids])])


_ENCODERS: dict[tuple[str, int], BpeEncoder] = {}


def encoder(ranks_path: str, cache_words: int = 1_000_000) -> BpeEncoder:
    """The encoder of this Python worker (built once a worker)."""
    key = (ranks_path, cache_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = BpeEncoder(ranks_path, cache_words)
    return _ENCODERS[key]


def slices(texts: list[str], chars: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``chars`` code points each."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 1_000_000) -> DataFrame:
    """(id, ids array<int>, offsets array<int>): token ids of every text and the byte offset at
    which each token starts.  Null text: both empty.  Extra columns of ``docs`` are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, cache_words)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids, counts = enc.encode_batch(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                size = enc.token_bytes[ids]
                at = np.cumsum(size) - size
                at = at - np.repeat(at[np.minimum(ends[:-1], max(len(at) - 1, 0))] if len(at) else np.zeros(len(counts), np.int64), counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, at.astype(np.int32))],
                    names=["id", "ids", "offsets"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, offsets array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the bytes of each array of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            data = [enc.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, "id " + kind + ", decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks_path: str, cache_words: int = 1_000_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass;
    token offsets cut the decoded bytes of a slice into those of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, cache_words)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts_all: list[np.ndarray] = []
            ids_sha: list[str] = []
            text_sha: list[str] = []
            for a, b in slices(texts):
                ids, counts = enc.encode_batch(texts[a:b])
                flat, at, ends = ids.tolist(), 0, np.cumsum(counts)
                data, offsets, begin = enc.decode(flat), enc.offsets(ids)[ends].tolist(), 0
                for end, stop in zip(ends.tolist(), offsets, strict=True):
                    ids_sha.append(hashlib.sha256(" ".join(map(enc.decimal.__getitem__, flat[at:end])).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(data[begin:stop]).hexdigest())
                    at, begin = end, stop
                counts_all.append(counts)
            n_tokens = np.concatenate(counts_all) if counts_all else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
