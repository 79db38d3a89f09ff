"""Word n-gram hashes and MinHash signatures of many texts at once (numpy)."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np

from weftgraph.llm.hashing import mix, run_hashes

_WORD: np.ndarray | None = None


def word_table() -> np.ndarray:
    """True for letters, numbers, marks and the underscore."""
    global _WORD
    if _WORD is None:
        _WORD = np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)])
        _WORD[ord("_")] = True
    return _WORD


def _marked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, which are inside words, word starts, word ends, the end of each text)."""
    low = [t.lower() for t in texts]
    cps = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_table()[cps]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last character is no word
    return cps, inside, starts, ends, np.cumsum([len(t) + 1 for t in low])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the number of words of each text."""
    cps, inside, starts, ends, stops = _marked(texts)
    return run_hashes(cps[inside], ends - starts), np.diff(np.searchsorted(starts, stops), prepend=0)


def words_and_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, and a 128-bit cryptographic digest of each text's words themselves, as two columns."""
    cps, inside, starts, ends, stops = _marked(texts)
    kept = inside.copy()
    kept[ends] = True  # what follows a word parts it from the next
    plain = np.where(inside, cps, 0)[kept].tobytes()
    at = np.concatenate([[0], np.cumsum(kept)[stops - 1] * 4]).tolist()
    digests = b"".join(hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True))
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    return run_hashes(cps[inside], ends - starts), counts, np.frombuffer(digests, np.int64).reshape(-1, 2)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams (with repeats) and their number in each text.  A text of
    fewer words has one n-gram, all its words; a text without words has none."""
    n = len(hashes)
    number = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
    left = np.repeat(np.minimum(counts, size), number)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        word = padded[at + k]
        if (counts < size).any():
            word = np.where(left > k, word, np.uint64(0))
        out = out * np.uint64(0xD6E8FEB86659FD93) + word
    return (mix(out) if n else out), number


def multipliers(k: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(grams: np.ndarray, number: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(texts, k) minima of k hash functions; texts without n-grams hold the largest value."""
    out = np.full((len(number), len(factors)), np.iinfo(np.uint32).max, np.uint32)
    full = np.flatnonzero(number)
    if len(full):
        first = (np.cumsum(number) - number)[full]
        for k, factor in enumerate(factors):
            out[full, k] = np.minimum.reduceat((grams * factor) >> np.uint64(32), first)
    return out


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) hash of each band of ``rows`` minima."""
    bands = signatures.shape[1] // rows
    x = signatures[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(x), 1))
    for r in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + x[:, :, r])
    return out
