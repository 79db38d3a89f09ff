"""64-bit hashes of runs of code points, many at once (numpy)."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(cps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each of the consecutive runs that tile ``cps`` (``sizes`` code points each, none empty).

    Every pair of place and code point is scattered on its own before the sum, so no
    pattern of letters makes the terms of two words cancel, as powers of one base would."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    x = np.arange(len(cps), dtype=np.int64)
    x -= np.repeat(first, sizes)
    x <<= 21
    x |= cps
    return mix(np.add.reduceat(mix(x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)), first))
