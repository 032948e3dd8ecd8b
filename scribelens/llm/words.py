"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEEDED = np.random.default_rng(20240601)
_BYTE = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_SEEDED.integers(2**40, 2**62)) * 2 + 1
_BACK = pow(_STEP, -1, 2**64)

#: Letters, digits and all above ASCII stay (A-Z in lower case), the rest becomes 0.
KEEP = np.zeros(256, np.uint8)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    KEEP[_c] = _c
for _c in range(0x41, 0x5B):
    KEEP[_c] = _c + 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept while small."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 12), np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if len(have) <= 5 << 20:
            _powers[base] = have
    return have[:n]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alphanumeric words of the texts that lie in ``data`` at ``at``.

    Returns the lower-cased bytes, each word's start and end, the number of words before
    each text (one more entry for the total), and a hash for each word.
    """
    low = KEEP[data]
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(len(at), np.int64), none.astype(np.uint64)
    inside = low != 0
    edges = at[:-1][at[:-1] < at[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_of = at[1:][at[:-1] < at[1:]] - 1
    last[ends_of] = inside[ends_of]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * powers(_STEP, n), out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(_BACK, n)[starts])
    return low, starts, ends, np.searchsorted(starts, at), hashes


def grams(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash for each k words in a row (whatever text they are of)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out = out * _MULTIPLIER + hashes[j : j + n]
    return mixed(out)


def starts_within(at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the k-word windows that don't leave their text, and the text of each."""
    room = np.maximum(np.diff(at) - k + 1, 0)
    text = np.repeat(np.arange(len(room)), room)
    before = np.cumsum(room) - room
    return np.arange(int(room.sum())) - before[text] + at[:-1][text], text
