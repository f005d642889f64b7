"""Five-word shingles of whole texts as 64-bit hashes, for many texts at once.

Words are runs of other bytes than the ASCII white space 0x09-0x0D and 0x20, with A-Z in lower case. All
work is on the bytes of a batch of texts, in NumPy: a word's hash is a polynomial in its bytes (each replaced by
a random number), taken from running sums, and a shingle's hash mixes the hashes of its words by position.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_random = np.random.Generator(np.random.PCG64(20_240_607))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _i in range(65, 91):
    _BYTE[_i] = _BYTE[_i + 32]
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_CACHE: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    kept = _CACHE.get(int(base))
    if kept is None or len(kept) < n:
        out = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        out[0] = 1
        kept = np.multiply.accumulate(out)
        if n <= 1 << 20:
            _CACHE[int(base)] = kept
    return kept[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, the number of its words."""
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    gap = _GAP[data]
    edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))  # starts and ends in turn
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, borders), prepend=0)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted. A text of fewer words, but not none, is one shingle."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for i in range(size if len(rolled) else 0):
        rolled += mix(hashes[i : n - size + 1 + i] ^ _PLACE[i]) * _PLACE[size + i]
    rolled = mix(rolled)
    out, start = [], 0
    for count in counts.tolist():
        if count >= size:
            own = np.sort(rolled[start : start + count - size + 1])
            out.append(own[np.flatnonzero(np.diff(own, prepend=~own[:1]))])
        elif count:
            part = hashes[start : start + count]
            out.append(mix(np.sum(mix(part ^ _PLACE[:count]) * _PLACE[32 : 32 + count], keepdims=True) + np.uint64(count)))
        else:
            out.append(np.empty(0, np.uint64))
        start += count
    return out
