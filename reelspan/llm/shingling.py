"""Word n-grams of many texts at once, as sorted distinct 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that are hashed in one stretch; a longer word makes its stretch longer.
STRETCH = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def factors(size: int) -> np.ndarray:
    """A pseudo-random factor for each place in a word."""
    return mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of lower-cased bytes, words parted by ASCII white space. A hash is the sum of the
    bytes, each times the factor of its place: unlike powers of a base, the factors of neighbouring places have nothing
    in common, so no regular pattern of letters makes unequal words collide."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + STRETCH, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        inside = ~_SPACE[part]
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
        first, length = edges[::2], edges[1::2] - edges[::2]
        if len(first):
            ends = length.cumsum()
            place = np.arange(ends[-1]) - np.repeat(ends - length, length)
            factor = factors(1 << max(12, int(length.max()).bit_length()))
            sums = np.add.reduceat((part[inside].astype(np.uint64) + np.uint64(1)) * factor[place], ends - length)
            starts.append(first + at)
            hashes.append(mixed(sums + length.astype(np.uint64)))
        at = end
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(bodies: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams, A-Z in lower case; with fewer
    words the whole sequence is the only one, without words there is none."""
    starts, hashes = word_hashes(b"\n".join(bodies).lower())
    offsets = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    bounds = np.searchsorted(starts, offsets)
    size = max(len(hashes) - words + 1, 0)
    grams = np.full(size, words, dtype=np.uint64)
    for i in range(words):
        grams = mixed(grams * np.uint64(_BASE) + hashes[i : i + size])
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= words:
            own = grams[low : high - words + 1]
        elif high > low:
            own = np.full(1, high - low, dtype=np.uint64)
            for h in hashes[low:high]:
                own = mixed(own * np.uint64(_BASE) + h)
        else:
            own = grams[:0]
        own = np.sort(own.view(np.int64))
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
    return out
