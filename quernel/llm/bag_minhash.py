"""BagMinHash signatures: unbiased for the weighted Jaccard similarity of multisets.

An item of weight w owns Poisson points over time and weight; each lands in one
of the signature's slots, and a slot keeps its earliest point.  The weight axis
is discretised to whole numbers and split into dyadic intervals, (0, 1], (1, 2],
(2, 4], (4, 8] and so on, each a process of its own whose rate is its width, so
an item starts only about log2(w) of them.  A point within an interval finds its
unit by bits, half after half, and counts if that unit is at most w.

Points are made in the order of time and only up to a text's horizon, by which
all slots are almost surely taken; a text with a slot left gets a longer horizon.
So the result is exactly that of the endless processes.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

#: Words of a shingle; slots of a signature; slots of a band.
WORDS, SLOTS, ROWS = 5, 80, 4
SLACK = 4.0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
KEPT = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, memoised under a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> list[int]:
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > KEPT:
                self.known.clear()
            for i, v in enumerate(got):
                if v is None:
                    got[i] = self.known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return got


def shingle_hashes(texts: list[bytes], hashes: WordHashes, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every shingle; a text of fewer words has one, of all its words."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter(chain.from_iterable(map(hashes.of, split)), np.uint64, int(sizes.sum()))
    sums = np.zeros(len(flat), np.uint64)
    factor = np.uint64(1)
    for k in range(min(words, len(flat))):
        sums[: len(flat) - k] += flat[k:] * factor
        factor = np.uint64((int(factor) * int(GOLDEN) + 2) % 2**64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    full = at + words <= np.repeat(sizes, sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    out_owner, out_hash = owner[full], mix(sums[full] ^ np.uint64(words))
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        own = np.array([xxhash.xxh3_64_intdigest(b" ".join(split[i])) for i in short], np.uint64)
        out_owner, out_hash = np.concatenate([out_owner, short]), np.concatenate([out_hash, own])
    return out_owner, out_hash


def weighted(owner: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, item) with their number."""
    key = mix(item + owner.astype(np.uint64) * GOLDEN)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return owner[first], item[first], count


def signatures(owner: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n rows of slots: the time of each slot's earliest point, as bits; all ones for an owner without items."""
    times = np.full((n, slots), np.inf)
    total = np.bincount(owner, weight, n)
    horizon = np.full(n, np.log(slots) + SLACK) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        times[todo] = np.inf
        _run(times, owner[mine], item[mine], weight[mine], horizon, slots)
        todo &= np.isinf(times).any(axis=1)
        horizon[todo] *= 2
    return times.view(np.uint64)


def _run(times: np.ndarray, owner: np.ndarray, item: np.ndarray, weight: np.ndarray, horizon: np.ndarray, slots: int) -> None:
    level, width = 0, 1
    while len(owner):
        _points(times, owner, mix(item + np.uint64((level + 1) * int(GOLDEN) % 2**64)), weight, horizon, slots, level, width)
        low = width if level else 1
        more = weight > low  # the next interval is (low, 2 * low]
        owner, item, weight = owner[more], item[more], weight[more]
        level, width = level + 1, 2 * low if level else 2


def _points(times, owner, seed, weight, horizon, slots, level, high) -> None:
    """All points of one interval's processes up to the horizons; high: the interval's upper end."""
    units = 1 if level == 0 else high // 2
    low = high - units
    flat = times.reshape(-1)
    at, limit, rate = np.zeros(len(owner)), horizon[owner], slots * units
    while len(owner):
        seed = seed + GOLDEN
        bits = mix(seed)
        at = at - np.log1p(-(bits >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        live = at <= limit
        owner, seed, weight, at, limit = owner[live], seed[live], weight[live], at[live], limit[live]
        place = mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        slot = ((place >> np.uint64(40)) * np.uint64(slots) >> np.uint64(24)).astype(np.int64)
        if units == 1:
            np.minimum.at(flat, owner * slots + slot, at)
        else:
            unit = low + 1 + (place & np.uint64(units - 1)).astype(np.int64)
            taken = unit <= weight
            np.minimum.at(flat, (owner * slots + slot)[taken], at[taken])


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; equal bands have equal keys."""
    n, slots = signature.shape
    parts = signature.reshape(n, slots // rows, rows)
    key = np.zeros((n, slots // rows), np.uint64)
    for r in range(rows):
        key = mix(key * GOLDEN + parts[:, :, r])
    return mix(key + np.arange(slots // rows, dtype=np.uint64) * GOLDEN).view(np.int64)


def multiset(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """A text's shingles as sorted distinct hashes of (shingle, how many before it)."""
    _, item = shingle_hashes([text], hashes, words)
    item.sort()
    if len(item):
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        if rank.any():
            item = np.sort(mix(item + rank.astype(np.uint64) * GOLDEN))
        else:
            item = np.sort(mix(item))
    return item


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)
