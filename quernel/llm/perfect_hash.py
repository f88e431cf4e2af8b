"""A minimal perfect hash of 64-bit keys over fixed-width rows, in memory or read by seeks.

The hash has levels of bit arrays: a key's place in a level is a hash of it, and
a key that is alone at its place stops there; the others go on to the next
level.  A key's slot is the number of set bits before its own.  Bits lie in
blocks of 512 behind the number of set bits before them, so a level costs one
block however many keys there are.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that is left.
GAMMA = 2.0
#: After so many levels the keys that are left are kept as a sorted list.
LEVELS = 40
BLOCK = np.dtype([("before", "<u8"), ("bits", "<u8", (8,))])
BLOCK_BITS = 512
LEVEL = np.dtype([("size", "<i8"), ("block", "<i8")])
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of int64 keys; for one seed, different keys have different ones."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64(seed * GOLDEN & MASK)
    for shift, factor in zip((30, 27), FACTORS):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _unshifted(x: np.ndarray, shift: int) -> np.ndarray:
    out = x
    for _ in range(64 // shift):
        out = x ^ (out >> np.uint64(shift))
    return out


def unmixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The keys of ``mix(keys, seed)``."""
    x = _unshifted(hashes.astype(np.uint64), 31)
    for shift, factor in zip((27, 30), reversed(FACTORS)):
        x = _unshifted(x * np.uint64(pow(factor, -1, 1 << 64)), shift)
    return (x - np.uint64(seed * GOLDEN & MASK)).view(np.int64)


class Rows:
    """Fixed-width rows of a file: each row is one seek and one read, unless they are loaded."""

    def __init__(self, file, at: int, dtype: np.dtype, n: int):
        self.file, self.at, self.dtype, self.n, self.held = file, at, dtype, n, None

    @classmethod
    def of(cls, values: np.ndarray) -> Rows:
        out = cls(None, 0, values.dtype, len(values))
        out.held = values
        return out

    def load(self) -> Rows:
        if self.held is None:
            self.held = self._read(0, self.n)
        return self

    def _read(self, first: int, n: int) -> np.ndarray:
        self.file.seek(self.at + first * self.dtype.itemsize)
        data = self.file.read(n * self.dtype.itemsize)
        if len(data) != n * self.dtype.itemsize:
            raise ValueError("the file ends early")
        return np.frombuffer(data, self.dtype)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        if self.held is not None:
            return self.held[index]
        return np.concatenate([np.zeros(0, self.dtype), *(self._read(int(i), 1) for i in index)])

    def __len__(self) -> int:
        return self.n


class PerfectHash:
    """Distinct int64 keys to 0 .. n-1, without the keys."""

    def __init__(self, levels: np.ndarray, blocks: Rows, rest: Rows, placed: int):
        """levels: LEVEL rows; blocks: BLOCK rows; rest: sorted keys beyond the levels; placed: keys within them."""
        self.levels, self.blocks, self.rest, self.placed = levels, blocks, rest, placed

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, words, held, keys = [], [], 0, np.asarray(keys, np.int64)
        while len(keys) and len(levels) < LEVELS:
            size = max(64, int(len(keys) * GAMMA))
            at = (mix(keys, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.zeros(-(-size // BLOCK_BITS) * BLOCK_BITS, bool)
            alone[:size] = np.bincount(at, minlength=size) == 1
            levels.append((size, held))
            words.append(np.packbits(alone, bitorder="little").view("<u8").reshape(-1, 8))
            held += len(words[-1])
            keys = keys[~alone[at]]
        blocks = np.zeros(held, BLOCK)
        if held:
            blocks["bits"] = np.concatenate(words)
        counts = np.bitwise_count(blocks["bits"]).sum(axis=1, dtype=np.uint64) if held else np.zeros(0, np.uint64)
        blocks["before"] = np.cumsum(counts) - counts
        return cls(np.array(levels, LEVEL), Rows.of(blocks), Rows.of(np.sort(keys)), int(counts.sum()))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot or -1 for a key that wasn't there at the build."""
        keys = np.asarray(keys, np.int64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, level in enumerate(self.levels):
            if not len(left):
                return out
            at = (mix(keys[left], n + 1) % np.uint64(level["size"])).astype(np.int64)
            block = self.blocks[level["block"] + at // BLOCK_BITS]
            word, bit = at // 64 % 8, (at % 64).astype(np.uint64)
            bits = block["bits"]
            own = bits[np.arange(len(at)), word]
            hit = (own >> bit & np.uint64(1)).astype(bool)
            below = np.where(np.arange(8) < word[:, None], np.bitwise_count(bits), 0).sum(axis=1)
            inside = np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (block["before"].astype(np.int64) + below + inside)[hit]
            left = left[~hit]
        for i in left if len(self.rest) else ():
            low, high = 0, len(self.rest)
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if self.rest[np.array([middle])][0] < keys[i] else (low, middle)
            if low < len(self.rest) and self.rest[np.array([low])][0] == keys[i]:
                out[i] = self.placed + low
        return out
