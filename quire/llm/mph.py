"""A minimal perfect hash over 64-bit keys, level by level, with fingerprints to tell strangers.

Each level is a bit array of `gamma` bits a key; keys that fall alone on a bit stay there, the others go to the
next level. A key's slot is the rank of its bit among all set bits, so n keys fill slots 0 to n - 1. Bits are stored in
records of 512 with the number of set bits before them, so a slot costs one record a level, wherever records are: in memory or in a file.

Defined cases: no keys, no levels, and every key is a stranger; keys must be distinct, negative ones are as good as others; a key that isn't in the
set has any slot or -1, and its fingerprint differs from that slot's but for one in 2^32.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

U = np.uint64
#: Bits of a record, and what of them lies before each.
_BITS = 512
RECORD = np.dtype([("rank", "<u8"), ("bits", "u1", _BITS // 8)])
_BEFORE = np.packbits(np.arange(_BITS)[None, :] < np.arange(_BITS)[:, None], axis=1)
#: Records at some places.
Take = Callable[[np.ndarray], np.ndarray]


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys.astype(U), 0x5EED) >> U(32)).astype(np.uint32)


def build(keys: np.ndarray, gamma: float = 2.0) -> tuple[list[int], list[np.ndarray]]:
    """Bits and records of each level, for distinct integers."""
    rest, sizes, records, total = keys.astype(U), [], [], 0
    while len(rest):
        size = max(8, int(len(rest) * gamma))
        at = (_hash(rest, len(sizes)) % U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=-(-size // _BITS) * _BITS) == 1
        level = np.zeros(len(alone) // _BITS, RECORD)
        level["bits"] = np.packbits(alone.reshape(-1, _BITS), axis=1)
        counts = alone.reshape(-1, _BITS).sum(axis=1)
        level["rank"] = total + np.cumsum(counts) - counts
        total += int(counts.sum())
        sizes.append(size)
        records.append(level)
        rest = rest[~alone[at]]
    return sizes, records


def slots(keys: np.ndarray, sizes: Sequence[int], levels: Sequence[Take]) -> np.ndarray:
    """The slot of each key; of a key that isn't in the set, any slot or -1."""
    keys = keys.astype(U)
    out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level, (size, take) in enumerate(zip(sizes, levels, strict=True)):
        if not len(rest):
            break
        at = (_hash(keys[rest], level) % U(size)).astype(np.int64)
        records, bit = take(at // _BITS), at % _BITS
        hit = (records["bits"][np.arange(len(at)), bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
        records, bit = records[hit], bit[hit]
        out[rest[hit]] = records["rank"].astype(np.int64) + np.bitwise_count(records["bits"] & _BEFORE[bit]).sum(axis=1, dtype=np.int64)
        rest = rest[~hit]
    return out
