"""Merging Burrows-Wheeler transforms of shards by interleave refinement.

Strings are taken as cyclic, so every rotation has a predecessor and no end marks are
needed; answers about prefixes of ``STEP * rounds`` bytes concern real substrings as long
as these end inside their string. Symbols are blocks of ``STEP`` bytes: the transform
holds the block before each rotation, and one round of refinement extends the sorted
prefix by a block. Each shard is sorted once, on its own; the merge only permutes shard
numbers.
"""

from __future__ import annotations

import numpy as np

STEP = 8
SHARD = 1 << 14  # rotations


def _keys(data: np.ndarray, base: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first block of every rotation as a number in byte order."""
    key = np.zeros(len(off), np.uint64)
    for i in range(STEP):
        key = key << np.uint64(8) | data[base + (off + i) % size]
    return key


def shard_transform(keys: np.ndarray, base: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of one shard's rotations, by prefix doubling; base counts from the shard's start."""
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    classes, width = int(rank.max()) + 1, STEP
    while classes < len(rank) and width < 2 * int(size.max()):
        pair = rank * len(rank) + rank[base + (off + width) % size]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        if int(rank.max()) + 1 == classes:
            break
        classes, width = int(rank.max()) + 1, 2 * width
    return np.argsort(rank, kind="stable")


def merge_transforms(symbols: np.ndarray, shard: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards after ``rounds`` blocks, and where prefixes part.

    ``symbols`` and ``shard`` hold the transforms one after the other. Returns for each
    place of the merged order the entry that stands there, and the round in which the
    place was first parted from the one before; -1 if they share all blocks.
    """
    n = len(symbols)
    entry = np.arange(n)
    common, block = np.full(n, -1, np.int16), np.zeros(n, np.int32)
    common[:1] = 0
    for r in range(rounds):
        symbol = symbols[entry]
        order = np.argsort(symbol, kind="stable")
        symbol, block, shard = symbol[order], block[order], shard[order]
        parted = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        fresh = np.flatnonzero(parted & (common[1:] < 0)) + 1
        common[fresh] = r
        block = np.zeros(n, np.int32)
        np.cumsum(parted, out=block[1:])
        # Within a shard, entries keep their order: its k-th place is its k-th entry.
        entry = np.empty(n, np.int64)
        entry[np.argsort(shard, kind="stable")] = np.arange(n)
    return entry, common


def repeated_starts(strings: list[bytes], weights: list[int], width: int) -> list[np.ndarray]:
    """For each string, which starts of its ``width``-byte substrings lie in an interval of
    the merged order that holds two occurrences or more, weights counted."""
    lengths = np.array([len(s) for s in strings])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64)
    base = np.repeat(ends - lengths, lengths)
    size = np.repeat(lengths, lengths)
    off = np.arange(len(data)) - base
    keys = _keys(data, base, off, size)
    # Whole strings to a shard, up to its size.
    shard_of = (ends - lengths) // SHARD
    orders, low = [], 0
    for number in np.unique(shard_of):
        high = int(ends[np.flatnonzero(shard_of == number)[-1]])
        orders.append(low + shard_transform(keys[low:high], base[low:high] - low, off[low:high], size[low:high]))
        low = high
    places = np.concatenate(orders)
    distinct, symbol = np.unique(keys, return_inverse=True)
    symbol = symbol.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
    before = base + (off - STEP) % size
    shard = np.repeat(np.unique(shard_of, return_inverse=True)[1], lengths)
    shard = shard.astype(np.uint8 if shard.max() < 256 else np.uint16)
    entry, common = merge_transforms(symbol[before[places]], shard[places], width // STEP)
    rotation = places[entry]
    interval = np.cumsum(common >= 0)
    real = off[rotation] + width <= size[rotation]
    weight = np.repeat(np.array(weights), lengths)[rotation] * real
    many = np.bincount(interval, weights=weight)[interval] >= 2
    flag = np.zeros(len(data), bool)
    flag[rotation] = many & real
    return [flag[e - n : e - width + 1] for n, e in zip(lengths, ends, strict=True)]
