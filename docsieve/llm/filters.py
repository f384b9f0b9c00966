"""Bloom filters of a whole corpus for operators that look hashes up where they read the texts: filled in tasks, merged block by
block, with counts of how often a hash occurs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsieve.llm.lines import has_bits, positions, set_bits

#: Bits of a filter and of one block of it; two bits a key. So many bits share a counter.
FILTER_BITS, BLOCK_BITS, SHARED = 1 << 28, 1 << 16, 4
#: Share of a twice-seen filter that may be set: at this one a quarter of the once-seen keys pass. A corpus that sets more
#: has its hashes counted exactly instead, see ``crowded``; what is found is the same.
MAX_FILL = 0.5
BLOCK_BYTES, BLOCK_CELLS = BLOCK_BITS // 8, BLOCK_BITS // SHARED


def crowded(filled: np.ndarray, max_fill: float) -> bool:
    """Whether a filter has so many bits set that it screens little."""
    return int(np.bitwise_count(filled).sum(dtype=np.int64)) > max_fill * 8 * len(filled)


def set_places(filled: np.ndarray) -> np.ndarray:
    """The places of the set bits of a packed array; the work is that of the bytes that have any."""
    some = np.flatnonzero(filled)
    byte, bit = np.nonzero(np.unpackbits(filled[some], bitorder="little").reshape(-1, 8))
    return some[byte] * 8 + bit


def packed(places: np.ndarray) -> bytes:
    """Places in a block as they are, or as a bitmap where that is fewer bytes."""
    if 2 * len(places) < BLOCK_BYTES:
        return places.astype(np.uint16).tobytes()
    block = np.zeros(BLOCK_BYTES, np.uint8)
    set_bits(block, places)
    return block.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return set_places(np.frombuffer(data, np.uint8)) if len(data) == BLOCK_BYTES else np.frombuffer(data, np.uint16).astype(np.int64)


def twice_filter(hashes: DataFrame, bits: int, often: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed filters of the keys that ``hashes`` (key, how many of it a row stands for) may hold twice or more, and of those that
    it may hold ``often`` times, whatever tasks they are in. Of the second one a bit stands for SHARED bits of the first.

    Each task fills its filters and counters and emits the blocks that have bits; counters only where they say more than the bits
    do. Blocks are merged apart from each other, counts added up. Only the finished filters, of ``bits`` / 8 bytes at most
    whatever the input, come to the driver.
    """

    def fill(batches):
        once, twice, cells = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), np.zeros(bits // SHARED, np.uint8)
        for batch in batches:
            h, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for at in positions(h, bits):
                order = np.argsort(at, kind="stable")
                at, times = summed(at[order], n[order])
                set_bits(twice, at[has_bits(once, at) | (times > 1)])
                set_bits(once, at)
                cell, times = summed(at // SHARED, times)
                cells[cell] = np.minimum(cells[cell] + times, 255)
        seen, again = set_places(once), set_places(twice)
        cell, implied = summed(seen // SHARED, np.ones(len(seen), np.int64))
        np.add.at(implied, np.searchsorted(cell, again // SHARED), 1)
        more = cell[cells[cell] > implied]
        blocks = np.unique(seen // BLOCK_BITS)
        for some in np.array_split(blocks, max(1, len(blocks) // 256)):
            own = lambda x, size: [x[i:j] - b * size for b, i, j in zip(some.tolist(), np.searchsorted(x, some * size), np.searchsorted(x, (some + 1) * size), strict=True)]  # noqa: E731, B023
            listed = own(more, BLOCK_CELLS)
            counts = [cells[c + b * BLOCK_CELLS].tobytes() for c, b in zip(listed, some.tolist(), strict=True)]
            binary = [map(packed, own(seen, BLOCK_BITS)), map(packed, own(again, BLOCK_BITS)), (c.astype(np.uint16).tobytes() for c in listed), counts]
            yield pa.record_batch([pa.array(some), *(pa.array(list(x), pa.binary()) for x in binary)], ["block", "once", "twice", "cells", "counts"])

    def merge(key, batches):
        once, twice, total = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_CELLS, np.int64)
        for batch in batches:
            for o, t, c, n in zip(*(batch.column(x).to_pylist() for x in ("once", "twice", "cells", "counts")), strict=True):
                o, t, c = unpacked(o), unpacked(t), np.frombuffer(c, np.uint16)
                twice[o[once[o]]] = True
                twice[t] = True
                once[o] = True
                own = np.bincount(np.r_[o, t] // SHARED, minlength=BLOCK_CELLS)
                own[c] = np.frombuffer(n, np.uint8)
                total += own
        if twice.any():
            many = np.packbits(total >= often, bitorder="little")
            yield pa.record_batch([pa.array([key[0].as_py()], pa.int64()), pa.array([packed(np.flatnonzero(twice))], pa.binary()), pa.array([many.tobytes()], pa.binary())], ["block", "twice", "many"])

    filled = hashes.mapInArrow(fill, "block long, once binary, twice binary, cells binary, counts binary")
    # Blocks are spread over the shuffle partitions and merged one after the other in each.
    spread = filled.repartition("block").sortWithinPartitions("block").mapInArrow(_by_block(merge), "block long, twice binary, many binary")
    whole = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8 // SHARED, np.uint8)
    for row in spread.toLocalIterator():
        set_bits(whole[0], unpacked(bytes(row.twice)) + row.block * BLOCK_BITS)
        whole[1][row.block * BLOCK_CELLS // 8 : (row.block + 1) * BLOCK_CELLS // 8] = np.frombuffer(bytes(row.many), np.uint8)
    return whole


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of sorted keys, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(counts, heads)


def frequent_bits(many: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return has_bits(many, a // SHARED) & has_bits(many, b // SHARED)


def _by_block(merge):
    """Hand runs of equal first column to ``merge(key, batches)``."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            values = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(values)) + 1, len(values)] if len(values) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key is not None and key.as_py() != values[a]:
                    yield from merge((key,), held)
                    held = []
                key = batch.column(0)[int(a)]
                held.append(batch.slice(a, b - a))
        if held:
            yield from merge((key,), held)

    return run
