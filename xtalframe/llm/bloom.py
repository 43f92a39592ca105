"""Pairs of Bloom filters, filled by tasks and merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_BITS = 19
MERGED_AT_ONCE = 1024
BLOCKS = "block int, part int, once binary, twice binary"


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)


def has(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    yes = np.ones(len(hashes), bool)
    for at in places(hashes, bits):
        yes &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return yes


class Filters:
    """Bits of the keys seen once and of those seen twice; two bits a key."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(1 << (bits - 3), np.uint8)
        self.twice = np.zeros(1 << (bits - 3), np.uint8)

    def put(self, bitmap: np.ndarray, hashes: np.ndarray) -> None:
        for at in places(hashes, self.bits):
            np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        distinct, n = np.unique(hashes, return_counts=True)
        again = (n > 1) | has(self.once, distinct, self.bits)
        self.put(self.twice, distinct[again])
        self.put(self.once, distinct)


def twice_filter(rows: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Bitmap that has every key occurring twice or more in ``rows``.

    ``hashes`` gives the 64-bit hashes of a batch. Every task fills a pair of
    filters; pairs merge block by block: once is the union, twice is the union
    and what both have once. Blocks travel compressed and without the empty
    ones; first up to ``MERGED_AT_ONCE`` tasks merge, then what they made. The
    result, 2**bits bits, comes to the driver.
    """
    block_bytes = 1 << (min(bits, BLOCK_BITS) - 3)
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def block(number: int, part: int, once: bytes, twice: bytes) -> list[pa.Array]:
        ints = (pa.array([x], pa.int32()) for x in (number, part))
        return [*ints, *(pa.array([x], pa.binary()) for x in (once, twice))]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(bits)
        for batch in batches:
            for found in hashes(batch):
                if len(found):
                    filters.add(found)
        pack = zstandard.ZstdCompressor(level=1).compress
        part = TaskContext.get().partitionId() // MERGED_AT_ONCE
        for n in range(len(filters.once) // block_bytes):
            cut = slice(n * block_bytes, (n + 1) * block_bytes)
            if filters.once[cut].any():
                packed = (pack(x[cut].tobytes()) for x in (filters.once, filters.twice))
                yield pa.RecordBatch.from_arrays(block(n, part, *packed), names=names)

    def merge(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=1).compress
        once, twice = np.zeros(block_bytes, np.uint8), np.zeros(block_bytes, np.uint8)
        for a, b in zip(rows.column("once"), rows.column("twice")):
            a, b = (np.frombuffer(unpack(x.as_py()), np.uint8) for x in (a, b))
            twice |= b | (once & a)
            once |= a
        return pa.table(block(rows.column("block")[0].as_py(), 0, pack(once.tobytes()), pack(twice.tobytes())), names=names)

    merged = rows.mapInArrow(fill, BLOCKS).groupBy("block", "part").applyInArrow(merge, BLOCKS)
    merged = merged.groupBy("block").applyInArrow(merge, BLOCKS)
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    for number, twice in merged.select("block", "twice").collect():
        bitmap[number * block_bytes : (number + 1) * block_bytes] = np.frombuffer(unpack(bytes(twice)), np.uint8)
    return bitmap


def filter_bits(keys: int, least: int = 20, most: int = 28) -> int:
    """Bits for about ``keys`` keys at eight bits each, within powers of two."""
    return min(most, max(least, (8 * keys).bit_length()))
