"""Words and windows of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_RANDOM = np.random.Generator(np.random.PCG64(20))  # fixed seed: the same hashes in every worker
BYTE_VALUES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are neither letters nor digits
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
PART_BYTES = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:  # double what is there
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class Powers:
    """Powers of the base and of its inverse, up to the longest buffer so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums c and factors d: (c[e] - c[s]) * d[s] is the hash of bytes s to e,
    wherever they stand."""
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of about ``PART_BYTES`` bytes of a binary column (one
    row at least): slice, its bytes, and the rows' offsets in them."""
    binary = batch.column(column).cast(pa.large_binary())
    buffers = binary.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(binary):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PART_BYTES, "right")) - 1)
        end = min(end, len(binary))
        yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: bytes that don't stand ``between``."""
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] |= inside[borders]
    last[borders - 1] |= inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 512


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every stretch of bytes, eight bytes a step. Every step
    mixes all bits, so no family of stretches falls together, as it does with
    sums of powers; other seeds give independent hashes."""
    room = np.zeros(len(data) + 8, np.uint8)
    room[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))  # eight bytes from every place on
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D & (1 << 64) - 1))
    short = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = starts[short], size[short]
    while len(short):
        lane = words[at] & _MASKS[np.minimum(left, 8)]
        h[short] = mix((h[short] ^ lane) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x632BE59BD9B4E019))
        more = np.flatnonzero(left > 8)
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return h


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACES, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lowered, and its row."""
    starts, ends, rows = word_bounds(data, offsets, between)
    return range_hashes(LOWER[data], starts, ends, seed), rows


def hash_of_word(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0][0]
