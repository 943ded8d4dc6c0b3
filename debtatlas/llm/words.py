"""Words of whole batches of texts as 64-bit hashes, in numpy.

A word is a maximal run of bytes other than space and the five control characters
0x09-0x0D; words never cross from one text to the next. Equal words have equal hashes
in every task and run. Work goes in slices, so a very long text needs only memory for
its words, never for tables over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 17
CHUNK_BYTES = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 0x9E3779B97F4A7C15 | 1


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values one to one (the finaliser of splitmix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbered(count: int, seed: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_STEP)
                   + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))


BYTES = numbered(256, 1)
#: The same with A-Z coded as a-z.
BYTES_LOWER = BYTES.copy()
BYTES_LOWER[0x41:0x5B] = BYTES[0x61:0x7B]


class _Powers:
    """Powers of a fixed odd number and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            size = max(count, SLICE + 64)
            self.up, self.down = (
                np.cumprod(np.array([1] + [base] * size, np.uint64))
                for base in (_STEP, pow(_STEP, -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.of(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return sums


def split(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and where each text's words begin (one more at the end).

    ``data`` holds the texts' bytes one after the other, ``bounds`` their limits.
    """
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
               codes: np.ndarray = BYTES) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        sums = _sums(codes[data[low:high]])
        _, down = _POWERS.of(high - low + 1)
        begin, end = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
        at = stop
    return mix(out)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words; the caller knows which cross texts."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(count, np.uint64)
    for at in range(0, count, SLICE):
        stop = min(at + SLICE, count)
        sums = _sums(hashes[at:stop + size - 1])
        _, down = _POWERS.of(stop - at + 1)
        out[at:stop] = (sums[size:] - sums[:-size]) * down[:stop - at]
    return mix(out)


def spread(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``counts``, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the limits of its rows; NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(limits):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[limits[0]:limits[-1]], limits - limits[0]


def chunks(batches, column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about ``size`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, limits = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(limits, limits[at] + size, "right")) - 1)
            stop = min(stop, batch.num_rows)
            yield (batch.slice(at, stop - at), data[limits[at]:limits[stop]],
                   limits[at:stop + 1] - limits[at])
            at = stop


def blobs(values: np.ndarray, limits: np.ndarray) -> pa.Array:
    """Cut an array into one binary value per row: row i is values[limits[i]:limits[i+1]]."""
    values = np.ascontiguousarray(values)
    offsets = np.ascontiguousarray(limits, np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(limits) - 1,
        [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())
