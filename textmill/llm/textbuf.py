"""Vectorised work on the UTF-8 bytes of a whole Arrow batch of texts.

No Python object is made per text, word or window: a batch is one byte array and
one array of offsets, and words and windows are index arrays into it.
"""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice of a batch holds, unless a single text is longer.
SLICE_BYTES = 1 << 20
_libc = ctypes.CDLL(None)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about SLICE_BYTES of text each, in order."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def release() -> None:
    """Give freed memory back to the system: a worker that waits should hold little."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """Hashes of any byte ranges of one buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.base = _BASE + 2 * seed
        table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * powers(self.base, len(data)), out=self.sums[1:])
        self.inverse = pow(self.base, -1, 1 << 64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end] - self.sums[start]
        out *= powers(self.inverse, len(self.sums))[start]
        return mix(out)


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; by default a word is a run without
    the space and the bytes 0x09 to 0x0D. Words never cross texts."""
    inside = ~_SPACE[data] if is_word is None else is_word[data]
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    full = off[:-1] < off[1:]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8, and "ss" for the sharp s;
    every text keeps its length in bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    out = table[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    letter = data[second]
    upper = second[(letter >= 0x80) & (letter <= 0x9E) & (letter != 0x97)]
    out[upper] += 0x20
    sharp = second[letter == 0x9F]
    out[sharp] = out[sharp - 1] = 0x73
    return out


def binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())
