"""Vectorised word scanning over Arrow string columns.

A chunk of documents is one byte array with document offsets; words are start
and end positions in it. No Python object is made per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 256

_U = np.uint64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words split at ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with full avalanche (in place)."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@dataclass
class Chunk:
    """Rows ``first`` to ``first + n`` of a batch; ``data`` holds their bytes and 8 zero bytes more."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def lanes(self) -> np.ndarray:
        """The 8 bytes from each position on, as an integer."""
        return np.ndarray((self.size + 1,), dtype="<u8", buffer=self.data, strides=(1,))

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and, for each document, the index of its first word (one more at the end)."""
        n = self.size
        inside = table[self.data[:n]]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            before[edge[:n]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
            after[edge[1:]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(column: pa.Array, size: int = CHUNK_BYTES, lower: bool = True, room: int = 8) -> Iterator[Chunk]:
    """The documents of an Arrow string column in runs of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        stop = min(max(stop, at + 1), len(column))
        lo, hi = int(offsets[at]), int(offsets[stop])
        data = np.zeros(hi - lo + room, dtype=np.uint8)
        data[: hi - lo] = LOWER[raw[lo:hi]] if lower else raw[lo:hi]
        yield Chunk(at, data, offsets[at : stop + 1] - lo)
        at = stop


def hash_words(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    lens = ends - starts
    h = (lens + seed).astype(_U) * _U(0x9E3779B97F4A7C15)
    lanes, live, k = chunk.lanes(), np.flatnonzero(lens <= LONG_WORD), 0
    while len(live):
        rest = lens[live] - 8 * k
        h[live] = mix64(h[live] ^ (lanes[starts[live] + 8 * k] & _MASKS[np.minimum(rest, 8)]))
        live, k = live[rest > 8], k + 1
    for i in np.flatnonzero(lens > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(chunk.data[starts[i] : ends[i]].tobytes(), seed)
    return h


def hash_word(word: str, seed: int = 0) -> int:
    """The hash of one word, as hash_words has it."""
    (chunk,) = chunks(pa.array([word]), lower=False)
    return int(hash_words(chunk, np.array([0]), np.array([chunk.size]), seed)[0])


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of a ragged array, and their offsets."""
    lens = (offsets[1:] - offsets[:-1])[which]
    out = np.zeros(len(which) + 1, dtype=np.int64)
    np.cumsum(lens, out=out[1:])
    at = np.repeat(offsets[:-1][which] - out[:-1], lens) + np.arange(out[-1])
    return flat[at], out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of a ragged array; an empty row has 0."""
    c = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


_model: tuple[object, object] = (None, None)


def worker_model(key: object, make: Callable[[], object]) -> object:
    """The model of this key in a Python worker. A worker serves many stages and keeps one model: that of another operator goes first."""
    global _model
    if _model[0] != key:
        if _model[0] is not None:
            _model = (None, None)
            trim()
        _model = (key, make())
    return _model[1]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; when a task ends, its worker gives freed memory back, as it stays for later tasks."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return out
