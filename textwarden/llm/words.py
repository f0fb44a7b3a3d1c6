"""Vectorised word segmentation and hashing over Arrow string batches.

Everything works on the UTF-8 bytes of whole texts. A null text is an empty one. A word's hash depends on
all its bytes and not on its place.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes handled at once; a longer single text is one group.
GROUP_BYTES = 1 << 20
#: Bytes of a range that is hashed in numpy; longer ones are hashed one by one.
LONG = 128
_BASE = 0x9E3779B97F4A7C15

#: Words are [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased texts.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _turned(x: np.ndarray) -> np.ndarray:
    return (x << U(32)) | (x >> U(32))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as one number; zeros stand behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _up_to(n: np.ndarray) -> np.ndarray:
    """Masks of the first n bytes of eight; n is 1 or more."""
    return U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * np.minimum(n, 8).astype(U))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair.

    Ranges under eight bytes have a hash of their own each (packed with their length, then mixed, both one-to-one).
    Longer ones pass eight bytes at a time through two states of 64 bits, which no single block can steer together, and
    those over LONG bytes through BLAKE2. Equal hashes are a hint all the same: where a result must be exact,
    callers compare bytes (equal_ranges).
    """
    n = (ends - starts).astype(np.int64)
    view = eights(data)
    out = np.full(len(n), _BASE, U)
    short = np.flatnonzero((n > 0) & (n < 8))
    out[short] = mix((view[starts[short]] & _up_to(n[short])) | (n[short].astype(U) << U(56)))
    left = np.flatnonzero((n >= 8) & (n <= LONG))
    a, b = mix(n[left].astype(U) + U(0xD1B54A32D192ED03)), mix(n[left].astype(U) ^ U(0x8CB92BA72F3D8DD7))
    for k in range(0, LONG, 8):
        if not len(left):
            break
        more = n[left] - k
        block = view[starts[left] + k] & _up_to(more)
        a = mix(a ^ block)
        b = mix((b ^ _turned(block)) * U(0xABC98388FB8FAC03) + a)
        done = more <= 8
        out[left[done]] = mix(a[done] + _turned(b[done]))
        go = ~done
        left, a, b = left[go], a[go], b[go]
    for i in np.flatnonzero(n > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def equal_ranges(data: np.ndarray, starts: np.ndarray, others: np.ndarray, other_starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[start:start + n] equals others[other_start:other_start + n], byte for byte."""
    one = eights(data)
    return equal_eights(one, starts, one if others is data else eights(others), other_starts, n)


def equal_eights(one: np.ndarray, starts: np.ndarray, two: np.ndarray, other_starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """equal_ranges over :func:`eights` of both sides."""
    out = np.ones(len(n), bool)
    for i in np.flatnonzero(n > 8 * LONG).tolist():
        s, t, m = int(starts[i]), int(other_starts[i]), int(n[i])
        out[i] = np.array_equal(one[s : s + m : 8][: m // 8], two[t : t + m : 8][: m // 8]) and one[s + m - 8] == two[t + m - 8]
    left, k = np.flatnonzero((n > 0) & (n <= 8 * LONG)), 0
    while len(left):
        more = n[left] - k
        same = ((one[starts[left] + k] ^ two[other_starts[left] + k]) & _up_to(more)) == 0
        out[left[~same]] = False
        left = left[same & (more > 8)]
        k += 8
    return out


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n neighbours, in two states as those of ranges; window i starts at element i."""
    if len(hashes) < n:
        return np.empty(0, U)
    size = len(hashes) - n + 1
    a, b = np.full(size, n, U), np.full(size, _BASE, U)
    for k in range(n):
        h = hashes[k : size + k]
        a = mix(a * U(_BASE) + h)
        b = mix((b ^ _turned(h)) * U(0xABC98388FB8FAC03) + a)
    return a + _turned(b)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts of the group
    offsets: np.ndarray  # of the texts in data, n + 1
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, n + 1
    rows: slice  # of the batch

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts, self.ends)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Of flags (one for each byte), by text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of texts of at most ``limit`` bytes, or one longer text."""
    data, offsets = string_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield slice(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def segment(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, rows: slice, cuts: np.ndarray | None = None) -> Words:
    """Words are runs of bytes that don't separate; ``cuts`` are places that end one and begin another."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after[-1:], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), rows)


def word_groups(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = True, limit: int = GROUP_BYTES) -> Iterator[Words]:
    for rows, data, offsets in groups(texts, limit):
        yield segment(LOWER[data] if lower else data, offsets, separators, rows)


#: Rows of an Arrow batch at most: whole texts make batches large on both sides of the socket.
BATCH_ROWS = 2000


#: What operators keep in a worker from task to task, and how to drop it.
HELD: dict[str, Callable[[], None]] = {}


def _begin(holds: str | None) -> None:
    """Drop what other operators have left in this worker."""
    for name, drop in HELD.items():
        if name != holds:
            drop()


def _end() -> None:
    """Give freed memory back: workers stay for later tasks, and so does what their allocators keep."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose batches are small and whose worker keeps little; ``holds`` names what stays in HELD."""
    from pyspark.sql import SparkSession

    spark, key = SparkSession.active(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(holds)
        yield from run(batches)
        _end()

    return partition


def crc32_mod5(spark_column):
    """crc32 of an id written as text, modulo 5 (a Column)."""
    from pyspark.sql import functions as F

    return F.crc32(spark_column.cast("string").cast("binary")) % 5
