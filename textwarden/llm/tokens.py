"""Token ids of whole texts, with a bounded cache of what white-space separated chunks encode to.

The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks in
turn. Chunks repeat, so most of them come from the cache. The cache is found by hash and answers only where the
bytes of the chunk it was filled from are equal, too.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import HELD, LOWER, SPACES, U, Words, eights, equal_eights, groups, segment

#: Chunks kept by a worker; the cache starts anew beyond it.
CACHE = 1_000_000
VOCABULARY = 49_408
END = 1
#: A chunk that is one token; it parts chunks that are encoded together.
MARK = "\x01"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII classes that the tokenizer never joins: letters 1, digits 2, the rest 3; 0 where it may
#: (other bytes, the apostrophe of contractions).
_CLASS = np.full(256, 3, np.uint8)
_CLASS[0x80:] = 0
_CLASS[0x27] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a chunk can be cut in two that encode as the whole does: fewer different chunks are left."""
    kind = _CLASS[data]
    return np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1


class HashTable:
    """64-bit hashes to 0, 1, 2 ... in the order of insertion; lookups and insertions of whole arrays."""

    def __init__(self, bits: int = 21) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, U)
        self.values = np.full(1 << bits, -1, np.int32)
        self.n = 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U(64 - self.bits)).astype(np.int64)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where a hash is unknown."""
        out = np.full(len(hashes), -1, np.int32)
        slot, left = self._slots(hashes), np.arange(len(hashes))
        while len(left):
            value = self.values[slot]
            same = self.keys[slot] == hashes[left]
            out[left[same]] = value[same]
            go = ~same & (value >= 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        slot, left = self._slots(hashes), np.arange(len(hashes))
        while len(left):
            first = np.unique(slot, return_index=True)[1]
            take = first[self.values[slot[first]] < 0]
            self.keys[slot[take]] = hashes[left[take]]
            self.values[slot[take]] = self.n + left[take]
            go = np.ones(len(left), bool)
            go[take] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        self.n += len(hashes)


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable()
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        # The chunks themselves: their bytes, where each begins, and how long it is.
        self.text = np.empty(1 << 20, np.uint8)
        self.text_used = 0
        self.text_start = np.zeros(1 << 16, np.int64)
        self.text_length = np.zeros(1 << 16, np.int32)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk)."""
        encode = self.tokenizer.encode_batch_fast
        together = [f" {MARK} ".join(chunks[i : i + 500]) + f" {MARK}" for i in range(0, len(chunks), 500)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encode(together, add_special_tokens=False)])
        at = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) == 1 and len(at) == len(chunks):
            lengths = np.diff(at, prepend=-1) - 1
            return np.delete(ids, at), lengths
        each = [e.ids for e in encode(chunks, add_special_tokens=False)]  # a text holds the mark itself
        return np.array(list(chain.from_iterable(each)), np.uint32), np.array([len(x) for x in each])

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        flat, lengths = self._encode([x.decode() for x in chunks])
        at, n = self.table.n, len(chunks)
        while at + n > len(self.start):
            self.start, self.length, self.text_start, self.text_length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length, self.text_start, self.text_length))
        text, sizes = np.frombuffer(b"".join(chunks), np.uint8), np.array([len(x) for x in chunks])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        while self.text_used + len(text) + 8 > len(self.text):
            self.text = np.concatenate((self.text, np.empty_like(self.text)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.text[self.text_used : self.text_used + len(text)] = text
        self.length[at : at + n] = lengths
        self.start[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.text_length[at : at + n] = sizes
        self.text_start[at : at + n] = self.text_used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.text_used += len(text)
        self.table.add(hashes)

    def _same(self, w: Words, idx: np.ndarray) -> bool:
        """Whether every chunk is, byte for byte, the one that its place in the cache was filled from."""
        n = w.ends - w.starts
        if not (n == self.text_length[idx]).all():
            return False
        # Under eight bytes, chunks of one length and one hash are equal (hash_ranges).
        more = np.flatnonzero(n >= 8)
        held = np.ndarray(len(self.text) - 7, "<u8", self.text, strides=(1,))
        return bool(equal_eights(eights(w.data), w.starts[more], held, self.text_start[idx[more]], n[more]).all())

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), each text's followed by ``end``."""
        raw = data.tobytes()
        # Special tokens are case-sensitive: texts that may hold one are not lower-cased beforehand.
        if b"<|" not in raw:
            data = LOWER[data]
            raw = data.tobytes()
            w = segment(data, offsets, SPACES, slice(0, len(offsets) - 1), _cuts(data))
        else:
            w = segment(data, offsets, SPACES, slice(0, len(offsets) - 1))
        hashes = w.hashes()
        if self.table.n > CACHE - 300_000 and self.table.n + len(hashes) > CACHE:
            self._clear()
        idx = self.table.get(hashes)
        missing = np.flatnonzero(idx < 0)
        for part in np.array_split(missing, -(-len(missing) // 500_000) or 1):  # one text may hold more than the cache
            if len(part):
                if self.table.n + len(part) > 1.6 * CACHE:
                    return self._long(data, offsets, end)
                new, first = np.unique(hashes[part], return_index=True)
                fresh = self.table.get(new) < 0
                new, at = new[fresh], part[first[fresh]]
                if len(new):
                    self._learn(new, [raw[i:j] for i, j in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
                idx[part] = self.table.get(hashes[part])
        if not self._same(w, idx):
            return self._long(data, offsets, end)
        lengths = self.length[idx].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.pool[np.repeat(self.start[idx] - before[:-1], lengths) + np.arange(before[-1])]
        return self._ended(ids, np.diff(before[w.first]), end)

    def _ended(self, ids: np.ndarray, counts: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end is None:
            return ids, counts
        return np.insert(ids, np.cumsum(counts), end).astype(np.uint32), counts + 1

    def _long(self, data: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Without the cache: for texts with more distinct chunks than it holds, or two chunks of one hash."""
        raw, at = data.tobytes(), offsets.tolist()
        ids = [np.array(self.tokenizer.encode(raw[i:j].decode(), add_special_tokens=False).ids, np.uint32) for i, j in zip(at[:-1], at[1:], strict=True)]
        return self._ended(np.concatenate(ids), np.array([len(x) for x in ids]), end)


@cache
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


HELD["tokens"] = encoder.cache_clear


def encoded_groups(texts: pa.Array, path: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, ids, number of ids of each row) of whole texts; nulls are empty, each text ends with END."""
    for rows, data, offsets in groups(texts):
        ids, counts = encoder(path).encode(data, offsets)
        yield rows, ids, counts


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
