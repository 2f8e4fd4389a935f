"""Vectorised text kernels over Arrow string buffers.

Texts are never turned into Python strings here: a batch's UTF-8 bytes are cut into slices of whole documents of
about SLICE bytes. A word is a longest run of bytes other than space and 0x09-0x0D, which is the same over bytes as
over code points. Words and lines get 64-bit hashes: their 8-byte blocks are mixed one by one, times an odd number of
the block's place, and summed. Mixing comes before the sum, so words that break polynomials modulo 2**64 get different
hashes; two given different words agree with a chance of about 2**-64. Memory is about 15 bytes for a byte of the
slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Low bytes of a block of 8 that a word of so many bytes reaches.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def block_hashes(blocks: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, none of them empty; blocks[i] are the 8 bytes from i on."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = (end - start).astype(np.int64)
    count = (size + 7) >> 3
    if count.max() == 1:
        total = mix(blocks[start] & _MASK[size]) * mix(np.array([_GOLD]))[0]
    else:
        first = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(first, count)
        at = np.repeat(start, count) + 8 * place
        left = np.minimum(np.repeat(end, count) - at, 8)
        odd = mix((place.astype(np.uint64) + np.uint64(1)) * _GOLD) | np.uint64(1)
        odd[place == 0] = mix(np.array([_GOLD]))[0]
        total = np.add.reduceat(mix(blocks[at] & _MASK[left]) * odd, first)
    return mix(total + size.astype(np.uint64) * _GOLD)


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string array; nulls have no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.fill_null("").cast(pa.large_string())
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(arr: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents; a document over `most` stands alone."""
    if not len(arr):
        return
    off, data = string_buffers(arr)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of a slice: start and end byte, document, 64-bit hash, and per document the first word's index."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool):
        n, docs = len(data), len(off) - 1
        held = np.zeros(n + 8, np.uint8)
        held[:n] = LOWER[data] if lower else data
        data = held[:n]
        #: the 8 bytes from each byte on
        self.blocks = np.ndarray((n + 1,), "<u8", held, strides=(1,))
        self.data, self.off, self.docs = data, off, docs
        inside = ~WS[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = off[:-1][off[:-1] < off[1:]]
        begins[edge] |= inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = off[1:][off[:-1] < off[1:]] - 1
        ends[last] |= inside[last]
        self.inside = inside
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(docs), self.count)
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges that aren't empty."""
        return block_hashes(self.blocks, start, end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of n words inside one document."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        k = len(self.hash) - n + 1
        whole = self.doc[:k] == self.doc[n - 1 :]
        return np.flatnonzero(whole), chain([self.hash[j : j + k] for j in range(n)])[whole]


_PLACE = mix(np.arange(1, 4097, dtype=np.uint64) * _GOLD) | np.uint64(1)


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes, position by position; each place has a multiplier of its own."""
    total = np.zeros(len(parts[0]), np.uint64)
    for x, place in zip(parts, _PLACE, strict=False):
        total += x * place
    return mix(total)


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes that `Words` gives to the same words."""
    raw = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, raw)])
    if any(WS[list(r)].any() or not r for r in raw):
        raise ValueError("not words")
    return Words(np.frombuffer(b"".join(raw), np.uint8), off, False).hash


def per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of true bytes in each document."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
