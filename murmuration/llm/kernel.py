"""Vectorised byte work shared by the operators that run inside Arrow tasks.

Texts arrive as Arrow string arrays.  Their UTF-8 buffer is viewed as one numpy
byte array, so words are found and hashed for a whole slice of documents at once
and no Python object is made per word.  Every function takes whole texts; a null
text counts as empty.  Slices are cut at document borders to about
``SLICE_BYTES``, hence memory follows the longest document, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

SLICE_BYTES = 512 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
#: Bytes of a word whose numbers are looked up; further ones are computed.
_NEAR = 64
_near: list[np.ndarray] = []

#: The white space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: All ASCII that is neither a letter nor a digit; bytes of longer characters count as letters.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_numbers(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each byte and its place in its word; sums of them tell words of any length apart.

    Numbers of different places have no common structure, as powers of one base have.
    """
    number = lambda byte, at: mix(mix(at + np.uint64(1)) ^ ((byte + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)))
    if not _near:
        cell = np.arange(_NEAR << 8, dtype=np.uint64)
        _near.append(number(cell & np.uint64(255), cell >> np.uint64(8)))
    value = _near[0][(np.minimum(place, _NEAR - 1) << 8) | data]
    far = np.flatnonzero(place >= _NEAR)
    value[far] = number(data[far].astype(np.uint64), place[far].astype(np.uint64))
    return value


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and n + 1 offsets into them."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, *more: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that hold about `most` bytes of text each, in all named columns together, one row at least."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (column, *more))
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)
    release()


def release() -> None:
    """Gives freed memory back to the system, so that a reused worker holds no more than its next slice needs."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Words:
    """The words of a slice of documents.

    start, end: byte positions; first: n + 1 offsets of each document's words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~space[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1]
        begins[edges] = inside[edges]  # a document's first byte begins a word of its own
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] = inside[:-1] & ~inside[1:]
        cut = offsets[1:]
        cut = cut[cut > 0]
        ends[cut] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word, after a byte-to-byte fold."""
        data = self.data if fold is None else fold[self.data]
        if not len(self):
            return np.empty(0, np.uint64)
        begin = int(self.start[0])
        owner = np.repeat(self.start.astype(np.int32), np.diff(np.append(self.start, len(data))))
        total = np.zeros(len(data) + 1, np.uint64)
        for a in range(begin, len(data), SLICE_BYTES):  # so that a long text needs 12 bytes a byte
            b = min(a + SLICE_BYTES, len(data))
            place = np.arange(a, b, dtype=np.int32) - owner[a - begin : b - begin]
            np.cumsum(byte_numbers(data[a:b], place), out=total[a + 1 : b + 1])
            total[a + 1 : b + 1] += total[a]
        value = total[self.end] - total[self.start]
        return mix(value ^ (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within a document, and n + 1 offsets."""
    n = max(0, len(hashes) - k + 1)
    value = hashes[:n].copy()
    for i in range(1, k):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i])
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    keep = np.ones(n, bool)
    for i in range(1, k):  # windows that would reach into the next document
        at = first[1:] - i
        at = at[(at >= 0) & (at < n)]
        keep[at] = False
    at = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=at[1:])
    value = value[keep]
    return value[: at[-1]], at


def bit_table(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """A table of at most 2**most_bits bits, one set for each hash of column `h`: a hash without its bit is not there.

    Bits are merged in the tasks; the driver gets a table of a fixed size, never the
    hashes.  With more hashes than bits it lets more pass, which costs time only.
    """
    bits = max(12, min(most_bits, (16 * hashes.count()).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(slot.alias("slot")).selectExpr("slot >> 6 AS w", "shiftleft(1L, int(slot & 63)) AS b")
    merged = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[merged.column("w").to_numpy()] = merged.column("b").to_numpy().view(np.uint64)
    return table


def has_bit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - 6 - int(len(table)).bit_length() + 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
