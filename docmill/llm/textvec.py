"""Words, shingles and hashes of a whole column of texts at once, in numpy on Arrow's buffers.

Texts are worked on in slices of some megabytes, cut between documents, so that memory follows the slice
and, for a text longer than that, the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
#: Longer words are hashed by the byte string instead of eight bytes at a time over all words.
LONG_WORD = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """True for the bytes outside the spans."""
    inside = np.ones(256, dtype=bool)
    for first, last in spans:
        inside[first : last + 1] = False
    return inside


#: Bytes of words between white space, and of words of letters, digits and all beyond ASCII (A-Z lower-cased first).
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Rows [first, last) of a batch: their bytes, A-Z lower-cased, with eight zero bytes behind."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Null texts are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        a, b = offsets[first], offsets[last]
        data = np.zeros(b - a + 8, dtype=np.uint8)
        np.take(LOWER, raw[a:b], out=data[: b - a])
        yield Slice(first, last, data, offsets[first : last + 1] - a)
        first = last


def words(s: Slice, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row where its words begin, with the total behind."""
    size = int(s.offsets[-1])
    is_word = inside[s.data[:size]]
    edges = s.offsets[:-1]
    edges = edges[edges < size]
    opens = is_word.copy()
    opens[1:] &= ~is_word[:-1]
    opens[edges] = is_word[edges]
    closes = is_word.copy()
    closes[:-1] &= ~is_word[1:]
    ends_at = edges[edges > 0] - 1
    closes[ends_at] = is_word[ends_at]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, s.offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, of all its bytes."""
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    length = ends - starts
    h = mix64(length.astype(np.uint64) * _M1 ^ (eight[starts] & _LOW[np.minimum(length, 8)]))
    open_ = np.flatnonzero((length > 8) & (length <= LONG_WORD))
    done = 8
    while open_.size:
        left = length[open_] - done
        h[open_] = mix64(h[open_] * _M1 ^ (eight[starts[open_] + done] & _LOW[np.minimum(left, 8)]))
        done += 8
        open_ = open_[left > 8]
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def hash_runs(h: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each run of n consecutive hashes."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        out = mix64(out * _M1 ^ h[i : i + count])
    return out
