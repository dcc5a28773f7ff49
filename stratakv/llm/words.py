"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of bytes of one class. Both classes used here hold every byte from 0x80, so working on UTF-8
bytes gives the same words as working on characters. A word's hash is a polynomial in its bytes, taken from prefix sums
over a slice of texts, with its length mixed in; texts are cut into slices of about a megabyte so that temporaries stay
small however large an Arrow batch is (one longer text makes one longer slice).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def byte_class(member) -> np.ndarray:
    return np.array([bool(member(b)) for b in range(256)])


#: Words that end at white space.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of digits, letters and everything outside ASCII; capitals are folded before.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    z = z ^ (z >> U(30))
    z *= U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z *= U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, U)
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, b & (2**64 - 1), U))]) for b in (BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array, nulls being empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(prefix))
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    h += (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word ends with its text."""
    inside = member[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = SPACED, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per text the number of words."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in slices(offsets):
        own = data[offsets[a] : offsets[b]]
        own = FOLD[own] if fold else own
        at = offsets[a : b + 1] - offsets[a]
        starts, ends = word_spans(own, at, member)
        hashes.append(span_hashes(prefix_hashes(own), starts, ends))
        counts[a:b] = np.diff(np.searchsorted(starts, at))
    return np.concatenate(hashes) if hashes else np.zeros(0, U), counts


def hash_one(word: bytes) -> int:
    """The hash that word gets above."""
    data = np.frombuffer(word, np.uint8)
    return int(span_hashes(prefix_hashes(data), np.array([0]), np.array([len(data)]))[0])
