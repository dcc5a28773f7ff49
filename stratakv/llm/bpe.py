"""Token ids of many texts by the tokenizers library, with one library call for each distinct segment.

Both tokenizers used here first part a text into pre-tokens that are then merged on their own. A text may therefore be
cut where a pre-token is certain to begin, and equal segments have equal ids. Cuts are made only

* before a single space, and before and after a single newline, each between two characters that aren't white space;
* between a letter or digit (ASCII, or of the Latin-1 letters) and one of . , ; : ! ?

None of these lies inside a special token or a contraction. A text with white space outside ASCII, or with separator
controls, stays whole. Segments are hashed in bulk (see words); a worker keeps the ids of segments it has seen, up to a
fixed number. Texts are taken a few megabytes at a time.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import words

U = np.uint64
SLICE_BYTES = 4 << 20
CACHE_SEGMENTS = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SOLID = ~SPACE
SOLID[0x1C:0x20] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?"]] = True
#: First bytes of white space outside ASCII, and the separator controls.
ODD = np.zeros(256, bool)
ODD[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def odd_places(data: np.ndarray) -> np.ndarray:
    """Where white space outside ASCII, or a separator control, begins."""
    at = np.flatnonzero(ODD[data])
    if not len(at):
        return at
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = ((a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    three |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[two | three | (a < 0x20)]


def segment_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    before[begins] = after[begins[1:] - 1] = after[n - 1] = 32  # a text's edge counts as white space
    alone = SOLID[before] & SOLID[after]
    cut = alone & ((data == 32) | (data == 10))
    cut[1:] |= (alone & (data == 10))[:-1]
    stop = np.flatnonzero(STOP[data])
    p, pp = before[stop], data[np.maximum(stop - 2, 0)]
    cut[stop] |= ALNUM[p] | ((pp == 0xC3) & (p >= 0x80) & (p != 0x97) & (p != 0xB7))
    if len(odd := odd_places(data)):
        for t in np.unique(np.searchsorted(offsets, odd, "right") - 1):
            cut[offsets[t] : offsets[t + 1]] = False
    cut[begins] = True
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, others from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


class Encoder:
    """Ids of texts. fold: the tokenizer lower-cases and drops white space, so segments are taken without both."""

    def __init__(self, path: str, fold: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.fold = Tokenizer.from_file(path), fold
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def one(self, text: str) -> list[int]:
        core = text[1:] if text[:1] == " " else text
        if core.isalpha() and max(core) < "Ā":  # a single pre-token
            text = core.lower() if self.fold else text
            return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(LETTERS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, keys: np.ndarray, found: list[list[int]]) -> None:
        if len(self.keys) + len(keys) > CACHE_SEGMENTS:
            self.forget()
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.cumsum(size) - size
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        self.ids = np.concatenate([self.ids, flat])
        keys, at, size = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.size, size])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def _slice(self, data: np.ndarray, offsets: np.ndarray):
        """For the segments of a slice: their entries, and where each text's segments begin."""
        starts = segment_starts(data, offsets)
        bounds = np.searchsorted(starts, offsets)
        ends = np.concatenate([starts[1:], [len(data)]])
        if self.fold:
            data = words.FOLD[data]
            starts = starts + ((data[starts] == 32) & (ends - starts > 1) if len(starts) else 0)
        h = words.span_hashes(words.prefix_hashes(data), starts, ends)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        if not known.all():
            new = first[~known]
            raw = data.tobytes()
            found = [self.one(raw[s:e].decode()) for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            if len(self.keys) + len(new) > CACHE_SEGMENTS:  # start anew with what this slice needs
                old = [self.ids[self.at[p] : self.at[p] + self.size[p]].tolist() for p in place[known].tolist()]
                self.forget()
                self.learn(distinct[known], old)
            self.learn(distinct[~known], found)
            place = np.searchsorted(self.keys, distinct)
        return place[inverse], bounds

    def encode(self, texts: pa.Array):
        """Yields (first text, ids of some texts in one array, where each text's ids begin and end)."""
        data, offsets = words.buffers(texts)
        for a, b in words.slices(offsets, SLICE_BYTES):
            entry, bounds = self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            size = self.size[entry]
            ends = np.concatenate([[0], np.cumsum(size)])
            source = np.repeat(self.at[entry] - ends[:-1], size) + np.arange(ends[-1])
            yield a, self.ids[source], ends[bounds]

    def count(self, texts: pa.Array) -> np.ndarray:
        data, offsets = words.buffers(texts)
        out = [np.zeros(0, np.int64)]
        for a, b in words.slices(offsets, SLICE_BYTES):
            entry, bounds = self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out.append(np.diff(np.concatenate([[0], np.cumsum(self.size[entry])])[bounds]))
        return np.concatenate(out)


@lru_cache(maxsize=4)
def encoder(path: str, fold: bool) -> Encoder:
    """One for each worker process, kept between tasks."""
    return Encoder(path, fold)
