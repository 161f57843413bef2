"""Words of a batch of texts as numpy arrays: spans, document numbers and 64-bit hashes.

A class table maps every UTF-8 byte to what it counts as; zero parts words.  A word's
hash is a polynomial over its mapped bytes modulo 2^64 (prefix sums give all of them at
once), then mixed; equal words have equal hashes, and callers whose results must not
rest on a hash compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Texts are taken in runs of about this many bytes (a longer text alone): the arrays stay in the cache.
RUN_BYTES = 1 << 16

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, RUN_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a uint64 array over all bits (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_classes(keep, lower: bool = True) -> np.ndarray:
    """Class table: bytes for which ``keep(byte)`` holds stand for themselves (A-Z lower-cased)."""
    t = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = b + 32 if lower and 0x41 <= b <= 0x5A else b
        t[b] = c if keep(c) else 0
    return t


#: Words of letters, digits and non-ASCII characters, lower-cased.
ALNUM = byte_classes(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)
#: Words between white space, as they are.
SPACED = byte_classes(lambda b: b > 0x20 or (b and b < 0x09) or 0x0D < b < 0x20, lower=False)


@dataclass
class Words:
    """Of a run of texts: mapped bytes, and for every word its span, text number and hash."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of every text, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))


def text_runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of runs of a string or binary array without nulls."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, int)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if n and texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + RUN_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Words:
    mapped = classes[data]
    inside = mapped != 0
    fresh = np.zeros(len(mapped) + 1, dtype=bool)  # where a text begins or ends
    fresh[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    start = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    sums = np.zeros(len(mapped) + 1, dtype=np.uint64)
    np.cumsum(mapped * powers(_BASE, len(mapped)), out=sums[1:])
    h = mix((sums[end] - sums[start]) * powers(_INVERSE, len(mapped) + 1)[start])
    return Words(mapped, offsets, start, end, doc, h)
