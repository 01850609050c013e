"""Vectorised text kernels shared by the corpus operators.

A *word* is a maximal run of bytes outside ``20 09-0D`` (hex), so words of the
UTF-8 bytes are exactly the regular expression ``[^\\x20\\x09-\\x0D]+`` on the
text.  Kernels work on blocks of whole documents joined by line feeds, which
keeps every Python-level loop per document, not per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# One random 64-bit value per byte; the seed is part of the fingerprint format.
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_2 = np.random.default_rng(20240230).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_WORD_BASE, _WORD_BASE_2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_WINDOW_BASE = U64(0xC2B2AE3D27D4EB4F)
_WINDOW_INVERSE = U64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def blocks(texts: Sequence[bytes], limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of consecutive documents of about ``limit`` bytes; a longer document stands alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield slice(first, i)
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield slice(first, len(texts))


@dataclass
class Words:
    """Words of a block: byte bounds in ``data``, and the first word of each document in ``first``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(docs) + 1 entries
    bounds: np.ndarray  # byte offset of each document, len(docs) + 1 entries

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(texts: Sequence[bytes], lower: bool = False) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = inside[0]
    edge[-1] = False
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return Words(data, starts, ends, np.searchsorted(starts, bounds), bounds)


def word_hashes(w: Words, second: bool = False) -> np.ndarray:
    """A 64-bit fingerprint of each word, the same in every process; there is a second, independent one."""
    if not len(w.starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = w.ends - w.starts
    table = powers(_WORD_BASE_2 if second else _WORD_BASE, int(lengths.max()) + 1)
    place = np.arange(len(w.data), dtype=np.int64)
    place[: w.starts[0]] = 0
    spans = np.diff(np.append(w.starts, len(w.data)))
    place[w.starts[0] :] -= np.repeat(w.starts, spans)
    np.minimum(place, len(table) - 1, out=place)
    value = (_BYTE_2 if second else _BYTE)[w.data]
    value *= table[place]
    value[_SPACE[w.data]] = 0
    return mix(np.add.reduceat(value, w.starts) + lengths.astype(np.uint64))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of ``width`` consecutive values, for each start that has so many."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_WINDOW_BASE, len(h)), out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(_WINDOW_INVERSE, n))


def document_windows(w: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and fingerprints of the windows that lie within one document."""
    f = window_hashes(h, width)
    doc = w.doc()
    starts = np.flatnonzero(doc[: len(f)] == doc[width - 1 :]) if len(f) else np.zeros(0, dtype=np.int64)
    return starts, f[starts]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    i = np.searchsorted(twice, keys)
    i[i == len(twice)] = 0
    return twice[i] == keys


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step)[:n] > 0


def column_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]
