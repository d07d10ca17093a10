"""Vectorised 64-bit hashes of words and shingles, computed over whole buffers with NumPy.

A word's hash is a polynomial over random 64-bit codes of its bytes, taken from prefix sums modulo 2**64 and mixed; equal
words have equal hashes in every process. Buffers are worked through in segments, so memory is bounded by ``SEGMENT``
and by the words of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
CHUNK = 1 << 21
_MASK = (1 << 64) - 1
_RANDOM = np.random.Generator(np.random.PCG64(7_193_002))
_CODES = _RANDOM.integers(1, _MASK, 256, dtype=np.uint64)
#: A-Z count as a-z.
_CODES[65:91] = _CODES[97:123]
_BASE = int(_RANDOM.integers(1, _MASK, dtype=np.uint64)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def separators(word_bytes: bytes | None) -> np.ndarray:
    """True for the bytes between words: all but ``word_bytes``, or else the white space of the contracts."""
    out = np.zeros(256, dtype=bool)
    if word_bytes is None:
        out[[9, 10, 11, 12, 13, 32]] = True
    else:
        out[:] = True
        out[list(word_bytes)] = False
    return out


WHITE = separators(None)
#: Words of ASCII letters and digits and of all that isn't ASCII.
ALNUM = separators(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(of: int, name: str) -> np.ndarray:
    if name not in _POWERS:
        p = np.full(SEGMENT + 1, of, dtype=np.uint64)
        p[0] = 1
        _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS[name]


def _segment(b: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and unmixed hashes of the words in a buffer of ``SEGMENT`` bytes at most."""
    gap = np.empty(len(b) + 2, dtype=bool)
    gap[0] = gap[-1] = True
    np.take(sep, b, out=gap[1:-1])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_CODES[b] * _powers(_BASE, "up")[: len(b)], out=sums[1:])
    return starts, (sums[ends] - sums[starts]) * _powers(_INVERSE, "down")[starts]


def _long_word(b: np.ndarray) -> int:
    out = 0
    for at in range(0, len(b), SEGMENT):
        part = b[at : at + SEGMENT]
        out += int((_CODES[part] * _powers(_BASE, "up")[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return out & _MASK


def words_of(data: bytes, sep: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words of a buffer."""
    b = np.frombuffer(data, dtype=np.uint8)
    all_starts, all_hashes, at = [], [], 0
    while at < len(b):
        end = min(at + SEGMENT, len(b))
        if end < len(b):
            gaps = np.flatnonzero(sep[b[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word fills the segment
                stop = end
                while stop < len(b) and not (found := np.flatnonzero(sep[b[stop : stop + SEGMENT]])).size:
                    stop += SEGMENT
                end = min(len(b), stop + (int(found[0]) if stop < len(b) else 0))
                all_starts.append(np.array([at]))
                all_hashes.append(np.array([_long_word(b[at:end])], dtype=np.uint64))
                at = end
                continue
        s, h = _segment(b[at:end], sep)
        all_starts.append(s + at)
        all_hashes.append(h)
        at = end
    if not all_starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(all_starts), mixed(np.concatenate(all_hashes))


def hashed_texts(texts: pa.Array, sep: np.ndarray = WHITE, lower: bool = False) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; null texts have none. ``lower`` lower-cases beyond A-Z as well."""
    held: list[bytes] = []
    size = 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        held.append((text.lower() if lower else text).encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= CHUNK or i == len(texts) - 1:
            starts, hashes = words_of(b"\n".join(held), sep)
            ends = np.cumsum([len(x) + 1 for x in held])
            cuts = np.searchsorted(starts, ends)
            at = 0
            for cut in cuts:
                yield hashes[at:cut]
                at = cut
            held, size = [], 0


_SEQUENCE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    k = min(k, n)
    if k == 0:
        return words
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * _SEQUENCE[i % 5] + words[i : n - k + 1 + i])
    return out
