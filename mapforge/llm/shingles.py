"""Word shingles of texts as 64-bit hashes, and b-bit MinHash signatures of their sets.

Pure numpy; nothing here needs Spark. Words are the maximal runs of characters other than
ASCII white space (``[^\\x20\\x09-\\x0D]+``) after lower-casing A-Z; ``bytes.lower`` and
``bytes.split`` on UTF-8 do exactly that. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 64
#: Hashed values that one pass of the signature kernel works on, so that they stay in a core's cache.
BLOCK = 1 << 17

_MASK = (1 << 64) - 1


def _constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers drawn from a fixed seed."""
    return np.random.default_rng(seed).integers(1, _MASK, size=n, dtype=np.uint64, endpoint=True) | np.uint64(1)


_PLACE = _constants(64, 7)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Masks of the first 0 to 8 of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def as_bytes(text) -> bytes:
    return b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def word_hashes(texts: list, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and each text's number of words.

    All words are hashed at once, eight bytes at a time; words of up to eight bytes and one length have different hashes.
    """
    raw = [as_bytes(t) for t in texts]
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    joined = b" ".join([*raw, b"        "])  # each text is followed by white space, and each byte by seven more
    if lower:
        joined = joined.lower()
    size = int(ends[-1]) if len(ends) else 0
    white = _WHITE[np.frombuffer(joined, np.uint8, size)]
    before = np.ones(size, bool)
    before[1:] = white[:-1]
    starts, stops = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    lengths = stops - starts
    eight = np.ndarray((size + 1,), "<u8", joined, strides=(1,))  # the eight bytes from each place on
    out = mix(lengths.astype(np.uint64) * _STEP)
    out = mix(out ^ (eight[starts] & _FIRST[np.minimum(lengths, 8)]))
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : stops[i]])
    rest, at = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD)), 8
    while len(rest):
        left = lengths[rest] - at
        out[rest] = mix(out[rest] * _STEP + (eight[starts[rest] + at] & _FIRST[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    return out, counts


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k values; its length is len(hashes) - k + 1, or 0."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _PLACE[j]
    return mix(out)


def shingle_sets(texts: list, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, one text after the other, and the bounds of each.

    A text of fewer than k words, but at least one, has its whole word sequence as its only shingle.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    rolled = windows(words, k)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= k:
            sets.append(np.unique(rolled[end - n : end - k + 1]))
        elif n:
            own = (words[end - n : end] * _PLACE[k : k + n]).sum(dtype=np.uint64)
            sets.append(mix(np.array([own], np.uint64) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def signatures(values: np.ndarray, bounds: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """b-bit MinHash signatures, 16 bits a symbol: one row of n symbols for each set; empty sets get zeros."""
    flips, factors, ends = _constants(n, seed), _constants(n, seed + 1), _constants(n, seed + 2)
    out = np.zeros((len(bounds) - 1, n), np.uint16)
    at = 0
    while at < len(bounds) - 1:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, side="right")) - 1)
        stop = min(stop, len(bounds) - 1)
        rows = np.flatnonzero(np.diff(bounds[at : stop + 1])) + at
        if len(rows):
            part = values[bounds[at] : bounds[stop]]
            starts = bounds[rows] - bounds[at]
            for j in range(n):
                least = np.minimum.reduceat((part ^ flips[j]) * factors[j], starts)
                out[rows, j] = ((least * ends[j]) >> np.uint64(48)).astype(np.uint16)
        at = stop
    return out
