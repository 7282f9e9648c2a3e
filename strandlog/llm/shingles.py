"""Word shingles of whole texts as sorted 64-bit hashes, for many texts at once in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, after lower-casing A-Z. A word's hash is a polynomial in its bytes
modulo 2^64, then mixed; a shingle's hash mixes the hashes of its words by their place.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at once, about.
AT_ONCE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)


def _power_table(n: int) -> np.ndarray:
    t = np.full(n, _BASE, np.uint64)
    t[0] = 1
    return np.cumprod(t, dtype=np.uint64)


#: Powers of the base for words of usual length.
_POWERS = _power_table(1 << 12)


def word_sums(raw: np.ndarray, word: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values times powers of their place in the word: differences are hashes of word beginnings."""
    at = np.arange(len(raw))
    place = np.where(word, at - np.maximum.accumulate(np.where(begins, at, 0)), 0)
    longest = int(place.max(initial=0)) + 1
    power = _POWERS if longest <= len(_POWERS) else _power_table(longest)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[place], out=sums[1:])
    return sums


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, in order, and the number of words of each text."""
    if len(raw) <= AT_ONCE:
        return _word_hashes(raw, offsets)
    parts, counts, lo = [], np.zeros(len(offsets) - 1, np.int64), 0
    while lo < len(raw):  # stretches that end between two words
        hi = lo + AT_ONCE
        while hi < len(raw) and not len(gap := np.flatnonzero(_SEPARATOR[raw[hi : hi + AT_ONCE]])):
            hi += AT_ONCE
        hi = min(len(raw), hi + int(gap[0])) if hi < len(raw) else len(raw)
        part, n = _word_hashes(raw[lo:hi], np.clip(offsets, lo, hi) - lo)
        parts.append(part)
        counts += n
        lo = hi
    return np.concatenate(parts), counts


def _word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    n_texts = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    word = ~_SEPARATOR[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = word[edges]  # a text's first byte begins a word even if the text before ends in one
    ends = word.copy()
    ends[:-1] &= ~word[1:] | begins[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = word_sums(_LOWER[raw], word, begins)
    hashes = mix(sums[stops] - sums[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``width`` words, sorted, one text after another, and the bounds of the texts.

    A text with fewer words has its whole word sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(raw, offsets)
    first = np.concatenate([[0], np.cumsum(counts)])
    n_shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n_shingles)])
    out = np.empty(bounds[-1], np.uint64)
    if len(words) >= width:
        m = len(words) - width + 1
        every = words[:m] * _PLACE[0]
        for j in range(1, width):
            every += words[j : j + m] * _PLACE[j]
        every = mix(every)
    for t in np.flatnonzero(counts >= width):
        part = every[first[t] : first[t + 1] - width + 1]
        part.sort()  # no other text reads these windows
        out[bounds[t] : bounds[t + 1]] = part
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        part = words[first[t] : first[t + 1]]
        out[bounds[t]] = mix(np.array([(part * _PLACE[: len(part)]).sum(dtype=np.uint64) + _U(len(part))]))[0]
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[bounds]


def similarity_sketches(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches: ``size`` coordinates for each non-empty set, in expected time n + size log size.

    In round i each element is thrown into a hashed bin with the value (i, hash); a bin keeps its least value. A set
    whose bins are all filled is done, since later values are larger. After ``size`` rounds, each still empty bin j takes
    the least element by the hash of round size + j, so that every coordinate fills.
    """
    n_sets = len(bounds) - 1
    bits = int(size).bit_length() - 1
    empty = np.iinfo(np.uint64).max
    flat = np.full(n_sets * size, empty, np.uint64)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(n_sets), counts)
    values = shingles
    for i in range(size):
        if not len(values):
            break
        h = mix(values + _U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        where = owner * size + (h >> _U(64 - bits)).astype(np.int64)
        np.minimum.at(flat, where, (h & _U((1 << 54) - 1)) | _U(i << 54))
        open_ = (flat.reshape(n_sets, size) == empty).any(axis=1)
        still = open_[owner]
        if not still.all():
            values, owner = values[still], owner[still]
    if len(values):
        sets = np.unique(owner)
        starts = np.searchsorted(owner, sets)
        table = flat.reshape(n_sets, size)
        for j in range(size):
            missing = table[sets, j] == empty
            if missing.any():
                h = mix(values + _U((size + j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                least = np.minimum.reduceat(h & _U((1 << 54) - 1), starts) | _U((size + j) << 54)
                table[sets[missing], j] = least[missing]
    return flat.reshape(n_sets, size)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; equal only for the same band of equal coordinates."""
    n, size = sketch.shape
    parts = mix(sketch + _U(0x632BE59BD9B4E019)).reshape(n, size // rows, rows)
    keys = np.zeros((n, size // rows), np.uint64)
    for j in range(rows):
        keys += parts[:, :, j] * _PLACE[j]
    return mix(keys + _PLACE[: size // rows] * _U(0x9FB21C651E98DF25)).view(np.int64)


def fingerprints(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: 128 bits by which equal sets are known."""
    out = []
    for seed in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5):
        sums = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mix(shingles ^ _U(seed)), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]
