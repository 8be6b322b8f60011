"""Vectorised text primitives over Arrow string arrays: words, word hashes, shingles.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; this equals
``[^\\x20\\x09-\\x0D]+`` on the text, because those bytes never occur inside a
multi-byte UTF-8 character. Words become 64-bit hashes (a polynomial over random
byte values, finalised by a mixer), so whole batches are hashed without one Python
object per word. Temporary memory is bounded by ``PIECE`` bytes of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; temporary arrays take about 30 times this.
PIECE = 1 << 18
#: Bytes of text that one slice of a batch holds at most (a single longer text is a slice of its own).
SLICE = 1 << 20
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        made = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def run_hashes(data: np.ndarray, off: np.ndarray, separators: np.ndarray, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of each maximal run of bytes that are no separators; texts' borders end runs."""
    hashes, begins, ends = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        while hi < len(data) and not separators[hi]:  # never cut inside a run
            more = np.flatnonzero(separators[hi : hi + 4096])
            hi = hi + int(more[0]) if len(more) else min(hi + 4096, len(data))
        part = data[lo:hi]
        word = ~separators[lo:hi]
        cut = np.zeros(len(part) + 1, bool)
        cut[off[np.searchsorted(off, lo) : np.searchsorted(off, hi, "right")] - lo] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | cut[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(start):
            power, inverse = _power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * power[: len(part)], out=total[1:])
            hashes.append(mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
            begins.append(start + lo)
            ends.append(end + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word (n + 1), byte start and end of each word)."""
    data, off = buffers(texts)
    hashes, begin, end = run_hashes(data, off, _SEP[data], _BYTE_LOWER if lower else _BYTE)
    return hashes, np.searchsorted(begin, off), begin, end


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (runs over text borders included)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= len(_GRAM) // 2:
        total = words[:n] * _GRAM[0]
        for j in range(1, k):
            total += words[j : j + n] * _GRAM[j]
        return mix(total)
    power, inverse = _power_tables(len(words) + 1)  # a rolling polynomial
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[k:] - total[:n]) * inverse[:n])


def shingle_sets(texts: pa.Array, k: int = SHINGLE, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; fewer words: the whole sequence as one; none: empty."""
    words, first, _, _ = word_hashes(texts, lower)
    grams = gram_hashes(words, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield distinct(grams[a : b - k + 1])
        elif b > a:
            yield short_shingle(words[a:b])
        else:
            yield np.zeros(0, np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def short_shingle(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    n = len(words)
    return mix((words * _GRAM[8 : 8 + n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts take at most ``most`` bytes (or are one row)."""
    off = buffers(batch.column(column))[1]
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


_FOLDED = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in map(chr, range(1 << 16))], np.uint32)


def folded(text: str) -> np.ndarray:
    """What each code point counts as: a letter (Unicode's L classes) in lower case where that is one code point, anything else as a space."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _FOLDED[np.minimum(code, len(_FOLDED) - 1)]
    far = np.flatnonzero(code >= len(_FOLDED))
    if len(far):
        kinds, at = np.unique(code[far], return_inverse=True)
        out[far] = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in map(chr, kinds.tolist())], np.uint32)[at]
    return out


def cut(text: str, most: int) -> list[str]:
    """The text in parts of at most ``most`` code points that end at a non-letter; only a longer run of letters is cut inside."""
    out, at = [], 0
    while len(text) - at > most:
        end = at + most
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + most
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
