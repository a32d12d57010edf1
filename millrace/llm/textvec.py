"""Vectorised text kernels over Arrow string buffers: no Python object per word.

A word is a maximal run of ASCII letters and digits and of bytes above 127 in the lower-cased UTF-8
text. Word hashes are polynomial in 64-bit wrap-around arithmetic, from one prefix sum per block of
documents, then mixed.

Near-dedup takes words by Unicode instead, see :func:`text_spans`.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[128:] = True
LETTERS = _WORD.copy()
LETTERS[ord("0") : ord("9") + 1] = False
_powers: list[np.ndarray] = []
_SIGN, _IDEOGRAPH, _UNSPACED = 2, 3, 4
#: Letters in a row that a word spans, by class of the first.
_SPAN = np.array([0, 0, 1, 2, 4])
#: Scripts written without spaces: ideographs and syllables, and alphabets, whose letters say less each.
_IDEOGRAPHS = ((0x2E80, 0x312F), (0x3190, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF))
_ALPHABETS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0xA980, 0xA9FF), (0xAA60, 0xAADF))
_classes: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 4096)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = True, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``most`` bytes, a longer document alone: (first, last + 1, bytes, offsets).

    Nulls read as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n, at = len(texts), 0
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        part = texts.slice(at, to - at)
        if lower:
            part = pc.utf8_lower(part)
        o = np.frombuffer(part.buffers()[1], np.int64 if wide else np.int32)[part.offset : part.offset + to - at + 1].astype(np.int64)
        body = part.buffers()[2]
        data = np.frombuffer(body, np.uint8)[o[0] : o[-1]] if body is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
        yield at, to, data, o - o[0]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, runs of the bytes in ``table``, and for each document the number of the first of its words (one more at the end)."""
    return runs(table[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes within documents, and for each document the number of its first (one more at the end)."""
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(inside)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def classes() -> np.ndarray:
    """By code point: 0 for what parts words, 1 for what joins others in a word, else a class of letters that are words by themselves.

    Letters, marks, numbers and what isn't assigned make words, as do the joiners and the soft hyphen;
    symbols such as emoji stand alone; punctuation, spaces, controls and signs of mathematics or
    currencies part words, as in ASCII.
    """
    if not _classes:
        of = np.ones(0x110000, np.uint8)
        for k in (*range(0x20000), *range(0xE0000, 0xE0200)):
            kind = unicodedata.category(chr(k))
            of[k] = _SIGN if kind == "So" else kind[0] in "LMN" or kind in ("Cn", "Co")
        for ranges, kind in ((_IDEOGRAPHS, _IDEOGRAPH), (_ALPHABETS, _UNSPACED)):
            for a, b in ranges:
                part = of[a : b + 1]
                part[part == 1] = kind
        of[:128] = _WORD[:128]
        of[[0xAD, 0x200C, 0x200D]] = 1
        of[0xFE00:0xFE10] = of[0xE0100:0xE01F0] = 0  # variation selectors
        _classes.append(of)
    return _classes[0]


def text_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`word_spans`, with words by Unicode.

    Runs of letters, marks and digits are words. In scripts without spaces a word starts at each letter
    and spans two letters of an ideographic or syllabic script, four of an alphabet, or what is left of
    the run; so three words in a row are a shingle of four or six letters.
    """
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return word_spans(data, offsets)
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0x7F >> size)
    for j in range(1, 4):
        more = size > j
        code[more] = code[more] << 6 | data[lead[more] + j] & 0x3F
    kind = classes()[np.minimum(code, 0x10FFFF)]
    inside = _WORD & (np.arange(256) < 128)
    inside = inside[data]
    joins = kind == 1
    for j in range(4):
        inside[lead[joins & (size > j)] + j] = True
    starts, ends, bounds = runs(inside, offsets)
    own = kind > 1
    if not own.any():
        return starts, ends, bounds
    at, kind = lead[own], kind[own]
    to = at + size[own]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    breaks = (to[:-1] != at[1:]) | edge[at[1:]] | (kind[:-1] == _SIGN) | (kind[1:] == _SIGN)
    stops = np.append(np.flatnonzero(breaks), len(at) - 1)
    last = stops[np.searchsorted(stops, np.arange(len(at)))]
    to = to[np.minimum(np.arange(len(at)) + _SPAN[kind] - 1, last)]
    starts, ends = np.concatenate([starts, at]), np.concatenate([ends, to])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, wherever it stands."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, spans: Callable = word_spans) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each document's."""
    starts, ends, bounds = spans(data, offsets)
    return span_hashes(data, starts, ends), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``size`` words in a row, document by document, and bounds.

    A document of fewer words has one shingle of them all; one of none has none.
    """
    k = np.diff(bounds)
    count = np.where(k >= size, k - size + 1, np.minimum(k, 1))
    out = np.zeros(len(words), np.uint64)
    for j in range(size):
        part = words[j:] * np.uint64(2 * (j + 1) * 0x51ED270B + 1 | 1)
        out[: len(part)] += (part << np.uint64(j + 1)) ^ (part >> np.uint64(63 - j))
    short = np.flatnonzero((k > 0) & (k < size))
    for d in short:
        h = np.uint64(0)
        for j, w in enumerate(words[bounds[d] : bounds[d + 1]].tolist()):
            h = np.uint64((int(h) * 31 + w * (j + 3)) & 0xFFFFFFFFFFFFFFFF)
        out[bounds[d]] = h
    new = np.concatenate([[0], np.cumsum(count)])
    take = np.repeat(bounds[:-1] - new[:-1], count) + np.arange(new[-1])
    return mix(out[take]), new


def distinct_in_documents(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct values in order of value, how often each occurs, and bounds."""
    values, counts, lengths = [], [], [0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s = np.sort(h[a:b])
        if len(s):
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            values.append(s[first])
            counts.append(np.diff(np.append(first, len(s))))
            lengths.append(len(first))
        else:
            lengths.append(0)
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.cumsum(lengths)
    return np.concatenate(values), np.concatenate(counts), np.cumsum(lengths)


def document_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over each document's rows, zero for none; they don't depend on the other documents of the block."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[:-1][some], axis=0, dtype=np.float64)
    return out


def release() -> None:
    """Gives freed memory back to the system, for a worker that is used again would hold its peak; without effect where the C library has no such call."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    pa.default_memory_pool().release_unused()
