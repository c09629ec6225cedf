"""Words and word shingles of whole batches of texts, hashed with numpy.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``, lower-cased for A-Z only. All functions work on
the bytes of an Arrow column at once, in slices of bounded size, so a batch of very long texts
needs no more memory than its own bytes and a slice's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
_SLICE = 1 << 19  # bytes handled at once, unless one text is longer
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return lower, space


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts of a bounded size; a null text is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    data, ends = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:
        texts = texts.fill_null("")
        data, ends = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + _SLICE, "right")) - 1)
        yield first, raw[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin and end."""
    lower, space = _tables()
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = space[raw]
    # a word also begins and ends at a text's border
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    inside = ~blank
    starts = inside.copy()
    starts[1:] &= blank[:-1] | border[1:n]
    ends = inside.copy()
    ends[:-1] &= blank[1:] | border[1:n]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    # sum of byte * base**(distance from the word's start), by prefix sums and the inverse power
    up = _powers(n, _BASE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((lower[raw].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    down = _powers(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    return mix((sums[end] - sums[begin]) * down[begin]), np.searchsorted(begin, offsets)


def split_words(raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as they are, and where each text's words begin and end; ``blank`` marks the bytes between words."""
    blank = (_tables()[1] if blank is None else blank)[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    first = ~blank
    first[1:] &= blank[:-1] | border[1:len(raw)]
    begin = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(~blank)])
    ends = np.append(kept[begin], kept[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[~blank].tobytes())])
    return words, np.searchsorted(begin, offsets)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order.

    A text with fewer words than ``width`` has its whole sequence as the only shingle; one without
    words, or a null, has none.
    """
    for _, raw, offsets in text_slices(texts):
        h, at = word_hashes(raw, offsets)
        full = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for i in range(width):
            full = full * _STEP + h[i:len(h) - width + 1 + i] if len(full) else full
        full = mix(full)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                yield np.unique(full[a:b - width + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for x in h[a:b]:
                    whole = whole * _STEP + x
                yield mix(whole ^ np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
