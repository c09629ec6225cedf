"""Periodic runs: maximal stretches of words that repeat with a period, at least three times over.

Candidate periods come from string synchronising sets. At scale t a position is selected if the hash of the t words that begin
there is the least among t + 1 neighbours, seen from it or from t words before; selection depends on the next 2t words only, so
a stretch of period q selects the same places one period later. Two neighbouring selected places with an equal context of at
least q words propose their distance. Windows that lie inside a run of a period of at most t / 3 would select everything and are
left out; where such a run covers the whole beginning of a longer period, the places where those runs end propose the period.
Scales double, and scale t serves the periods from 1.5t to 3t. Every proposal is extended to both sides with prefix hashes and
then held against the words themselves, so no run is reported that the words do not have.

Texts are handled in slices with numpy, each text of a slice closed by a mark of its own that nothing else equals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siterank.llm.words import mix, split_words, text_slices

LEAST = 24  # words of the shortest run
TIMES = 3  # periods in a run; the proofs of completeness need three
_SMALL = 5  # periods up to this one are compared directly
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes:
    """Hashes of all windows of an integer sequence."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        values = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        up, down = np.full(n, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        up[:1], down[:1] = 1, 1
        np.multiply.accumulate(up, out=up)
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up, out=self.sums[1:])

    def at(self, i: np.ndarray, length) -> np.ndarray:
        return (self.sums[i + length] - self.sums[i]) * self.down[i]

    def all(self, n: int, length: int) -> np.ndarray:
        """Those of every window within the first ``n`` values."""
        return (self.sums[length:n + 1] - self.sums[:n + 1 - length]) * self.down[:n + 1 - length]


def _least_around(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:len(out) - (width - have)], out[width - have:]) if have < width else out


def synchronising_set(hashes: _Hashes, n: int, scale: int, inside: np.ndarray) -> np.ndarray:
    """Selected places among the first ``n`` values; ``inside`` marks windows of a small period."""
    if n < 2 * scale:
        return np.zeros(0, np.int64)
    ids = np.minimum(mix(hashes.all(n, scale)), _NONE - np.uint64(1))
    ids[inside[:len(ids)]] = _NONE
    least = _least_around(ids, scale + 1)
    return np.flatnonzero(((least == ids[:len(least)]) | (least == ids[scale:])) & (least != _NONE))


def _neighbours(hashes: _Hashes, n: int, places: np.ndarray, begin: np.ndarray, length: int):
    """(place, next place with the same ``length`` values from its beginning), and the places that have one."""
    ok = (begin >= 0) & (begin + length <= n)
    places, key = places[ok], hashes.at(begin[ok], length)
    order = np.argsort(key, kind="stable")  # places ascend within a key
    same = key[order[1:]] == key[order[:-1]]
    pairs = places[order[:-1][same]], places[order[1:][same]]
    return pairs, np.unique(np.concatenate(pairs))


def _stretches(codes: np.ndarray, period: int) -> np.ndarray:
    """(start, end, period) of the maximal stretches of at least three periods."""
    equal = np.zeros(max(0, len(codes) - period) + 2, np.int8)
    equal[1:-1] = codes[period:] == codes[:max(0, len(codes) - period)]
    steps = np.diff(equal)
    start, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) + period
    keep = end - start >= TIMES * period
    return np.stack([start[keep], end[keep], np.full(int(keep.sum()), period)], axis=1)


def _extended(codes: np.ndarray, hashes: _Hashes, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(start, end, period) of the runs through the proposed pairs, as far as they hold three periods."""
    def reach(most, equal):
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = equal(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    period = j - i
    right = reach(n - j, lambda d: hashes.at(i, d) == hashes.at(j, d))
    left = reach(i, lambda d: hashes.at(i - d, d) == hashes.at(j - d, d))
    keep = left + right >= (TIMES - 1) * period
    found = np.unique(np.stack([i - left, j + right, period], axis=1)[keep], axis=0)
    exact = []
    for s, e, q in found.tolist():
        if np.array_equal(codes[s:e - q], codes[s + q:e]):
            exact.append((s, e, q))
        else:  # two windows shared a hash: take the words themselves
            all_of = _stretches(codes[:n], q)
            exact += [tuple(r) for r in all_of[(all_of[:, 0] < e) & (all_of[:, 1] > s)].tolist()]
    return np.array(exact, np.int64).reshape(-1, 3)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row for each stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def runs_of(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, end, smallest period) of every maximal stretch of at least three periods, by start.

    ``codes`` holds texts of falling length one after the other, each closed by a value of its own; ``ends`` are the places behind them.
    """
    lengths = np.diff(ends, prepend=0) - 1
    runs = _smallest(np.concatenate([np.zeros((0, 3), np.int64), *(_stretches(codes, q) for q in range(1, _SMALL + 1))]))
    if not len(lengths) or lengths[0] < TIMES * (_SMALL + 1):
        return runs
    hashes, scale = _Hashes(codes), 4
    while 3 * scale <= 2 * (int(lengths[0]) // TIMES):
        n = int(ends[np.searchsorted(-lengths, -(9 * scale // 2), "right") - 1])  # longer texts only
        small = runs[(3 * runs[:, 2] <= scale) & (runs[:, 0] < n)]
        long = small[small[:, 1] - small[:, 0] >= scale]
        marks = np.zeros(n + 2, np.int64)
        np.add.at(marks, long[:, 0], 1)
        np.add.at(marks, long[:, 1] - scale + 1, -1)
        chosen = synchronising_set(hashes, n, scale, np.cumsum(marks)[:n] > 0)
        borders = small[small[:, 1] - small[:, 0] >= 3 * scale - 1][:, 1]
        pairs = [(np.zeros(0, np.int64),) * 2]
        for length, above in ((2 * scale, 3 * scale // 2 - 1), (5 * scale // 2, 2 * scale), (3 * scale, 5 * scale // 2)):
            (i, j), chosen = _neighbours(hashes, n, chosen, chosen, length)
            found = [(i, j)]
            for before in (0, length // 2, length) if len(borders) else ():
                found.append(_neighbours(hashes, n, borders, borders - before, length)[0])
            for i, j in found:
                near = (j - i > above) & (j - i <= length)
                pairs.append((i[near], j[near]))
        i, j = (np.concatenate(x) for x in zip(*pairs))
        if len(i):
            runs = _smallest(np.concatenate([runs, _extended(codes, hashes, n, i, j)]))
        scale *= 2
    return runs


def _slice_runs(words: pa.Array, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of the texts of a slice, and which words they drop."""
    counts = np.diff(at)
    order = np.argsort(-counts, kind="stable")
    ends = np.cumsum(counts[order] + 1)
    starts = ends - counts[order] - 1
    source = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)  # place -> word
    inner = np.ones(len(source), bool)
    inner[ends - 1] = False
    source[inner] = np.arange(int(inner.sum())) + np.repeat(at[:-1][order] - np.cumsum(np.append(0, counts[order]))[:-1], counts[order])
    codes = np.empty(len(source), np.int64)
    known = words.dictionary_encode()
    codes[inner] = known.indices.to_numpy(zero_copy_only=False)[source[inner]]
    codes[ends - 1] = len(known.dictionary) + np.arange(len(ends))
    runs = runs_of(codes, ends)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    drop = np.zeros(len(source) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    gone = np.zeros(len(words), bool)
    gone[source[inner]] = np.cumsum(drop)[:-1][inner] > 0
    text = np.searchsorted(ends, runs[:, 0], "right")
    rows = np.stack([order[text], runs[:, 0] - starts[text], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))], gone


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(``id_col``, n_words, runs, collapsed) of every row: one narrow pass, no shuffle.

    Words are runs of bytes outside ``\\x20 \\x09-\\x0D``, numbered from 0. ``runs`` lists (start, length, period) by start, then period: the
    stretches with smallest period q and a length of at least ``least`` and 3q that no neighbouring word extends. ``collapsed`` joins by one space the words
    that no run contains after its first period. A null or empty text, or one of blanks, has no words, no runs and an empty
    ``collapsed``. A text may have any length: it is handled whole, in memory of some hundred bytes a word. Repeated rows give equal
    rows; a null id stays null. Other columns are ignored, whatever their names.
    """
    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches):
        for batch in batches:
            for first, raw, offsets in text_slices(batch.column(1)):
                words, at = split_words(raw, offsets)
                rows, gone = _slice_runs(words, at, least)
                n = len(at) - 1
                left = np.append(0, np.cumsum(~gone))[at]
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), words.filter(pa.array(~gone))), pa.scalar(b" ", pa.large_binary()))
                per_text = np.searchsorted(rows[:, 0], np.arange(n + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(per_text), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], fields=list(shape)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.diff(at)), runs, joined.cast(pa.large_string()).cast(pa.string())],
                    [id_col, "n_words", "runs", "collapsed"])

    return kept.mapInArrow(each, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, n_words long, "
                                 "runs array<struct<start: long, length: long, period: long>>, collapsed string")
