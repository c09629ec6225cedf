"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, from merged Burrows-Wheeler transforms.

Documents are parsed at the places of a string synchronising set: content alone chooses them, and every repeated string of ``length``
bytes begins at the same distance, less than ``scale``, before the first chosen place in it. So only the suffixes at chosen places are sorted.

1. A *shard*, the documents that a task gathers, sorts its suffixes by context and keeps them as a Burrows-Wheeler transform of its parse: rows
   in suffix order, each with the phrase that precedes it. Contexts are cut into stretches: the bytes that any repeated string has after its
   first chosen place, then those up to ``length``, then the preceding phrase. A stretch is held as a hash (64, 32, 32 bits).
2. Rows are dealt by the first stretch. A task merges its shards' sorted rows by refining their interleaving: round k orders by stretch k
   only inside intervals that agreed so far, so no suffix is sorted anew, and the round in which two neighbours part is their common prefix. An
   interval of equal context and equal preceding phrase is a repeat with all strings that begin in that phrase.
3. Rows that share the first stretch with others but part later are the borders of repeats. Their strings at every byte are sorted and merged in
   the same way in a second, smaller pass, which settles the borders to the byte.

Equal rows of a shard collapse before the shuffle. A first stretch with many different rows in a shard is dealt by the whole row instead, so
that a passage that a third of all documents share doesn't meet in one task; one row then tells the others' task that it is repeated.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import discard, marked, stage
from siterank.llm.periodic_runs import _least_around
from siterank.llm.words import mix, text_slices

LENGTH = 400
SHARD_ROWS = 1_000_000
RANGE_BYTES = 32 << 20  # bytes of text for each range of hashes that one call merges
CROWD = 16  # different rows of a shard with one first stretch, beyond which they are dealt by the whole row
CROWD_MERGED = 4096  # the same among merged rows, for the second pass
_MULTI, _CROWDED, _TOKEN = 1, 2, 4
_EDGE, _PARTNER, _SPREAD = 1, 2, 4
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)

ROW = np.dtype([("first", "<u8"), ("rest", "<u4"), ("before", "<u4"), ("k1", "<i8"), ("k2", "<i4"), ("at", "<i4"),
                ("gap", "u1"), ("least", "u1"), ("flags", "u1")])
NUMBERED = np.dtype(ROW.descr + [("shard", "<i4")])
STRING = np.dtype([("first", "<u8"), ("rest", "<u4"), ("edge", "<u4"), ("back", "u1"), ("flags", "u1")])
EDGE = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("at", "<i4"), ("asks", "u1")])
SPAN = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("lo", "<i4"), ("hi", "<i4")])
FOUND = "k1 long, k2 int, lo int, hi int, asks int"


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers, out=powers))
    return tuple(out)


class ByteHashes:
    """Hashes of all byte strings of a slice of texts."""

    def __init__(self, raw: np.ndarray):
        self.n = len(raw)
        up, self.down = _powers(1 << max(20, self.n.bit_length()))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_VALUES[raw] * up[:self.n], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.down[:self.n + 1 - length]


def _half(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(32)).astype(np.uint32)


def parse_scales(length: int) -> tuple[int, int]:
    """(scale, bytes of a sample) of the parse, so that a string of ``length`` chooses a place among its first ``scale`` bytes by its own bytes."""
    gram = min(16, max(1, length // 8))
    scale = 1
    while scale < 128 and 4 * scale - 1 + gram <= length:
        scale *= 2
    return scale, gram


def chosen_places(hashes: ByteHashes, offsets: np.ndarray, length: int):
    """(place, text, gap, least) of the suffixes to sort. Strings of ``length`` bytes whose first chosen place is ``place`` begin
    ``least`` to ``gap - 1`` bytes before it; places of which no such string fits into the text are left out."""
    scale, gram = parse_scales(length)
    none = np.zeros(0, np.int64)
    if hashes.n < length:
        return none, none, none, none
    ids = _half(hashes.all(gram))
    least = _least_around(ids, scale + 1)
    place = np.flatnonzero((least == ids[:len(least)]) | (least == ids[scale:]))
    text = np.searchsorted(offsets, place, "right") - 1
    inside = place + scale + gram <= offsets[text + 1]
    place, text = place[inside], text[inside]
    gap = place - offsets[text] + 1
    follows = text[1:] == text[:-1]
    gap[1:][follows] = np.diff(place)[follows]
    least = np.maximum(0, place + length - offsets[text + 1])
    fits = least < gap
    return place[fits], text[fits], gap[fits], least[fits]


def interleave(shards: list[np.ndarray], columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted shards; the rows, and in how many leading columns each agrees with the one above."""
    rows = np.concatenate(shards)
    rows = rows[np.argsort(rows[columns[0]], kind="stable")]  # a merge of sorted stretches
    agree = np.zeros(len(rows), np.int8)
    agree[1:] = rows[columns[0]][1:] == rows[columns[0]][:-1]
    for depth, column in enumerate(columns[1:], 1):
        open_rows = agree == depth
        open_rows[:-1] |= agree[1:] == depth
        at = np.flatnonzero(open_rows)
        interval = np.cumsum(agree[at] < depth)
        rows[at] = rows[at[np.lexsort((rows[column][at], interval))]]
        deeper = (interval[1:] == interval[:-1]) & (rows[column][at[1:]] == rows[column][at[:-1]])
        agree[at[1:][deeper]] = depth + 1
    return rows, agree


def _numbered(rows: np.ndarray, shard: int) -> np.ndarray:
    out = np.empty(len(rows), NUMBERED)
    for column in ROW.names:
        out[column] = rows[column]
    out["shard"] = shard
    return out


def _dealt(rows: np.ndarray, hashes: np.ndarray, ranges: int) -> list[tuple[int, np.ndarray]]:
    """(range, its rows) by the upper half of the hashes, in the order of the rows."""
    to = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(ranges + 1))
    return [(r, rows[order[a:b]]) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans of the same text that overlap, as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["k2"], spans["k1"]))]
    text = np.cumsum(np.append(0, (spans["k1"][1:] != spans["k1"][:-1]) | (spans["k2"][1:] != spans["k2"][:-1])))
    reach = np.maximum.accumulate(spans["hi"] + text * (1 << 32)) - text * (1 << 32)
    first = np.append(True, (text[1:] != text[:-1]) | (spans["lo"][1:] > reach[:-1]))
    out = spans[first]
    out["hi"] = reach[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]
    return out


def _spans(k1, k2, lo, hi) -> np.ndarray:
    out = np.empty(len(k1), SPAN)
    out["k1"], out["k2"], out["lo"], out["hi"] = k1, k2, lo, hi
    return out


def _records(parts: list[tuple]) -> pa.RecordBatch:
    """(range, rows, edges, spans found already) as one batch."""
    columns = list(zip(*parts)) or [()] * 4
    binary = [pa.array([None if x is None or not len(x) else x.tobytes() for x in c], pa.binary()) for c in columns[1:]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *binary], ["range", "data", "edges", "done"])


RECORDS = "range int, data binary, edges binary, done binary"


def _found(spans: np.ndarray, asks: np.ndarray | int = 0) -> pa.Table:
    columns = [pa.array(np.ascontiguousarray(spans[c])) for c in ("k1", "k2", "lo", "hi")]
    return pa.table([*columns, pa.array(np.broadcast_to(np.int32(asks), len(spans)).copy())], ["k1", "k2", "lo", "hi", "asks"])


def suffix_shards(texts: DataFrame, length: int, ranges: int) -> DataFrame:
    """Sorted suffix rows of every shard, cut by ranges of the first stretch."""
    scale, _ = parse_scales(length)
    first = length - scale + 1

    def rows_of(raw, offsets, k1, k2):
        hashes = ByteHashes(raw)
        place, text, gap, least = chosen_places(hashes, offsets, length)
        rows = np.empty(len(place), ROW)
        rows["first"] = mix(hashes.at(place, first))
        after = length - least - first  # bytes of the second stretch; shorter where the text ends
        rows["rest"] = _half(hashes.at(place + first, after) + after.astype(np.uint64) * _ODD)
        rows["before"] = _half(hashes.at(place - gap + 1, gap - 1) + gap.astype(np.uint64) * _ODD)
        rows["k1"], rows["k2"], rows["at"] = k1[text], k2[text], place - offsets[text]
        rows["gap"], rows["least"], rows["flags"] = gap, least, 0
        return rows

    def shard(held):
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["before"], rows["rest"], rows["first"]))]
        new = np.append(True, (rows["first"][1:] != rows["first"][:-1]) | (rows["rest"][1:] != rows["rest"][:-1]) | (rows["before"][1:] != rows["before"][:-1]))
        again = np.diff(np.append(np.flatnonzero(new), len(rows))) > 1
        repeated = rows[again[np.cumsum(new) - 1]]
        done = _joined(_spans(repeated["k1"], repeated["k2"], repeated["at"] - repeated["gap"] + 1, repeated["at"] + length - repeated["least"].astype(np.int64)))
        rows = rows[new]
        rows["flags"] = again * np.uint8(_MULTI)
        lead = np.append(True, rows["first"][1:] != rows["first"][:-1])
        crowd = (np.diff(np.append(np.flatnonzero(lead), len(rows))) > CROWD)[np.cumsum(lead) - 1]
        token = rows[crowd & lead]
        token["flags"] |= _TOKEN
        rows["flags"][crowd] |= _CROWDED
        whole = mix(rows["first"] ^ (rows["rest"].astype(np.uint64) << np.uint64(32) | rows["before"]))
        rows, hashes = np.concatenate([rows, token]), np.concatenate([np.where(crowd, whole, rows["first"]), token["first"]])
        order = np.argsort(rows["first"], kind="stable")
        rows, hashes = rows[order], hashes[order]
        parts = [(r, some, None, None) for r, some in _dealt(rows, hashes, ranges)]
        return _records(parts + [(r, None, None, some) for r, some in _dealt(done, mix(done["k1"].view(np.uint64)), ranges)])

    def each(batches):
        held, n = [], 0
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, raw, offsets in text_slices(batch.column(2)):
                some = rows_of(raw, offsets, k1[lo:lo + len(offsets) - 1], k2[lo:lo + len(offsets) - 1])
                held.append(some)
                n += len(some)
                if n >= SHARD_ROWS:
                    yield shard(held)
                    held, n = [], 0
        if n:
            yield shard(held)

    return texts.select("k1", "k2", "text").mapInArrow(each, RECORDS)


def merged_suffixes(shards: DataFrame, length: int) -> DataFrame:
    """Spans that are repeated (asks = 0), and the rows whose strings the second pass has to sort (``lo`` the place, ``hi`` gap and least)."""
    def merge(table):
        done = [np.frombuffer(d, SPAN) for d in table.column("done").to_pylist() if d]
        shards = [np.frombuffer(d, ROW) for d in table.column("data").to_pylist() if d]
        out = [_found(_joined(np.concatenate(done)))] if done else []
        if not shards:
            return pa.concat_tables(out)
        rows, agree = interleave([_numbered(s, i) for i, s in enumerate(shards)], ("first", "rest", "before"))
        starts = np.flatnonzero(agree < 3)
        kind, interval = np.cumsum(agree < 3) - 1, np.cumsum(agree == 0) - 1
        token, multi = (rows["flags"] & _TOKEN) > 0, (rows["flags"] & _MULTI) > 0
        # a token may meet the row it stands for, and equal texts have equal keys: what counts is that two rows are of different shards
        own = rows["shard"]
        repeated = (np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)) | np.maximum.reduceat(multi, starts)
        repeated = repeated[kind]
        edge = ~repeated & ~token
        crowded = np.bincount(interval, (rows["flags"] & (_CROWDED | _TOKEN)) > 0) > 0
        kinds, edges = np.bincount(interval, agree < 3), np.bincount(interval, edge)
        asking = (((kinds > 1) & (edges > 0)) | crowded)[interval]
        spread = (crowded | (np.bincount(interval) > CROWD_MERGED))[interval] * _SPREAD
        here = rows[repeated & ~multi & ~token]
        out.append(_found(_joined(_spans(here["k1"], here["k2"], here["at"] - here["gap"] + 1, here["at"] + length - here["least"].astype(np.int64)))))
        lead = np.zeros(len(rows), bool)
        lead[np.flatnonzero(~token)[np.unique(kind[~token], return_index=True)[1]]] = True
        asked = asking & (edge | lead)
        some = rows[asked]
        out.append(_found(_spans(some["k1"], some["k2"], some["at"], some["gap"].astype(np.int64) | some["least"].astype(np.int64) << 8),
                          np.where(edge, _EDGE, _PARTNER)[asked] | spread[asked]))
        return pa.concat_tables(out)

    return shards.groupBy("range").applyInArrow(merge, FOUND)


def string_shards(texts: DataFrame, length: int, ranges: int) -> DataFrame:
    """Sorted strings of ``length`` bytes around the borders of repeats, of every shard."""
    scale, _ = parse_scales(length)
    first = length - scale + 1

    def strings_of(raw, offsets, k1, k2, asks):
        hashes = ByteHashes(raw)
        text = np.repeat(np.arange(len(asks)), asks.value_lengths().to_numpy())
        at, packed, kind = (pc.struct_field(asks.flatten(), [i]).to_numpy().astype(np.int64) for i in range(3))
        edges = np.empty(len(at), EDGE)
        edges["k1"], edges["k2"], edges["at"], edges["asks"] = k1[text], k2[text], at, kind
        place = offsets[text] + at
        least, count = packed >> 8, (packed & 255) - (packed >> 8)
        edge = np.repeat(np.arange(len(at)), count)
        back = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + least[edge]
        start = place[edge] - back
        rows = np.empty(len(edge), STRING)
        rows["first"] = mix(hashes.at(start, length))
        rows["rest"] = _half(hashes.at(start, length // 2) * _ODD + mix(hashes.at(start + length // 2, length - length // 2)))
        rows["edge"], rows["back"], rows["flags"] = edge, back, 0
        return edges, rows, mix(hashes.at(place, first))

    def shard(held):
        shift = np.cumsum([0, *(len(h[0]) for h in held)])
        edges, to = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
        rows = np.concatenate([h[1] for h in held])
        rows["edge"] += np.repeat(shift[:-1], [len(h[1]) for h in held]).astype(np.uint32)
        rows = rows[np.lexsort((rows["rest"], rows["first"]))]
        new = np.append(True, (rows["first"][1:] != rows["first"][:-1]) | (rows["rest"][1:] != rows["rest"][:-1]))
        again = np.diff(np.append(np.flatnonzero(new), len(rows))) > 1
        done = _reached(edges, rows[again[np.cumsum(new) - 1]], length)
        rows = rows[new]
        rows["flags"] = again * np.uint8(_MULTI)
        hashes = np.where(edges["asks"][rows["edge"]] & _SPREAD, rows["first"], to[rows["edge"]])
        parts = []
        for r, some in _dealt(rows, hashes, ranges):
            used, some["edge"] = np.unique(some["edge"], return_inverse=True)
            parts.append((r, some, edges[used], None))
        return _records(parts + [(r, None, None, some) for r, some in _dealt(done, mix(done["k1"].view(np.uint64)), ranges)])

    def each(batches):
        held, n = [], 0
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, raw, offsets in text_slices(batch.column(2)):
                m = len(offsets) - 1
                held.append(strings_of(raw, offsets, k1[lo:lo + m], k2[lo:lo + m], batch.column(3).slice(lo, m)))
                n += len(held[-1][1])
                if n >= SHARD_ROWS:
                    yield shard(held)
                    held, n = [], 0
        if n:
            yield shard(held)

    return texts.select("k1", "k2", "text", "asked").mapInArrow(each, RECORDS)


def _reached(edges: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """What the repeated strings of each border cover: all of them hold its place, so one span each."""
    rows = rows[(edges["asks"][rows["edge"]] & _EDGE) > 0]
    used, edge = np.unique(rows["edge"], return_inverse=True)
    if not len(used):
        return np.zeros(0, SPAN)
    far, near = np.zeros(len(used), np.int64), np.full(len(used), length, np.int64)
    np.maximum.at(far, edge, rows["back"])
    np.minimum.at(near, edge, rows["back"])
    of = edges[used]
    return _spans(of["k1"], of["k2"], of["at"] - far, of["at"] - near + length)


def merged_strings(shards: DataFrame, length: int) -> DataFrame:
    """Spans of the borders' repeated strings."""
    def merge(table):
        out = [np.frombuffer(d, SPAN) for d in table.column("done").to_pylist() if d]
        held, edges, n = [], [], 0
        for data, of in zip(table.column("data").to_pylist(), table.column("edges").to_pylist()):
            if data:
                rows, some = np.frombuffer(data, STRING).copy(), np.frombuffer(of, EDGE)
                rows["edge"] += n
                held.append(rows)
                edges.append(some)
                n += len(some)
        if held:
            rows, agree = interleave(held, ("first", "rest"))
            kind = np.cumsum(agree < 2) - 1
            multi = (rows["flags"] & _MULTI) > 0
            repeated = (np.bincount(kind) > 1) | (np.bincount(kind, multi) > 0)
            out.append(_reached(np.concatenate(edges), rows[repeated[kind] & ~multi], length))
        return _found(_joined(np.concatenate(out)))

    return shards.groupBy("range").applyInArrow(merge, FOUND)


def _cut(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, n_bytes, spans, kept): overlapping spans joined and their bytes taken out."""
    shape = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def each(batches):
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                text = text.as_py() or b""
                joined, at, parts = [], 0, []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in found.as_py() or ()):
                    if joined and lo <= joined[-1]["end"]:
                        joined[-1]["end"] = max(hi, joined[-1]["end"])
                    else:
                        joined.append({"start": lo, "end": hi})
                for s in joined:
                    parts.append(text[at:s["start"]])
                    at = s["end"]
                sizes.append(len(text))
                spans.append(joined)
                kept.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(shape)), pa.array(kept, pa.binary())],
                                             [id_col, "n_bytes", "spans", "kept"])

    return rows.mapInArrow(each, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_bytes, spans, kept) of every row: the maximal runs of bytes covered by a string of ``length`` bytes that starts
    at least twice in the table, in the same text or another, and the remaining bytes, which may split a character.

    Strings are judged on the texts as given. Texts are handled whole, in memory of some fifty bytes a byte of the longest. A null text
    is empty; a text shorter than ``length`` has no span. Equal rows repeat each other: from ``length`` bytes on nothing of them is kept.
    An id may be null or repeated, as rows are told apart by their text. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("_id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text")})
    long = docs.where(F.octet_length("text") >= length)
    ranges = max(8, (long.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // RANGE_BYTES)
    first, first_path = stage(merged_suffixes(suffix_shards(long, length, ranges), length), "suffix-spans")
    asked, asked_path = stage(first.where("asks > 0").groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi", "asks")).alias("asked")), "suffix-borders")
    texts = marked(long, asked, "k1").where("_hit").drop("_hit").join(asked, ["k1", "k2"])
    second = merged_strings(string_shards(texts, length, ranges), length)
    both = first.where("asks = 0").unionByName(second).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    spans, spans_path = stage(both, "repeated-spans")
    discard(spark, first_path, asked_path)
    near = marked(docs, spans, "k1")
    hit = near.where("_hit").join(spans, ["k1", "k2"], "left").select("_id", "text", "found")
    rest = near.where("not _hit").select("_id", "text", F.lit(None).cast(spans.schema["found"].dataType).alias("found"))
    return _cut(hit.unionByName(rest), id_col)
