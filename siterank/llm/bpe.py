"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Each match of the pattern is encoded on its own. A piece in the vocabulary is one token; any other is merged
by a segment tree over its byte positions: a leaf holds the rank of the pair that begins there together with the
position, a node the smallest of its leaves, so the root is the leftmost pair of the lowest rank. A merge updates at most three
leaves, those of the merged pair and of its live neighbours, in logarithmic time; a piece of n bytes takes O(n log n).

The vocabulary is read once on the driver and broadcast: its size is fixed by the file. Each text is encoded in one narrow pass;
pieces met often in a task are remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
import sys
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

REMEMBERED = 250_000  # pieces in each half of what a worker remembers, some 40 MB
REMEMBERED_CHARS = 32  # longer ones are not kept
_AT_ONCE = 1 << 16  # pieces of a text held at once
NEVER = sys.maxsize


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """``{token bytes: rank}`` of a rank file: a base64 token and its rank on each line."""
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path) as file:
            lines = file.read().split("\n")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    rank = ranks.get(piece)
    if rank is not None:
        return [rank]
    n, known = len(piece), ranks.get
    size = 1 << (n - 1).bit_length()
    place = size - 1
    tree = [NEVER] * (2 * size)  # tree[1] is the root, leaf i is tree[size + i]
    for i in range(n - 1):
        rank = known(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    ends = list(range(1, n + 1))  # of the token that begins at a live position; also where the next one begins
    before = list(range(-1, n - 1))
    while tree[1] != NEVER:
        i = tree[1] & place
        j = ends[i]
        end = ends[i] = ends[j]
        if end < n:
            before[end] = i
            rank = known(piece[i:ends[end]])
            changed = [(i, NEVER if rank is None else rank * size + i)]
        else:
            changed = [(i, NEVER)]
        if tree[size + j] != NEVER:
            changed.append((j, NEVER))
        left = before[i]
        if left >= 0:
            rank = known(piece[left:end])
            value = NEVER if rank is None else rank * size + left
            if tree[size + left] != value:
                changed.append((left, value))
        for k, value in changed:
            k += size
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return out


class Encoder(dict):
    """Packed ids (little-endian unsigned 32-bit) of pieces. When full, what it remembers becomes the older half, which is
    asked before a piece is merged again, and the half before it is forgotten."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.pattern, self.older = ranks, regex.compile(pattern), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = merge(piece.encode("utf-8"), self.ranks)
            packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(text) < _AT_ONCE:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        pieces = (m.group() for m in self.pattern.finditer(text))
        out = bytearray()
        while some := list(islice(pieces, _AT_ONCE)):
            out += b"".join(map(self.__getitem__, some))
        return bytes(out)


_LAST: list = []  # a worker's encoder, kept for the next task with the same vocabulary


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    if not _LAST or _LAST[0].pattern.pattern != pattern or _LAST[0].ranks != ranks:
        _LAST[:] = [Encoder(ranks, pattern)]
    return _LAST[0]


def _mapped(df: DataFrame, id_cols: list[str], column: str, out: str, make) -> DataFrame:
    """``id_cols`` and the binary column ``out``, made from ``column`` by ``make()``'s function, value by value."""
    def each(batches):
        convert = make()
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([convert(x.as_py()) for x in part.columns[-1]], pa.binary())],
                                                 [*id_cols, out])

    kept = df.select(*id_cols, column)
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in id_cols)
    return kept.mapInArrow(each, f"{kinds}, `{out}` binary")


def encode(docs: DataFrame, path: str, pattern: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(``id_cols``, ids) of every row; ``ids`` are the packed token ids of the whole text, empty for a null or empty one.

    Special tokens are ordinary text. Repeated ids keep their rows; other columns are ignored. The
    vocabulary must hold all 256 single bytes.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, path))

    def make():
        encoder = _encoder(ranks.value, pattern)
        return lambda text: encoder.encode(text) if text else b""

    return _mapped(docs.withColumn("_text", F.col(text_col).cast("string")), list(id_cols), "_text", "ids", make)


def decode(encoded: DataFrame, path: str, id_cols: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """(``id_cols``, decoded) of every row: the bytes of the packed ids; empty for null. An unknown id is an error."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(encoded.sparkSession, path))

    def make():
        tokens = {i: token for token, i in ranks.value.items()}
        return lambda ids: b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))

    return _mapped(encoded, list(id_cols), ids_col, "decoded", make)


def round_trip(docs: DataFrame, path: str, pattern: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(``id_cols``, ids, decoded) of every row: what ``encode`` and then ``decode`` give, by one pass of one worker a task."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, path))

    def each(batches):
        encoder = _encoder(ranks.value, pattern)
        tokens = {i: token for token, i in encoder.ranks.items()}
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                ids = [encoder.encode(t.as_py()) if t.is_valid else b"" for t in part.columns[-1]]
                back = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), pa.array(back, pa.binary())], [*id_cols, "ids", "decoded"])

    kept = docs.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in id_cols)
    return kept.mapInArrow(each, f"{kinds}, ids binary, decoded binary")
