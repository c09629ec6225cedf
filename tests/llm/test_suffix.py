"""Suffix-array dedup against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import no_docs, odd_docs, odd_rows

from siterank.llm import queries
from siterank.llm import suffix_dedup as sd


def plain(texts, length):
    """(bytes, spans, kept bytes) of every text."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        marks = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if times[x[i:i + length]] > 1:
                marks[i] += 1
                marks[i + length] -= 1
        gone = np.append(False, np.append(np.cumsum(marks)[:-1] > 0, False))
        spans = list(zip(np.flatnonzero(~gone[:-1] & gone[1:]).tolist(), np.flatnonzero(gone[:-1] & ~gone[1:]).tolist()))
        out.append((len(x), spans, bytes(v for v, g in zip(x, gone[1:]) if not g)))
    return out


def pieced(rng, n, letters, size, pieces=12):
    """Texts put together from common pieces and random letters."""
    word = lambda m: "".join(rng.choice(letters) for _ in range(m))
    common = [word(rng.randrange(5, size)) for _ in range(pieces)]
    return ["".join(rng.choice(common) if rng.random() < 0.6 else word(rng.randrange(1, size)) for _ in range(rng.randrange(12))) for _ in range(n)]


# rows of a shard, and how many with one first stretch are dealt by the whole row
@pytest.mark.parametrize("rows,crowd,merged", [(1_000_000, 16, 4096), (200, 1, 2)], ids=["whole", "crowded"])
@pytest.mark.parametrize("length,letters", [(8, "ab"), (24, "abcdefghé漢"), (60, "x"), (60, "ab")])
def test_spans_are_exact(spark, monkeypatch, rows, crowd, merged, length, letters):
    for name, value in (("SHARD_ROWS", rows), ("CROWD", crowd), ("CROWD_MERGED", merged)):
        monkeypatch.setattr(sd, name, value)
    texts = pieced(random.Random(length), 60, letters, 3 * length // 2) + [None, "", "x" * 200, "x" * 200, "ab" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in sd.without_repeats(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, length)


def test_places_depend_on_content_alone():
    rng = np.random.default_rng(1)
    length = 400
    piece = rng.integers(97, 123, length).astype(np.uint8)
    raw = np.concatenate([rng.integers(97, 123, 333).astype(np.uint8), piece, rng.integers(97, 123, 500).astype(np.uint8), piece])
    place, _, gap, least = sd.chosen_places(sd.ByteHashes(raw), np.array([0, len(raw)]), length)
    first = [min(p - a for p in place if p >= a) for a in (333, 333 + length + 500)]
    assert first[0] == first[1] < sd.parse_scales(length)[0]
    assert gap.max() <= 128 and (least < gap).all()


def test_interleaving_sorts_and_tells_common_prefixes():
    rng = np.random.default_rng(5)
    rows = np.zeros(300, sd.ROW)
    for c, n in (("first", 6), ("rest", 3), ("before", 2)):
        rows[c] = rng.integers(0, n, 300)
    rows["at"] = np.arange(300)
    order = ["first", "rest", "before"]
    shards = [np.sort(part, order=order) for part in np.split(rows, [40, 41, 200])]
    merged, agree = sd.interleave(shards, tuple(order))
    keys = [tuple(int(r[c]) for c in order) for r in merged]
    assert keys == sorted(keys) and sorted(merged["at"].tolist()) == list(range(300))
    assert agree.tolist() == [0] + [next((k for k in range(3) if a[k] != b[k]), 3) for a, b in zip(keys, keys[1:])]


def test_odd_rows_and_extra_columns(spark):
    rows = odd_rows()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in sd.without_repeats(odd_docs(spark)).collect())
    want = sorted((r[0] is None, r[0] or 0, *p) for r, p in zip(rows, plain([r[1] for r in rows], 400)))
    assert got == want and sum(bool(w[3]) for w in want) == 5  # both long texts and the three of one letter
    assert sd.without_repeats(no_docs(spark)).collect() == []
    clashing = spark.createDataFrame([("y" * 500, 1, 2)] * 2, "k1 string, found long, text long")
    assert [bytes(r.kept) for r in sd.without_repeats(clashing, id_col="found", text_col="k1").collect()] == [b"", b""]


@pytest.mark.parametrize("crowd", [0, 16])
def test_equal_texts_of_different_shards(spark, crowd, monkeypatch):
    monkeypatch.setattr(sd, "CROWD", crowd)
    rng = random.Random(2)
    twin, lone = ("".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(2))
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(1, twin), (2, lone), (3, twin)], 3), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in sd.without_repeats(docs).collect()}
    assert got == {1: b"", 2: lone.encode(), 3: b""}


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_suffix_dedup"](spark, sf).collect()}
    for d, (n, spans, kept) in zip(docs, plain([d.text for d in docs], 400)):
        assert got[d.doc_id] == (d.doc_id, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
