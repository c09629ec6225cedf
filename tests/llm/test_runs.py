"""Periodic runs against direct comparison of words at every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, no_docs, odd_docs, odd_rows

from siterank.llm import periodic_runs as pr
from siterank.llm import queries


def plain_runs(w, least=24):
    """(start, length, period) of every maximal stretch of three periods, by comparing words."""
    best = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= 3 * q:
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items() if e - s >= least)


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    n = rng.randrange(400)
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 30 else 0):
        s = rng.randrange(n - 1)
        p = 1 + rng.randrange(max(1, (n - s) // 3))
        if rng.random() < 0.5 and p > 2:  # a period that itself repeats a smaller one, but for one word
            u = rng.randrange(1, 5)
            w[s:s + p] = [w[s + i % u] for i in range(p)]
            w[s + rng.randrange(p)] = "z"
        for i in range(s, min(n, s + p * rng.randrange(2, 6) + rng.randrange(p + 1))):
            w[i] = w[s + (i - s) % p]
    return w


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    found = 0
    for _ in range(60):
        docs = [repetitive(rng) for _ in range(rng.randrange(1, 12))]
        for first, raw, offsets in pr.text_slices(pa.array([" ".join(d) for d in docs])):
            words, at = pr.split_words(raw, offsets)
            rows, gone = pr._slice_runs(words, at, 3)
            for k in range(len(at) - 1):
                want = plain_runs(docs[first + k], 3)
                assert [tuple(r[1:]) for r in rows.tolist() if r[0] == k] == want
                found += len(want)
    assert found > 1000


def test_synchronising_sets_depend_on_content_alone():
    rng = np.random.default_rng(3)
    piece = rng.integers(0, 9, 60)
    codes = np.concatenate([rng.integers(0, 9, 37), piece, rng.integers(0, 9, 50), piece, rng.integers(0, 9, 20)])
    chosen = pr.synchronising_set(pr._Hashes(codes), len(codes), 8, np.zeros(len(codes), bool))
    inside = [set(c - a for c in chosen if a <= c <= a + 60 - 16) for a in (37, 147)]
    assert inside[0] == inside[1] and inside[0]
    assert np.diff(chosen).max() <= 8


def test_odd_rows_and_extra_columns(spark):
    odd, none = odd_docs(spark), no_docs(spark)
    got = sorted(pr.periodic_runs(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))
    want = []
    for r in odd_rows():
        w = WORD.findall(r[1] or "")
        runs = plain_runs(w) if len(w) < 5000 else [(0, len(w) - (r[0] == 11), 8)]  # the long texts repeat eight words throughout
        want.append((r[0], len(w), runs, collapsed(w, runs)))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == want
    assert pr.periodic_runs(none).collect() == []
    clashing = spark.createDataFrame([("runs of a " * 9, "x", 1, 2)], "n_words string, runs string, collapsed int, id int")
    assert [tuple(x) for x in pr.periodic_runs(clashing, "id", "n_words").first().runs] == [(0, 27, 3)]


def test_query_on_planted_periods(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        w, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        if len(w) > 1200:  # direct comparison takes too long
            continue
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(len(w))]
            planted += 1
        runs = plain_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert got[d.doc_id] == (d.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                                 hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    assert planted > 5
