"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import lowered, no_docs, odd_docs, odd_rows

from siterank.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top=20):
    """{item: [(id, score)]} by scoring every document; ids may be null and come last then."""
    terms = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in terms]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    held = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(terms, lengths):
            m = 75 + (25 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * k * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, k in Counter(TERM.findall(lowered(text))).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search_equals_scoring_all(spark, monkeypatch):
    """Small blocks, equal scores, several blocks of items."""
    monkeypatch.setattr(ls, "BLOCK_DOCS", 17)
    rng = np.random.default_rng(4)
    words = [f"w{int(k)}" for k in rng.zipf(1.4, 5000) % 60]
    docs = [(i, " ".join(words[a:a + n])) for i, (a, n) in enumerate(zip(rng.integers(0, 4000, 300), rng.integers(0, 60, 300)))]
    docs += [(1000 + i, docs[i][1]) for i in range(40)]  # equal scores
    items = [(i, " ".join(words[a:a + 12])) for i, a in enumerate(rng.integers(0, 4900, 25))]
    for blocks in (2048, 7):
        got = ls.ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"),
                               top=5, block_items=blocks)
        assert found(got) == plain_search(docs, items, 5)


def test_bounds_hold_and_prune():
    """No vector of a node scores above the node's bound, and most leaves of a clustered set are never opened."""
    rng = np.random.default_rng(6)
    size, n = 400, 3000
    group = rng.integers(0, 40, n)
    codes = np.sort(group[:, None] * 10 + rng.permuted(np.tile(np.arange(10), (n, 1)), axis=1)[:, :6], axis=1)
    values = rng.integers(100_000, 500_000, (n, 6))
    items = ls.Items([(i, " ".join(f"t{k}" for k in range(i * 10, i * 10 + 5))) for i in range(0, 40)])
    assert len(items.vocabulary) == 200
    items.codes = items.codes % size
    items.weights = rng.integers(1000, 8000, len(items.codes))
    at = np.arange(0, 6 * n + 1, 6)
    tree = ls.BallTree(codes.ravel().copy(), values.ravel().copy(), at.copy(), size, items)
    dense = np.zeros((n, size), np.int64)
    np.put_along_axis(dense, codes, values, axis=1)
    weights = np.zeros((len(items.ids), size), np.int64)
    for k in range(len(items.ids)):
        weights[k, items.codes[items.at[k]:items.at[k + 1]]] = items.weights[items.at[k]:items.at[k + 1]]
    exact = dense @ weights.T
    for (lo, hi, _), bound in zip(tree.nodes, tree.bounds):
        assert (exact[tree.order[lo:hi]] <= bound).all()
    kept = [[] for _ in items.ids]
    scored = tree.search(items, size, kept, np.arange(n), np.zeros(n, bool), 5)
    for k, heap in enumerate(kept):
        order = np.lexsort((np.arange(n), -exact[:, k]))[:5]
        assert sorted(heap, reverse=True) == [(int(exact[i, k]), True, -int(i)) for i in order if exact[i, k] > 0]
    assert scored < n * len(items.ids) / 3


def test_odd_and_empty_tables(spark):
    odd, none = odd_docs(spark), no_docs(spark)
    items = [(1, "the old river bank, MIT license"), (2, None), (3, "... !"), (4, "straße 漢字 ünïcödé"), (None, "word"), (5, "the old river bank, MIT license")]
    asked = spark.createDataFrame([(*i, "x", 7) for i in items], "item_id long, text string, score string, rank long")
    assert found(ls.ranked_search(odd, asked)) == plain_search([(r[0], r[1]) for r in odd_rows()], items)
    assert ls.ranked_search(none, asked).collect() == [] and ls.ranked_search(odd, asked.where("false")).collect() == []
    again = ls.ranked_search(odd.drop("id"), asked.where("item_id = 1").unionByName(asked.where("item_id = 1")))
    assert len(again.collect()) == 2 * len(plain_search([(r[0], r[1]) for r in odd_rows()], items[:1]))


@pytest.mark.parametrize("text,want", [("A1b-ÄÖ_z", ["a1b", "ÄÖ", "z"]), ("", []), (None, []), ("x\x7fy z", ["x", "y", "z"])])
def test_terms(text, want):
    import pyarrow as pa
    from siterank.llm.words import text_slices
    got = [w.decode() for _, raw, offsets in text_slices(pa.array([text], pa.string())) for w in ls.terms_of(raw, offsets)[0].to_pylist()]
    assert got == want == TERM.findall(lowered(text))
