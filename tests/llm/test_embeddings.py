"""Embedding near-dedup against brute force."""

import math

import numpy as np
import pytest
from helpers import smallest_reachable

from siterank.llm import embedding_dedup


def brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1:]
             if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= embedding_dedup.COSINE]
    return pairs, smallest_reachable({i for i, _ in rows}, pairs)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 32))
    rows = [(i, (middles[i % 12] + rng.normal(size=32) * (0.05 if i % 3 else 0.4)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]
    pairs, component = brute(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    degree = dict.fromkeys(component, 0)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    assert all(got[i].n_links <= degree[i] for i in degree)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(degree.values())
    assert np.mean([got[i].component_id == c for i, c in component.items()]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]),
            (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (12, [-1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, keys string, m int")
    out = embedding_dedup.near_vectors(df).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == 13 and got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[11] == (1, 10, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12))
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []
