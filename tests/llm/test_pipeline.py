"""Each stage of the pipeline against a plain version, on the documents its predecessor kept."""

import base64
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from helpers import INNER, no_docs, odd_docs, smallest_reachable
from test_documents import plain_dedup

from siterank.llm import langid
from siterank.llm.common import stage


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, function in corpus_pipeline.STAGES:
        out, _ = stage(function(spark, kept[-1], sf), f"test-{name}")
        kept.append(out)
    for df in kept[1:-1]:
        assert df.columns == docs.columns
    raw, known, lines, apart, mixed, ids = [df.collect() for df in kept]
    models = langid.fit(langid.training_rows(docs))
    assert {r.doc_id for r in known} == {r.doc_id for r in raw if not models.predict(r.text)[3]} and len(known) > 0.97 * len(raw)
    want = plain_dedup([(r.doc_id, r.text) for r in known])
    assert {r.doc_id: r.text for r in lines} == {i: t for i, t in want.items() if t.strip() or t == {r.doc_id: r.text for r in known}[i]}
    from helpers import linked, shingles
    sets = {r.doc_id: shingles(r.text) for r in lines}
    order = sorted(sets)
    component = smallest_reachable(sets, [(a, b) for k, a in enumerate(order) for b in order[k + 1:] if sets[a] & sets[b] and linked(sets[a], sets[b])])
    assert {r.doc_id for r in apart} == {i for i, c in component.items() if i == c}
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= {r.doc_id for r in apart} and max(times.values()) <= 3
    assert Counter(r.doc_id for r in ids) == times and all(r.exact for r in ids)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    token = {i: t for t, i in ranks.items()}
    text = {r.doc_id: r.text for r in mixed}
    assert all(b"".join(token[i] for i in np.frombuffer(r.ids, "<u4").tolist()) == text[r.doc_id].encode() for r in ids)


def test_odd_and_empty_documents(spark, sf):
    for docs in (odd_docs(spark), no_docs(spark)):
        for name, function in corpus_pipeline.STAGES:
            docs, _ = stage(function(spark, docs, sf), f"odd-{name}")
            docs.count()


def test_callers_columns_keep_their_values(spark, sf):
    """Columns named like an operator's own come out as they went in."""
    docs = odd_docs(spark)
    for name in ("line_dedup", "jaccard_join", "mix_sources"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.select(*INNER).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(range(len(INNER)))]


def test_repeated_and_missing_ids(spark, sf):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (3, "other words than those above are here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_each_group(spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in rows if i != 2)
