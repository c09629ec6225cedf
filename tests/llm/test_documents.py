"""Operators on documents, against plain versions and on odd tables."""

import base64
import hashlib
import math
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import linked, near_copies, no_docs, odd_docs, odd_rows, shingles, smallest_reachable, words
from pyspark.sql import functions as F

from siterank.llm import bpe, hidden_markov, jaccard_join, langid, license_scan, line_dedup, minhash, mixing, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    df = odd_docs(spark).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def none(spark):
    return no_docs(spark)


def same_ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in odd_rows())


# --- Jaccard join ------------------------------------------------------------------------

def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1:] if linked(x, y)]
    return smallest_reachable({i for i, _ in sets}, pairs)


def test_jaccard_near_copies(spark):
    docs = near_copies(spark)
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_jaccard_odd_rows(odd, none):
    rows = jaccard_join.jaccard_components(odd).collect()
    assert same_ids(rows)
    want = plain_components([(r[0], r[1]) for r in odd_rows() if r[0] is not None])
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in rows}[9] == 1 and {r.doc_id: r.n_shingles for r in rows}[4] == 0
    assert jaccard_join.jaccard_components(none).collect() == []


def test_tree_finds_all_links():
    rng = np.random.default_rng(1)
    hot = (np.zeros(0, np.uint32), np.zeros(0, np.uint16))
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(30, 60)], rng.integers(0, 1 << 60, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(60)]
    for probe in sets[:10]:
        want = [i for i, m in enumerate(sets) if linked(set(probe.tolist()), set(m.tolist()))]
        assert sorted(jaccard_join.tree_links(probe, sets, hot)) == want


# --- line dedup --------------------------------------------------------------------------

def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1:] or (len(a) == len(b) and a[k + 1:] == b[k + 1:])


def plain_dedup(rows):
    lines = [(i, k, line) for i, t in sorted(rows) for k, line in enumerate(t.split("\n"))]
    first = {}
    for i, k, line in lines:
        first.setdefault(line, (i, k))
    gone = set()
    for i, k, line in lines:
        if len(line) >= 20 and any(place < (i, k) and (o == line or (first[line] == (i, k) and len(o) >= 20 and distance_at_most_one(o, line)))
                                   for o, place in first.items()):
            gone.add((i, k))
    return {i: "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_lines_within_one_edit(spark):
    line = "this line has more than twenty characters"
    rows = [(1, line + "\nshort"), (2, "short\n" + line), (3, line[:7] + "X" + line[8:]), (4, line[:9] + line[10:]), (5, "Z" + line), (6, line + "!!"),
            (7, "another quite different line of text\n" + line[:-1]), (8, line[:3] + line[5:]), (9, "é" * 30), (10, "é" * 31), (11, "é" * 33)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_dedup(rows)
    assert got[3] == "" and got[6] == line + "!!" and got[2] == "short"


def test_lines_random(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abc "), rng.integers(20, 26))) for _ in range(15)]
    rows = []
    for i in range(60):
        line = list(base[rng.integers(15)])
        for _ in range(rng.integers(3)):
            k, what = rng.integers(len(line)), rng.integers(3)
            line[k:k + 1] = [] if what == 0 else ["abc"[rng.integers(3)]] if what == 1 else [line[k], "x"]
        rows.append((i, "".join(line)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_dedup(rows)


def test_short_lines_repeated(spark):
    line = "a line of more than twenty characters"
    rows = [(1, f"Of, edti oner.\nword\n{line}"), (2, "Of, edti oner.\nword\nOf, edti onerx"), (3, f"Of, edti oner.\n{line}!"), (4, "  word \n\n"), (5, "\n  word ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, repeat_words=2).collect()}
    assert got == {1: rows[0][1], 2: "word\nOf, edti onerx", 3: "", 4: rows[3][1], 5: rows[4][1]}


def test_lines_odd_rows(odd, none):
    rows = line_dedup.dedup_lines(odd).collect()
    assert same_ids(rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].text is None and by_id[5].text == "" and by_id[17].text == "\n\n\n" and by_id[2].text == "" and by_id[2].n_removed == 2
    assert by_id[None].text == "a row without an id has some words too"
    assert line_dedup.dedup_lines(none).collect() == []


# --- mixing ------------------------------------------------------------------------------

def test_mix_odd_rows(odd, none):
    rows = mixing.mix_sources(odd).collect()
    assert same_ids(rows) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(r.size for r in rows) == sorted(len(words(r[1])) for r in odd_rows())
    assert mixing.mix_sources(none).collect() == []
    again = mixing.mix_sources(odd.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_targets(spark):
    sizes = {"a": 9000, "b": 200, "c": 30000, None: 4000}
    rows = [(k, "w " * (n // 20), s) for s, n in sizes.items() for k in range(20)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=32).collect()
    # by hand: weights 5, 2, 1, 5; b stops at 600, a at 27,000 and null at 12,000; c takes what is left
    want = {"a": None, "b": 600.0, "c": None, None: 12000.0}
    weights, total, left = {"a": 5, "b": 2, "c": 1, None: 5}, sum(sizes.values()), {}
    open_, rest = set(sizes), float(total)
    while True:
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            left[s] = 3.0 * sizes[s]
            rest -= left[s]
        open_ -= full
    left |= {s: level * weights[s] for s in open_}
    assert left["b"] == want["b"] and left[None] == want[None]
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(left[source[r.doc_id]])
    for s in sizes:
        assert taken[s] == pytest.approx(left[s], abs=32)


def test_mix_draws_every_block_before_a_second_time(spark):
    sources = spark.createDataFrame([(1, 1000, 2500.0), (2, 77, 20.0)], "src int, source_size long, target double")
    slots = mixing.draw_slots(sources, block_words=10, shard_slots=20).collect()
    times = Counter(r.block for r in slots if r.src == 1)
    assert len(times) == 100 and set(times.values()) == {2, 3} and sum(times.values()) == 250
    assert len({r.shard for r in slots}) > 5 and len({(r.src, r.slot) for r in slots}) == len(slots)


def test_repeated_documents_meet_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(None if s == "n" else k, " ".join(f"{s}{k}w{j}" for j in range(int(rng.integers(1, 90)))), s, k) for s in "abn" for k in range(60)]
    rows += [(500, " ".join(f"long{j}" for j in range(3000)), "c", 0), (7, "twice the same row", "a", 1), (7, "twice the same row", "a", 2), (9, "", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    want = {r.source: r.target for r in mixing.source_targets(docs.select("source", F.size(F.split("text", " ")).cast("long").alias("size")).where("text != ''")).collect()}
    got, longest = Counter(), Counter()
    for r in mixing.repeated_documents(docs, block_words=1).collect():
        got[r.source] += len(r.text.split())
    for _, t, s, _ in rows:
        longest[s] = max(longest[s], len(t.split()))
    assert set(want) == set("abcn") and all(abs(got[s] - want[s]) <= longest[s] + 1 for s in want), (got, want)


# --- byte-level BPE ----------------------------------------------------------------------

def test_bpe_equals_library(odd, none):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.encode(odd, PATH, public_tokenizers.PATTERN, ("doc_id", "n", "text"))
    rows = bpe.decode(ids.withColumn("copy", F.col("ids")), PATH, ("doc_id", "text", "copy")).collect()
    assert same_ids(rows)
    for r in rows:
        assert np.frombuffer(r.copy, "<u4").tolist() == own.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).collect() == []
    for piece in ("a" * 700, "ab" * 333, "thblebleou" * 50, "é漢🎉" * 40, "!" * 255, " \t\n" * 60):
        assert bpe.merge(piece.encode(), ranks) == own._encode_single_piece(piece.encode())


def test_bpe_remembers_a_bounded_number_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder({bytes([i]): i for i in range(256)}, public_tokenizers.PATTERN)
    assert len(encoder.encode(" ".join(f"w{i}" for i in range(200)))) // 4 == len(" ".join(f"w{i}" for i in range(200)))
    assert len(encoder) <= 10


# --- language ID -------------------------------------------------------------------------

def test_language_models(spark, sf, none, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = langid.fit(langid.training_rows(docs))
    rows = langid.identify(docs, models, ("doc_id", "lang")).collect()
    held = [r for r in rows if __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.03
    strange = {r.doc_id: r for r in langid.identify(odd, models).collect()}
    assert strange[4].lang_pred == strange[5].lang_pred == strange[13].lang_pred == "und" and strange[13].rejected
    assert strange[14].rejected and not strange[1].rejected is None
    assert langid.identify(none, models).collect() == [] and langid.fit(none).languages == []
    assert langid.identify(odd, langid.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    code = rng.choice([97, 98, 99, 32], 400).astype(np.uint32)
    padded = np.concatenate([np.full(3, 32, np.uint32), code])
    rows, c = np.unique(np.lib.stride_tricks.sliding_window_view(padded, 4), axis=0, return_counts=True)
    models = langid.kneser_ney({"x": (rows, c), "y": (rows[:50], c[:50])}, 4)
    for before in ([97, 98, 99], [99, 99, 32], [97, 97, 97]):
        total = sum(np.exp(models.log_probabilities(np.array([*before, k], np.uint32))[-1]) for k in (97, 98, 99, 32, 120))
        assert total == pytest.approx([1, 1], abs=1e-5)  # 120 stands for all other characters


# --- language-model scoring --------------------------------------------------------------

def test_forward_is_exact():
    rng = np.random.default_rng(2)
    k, v = 3, 5
    first, moves, emits = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T
    lens = np.array([4, 1, 0, 5])
    ids = rng.integers(0, v, lens.sum())
    counts = hidden_markov._empty_counts(v, k)
    got = hidden_markov.sweep(ids, lens, emits, first, moves, counts)
    at, expected = 0, np.zeros((v, k))
    for n, value in zip(lens, got):
        own = ids[at:at + n]
        at += n
        total, paths = 0.0, np.ndindex(*[k] * n) if n else []
        weight = np.zeros((n, k))
        for path in paths:
            p = first[path[0]] * emits[own[0], path[0]]
            for t in range(1, n):
                p *= moves[path[t - 1], path[t]] * emits[own[t], path[t]]
            total += p
            for t in range(n):
                weight[t, path[t]] += p
        if n:
            assert value == pytest.approx(math.log(total))
            np.add.at(expected, own, weight / total)
    assert np.allclose(counts["emits"], expected) and counts["first"].sum() == pytest.approx(3) and counts["moves"].sum() == pytest.approx(lens.sum() - 3)


class _Caught:
    """Takes the place of a table; gives back the function of its groups."""

    def groupBy(self, *_):
        return self

    def applyInArrow(self, function, _):
        return function


def test_sums_of_a_range_hold_no_counts_of_all_blocks_together():
    rng, states, size, blocks = np.random.default_rng(3), 4, 20_000, 30
    words, rows, whole = np.arange(size, dtype=np.uint64) * 7, [], np.zeros((size, states))
    for block in range(blocks):
        share = rng.random((size, states)).astype("<f4").astype(float)
        whole += share
        rows.append((0, block, size, words.tobytes(), hidden_markov._pack(np.full(size, 2)), hidden_markov._pack_share(share), None))
    total, table = hidden_markov._sums(_Caught(), states), hidden_markov._batch(rows, hidden_markov.PIECES)
    tracemalloc.start()
    got = total((pa.scalar(0),), table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == blocks and np.allclose(hidden_markov._unpack_share(got[7]["share"], size, states), whole)
    assert (hidden_markov._unpack(got[7]["total"], size) == 2 * blocks).all()
    # words with their sorted copies and places, and the packed output; all blocks' counts by state are another 32 bytes a word, and were held twice
    assert peak < 70 * size * blocks, peak / (size * blocks)


def test_lm_scores(spark, odd, none):
    rows = hidden_markov.score_texts(odd, held_out=hidden_markov.fold_held_out()).collect()
    assert same_ids(rows)
    held = lambda i: __import__("zlib").crc32(str(i).encode()) % 7 == 2 if i is not None else False
    count = Counter()
    for r in odd_rows():
        if not held(r[0]):
            count.update([*words(r[1]), None])
    n, v = sum(count.values()), len(count)
    text = {r[0]: r[1] for r in odd_rows()}
    for r in rows:
        tokens = [*words(text[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score < 0
    assert hidden_markov.score_texts(none).collect() == []
    untaught = hidden_markov.score_texts(odd, held_out=F.lit(True)).collect()
    assert all(r.base_score == 0 and r.score == pytest.approx(0) and r.n_known == 0 for r in untaught)
    twice = hidden_markov.score_texts(odd, held_out=hidden_markov.fold_held_out(), passes=2).collect()
    assert same_ids(twice)


def test_lm_beats_the_base(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = hidden_markov.score_texts(docs, held_out=hidden_markov.fold_held_out()).groupBy("held_out").agg(F.sum("score"), F.sum("base_score")).collect()
    assert all(r[1] > r[2] for r in s)


def test_lm_passes_over_all_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    settled, once = (hidden_markov.score_texts(docs, **k).agg(F.sum("score"), F.sum("n_tokens")).first() for k in ({}, {"passes": 1}))
    assert settled[0] - once[0] > 0.002 * once[1]


def test_lm_centres_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit(False).alias("held"), "text")
    one, other = (hidden_markov.centres(hidden_markov._blocks(docs.repartition(k)), 4) for k in (1, 5))
    assert one.shape == (4, hidden_markov.PROFILE) and np.allclose(one, other, atol=1e-2)
    assert len({tuple(np.round(c, 2)) for c in one}) == 4


def test_expected_counts_keep_32_bits():
    rng = np.random.default_rng(2)
    share = rng.random((50, 4)) * 10.0 ** rng.integers(-12, 9, (50, 4))
    back = hidden_markov._unpack_share(hidden_markov._pack_share(share), 50, 4)
    assert np.all(np.abs(back - share) <= 2.0 ** -23 * share.sum(axis=1, keepdims=True))


def test_emissions_sum_to_one():
    train, share = np.array([3, 1, 0, 2]), np.array([[2.0, 1.0], [0.5, 0.5], [0, 0], [0.0, 2.0]])
    totals = hidden_markov.Totals(6, 3, share.sum(axis=0), np.array([0.2, 0.1]), None, None)
    assert totals.emissions(train, share).sum(axis=0) == pytest.approx([1, 1])


# --- toxicity ----------------------------------------------------------------------------

def test_toxicity(spark, odd, none):
    rude = [(i, f"{'Fine words ' * (i % 5 + 1)}you are such a blorkface {'and more' * (i % 3)}", 1) for i in range(60)]
    kind = [(i, f"{'Fine words ' * (i % 5 + 1)}you are such a friend {'and more' * (i % 3)}", 0) for i in range(60, 240)]
    docs = spark.createDataFrame([r[:2] for r in rude + kind], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rude + kind] + [(5, 1), (None, 1), (10**6, 0), (70, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "blorkface" in model.lexicon.words
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[r[0]].predicted == r[2] and (got[r[0]].score >= 0.5) == r[2] for r in rude + kind)
    rows = toxicity.score(odd, model).collect()
    assert same_ids(rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, model).collect() == []
    assert toxicity.score(odd, toxicity.fit(none, labels)).agg(F.max("score")).first()[0] == 0


def test_disguised_words():
    features = toxicity.WordFeatures(toxicity.Lexicon({"idiot": 3.0}, {"lowei": 2.0}))
    row = lambda t: dict(zip(toxicity.FEATURES, features.features(t)))
    assert row("You idiot!")["hits"] == 0.5 and row("You idiot!")["near_second"] == 0.5
    assert row("an 1d1ot")["disguised_hits"] == 0.5 and row("i.d.i.o.t")["hits"] == 1 and row("loweick")["stems"] == 1
    assert row(None) == row("") == dict.fromkeys(toxicity.FEATURES, 0.0)


# --- license scans -----------------------------------------------------------------------

def test_licenses(spark, odd, none):
    rows = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(odd).collect()}
    assert set(rows) == {(16, "MIT")} and rows[16, "MIT"].containment == 1.0 and rows[16, "MIT"].first_word == 0
    assert license_scan.scan_licenses(none).collect() == []
    for license, text in license_scan.TEMPLATES:
        for pad in (0, 1, 7, 50):
            body = "pad " * pad + text.upper() + " tail" * pad
            found = license_scan.scan_licenses(spark.createDataFrame([(1, body)], "doc_id long, text string")).collect() if pad == 7 else None
            if found is not None:
                assert license in {r.license for r in found}


# --- fingerprints ------------------------------------------------------------------------

def test_fingerprints(spark, odd, none):
    rows = minhash.edited_fingerprints(odd).collect()
    assert same_ids(rows)
    texts = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(texts):
        after, m = texts[(k + 1) % len(texts)][1], len(t) // 4
        want[i, len(t), hashlib.sha256((t[:len(t) - m] + after[:m]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in rows) == want
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] and prints[4] == prints[5] == prints[6] and prints[1] != prints[9]
    assert minhash.edited_fingerprints(none).collect() == []
    one = minhash.edited_fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert one[0].edited == "abcd efab" and one[0].near_next == 1.0


def test_fingerprints_estimate_similarity(spark):
    docs = near_copies(spark)
    signed = {r.doc_id: np.frombuffer(r.signature, "<u4") for r in minhash.fingerprints(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    ids = sorted(sets)
    off = [minhash.likeness(signed[a], signed[b]) - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1:]]
    assert abs(np.mean(off)) < 0.01 and np.max(np.abs(off)) < 0.25


def test_near_documents(spark, none):
    docs = near_copies(spark)
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    got = {r.id: r.component for r in minhash.near_documents(docs).collect()}
    whole = smallest_reachable(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
    assert all(whole[i] == whole[c] for i, c in got.items())  # no false link
    assert len(got) >= 0.8 * sum(i != c for i, c in whole.items())
    assert minhash.near_documents(none).collect() == []


def test_near_documents_in_a_crowd(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(160):
        text = [f"w{k}" for k in range(104)]
        for k in rng.choice(104, 2, replace=False):
            text[k] = f"v{i}x{k}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, rows[7 * i][1]) for i in range(5)] + [(300, "  "), (301, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    signed = {r.doc_id: np.frombuffer(r.signature, "<u4").reshape(minhash.BANDS, -1) for r in minhash.fingerprints(docs).collect()}
    links = [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b]) and (signed[a] == signed[b]).all(axis=1).any()]
    want = {i: c for i, c in smallest_reachable(sets, links).items() if i != c}
    for chunk_docs in (minhash.CHUNK_DOCS, 7):
        assert {r.id: r.component for r in minhash.near_documents(docs, chunk_docs=chunk_docs).collect()} == want


def test_round_trip_equals_encoding_and_decoding(odd, none):
    one = bpe.round_trip(odd, PATH, public_tokenizers.PATTERN).orderBy("doc_id", "ids").collect()
    ids = bpe.encode(odd, PATH, public_tokenizers.PATTERN)
    two = bpe.decode(ids.withColumn("packed", F.col("ids")), PATH, ("doc_id", "ids"), "packed").orderBy("doc_id", "ids").collect()
    assert one == two and bpe.round_trip(none, PATH, public_tokenizers.PATTERN).collect() == []
