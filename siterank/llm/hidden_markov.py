"""Language-model scoring with a hidden Markov model over words.

Latent states are trained by Baum-Welch: every block of documents gives its expected counts (transitions, first states, and each word's
share of each state), which are summed over all blocks by ranges of the word's hash. A text's likelihood is computed exactly by
the scaled forward recursion, for all documents of a block side by side.

A state emits ``(1 - u) * ((1 - MIX) * expected count / total + MIX * count / N)`` for a word of the training texts, and
``u`` for all others together, its expected share of words met once. These sum to one, as the base's do.

Scale: the vocabulary grows with the corpus and is never broadcast or collected. A block holds its own words once; their
counts travel as packed arrays by range of the hash and back to the block, as 32-bit floats in which a share under their own precision is zero. The
first pass takes each training text for one state: the nearest of a few centres, which are chosen and moved over the word profiles of all training
texts. Each later pass estimates every parameter anew from all of them, until their summed likelihood settles. Blocks are a table
bucketed by their number: a pass reads them where they lie and shuffles counts alone. The files of a pass, shuffled ones
included, are removed when the next one has ended. Training passes compute with 32-bit floats, the scores with 64-bit ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import bucketed, discard, fold, stage
from siterank.llm.words import text_slices, word_hashes

STATES = 4
SETTLED = 0.005  # passes end when one raises the mean log-likelihood of a training token by less
MOST_PASSES = 12
PROFILE = 128  # counts of a text's word profile
CENTRE_ROUNDS = 4
CENTRE_TOKENS = 64  # texts that may become a centre have at least so many; if none has, any may
MIX = 0.1
BLOCK_TOKENS = 1_000_000  # a block ends beyond it
RANGE_TOKENS = 2_000_000
END = np.uint64(1)
_SIDE_BY_SIDE = 1 << 18  # tokens of documents that one sweep takes
_PRECISION = 2.0 ** -24  # of a 32-bit float


def sweep(ids: np.ndarray, lens: np.ndarray, emits: np.ndarray, first: np.ndarray, moves: np.ndarray, counts: dict | None = None) -> np.ndarray:
    """Natural log-likelihood of each sequence; with ``counts``, its expected counts are added there.

    Sequences lie one after another in ``ids``. Those of a sweep advance together, the longest first, so that the
    ones still running are always the front rows. All that needs no order of steps is done for a whole sweep at once.
    """
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    out = np.zeros(len(lens))
    ends = np.cumsum(lens[order])
    ones, back = np.ones(len(first), emits.dtype), np.ascontiguousarray(moves.T)
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _SIDE_BY_SIDE, "right")))
        own = order[lo:hi]
        n = lens[own]
        running = len(own) - np.searchsorted(n[::-1], np.arange(n[0]), "right")  # by step
        at = np.concatenate([[0], np.cumsum(running)])  # a step's rows: those of its running sequences
        step = np.repeat(np.arange(len(running)), running)
        row = np.arange(at[-1]) - at[step]
        words = ids[starts[own][row] + step]
        seen = emits[words]
        now, scale = np.empty_like(seen), np.empty(len(seen), seen.dtype)
        cuts, x = at.tolist(), None
        for a, b in zip(cuts, cuts[1:]):
            x = np.multiply(first, seen[a:b], out=now[a:b]) if x is None else np.matmul(x[:b - a], moves, out=now[a:b])
            if a:
                x *= seen[a:b]
            x /= np.matmul(x, ones, out=scale[a:b])[:, None]
        out[own] = np.bincount(row, np.log(scale), len(own))
        if counts is not None:
            seen /= scale[:, None]
            after = np.ones_like(now)
            for a, b, c in zip(cuts[-3::-1], cuts[-2::-1], cuts[:1:-1]):
                ahead = seen[b:c]
                ahead *= after[b:c]
                np.matmul(ahead, back, out=after[a:a + c - b])
            before = at[step[cuts[1]:] - 1] + row[cuts[1]:]
            counts["moves"] += (now[before].astype(np.float64).T @ seen[cuts[1]:].astype(np.float64)) * moves
            now *= after
            counts["first"] += now[:cuts[1]].sum(axis=0)
            for k in range(len(first)):
                counts["emits"][:, k] += np.bincount(words, now[:, k], len(counts["emits"]))
        lo = hi
    return out


def _empty_counts(words: int, states: int) -> dict:
    return {"first": np.zeros(states), "moves": np.zeros((states, states)), "emits": np.zeros((words, states))}


def _normal(x: np.ndarray, prior: float) -> np.ndarray:
    x = x + prior
    return x / x.sum(axis=-1, keepdims=True)


def profiles(hashes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Word profiles of texts: square roots of counts by hash of the word, of length 1."""
    doc = np.repeat(np.arange(len(lens)), lens)
    counts = np.bincount(doc * PROFILE + (hashes >> np.uint64(40)).astype(np.int64) % PROFILE, minlength=len(lens) * PROFILE).reshape(len(lens), PROFILE)
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _profiled(batch: pa.RecordBatch):
    """(profiles, lengths) of the training texts of each block."""
    for vectors, held, lens in zip(*(c.to_pylist() for c in batch.columns)):
        use = ~np.array(held, bool)
        yield np.frombuffer(vectors, "<f2").reshape(-1, PROFILE).astype(float)[use], np.array(lens)[use]


def centres(blocks: DataFrame, states: int) -> np.ndarray:
    """A centre for each state: texts far from each other, then means of the texts nearest to each. Every training text takes part in every step."""
    rows = blocks.select("vectors", "held", "lens")
    found = np.zeros((0, PROFILE))

    def far(batches):
        for batch in batches:
            for x, n in _profiled(batch):
                if len(x):
                    near = (x @ found.T).max(axis=1) if len(found) else -n.astype(float)
                    k = int(np.lexsort((near, n < CENTRE_TOKENS))[0])
                    yield pa.RecordBatch.from_pydict({"short": [bool(n[k] < CENTRE_TOKENS)], "near": [float(near[k])], "x": [x[k].tolist()]})

    for _ in range(states):
        best = rows.mapInArrow(far, "short boolean, near double, x array<double>").agg(F.min(F.struct("short", "near", "x")).alias("b")).first().b
        if best is None:
            return np.zeros((states, PROFILE))
        found = np.vstack([found, best.x])

    def near(batches):
        for batch in batches:
            for x, _ in _profiled(batch):
                group = (x @ found.T).argmax(axis=1)
                for k in np.unique(group):
                    yield pa.RecordBatch.from_pydict({"k": [int(k)], "x": [np.round(x[group == k].sum(axis=0) * 1024) / 1024]},
                                                     pa.schema([("k", pa.int32()), ("x", pa.list_(pa.float64()))]))

    for _ in range(CENTRE_ROUNDS):
        sums = rows.mapInArrow(near, "k int, x array<double>").select("k", F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
        moved = np.zeros_like(found)
        for k, i, v in sums:  # states times PROFILE rows
            moved[k, i] = v
        norm = np.linalg.norm(moved, axis=1, keepdims=True)
        found = np.where(norm > 0, moved / np.maximum(norm, 1e-9), found)
    return found


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<u4").ravel()


def _tokens(texts: pa.Array):
    """(word hashes with an end after each text, lengths) of slices of texts."""
    for _, raw, offsets in text_slices(texts):
        h, at = word_hashes(raw, offsets)
        yield np.insert(h, at[1:], END), np.diff(at) + 1


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents in blocks: their tokens as places in the block's own sorted words, and how often training texts hold each."""
    def each(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, held, hashes, lens = [], [], [], []

        def flush():
            tokens, n = np.concatenate(hashes), np.concatenate(lens)
            words, place = np.unique(tokens, return_inverse=True)
            train = np.bincount(place[np.repeat(~np.array(held, bool), n)], minlength=len(words))
            seen = np.concatenate([profiles(h, m) for h, m in zip(hashes, lens)]).astype("<f2")
            by_use = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(words), np.int64)
            rank[by_use] = np.arange(len(words))
            values = [task << 32 | number, ids, held, n.tolist(), len(tokens), _pack(rank[place]), len(words), words.tobytes(), _pack(rank), _pack(train), seen.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (
                pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int32(), pa.binary(),
                pa.binary(), pa.binary(), pa.binary()))], ["block", "ids", "held", "lens", "n", "tokens", "n_words", "words", "ranks", "train", "vectors"])

        for batch in batches:
            lo = 0
            for h, n in _tokens(batch.column(2)):
                part = batch.slice(lo, len(n))
                lo += len(n)
                ids += part.column(0).to_pylist()
                held += part.column(1).to_pylist()
                hashes.append(h)
                lens.append(n)
                if sum(map(len, hashes)) >= BLOCK_TOKENS:
                    yield flush()
                    number += 1
                    ids, held, hashes, lens = [], [], [], []
        if ids:
            yield flush()

    return docs.mapInArrow(each, "block long, ids array<long>, held array<boolean>, lens array<int>, n int, tokens binary, n_words int, words binary, "
                                 "ranks binary, train binary, vectors binary")


PIECES = "range int, block long, n int, words binary, train binary, share binary, path array<double>"
SUMS = "block long, range int, n int, total binary, share binary, stats array<double>, path array<double>"


def _read(row: dict) -> tuple:
    """(tokens as ranks of their words by use, lengths, words, training counts, place of each rank in the sorted words).

    Sweeps work on tables in the order of the ranks: the rows of frequent words lie together and stay in the cache.
    """
    words = np.frombuffer(row["words"], np.uint64)
    place = np.empty(len(words), np.int64)
    place[_unpack(row["ranks"], len(words))] = np.arange(len(words))
    return _unpack(row["tokens"], row["n"]).astype(np.int32), np.array(row["lens"], np.int64), words, _unpack(row["train"], len(words)), place


def _pack_share(share: np.ndarray) -> bytes:
    """Expected counts by word and state, compressed by state and byte; what is under the precision of the word's sum is zero."""
    exact = np.where(share < share.sum(axis=1, keepdims=True) * _PRECISION, 0.0, share).astype("<f4")
    return pa.compress(exact.T.copy().view(np.uint8).reshape(share.shape[1], -1, 4).transpose(0, 2, 1).tobytes(), "zstd", asbytes=True)


def _unpack_share(packed: bytes, n: int, states: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n * states, "zstd", asbytes=True), np.uint8).reshape(states, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<f4").reshape(states, n).T.astype(np.float64)


def _cut(row: dict, words: np.ndarray, train: np.ndarray, counts: dict, like: float, ranges: int) -> list[tuple]:
    """A block's expected counts by range of the hash."""
    cuts = np.searchsorted(words, np.arange(ranges + 1, dtype=np.uint64)[:-1] * np.uint64((1 << 64) // ranges)).tolist() + [len(words)]
    out = [(k, row["block"], b - a, words[a:b].tobytes(), _pack(train[a:b]), _pack_share(counts["emits"][a:b]), None)
           for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    # what has no word goes with some range; which one does not matter
    path = np.concatenate([counts["first"], counts["moves"].ravel(), [like]]).tolist()
    return [(*out[0][:6], path), *out[1:]] if out else []


def _expected(row: dict, model: Totals, total: np.ndarray, share: np.ndarray, ranges: int) -> list[tuple]:
    """The expected counts of a block's training texts under a model."""
    tokens, lens, words, train, place = _read(row)
    use = ~np.array(row["held"], bool)
    counts = _empty_counts(len(words), len(model.first))
    emits = model.emissions(total, share).astype(np.float32)[place]
    like = sweep(tokens[np.repeat(use, lens)], lens[use], emits, model.first.astype(np.float32), model.moves.astype(np.float32), counts).sum()
    by_rank, counts["emits"] = counts["emits"], np.empty_like(counts["emits"])
    counts["emits"][place] = by_rank
    return _cut(row, words, train, counts, like, ranges)


def _grouped(row: dict, middle: np.ndarray, ranges: int) -> list[tuple]:
    """The counts of a block's training texts, each taken for the state of the nearest centre, which it rarely leaves."""
    tokens, lens, words, train, place = _read(row)
    use, states = ~np.array(row["held"], bool), len(middle)
    group = (np.frombuffer(row["vectors"], "<f2").reshape(-1, PROFILE).astype(float) @ middle.T).argmax(axis=1)
    counts = _empty_counts(len(words), states)
    own = np.repeat(group, lens)[np.repeat(use, lens)]
    by_rank = np.bincount(tokens[np.repeat(use, lens)] * states + own, minlength=len(words) * states).reshape(-1, states)
    counts["emits"][place] = by_rank
    counts["first"] = np.bincount(group[use], minlength=states).astype(float)
    stay = np.bincount(group[use], np.maximum(lens[use] - 1, 0), states)
    counts["moves"] = stay[:, None] * (np.full((states, states), 0.05 / max(1, states - 1)) * (1 - np.eye(states)) + np.eye(states) * 0.95)
    return _cut(row, words, train, counts, 0.0, ranges)


def _batch(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _sums(pieces: DataFrame, states: int) -> DataFrame:
    """Totals of each range's words over all blocks, sent back to each block that holds them, in its order."""
    def total(key, table):
        table = table.combine_chunks()
        blocks, sizes, paths = (table.column(c).to_pylist() for c in ("block", "n", "path"))
        words, trains, shares = ([x.as_buffer() for x in table.column(c)] for c in ("words", "train", "share"))
        known, of = np.unique(np.concatenate([np.frombuffer(w, np.uint64) for w in words]), return_inverse=True)
        of, ends = of.astype(np.int32), np.cumsum([0, *sizes])
        places = [of[a:b] for a, b in zip(ends, ends[1:])]
        # a block holds a word once, so its counts are added where they belong; the blocks' own counts are never held together
        train, share = np.zeros(len(known), np.int64), np.zeros((len(known), states))
        for i, n, own_train, own_share in zip(places, sizes, trains, shares):
            train[i] += _unpack(own_train, n)
            share[i] += _unpack_share(own_share, n, states)
        stats = [float(train.sum()), float((train > 0).sum()), *share.sum(axis=0), *share[train == 1].sum(axis=0)]
        path = np.sum([p for p in paths if p], axis=0).tolist() if any(paths) else None
        out = [(block, key[0].as_py(), n, _pack(train[i]), _pack_share(share[i]), None, None) for block, n, i in zip(blocks, sizes, places)]
        out[0] = (*out[0][:5], stats, path)
        return _batch(out, SUMS)

    return pieces.groupBy("range").applyInArrow(total, SUMS)


def _vector(df: DataFrame, column: str, size: int) -> np.ndarray:
    """Element-wise sum of an array column."""
    rows = df.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum("v")).collect()
    out = np.zeros(size)
    for i, v in rows:
        out[i] = v
    return out


@dataclass
class Totals:
    """What a pass leaves besides the words: sizes, state totals, first states and transitions, and the training texts' likelihood before it."""
    n: int
    v: int
    weight: np.ndarray
    unknown: np.ndarray
    first: np.ndarray
    moves: np.ndarray
    like: float = 0.0

    def emissions(self, train: np.ndarray, share: np.ndarray) -> np.ndarray:
        seen = (1 - self.unknown) * ((1 - MIX) * share / self.weight + MIX * (train / max(1, self.n))[:, None])
        return np.where((train > 0)[:, None], seen, self.unknown)


def _totals(sums: DataFrame, states: int) -> Totals:
    stats, path = _vector(sums, "stats", 2 + 2 * states), _vector(sums, "path", states + states * states + 1)
    n, v, weight, once = int(stats[0]), int(stats[1]), stats[2:2 + states], stats[2 + states:]
    unknown = np.clip((once + 1 / states) / (weight + 1), 1 / (n + v + 1), 0.5) if n else np.ones(states)
    return Totals(n, v, np.maximum(weight, 1e-9), unknown, _normal(path[:states], 0.1), _normal(path[states:-1].reshape(states, states), 0.1), path[-1])


def _returned(table: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray]:
    """(training counts, expected counts by state) of a block's sorted words, from its ranges."""
    rows = sorted(table.to_pylist(), key=lambda r: r["range"])
    return (np.concatenate([_unpack(r["total"], r["n"]) for r in rows]).astype(np.int64),
            np.concatenate([_unpack_share(r["share"], r["n"], states) for r in rows]))


def _next_pass(model: Totals, states: int, ranges: int):
    """A block's expected counts under the model of the pass before."""
    def expected(left, right):
        return _batch(_expected(left.to_pylist()[0], model, *_returned(right, states), ranges), PIECES)
    return expected


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, states: int = STATES, passes: int | None = None) -> DataFrame:
    """(``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out``: a condition; its rows teach nothing (default: none is held out). A null text is empty and has the end as its only token. Repeated
    ids keep their rows and all teach; other columns are ignored. ``passes``: of Baum-Welch over all training texts (default: until the
    likelihood settles). Without training texts every word is unknown and both scores are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = bucketed(_blocks(rows), "blocks", "block")
    n_words = blocks.agg(F.sum(F.col("n_words").cast("long"))).first()[0]
    ranges = max(12, (n_words or 0) // RANGE_TOKENS)
    middle = centres(blocks, states)

    def first_pass(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _batch(_grouped(row, middle, ranges), PIECES).to_batches()

    train_columns = ("block", "held", "lens", "n", "tokens", "n_words", "words", "ranks", "train")
    sums, path = stage(_sums(blocks.select(*train_columns, "vectors").mapInArrow(first_pass, PIECES), states), "word-sums", free=True)
    model, before = _totals(sums, states), None
    for _ in range((passes or MOST_PASSES) - 1):
        pieces = blocks.select(*train_columns).groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(
            _next_pass(model, states, ranges), PIECES)
        sums, next_path = stage(_sums(pieces, states), "word-sums", free=True)
        discard(spark, path)
        path, model = next_path, _totals(sums, states)
        # that of the model before this pass
        if passes is None and before is not None and model.like - before <= SETTLED * model.n:
            break
        before = model.like
    fields = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(left, right):
        row = left.to_pylist()[0]
        tokens, lens, _, _, place = _read(row)
        train, own = _returned(right, states)
        train, own = train[place], own[place]
        ends = np.concatenate([[0], np.cumsum(lens)])[:-1]
        base = np.add.reduceat(np.log10((train + 1) / (model.n + model.v + 1))[tokens], ends)
        known = np.add.reduceat((train > 0).astype(np.int64)[tokens], ends)
        like = sweep(tokens, lens, model.emissions(train, own), model.first, model.moves) / np.log(10)
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lens), pa.array(known),
                         pa.array(np.full(len(lens), model.n)), pa.array(base), pa.array(like)], names=fields)

    out = (blocks.select("block", "ids", "held", "lens", "n", "tokens", "n_words", "words", "ranks", "train").groupBy("block")
           .cogroup(sums.select("block", "range", "n", "total", "share").groupBy("block"))
           .applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    return out.withColumnRenamed("id", id_col)


def fold_held_out(id_col: str = "doc_id"):
    """The fold whose texts teach nothing in the query."""
    return fold(id_col, 7) == 2
