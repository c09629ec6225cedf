"""Ranked lexical search: exact inner products found in ball trees of sparse document vectors.

A document's coordinate for a term depends on its count and on the document's length, an item's on how rare the term is; the score
is their inner product, in whole numbers. Each task gathers its documents' vectors in blocks and builds a ball tree over each: a
node has the mean of its vectors and the largest distance from it, and halves its vectors along the line between two far ones. For an item
the nodes are opened best first; a node is left with all its documents if ``item * mean + |item| * radius``, rounded up, is below
the item's least kept score. The ball of a few long texts is wide, so the node's largest coordinates bound it a second time: no
document scores above their product with the item. Leaves are scored exactly. What an item has found goes on from block to block of a task, so later blocks
are pruned harder. Only the kept rows of each task are shuffled.

Vectors hold the terms of the items alone, which leaves every score as it is. Items are taken in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from siterank.llm.common import discard, stage
from siterank.llm.words import split_words, text_slices

TOP = 20
BLOCK_ITEMS = 2048  # items whose terms are sent to the tasks at once
BLOCK_DOCS = 20_000  # documents of a tree, unless their terms reach the next bound first
BLOCK_TERMS = 2_000_000
LEAF_DOCS = 16
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_APART = ~((_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)))


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, lower-cased for A-Z, and where each text's terms begin and end."""
    return split_words(_LOWER[raw], offsets, _APART)


class Items:
    """A block of items: their ids, and the weighted terms of each over a common vocabulary."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        found = [terms_of(raw, offsets) for _, raw, offsets in text_slices(pa.array([t for _, t in rows], pa.large_string()))]
        words = pa.chunked_array([w for w, _ in found], pa.large_binary()).combine_chunks().dictionary_encode()
        self.vocabulary = words.dictionary
        counts = np.concatenate([np.diff(at) for _, at in found]) if found else np.zeros(0, np.int64)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys, times = np.unique(np.repeat(np.arange(len(counts)), counts) * max(1, len(self.vocabulary)) + codes, return_counts=True)
        owner, self.codes, self.times = *np.divmod(keys, max(1, len(self.vocabulary))), times.astype(np.int64)
        self.at = np.searchsorted(owner, np.arange(len(rows) + 1))
        self.weights = np.zeros(len(keys), np.int64)

    def weigh(self, n_docs: int, held_by: np.ndarray) -> None:
        """Weights by how many documents hold each term; a term of no document weighs nothing."""
        rare = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in held_by.tolist()]
        self.weights = np.array(rare, np.int64)[self.codes] * self.times if len(rare) else self.weights


def term_vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(id, n, codes, counts) of every row: all terms of the text, and those of the vocabulary as packed 32-bit values."""
    size = max(1, len(vocabulary))

    def each(batches):
        for batch in batches:
            for first, raw, offsets in text_slices(batch.column(1)):
                words, at = terms_of(raw, offsets)
                known = words.dictionary_encode()
                place = pc.index_in(known.dictionary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                code = place[known.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                keys, counts = np.unique(text[code >= 0] * size + code[code >= 0], return_counts=True)
                ends = pa.py_buffer((4 * np.searchsorted(keys // size, np.arange(len(at)))).astype(np.int32).tobytes())
                packed = [pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends, pa.py_buffer(v.astype("<u4").tobytes())])
                          for v in (keys % size, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), pa.array(np.diff(at)), *packed], ["id", "n", "codes", "counts"])

    return docs.mapInArrow(each, "id long, n long, codes binary, counts binary")


def held_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs; one row of it for each task and term is shuffled."""
    def each(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "m"])

    out = np.zeros(size, np.int64)
    for row in vectors.select("codes").mapInArrow(each, "code long, m long").groupBy("code").agg(F.sum("m").alias("m")).collect():  # at most the vocabulary
        out[row.code] = row.m
    return out


class BallTree:
    """Ball tree over sparse rows: ``values[at[i]:at[i + 1]]`` at columns ``codes[at[i]:at[i + 1]]``; no row is empty."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, at: np.ndarray, size: int, items: Items, leaf: int = LEAF_DOCS):
        self.codes, self.values, self.at = codes, values, at
        self.order = np.arange(len(at) - 1)
        norms = np.sqrt([np.square(items.weights[a:b].astype(float)).sum() for a, b in zip(items.at, items.at[1:])])
        self.nodes, self.bounds = [], []  # (first row, last row, children), and the upper bound of every item's score
        self._build(0, len(self.order), size, items, norms, leaf)

    def _dots(self, lo: int, hi: int, dense: np.ndarray) -> np.ndarray:
        a, b = self.at[lo], self.at[hi]
        return np.add.reduceat(self.values[a:b] * dense[self.codes[a:b]], self.at[lo:hi] - a)

    @staticmethod
    def _products(items: Items, dense: np.ndarray, more) -> np.ndarray:
        """Inner products of all items with ``dense``, and ``more``, rounded up."""
        sums = np.concatenate([[0.0], np.cumsum(items.weights * dense[items.codes])])
        return (sums[items.at[1:]] - sums[items.at[:-1]] + more) * (1 + 1e-9) + 1e-9 * sums[-1] + 1.0

    def _dense(self, row: int, size: int) -> np.ndarray:
        out = np.zeros(size)
        out[self.codes[self.at[row]:self.at[row + 1]]] = self.values[self.at[row]:self.at[row + 1]]
        return out

    def _build(self, lo: int, hi: int, size: int, items: Items, norms: np.ndarray, leaf: int) -> int:
        a, b = self.at[lo], self.at[hi]
        values, starts = self.values[a:b].astype(float), self.at[lo:hi] - a
        mean = np.bincount(self.codes[a:b], values, size) / (hi - lo)
        squares, own = np.add.reduceat(values * values, starts), float(mean @ mean)
        apart = squares - 2 * np.add.reduceat(values * mean[self.codes[a:b]], starts) + own
        # the difference of squares may lose its last digits: they are given back, so that the radius is never too small
        radius = math.sqrt(max(0.0, float(apart.max())) + 1e-9 * (float(squares.max()) + own))
        most = np.zeros(size)
        np.maximum.at(most, self.codes[a:b], values)
        bounds = np.minimum(self._products(items, mean, norms * radius), self._products(items, most, 0.0))
        node = len(self.nodes)
        self.nodes.append((lo, hi, ()))
        self.bounds.append(bounds)
        if hi - lo > leaf:
            one = self._dense(lo + int(apart.argmax()), size)
            far = squares - 2 * self._dots(lo, hi, one)
            along = self._dots(lo, hi, self._dense(lo + int(far.argmax()), size) - one)
            self._permute(lo, hi, np.argsort(along, kind="stable"))
            mid = (lo + hi) // 2
            self.nodes[node] = (lo, hi, (self._build(lo, mid, size, items, norms, leaf), self._build(mid, hi, size, items, norms, leaf)))
        return node

    def _permute(self, lo: int, hi: int, order: np.ndarray) -> None:
        a, b = self.at[lo], self.at[hi]
        lengths = np.diff(self.at[lo:hi + 1])[order]
        ends = np.cumsum(lengths)
        take = np.repeat(self.at[lo:hi][order] - (ends - lengths), lengths) + np.arange(b - a)
        self.codes[a:b], self.values[a:b] = self.codes[take], self.values[take]
        self.at[lo + 1:hi + 1] = a + ends
        self.order[lo:hi] = self.order[lo:hi][order]

    def search(self, items: Items, size: int, found: list[list], ids: np.ndarray, null: np.ndarray, top: int) -> int:
        """Put the best documents of every item into its heap of (score, not null, -id); the number of scored documents."""
        weights, scored = np.zeros(size, np.int64), 0
        for k, kept in enumerate(found):
            mine = slice(items.at[k], items.at[k + 1])
            weights[items.codes[mine]] = items.weights[mine]
            open_nodes = [(-self.bounds[0][k], 0)]
            while open_nodes and not (len(kept) == top and -open_nodes[0][0] < kept[0][0]):
                lo, hi, children = self.nodes[heapq.heappop(open_nodes)[1]]
                if children:
                    for c in children:
                        heapq.heappush(open_nodes, (-self.bounds[c][k], c))
                    continue
                scores = self._dots(lo, hi, weights)
                scored += hi - lo
                for i in np.flatnonzero(scores >= (max(1, kept[0][0]) if len(kept) == top else 1)):
                    row = self.order[lo + i]
                    entry = (int(scores[i]), not null[row], -int(ids[row]))
                    if len(kept) < top:
                        heapq.heappush(kept, entry)
                    elif entry > kept[0]:
                        heapq.heapreplace(kept, entry)
            weights[items.codes[mine]] = 0
        return scored


def _search(vectors: DataFrame, items: Items, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of each item in each task."""
    size = max(1, len(items.vocabulary))

    def each(batches):
        found = [[] for _ in items.ids]
        held, n_held, terms = [], 0, 0

        def flush():
            ids, null = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            codes, counts, lengths = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            m = np.repeat(75 + (25 * np.concatenate([h[5] for h in held]) * n_docs) // n_terms, lengths)
            values = (1_000_000_000 * counts) // (1000 * counts + 12 * m)
            BallTree(codes, values, np.append(0, np.cumsum(lengths)), size, items).search(items, size, found, ids, null, top)

        for batch in batches:
            lengths = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            for lo in range(0, len(batch), 2000):
                part, some = batch.slice(lo, 2000), lengths[lo:lo + 2000]
                codes, counts = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u4").astype(np.int64) for k in (2, 3))
                full = some > 0
                held.append((part.column(0).fill_null(0).to_numpy(zero_copy_only=False)[full], part.column(0).is_null().to_numpy(zero_copy_only=False)[full],
                             codes, counts, some[full], part.column(1).to_numpy()[full]))
                n_held, terms = n_held + int(full.sum()), terms + len(codes)
                if n_held >= BLOCK_DOCS or terms >= BLOCK_TERMS:
                    flush()
                    held, n_held, terms = [], 0, 0
        if n_held:
            flush()
        rows = [(k, items.ids[k], -i if known else None, s) for k, kept in enumerate(found) for s, known, i in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["item", "item_id", "doc_id", "score"])

    return vectors.mapInArrow(each, "item long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal scores by ascending id.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, lower-cased for A-Z only. A null or empty text has no term: such a
    document counts nowhere, such an item has no rows. Texts of any length are read whole. A null document id comes last among
    equal scores. Repeated rows of either table are rows of their own. Empty tables give no rows. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    blocks = max(1, -(-items.count() // block_items))
    out = None
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        block = Items([(r.id, r.text) for r in some.collect()])  # of about block_items items
        vectors, path = stage(term_vectors(docs, block.vocabulary), "term-vectors")
        n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        block.weigh(n_docs, held_counts(vectors, len(block.vocabulary)))
        best, _ = stage(_search(vectors, block, n_docs, max(1, n_terms or 0), top), "best-documents")
        discard(spark, path)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
            F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
