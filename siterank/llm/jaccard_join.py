"""N-gram Jaccard join: exact links between documents by a prefix-tree join of their shingle sets.

Sets are ordered by one global order (frequent shingles last, then by hash). Two sets with
100 * intersection >= 75 * union share a shingle among the first ``n - ceil(0.75 n) + 1`` of each, so
only those are posted and joined. Candidate sets are stored in a trie; the probing set walks it once,
shares the partial overlap of common beginnings and leaves a subtree when the lengths that remain
cannot reach the threshold any more.

Scale: equal sets collapse to one class before anything else. In a crowd of near copies each set is first held against one
other, the smallest id of most of its postings; only sets of *different*
components that still share a posting are then compared, so no group is expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import discard, looked_up, marked, matching, stage, without
from siterank.llm.components import components
from siterank.llm.words import shingle_sets

PERCENT = 75
# The global order puts frequent shingles last, which keeps common passages out of the postings; any order gives the same
# links. Counts are of all documents; the most frequent shingles are listed, those beyond the list keep the order of their hashes.
FREQUENT = 2_000_000  # most shingles listed and broadcast, 6 bytes each
CHUNK_SETS = 512  # sets of a chunk of a posting; a task compares two chunks
LEAST = 3  # documents that hold a listed shingle
_RANGE_ROWS = 4000  # documents for each range of hashes that one task counts
_BATCH = 1 << 21  # shingles counted together before the shuffle
BLOCK = 128  # candidates that share a trie


def _pack(sorted_values: np.ndarray) -> bytes:
    """Differences by byte plane, compressed: one to two bytes a value."""
    return pa.compress(np.diff(sorted_values, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def frequent_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The upper halves of the hashes of frequent shingles, sorted, and in how many documents each occurs.

    Counts are pre-aggregated over batches and dealt by ranges of the hash, so a range holds a shingle once for each batch.
    """
    ranges = max(16, docs.count() // _RANGE_ROWS)
    edges = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 32) // ranges)

    def count(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            cuts = [0, *np.searchsorted(h, edges.astype(np.uint32)).tolist(), len(h)]
            rows = [(k, b - a, _pack(h[a:b]), pa.compress(np.minimum(c[a:b], 65535).astype("<u2").tobytes(), "zstd", asbytes=True))
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "n", "hashes", "counts"])

        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                n += len(s)
                if n >= _BATCH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def total_up(key, table):
        parts = list(zip(*(table.column(c).to_pylist() for c in ("n", "hashes", "counts"))))
        h = np.concatenate([_unpack(p, n) for n, p, _ in parts])
        c = np.concatenate([np.frombuffer(pa.decompress(q, 2 * n, "zstd", asbytes=True), "<u2") for n, _, q in parts])
        h, of = np.unique(h, return_inverse=True)
        c = np.minimum(np.bincount(of, c), 65535).astype("<u2")
        keep = np.flatnonzero(c >= LEAST)
        keep = np.sort(keep[np.argsort(-c[keep].astype(np.int64), kind="stable")[:FREQUENT // ranges]])
        return pa.table({"hashes": pa.array([h[keep].tobytes()], pa.binary()), "counts": pa.array([c[keep].tobytes()], pa.binary())})

    packed = (docs.select(text_col).mapInArrow(count, "range int, n int, hashes binary, counts binary")
              .groupBy("range").applyInArrow(total_up, "hashes binary, counts binary").collect())
    h = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r.hashes, np.uint32) for r in packed)])
    c = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r.counts, np.uint16) for r in packed)])
    order = np.argsort(h)
    return h[order], c[order]


def levels(h: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many documents the shingles occur; 0 if they aren't listed."""
    if not len(hot[0]):
        return np.zeros(len(h), np.int64)
    top = (h >> np.uint64(32)).astype(np.uint32)
    i = np.minimum(np.searchsorted(hot[0], top), len(hot[0]) - 1)
    return np.where(hot[0][i] == top, hot[1][i], 0).astype(np.int64)


def prefix(h: np.ndarray, hot, percent: int = PERCENT) -> np.ndarray:
    """The first shingles in the global order, as many as any linked set must share one of."""
    level = levels(h, hot)
    ordered = h[np.lexsort((h, level))] if level.any() else h
    return ordered[:len(h) - -(-percent * len(h) // 100) + 1] if len(h) else h


def tree_links(probe: np.ndarray, members: list[np.ndarray], hot, percent: int = PERCENT) -> list[int]:
    """Which members link with the probe, found in one walk over a trie of the members' ordered sets."""
    known = np.unique(np.concatenate([probe, *members]))
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, levels(known, hot)))] = np.arange(len(known))
    coded = [np.sort(rank[np.searchsorted(known, m)]) for m in members]
    in_probe = np.zeros(len(known), bool)
    in_probe[rank[np.searchsorted(known, probe)]] = True
    before = np.concatenate([[0], np.cumsum(in_probe)])  # probe shingles of smaller rank
    order = sorted(range(len(coded)), key=lambda i: coded[i].astype(">i8").tobytes())
    rows = [coded[i] for i in order]
    sizes = np.array([len(r) for r in rows])
    shared = [0]  # length of the beginning that a row shares with the row above
    for x, y in zip(rows, rows[1:]):
        n = min(len(x), len(y))
        apart = np.flatnonzero(x[:n] != y[:n])
        shared.append(int(apart[0]) if len(apart) else n)
    shared = np.array(shared)

    def can(overlap: int, left: int, shortest: int) -> bool:
        best = min(overlap + left, len(probe))
        return 100 * best >= percent * (len(probe) + shortest - best)

    found, open_nodes = [], [(0, len(rows), 0, 0)]  # rows lo..hi share their first `depth` shingles, `overlap` of them in the probe
    while open_nodes:
        lo, hi, depth, overlap = open_nodes.pop()
        end = int(sizes[lo]) if hi - lo == 1 else int(shared[lo + 1:hi].min())
        at = int(rows[lo][depth - 1]) + 1 if depth else 0
        if not can(overlap, min(len(probe) - int(before[at]), int(sizes[lo:hi].max()) - depth), int(sizes[lo:hi].min())):
            continue
        overlap += int(in_probe[rows[lo][depth:end]].sum())
        if hi - lo == 1:
            if 100 * overlap >= percent * (len(probe) + int(sizes[lo]) - overlap):
                found.append(order[lo])
            continue
        cuts = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1:hi] == end)).tolist(), hi]
        open_nodes += [(a, b, end, overlap) for a, b in zip(cuts, cuts[1:])]
    return found


def _postings(docs: DataFrame, id_col: str, text_col: str, hot, percent: int) -> DataFrame:
    """(id, n_shingles, digest of the set, posted shingles) of every row."""
    def each(batches):
        for batch in batches:
            n, digests, posted = [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                posted.append(prefix(s, hot.value, percent).view(np.int64))
            ends = np.cumsum([0, *map(len, posted)])
            flat = np.concatenate(posted) if posted else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "n", "digest", "posted"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(each, "id long, n long, digest binary, posted array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, hot, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose texts link. The candidates of each b are dealt into tries of about ``BLOCK`` sets."""
    texts = matching(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
    rows = (dealt.select("b", "block", F.col("a").alias("id"), F.lit(False).alias("probe"))
            .unionByName(dealt.select("b", "block", F.col("b").alias("id"), F.lit(True).alias("probe")).distinct())
            .join(texts, "id").select("b", "block", "probe", "id", "text")
            .repartition("b", "block").sortWithinPartitions("b", "block"))

    def flush(group):
        members = [(i, s) for probe, i, s in group if not probe]
        for _, b, s in (x for x in group if x[0]):
            for k in tree_links(s, [m for _, m in members], hot.value, percent) if members else ():
                yield members[k][0], b

    def each(batches) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for b, block, probe, i, s in zip(*columns, shingle_sets(batch.column(4))):
                if (b, block) != key:
                    out += flush(group)
                    key, group = (b, block), []
                group.append((probe, i, s))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out = list(flush(group))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(each, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(``id_col``, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest id reachable over links of ``100 * intersection >= percent * union``.
    Null and empty texts, and texts of blanks, have no shingle and link with nothing: their component is
    their own id. Equal texts always link. A repeated id gives one row for each of its rows; a null id
    has a null component unless its text equals another's. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hot = spark.sparkContext.broadcast(frequent_shingles(docs, "text"))
    sets, _ = stage(_postings(docs, "id", "text", hot, percent), "shingle-sets", free=True)
    classes, _ = stage(sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")), "set-classes", free=True)

    reps = classes.where("rep is not null").select(F.col("rep").alias("id"))
    copies = sets.select("id", "digest").join(classes, "digest").where("id != rep").select("id").join(reps, "id", "left_anti")
    posted = without(sets.where("n > 0 and id is not null").select("id", "n", "posted"), copies, "id").select(
        "id", "n", F.posexplode("posted").alias("pos", "shingle"))
    # most postings are alone; those that surely are go before the wider shuffles
    several = posted.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1").select("shingle")
    some = marked(posted, several, "shingle").where("_hit").drop("_hit")
    common = some.groupBy("shingle").agg(F.min(F.struct("id", "n", "pos")).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    shared, shared_path = stage(some.join(common, "shingle").select("shingle", "id", "n", "pos", "first"), "shared-shingles", free=True)

    def reach(x: str, y: str):
        """Whether two sets could link if this posting is the first that they share: enough shingles follow it in both."""
        n = [F.col(f"{c}n") for c in (x, y)]
        return (100 + percent) * F.least(*[F.col(f"{c}n") - F.col(f"{c}pos") for c in (x, y)]) >= percent * (n[0] + n[1])

    # each set against the first of most of its postings
    near = (shared.where(F.col("id") != F.col("first.id")).where(reach("", "first."))
            .groupBy(F.col("id").alias("a"), F.col("first.id").alias("b")).agg(F.count("*").alias("m"))
            .groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b")))
    near, near_path = stage(near, "near", free=True)
    links, links_path = stage(_verified(near, docs, hot, percent), "links", free=True)
    stars = components(links, "a", "b")

    # postings on which components meet: their sets are still to be compared with each other
    named = looked_up(shared.drop("first"), stars.withColumnRenamed("node", "id"), "id").select(
        "shingle", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
    meet = named.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("shingle")
    met, met_path = stage(named.join(meet, "shingle"), "met-shingles", free=True)
    # a posting is cut into chunks and each pair of chunks is a join of its own, so that one of very many sets is spread over the tasks
    sizes = met.groupBy("shingle").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("int").alias("chunks"))
    dealt = met.join(sizes, "shingle").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.select("shingle", "id", "n", "pos", "c", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("to")).select(
        "shingle", "id", "n", "pos", "c", "chunk", F.least("chunk", "to").alias("lo"), F.greatest("chunk", "to").alias("hi"))
    left, right = dealt.alias("x"), dealt.alias("y")
    same = "x.shingle = y.shingle and x.lo = y.lo and x.hi = y.hi and x.c < y.c and (x.lo = x.hi or x.chunk != y.chunk)"
    apart = (left.join(right, F.expr(same)).where(reach("x.", "y."))
              .select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct())
    apart, apart_path = stage(apart, "apart", free=True)
    more, more_path = stage(_verified(apart, docs, hot, percent), "links", free=True)
    whole = components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")

    ends = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component"))
    out = sets.select("id", "n", "digest").join(ends, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    hot.unpersist()
    discard(spark, shared_path, near_path, links_path, met_path, apart_path, more_path)
    return out
