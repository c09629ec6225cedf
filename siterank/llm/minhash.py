"""Document fingerprints by MinHash over word shingles.

A signature holds the minimum of ``PERMUTATIONS`` universal hashes over a text's shingles, computed with numpy for a slice of a text
at a time. Bands of it are joined in Spark to find near documents, whose Jaccard similarity is then verified on the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import matching, stage, without
from siterank.llm.components import components
from siterank.llm.words import shingle_sets

PERMUTATIONS = 128
BANDS = 32  # of 4 values: at a similarity of 0.75 two documents share a band with 0.999995
PERCENT = 75
CHUNK_DOCS = 512  # documents of a chunk of a bucket; a task compares two chunks
BUCKET_DOCS = 2000
MOST_BUCKETS = 2000  # beyond it buckets grow; a task sorts and streams its bucket
_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the upper 32 bits of ``a * shingle + b`` (mod 2**64); all ones for an empty set."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for lo in range(0, len(shingles), 512):
        np.minimum(out, (shingles[lo:lo + 512] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values: an unbiased estimate of the Jaccard similarity. Two empty sets are alike."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, signature) of every row: packed little-endian 32-bit values. A null text has that of the empty one."""
    kept = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))

    def each(batches):
        for batch in batches:
            signed = [signature(s).astype("<u4").tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.binary())], [id_col, "signature"])

    return kept.mapInArrow(each, f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, signature binary")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those (id, other) of ``pairs`` whose texts are similar."""
    texts, _ = stage(matching(docs, pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))), "id"), "band-texts")
    both = pairs.join(texts, "id").join(texts.select(F.col("id").alias("other"), F.col("text").alias("other_text")), "other")

    def verify(batches):
        for batch in batches:
            ok = []
            for a, b in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
                inner = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(inner > 0 and 100 * inner >= percent * (len(a) + len(b) - inner))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["id", "other"])

    return both.select("id", "other", "text", "other_text").mapInArrow(verify, "id long, other long")


def _apart(bands: DataFrame, stars: DataFrame, chunk_docs: int) -> DataFrame:
    """(id, other): pairs that share a band but lie in different components. A bucket is cut into pairs of chunks of about ``chunk_docs``."""
    named = bands.join(stars.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    meet = named.groupBy("band", "value").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).where("low < high").select(
        "band", "value", F.ceil(F.col("m") / chunk_docs).cast("int").alias("chunks"))
    met = named.join(meet, ["band", "value"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt, _ = stage(met.select("band", "value", "id", "c", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("to")).select(
        "band", "value", "id", "c", "chunk", F.least("chunk", "to").alias("lo"), F.greatest("chunk", "to").alias("hi")), "band-chunks")
    left, right = dealt.alias("x"), dealt.alias("y")
    same = "x.band = y.band and x.value = y.value and x.lo = y.lo and x.hi = y.hi"
    return (left.join(right, F.expr(f"{same} and x.c < y.c and (x.lo = x.hi or x.chunk != y.chunk)"))
            .select(F.greatest("x.id", "y.id").alias("id"), F.least("x.id", "y.id").alias("other")).distinct())


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """(id, component) of rows near another, by equal bands and then the verified similarity: every similar pair that shares a band links.

    Equal texts collapse first. Each document is then held against the smallest id of each of its bands, so a crowd of near copies gives one
    pair for each and not all pairs; documents that still share a band but lie in different components are compared with each other.
    Texts without words and null ids are near to nothing.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").where(
        F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    named = docs.select("id", F.sha2("text", 256).alias("digest"))
    classes, _ = stage(named.groupBy("digest").agg(F.min("id").alias("rep")), "text-classes")
    copies, _ = stage(named.join(classes, "digest").where("id != rep").select("id", F.col("rep").alias("other")).distinct(), "text-copies")
    docs = without(docs, copies.select("id").join(classes.select(F.col("rep").alias("id")), "id", "left_anti"), "id")
    width = 4 * PERMUTATIONS // BANDS
    signed, _ = stage(fingerprints(docs, "id", "text"), "signatures")
    bands = signed.select("id", F.posexplode(F.array(*[
        F.substring("signature", 1 + i * width, width) for i in range(BANDS)])).alias("band", "value"))
    least = bands.groupBy("band", "value").agg(F.min("id").alias("other"))
    pairs, _ = stage(bands.join(least, ["band", "value"]).where("id != other").select("id", "other").distinct(), "band-pairs")
    links, _ = stage(_verified(pairs, docs, percent).unionByName(copies), "links")
    stars = components(links, "id", "other")
    apart, _ = stage(_apart(bands, stars, chunk_docs), "band-pairs")
    more, _ = stage(_verified(apart, docs, percent), "links")
    whole = components(stars.select(F.col("node").alias("id"), F.col("component").alias("other")).unionByName(more), "id", "other")
    return whole.select(F.col("node").alias("id"), "component")


def with_next(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(id, text) rows dealt by ranges of the id, so that each is followed by the next one by (id, text) in its task.

    A task's rows are sorted by (bucket, mine descending, id, text). The last of a bucket, with mine = 0, is a copy of the first
    row of the next bucket that has rows, and of the first of all for the last bucket. Texts are shuffled once.
    """
    parts = min(MOST_BUCKETS, max(48, docs.count() // bucket_docs))
    bounds = docs.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    bounds = sorted(set(bounds))
    # the id's place among the bounds, of which there are at most MOST_BUCKETS
    place = F.expr(f"size(filter(array({', '.join(f'{b}L' for b in bounds)}), b -> b <= id))") if bounds else F.lit(0)
    placed = docs.withColumn("own", F.when(F.col("id").isNull(), F.lit(0)).otherwise(place).cast("int"))
    firsts = [(r[0], r[1]) for r in placed.groupBy("own").agg(F.min(F.coalesce("id", F.lit(-1 << 63)))).collect()]  # a row for each bucket
    firsts.sort()
    lead = {}  # bucket of the first row -> bucket that needs it
    for (a, _), (b, _) in zip(firsts, firsts[1:] + firsts[:1]):
        lead[b] = a
    if not firsts:
        firsts, lead = [(0, -1 << 63)], {0: 0}
    first_of = F.create_map(*[x for k, v in firsts for x in (F.lit(k), F.lit(v).cast("long"))])
    lead_of = F.create_map(*[x for k, v in lead.items() for x in (F.lit(k), F.lit(v))])
    own = F.struct(F.col("own").alias("bucket"), F.lit(1).alias("mine"))
    copy = F.struct(F.element_at(lead_of, F.col("own")).alias("bucket"), F.lit(0).alias("mine"))
    is_first = F.coalesce("id", F.lit(-1 << 63)) == F.element_at(first_of, F.col("own"))
    dealt = placed.withColumn("to", F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own)))).select("to.bucket", "to.mine", "id", "text")
    return dealt.repartition(2 * len(firsts), "bucket").sortWithinPartitions("bucket", F.desc("mine"), F.asc_nulls_first("id"), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they are to each other and to the next document's.

    Edited: the last ``floor(n_chars / 4)`` code points are replaced by the first as many of the next document by id (after the last:
    the first), or by all if it has fewer. A null text is empty; equal ids follow each other by text; a null id comes first. One
    document is next to itself. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def emit(out):
        names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    def each(batches):
        held = None  # the row that waits for its next one: bucket, mine, id, text, signature
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                signed = [signature(s) for s in shingle_sets(part.column(3))]
                rows = list(zip(*(c.to_pylist() for c in part.columns), signed))
                pairs = []
                for row in rows:
                    if held and held[1] and held[0] == row[0]:
                        pairs.append((held, row))
                    held = row
                edited = [h[3][:len(h[3]) - len(h[3]) // 4] + n[3][:len(h[3]) // 4] for h, n in pairs]
                again = [signature(s) for s in shingle_sets(pa.array(edited, pa.string()))]
                yield emit([(h[2], len(h[3]), e, h[4].astype(">u4").tobytes().hex(), s.astype(">u4").tobytes().hex(), likeness(h[4], s), likeness(h[4], n[4]))
                            for (h, n), e, s in zip(pairs, edited, again)])

    out = with_next(rows).mapInArrow(each, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
