"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

A hash is the axis (with its sign) nearest to the vector after three rounds of random signs and a Hadamard transform. A table's key
joins several hashes; besides its own bucket a vector enters those where its least certain
hash takes the runner-up axis. Vectors that share a bucket are compared in double precision.

Equal vectors collapse to one class first. Nothing is emitted per pair: a bucket gives each vector its number of new links and the
smallest vector it reaches there. A link met in several buckets is counted in the one
of the smallest key. A bucket of more than ``CHUNK`` vectors is cut into chunks, and each two chunks are a unit of work of their own, so
no unit holds more than two chunks and every candidate is still compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import discard, stage
from siterank.llm.components import components
from siterank.llm.words import mix

COSINE = 0.9
PROBES = 2
CHUNK = 1024
# Per hash of a key, measured at cosine 0.9 and 64 axes: two vectors share a bucket of two hashes with 0.47, of three with 0.25.
SHARED = 0.63
MISSED = 0.01  # links that may be missed, at the threshold itself


def settings(rows: int, axes: int) -> tuple[int, int]:
    """Hashes per key, so that buckets outnumber the rows, and tables, so that at most ``MISSED`` is lost."""
    hashes = max(2, math.ceil(math.log(max(rows, 2)) / math.log(2 * axes) - 0.5))
    return hashes, math.ceil(math.log(MISSED) / math.log(1 - SHARED ** hashes))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (a power of two long) after rounds of sign flips and the fast Hadamard transform."""
    n, d = x.shape
    for s in signs:
        x = x * s
        step = 1
        while step < d:
            y = x.reshape(n, d // (2 * step), 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            step *= 2
        x = x / math.sqrt(d)
    return x


def bucket_keys(x: np.ndarray, hashes: int, tables: int, probes: int = PROBES, seed: int = 17) -> np.ndarray:
    """Keys of each unit row of ``x``, ``tables * probes`` of them, by table."""
    n, dims = x.shape
    axes = 1 << max(0, (dims - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, axes - dims)))
    rng = np.random.default_rng([seed, dims])
    out = np.zeros((n, tables * probes), np.uint64)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(hashes):
            y = rotate(x, rng.choice([-1.0, 1.0], (3, axes)))
            size = np.abs(y)
            i = size.argmax(axis=1)
            top = size[np.arange(n), i]
            best.append(2 * i + (y[np.arange(n), i] < 0))
            size[np.arange(n), i] = -1
            j = size.argmax(axis=1)
            second.append(2 * j + (y[np.arange(n), j] < 0))
            gap.append(top - size[np.arange(n), j])
        order = np.argsort(np.array(gap), axis=0)  # least certain hash first
        for p in range(probes):
            h = np.full(n, t * 1_000_003 + dims, np.uint64)
            for k in range(hashes):
                other = (order[p - 1] == k) if p else np.zeros(n, bool)
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(other, second[k], best[k]).astype(np.uint64) + np.uint64(1))
            out[:, t * probes + p] = h
    return out


def _unit(values: list) -> np.ndarray | None:
    """The vector at length one, or None if it links with nothing."""
    if not values or None in values:
        return None
    x = np.array(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or not top:
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def _hashed(vectors: DataFrame, hashes: int, tables: int) -> DataFrame:
    def each(batches):
        for batch in batches:
            rows = [(i, m, u) for i, m, v in zip(*(c.to_pylist() for c in batch.columns)) if (u := _unit(v)) is not None]
            for dims in sorted({len(u) for _, _, u in rows}):
                own = [r for r in rows if len(r[2]) == dims]
                x = np.stack([u for _, _, u in own])
                keys = bucket_keys(x, hashes, tables).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.int64()),
                     pa.array([u.tobytes() for u in x], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "m", "vector", "keys"])

    return vectors.mapInArrow(each, "id long, m long, vector binary, keys array<long>")


def block_links(key: int, left: tuple, right: tuple | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links first met under ``key``, smallest id reached) of the vectors of one chunk, or of two against each other.

    A chunk is (ids, copies, unit rows, keys as rows, ordered alike by table and probe).
    """
    a, b = left, left if right is None else right
    i, j = np.nonzero(a[2] @ b[2].T >= cosine)
    if right is None:
        i, j = i[i < j], j[i < j]
    new = np.ones(len(i), bool)
    for lo in range(0, len(i), 1 << 16):  # bounded memory for crowded buckets
        x, y = a[3][i[lo:lo + (1 << 16)]], b[3][j[lo:lo + (1 << 16)]]
        for p in range(x.shape[1]):  # keys of different tables are never equal
            t = p // PROBES * PROBES
            for q in range(t, t + PROBES):
                new[lo:lo + len(x)] &= ~((x[:, p] == y[:, q]) & (x[:, p] < key))
    ids = a[0] if right is None else np.concatenate([a[0], b[0]])
    shift = 0 if right is None else len(a[0])
    j = j + shift
    copies = a[1] if right is None else np.concatenate([a[1], b[1]])
    links = np.bincount(i[new], copies[j[new]], len(ids)) + np.bincount(j[new], copies[i[new]], len(ids))
    root = ids.copy()
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        if (root == before).all():
            break
    return ids, links.astype(np.int64), root


def _bucket_links(rows: DataFrame, cosine: float) -> DataFrame:
    """Rows sorted by (key, x, y) make runs; each run is one unit of work."""
    def flush(run):
        key, x, y = run[0][:3]
        chunk = lambda c: (np.array([r[4] for r in c]), np.array([r[5] for r in c]),
                           np.stack([np.frombuffer(r[6]) for r in c]), np.array([r[7] for r in c], np.int64))
        dims = {len(r[6]) for r in run}
        for d in dims:
            own = [r for r in run if len(r[6]) == d]
            left = [r for r in own if r[3] == x]
            right = [r for r in own if r[3] == y] if x != y else None
            if left and (right is None or right):
                ids, links, root = block_links(key, chunk(left), chunk(right) if right else None, cosine)
                some = (links > 0) | (root != ids)
                yield ids[some], links[some], root[some]

    def each(batches):
        run = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if run and row[:3] != run[0][:3]:
                    if len(run) > 1:
                        out += flush(run)
                    run = []
                run.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["id", "links", "root"])
        if len(run) > 1:
            out = list(flush(run))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], ["id", "links", "root"])

    return rows.mapInArrow(each, "id long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(``id_col``, n_links, component_id, kept) of every row.

    Links are pairs found with a cosine of at least ``cosine``. Null, empty and zero vectors and those with a null, NaN or infinite component link with
    nothing and are kept; so do vectors of different lengths with each other. Equal vectors always link. Rows
    that repeat an id are vectors of their own under one name. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("bad", F.coalesce(bad, F.lit(True)))
    named, named_path = stage(rows.select("id", "bad", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "vectors")
    classes, classes_path = stage(named.where("not bad and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("m")), "classes")
    size = classes.agg(F.count("*"), F.lit(0)).first()[0]
    axes = rows.where("not bad").agg(F.max(F.size("v"))).first()[0] or 1
    hashes, tables = settings(size, 1 << max(0, (axes - 1).bit_length()))
    reps = (rows.where("not bad").withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
            .join(classes, ["h1", "h2", "id"]).groupBy("id", "m", "h1", "h2").agg(F.first("v").alias("v")).select("id", "m", "v"))
    hashed, hashed_path = stage(_hashed(reps, hashes, tables), "hashed")
    entries = hashed.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    crowds = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    dealt = entries.join(crowds, "key").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("chunks")))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, "chunk").alias("x"), F.greatest(o, "chunk").alias("y")))
    units = dealt.select("key", "id", "chunk", F.explode(others).alias("u")).select("key", F.col("u.x").alias("x"), F.col("u.y").alias("y"), "chunk", "id")
    work = (units.join(hashed, "id").select("key", "x", "y", "chunk", "id", "m", "vector", "keys")
            .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y"))
    found, found_path = stage(_bucket_links(work, cosine), "vector-links")
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    near = components(found.where("id != root"), "id", "root")
    ends = classes.join(degree, "id", "left").join(near.withColumnRenamed("node", "id"), "id", "left").select(
        "h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    good = named.where("not bad").join(ends, ["h1", "h2"], "left")
    alone = named.where("bad").withColumn("links", F.lit(0)).withColumn("component", F.col("id"))
    out, _ = stage(good.select("id", "links", "component").unionByName(alone.select("id", "links", "component")).select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), "near-vectors")
    discard(spark, named_path, classes_path, hashed_path, found_path)
    return out
