"""Mix sources to target weights, in DataFrame operations only.

Each source's words, its documents one after another in the order of a hash, are packed into blocks of a fixed
length. A source is due ``n_blocks * target / size`` slots; each slot picks its output shard at random, so the counts of a source over the
shards are multinomial and its total is as due. The slots of a source are numbered through
the shards and mapped to blocks by one pseudorandom permutation of the block indexes per pass, so no
block is drawn again before all others. Slots and blocks then join by index.

Scale: sums within a source run over buckets of about ``BUCKET`` documents and then over the buckets; slots
are made in chunks; both are spread by (source, bucket or chunk), so a source with a third of all rows has
no task of its own. Tables that grow with the documents (blocks, offsets, shares) meet in shuffle joins, never in a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siterank.llm.common import as_row, stage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 8192  # slots of an output shard, on average
BUCKET = 1000
CHUNK = 10_000
# Primes above any number of blocks of a source: multiplying by one permutes the block indexes.
PRIMES = (2147483647, 2147483629, 2147483587)


def _hash32(*parts: Column | str) -> Column:
    """The first 32 bits of the md5 of the parts, joined by ``|``: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, n_docs, source_size, target, src) of every source; ``src`` is its place by code point, null last.

    Sources share all words by weight. One that would exceed ``max_passes`` times its size stops there and
    the rest is shared again by weight: all others end at one level per unit of weight, the largest of the levels that hold
    when the k sources that fill first are full.
    """
    cycle = F.array(*map(F.lit, weights))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(cycle, ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", max_passes * F.col("source_size"))
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "src")
    full_before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (total - full_before) / weight_left)
    s = s.withColumn("level", F.max("level").over(W.partitionBy()))
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).select(
        "source", "src", "n_docs", "source_size", "target")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_passes: int, keys: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Each document's words as a span [start, start + size) of its source; and the sources. ``keys`` go along and order equal ids of one size."""
    n_words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    names = [f"h{i + 1}" for i in range(len(keys))]
    sizes, _ = stage(docs.select(*(k.alias(c) for k, c in zip(keys, names)), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words.alias("size"),
                                 F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key")), "sizes")
    sources, _ = stage(source_targets(sizes, weights, max_passes), "sources")
    named = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(
        *names, "id", sizes["source"], "size", "key", "src", "n_docs", "source_size", "target")
    # buckets follow the order of the keys, so a sum over buckets and one within a bucket give the place
    named = named.withColumn("bucket", F.floor(
        F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n_docs") / BUCKET) / F.lit(2.0 ** 32)))
    before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = named.groupBy("src", "bucket").agg(F.sum("size").alias("s")).select(
        "src", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("src", "bucket").orderBy("key", "id", "size", *names).rowsBetween(W.unboundedPreceding, -1)
    placed = (named.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(offsets.hint("merge"), ["src", "bucket"]).withColumn("start", F.col("offset") + F.col("inner"))
              .drop("inner", "offset", "bucket", "key", "n_docs"))
    return stage(placed, "placed")[0], sources


def draw_slots(sources: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES, shard_slots: int = SHARD_SLOTS,
               seed: int = 0) -> DataFrame:
    """(shard, src, slot, block, passed): the blocks that the mix takes, in which shard, and on which pass."""
    due = (sources.where("source_size > 0")
           .withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
           .withColumn("n_slots", F.least(F.floor(F.col("n_blocks") * F.col("target") / F.col("source_size") + 0.5),
                                          max_passes * F.col("n_blocks")))
           .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.sum("n_slots").over(W.partitionBy()) / shard_slots)))
           .where("n_slots > 0").select("src", "n_blocks", "n_slots", "n_shards"))
    chunks = due.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / CHUNK))).alias("chunk")).repartition("src", "chunk")
    draws = chunks.select("src", "n_blocks", "n_shards", F.explode(F.sequence(
        F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n_slots")) - 1)).alias("draw"))
    shard = F.floor(_hash32(F.lit(str(seed)), F.lit("shard"), "src", "draw") * F.col("n_shards") / F.lit(2.0 ** 32))
    counts = draws.groupBy("src", "n_blocks", shard.alias("shard")).agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("src").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # dealt by shard: by source alone, a large source's slots would be one task's
    slots = counts.withColumn("first", first).repartition("src", "shard").select(
        "shard", "src", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    passed = F.floor(F.col("slot") / F.col("n_blocks"))
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.col("passed") % len(PRIMES) + 1).cast("int"))
    turn = _hash32(F.lit(str(seed)), F.lit("turn"), "src", "passed") % F.col("n_blocks")
    return slots.withColumn("passed", passed).select(
        "shard", "src", "slot", "passed",
        ((prime % F.col("n_blocks") * (F.col("slot") % F.col("n_blocks")) + turn) % F.col("n_blocks")).alias("block"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
                max_passes: int = MAX_PASSES, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """(``id_col``, size, source_size, target, taken) of every row of ``docs``.

    size: words of the text, 0 for null and empty ones, which are never taken. A null source is a source of
    its own, the last. Every row counts, repeated ids too; equal ids are ordered by their size. An empty table
    gives an empty one. Other columns are ignored. ``taken`` is the number of the document's words
    in the blocks drawn, at most ``max_passes`` times its size, and depends on nothing but the rows, the parameters and the seed.
    """
    columns = [F.col("id").alias(id_col), "size", "source_size", "target", "taken"]
    return _taken(*_placed(docs, id_col, text_col, source_col, weights, max_passes), max_passes, block_words, seed).select(*columns)


def _taken(placed: DataFrame, sources: DataFrame, max_passes: int, block_words: int, seed: int) -> DataFrame:
    """``placed`` with ``taken``."""
    times = draw_slots(sources, block_words, max_passes, seed=seed).groupBy("src", "block").agg(F.count("*").alias("times"))
    spans = placed.where("size > 0").select("src", "id", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
    words = (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
             - F.greatest(F.col("start"), F.col("block") * block_words))
    taken = (spans.join(times.hint("merge"), ["src", "block"]).groupBy("src", "start", "id", "size")
             .agg(F.sum(words * F.col("times")).alias("taken")))
    some = placed.where("size > 0").join(taken.drop("id").hint("merge"), ["src", "start", "size"], "left")
    return some.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).unionByName(
        placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def _copies(rows: DataFrame) -> DataFrame:
    """(h1, h2, m, n): how often all ``m`` rows of a key are taken together.

    The shares of documents are added up by source, from short to long ones, and a document is taken once more where their sum passes a
    half: so a source's words stay within its longest document of what is taken. Sums run over the sizes of a
    source and parts of about ``BUCKET`` keys of a size.
    """
    one = F.lit(1 << 30)
    keyed = rows.where("size > 0").groupBy("src", "size", "h1", "h2").agg(F.count("*").alias("m"), F.sum("taken").alias("t"))
    keyed = keyed.select("src", "size", "h1", "h2", "m", F.expr("t div size").alias("whole"), F.expr(f"(t % size) * {1 << 30}L div size").alias("share"))
    keyed, _ = stage(keyed, "shares")
    parts = keyed.groupBy("src", "size").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    keyed = keyed.join(parts.hint("merge"), ["src", "size"]).withColumn("part", F.pmod("h1", F.col("parts"))).drop("parts")
    before = W.partitionBy("src").orderBy("size", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy("src", "size", "part").agg(F.sum("share").alias("s")).select(
        "src", "size", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("src", "size", "part").orderBy("h1", "h2").rowsBetween(W.unboundedPreceding, 0)
    summed = keyed.withColumn("inner", F.sum("share").over(within)).join(offsets.hint("merge"), ["src", "size", "part"]).withColumn(
        "upto", F.col("offset") + F.col("inner") + F.lit(1 << 29))
    more = F.floor(F.col("upto") / one) - F.floor((F.col("upto") - F.col("share")) / one)
    return summed.select("h1", "h2", "m", (F.col("whole") + more).alias("n")).where("n > 0")


def repeated_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, weights=WEIGHTS,
                       max_passes: int = MAX_PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` as the mix repeats them: whole documents, each as often as its words are taken.

    Shares of documents are rounded by their sum within each source, so a source's words stay within its longest document of the
    words taken. Documents without words go. Ids may be null or repeat: a row is known by its id, source and text. Rows
    that agree in all three share their copies as evenly as can be.
    """
    parts = [F.col(source_col), F.col(text_col).cast("string")]
    gaps = [F.col(c).isNull() for c in (id_col, source_col)]
    h1 = F.xxhash64(F.lit(seed), F.col(id_col), *parts, *gaps)
    h2 = F.xxhash64(F.lit(seed), F.lit("second"), F.col(id_col), *parts, *gaps)
    placed, sources = _placed(docs, id_col, text_col, source_col, weights, max_passes, (h1, h2))
    times, _ = stage(_copies(_taken(placed, sources, max_passes, block_words, seed)).select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("m").alias("_m"), F.col("n").alias("_n")), "copies")
    named = docs.select(as_row(docs), h1.alias("_h1"), h2.alias("_h2"))
    out = named.join(times.where("_m = 1"), ["_h1", "_h2"]).withColumn("_times", F.col("_n"))
    if not times.where("_m > 1").isEmpty():
        place = F.row_number().over(W.partitionBy("_h1", "_h2").orderBy(F.xxhash64("_row")))
        out = out.unionByName(named.join(times.where("_m > 1"), ["_h1", "_h2"]).withColumn(
            "_times", F.expr("_n div _m") + F.when(place <= F.col("_n") % F.col("_m"), 1).otherwise(0)))
    return out.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")
