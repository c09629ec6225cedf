"""Line dedup by a deletion-neighbourhood join.

A line goes when an earlier line, by (id, line number), is equal or within one edit (one character inserted,
deleted or replaced). Equal lines collapse first. Each distinct line then emits keys of all its variants
within the bound: the text without character i under (i, rest), so that equal keys are lines that differ in at most that
one character, and under (rest) to meet a whole line equal to it. Equal keys join, the edit distance to the earliest line of a key
is verified, and the earliest stays.

Because of those two kinds of keys every line of a key is within the bound of the earliest one (or of the one whole
line of the key), so a key is settled by its minimum: no pairs are emitted, however many lines share it.

Scale: lines within one edit agree on all but one of ``n`` stretches, counted from the front up to some stretch and from
the back after it. Lines that share no such key with another are dropped, first with 2 stretches and then with
8 and 32, so variants are made of few lines. Whole texts are shuffled only where a line goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import as_row, discard, matching, stage
from siterank.llm.words import mix

MIN_CHARS = 20  # shorter lines (headings, list marks, blank lines) are never removed
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _stretch_keys(line: str, parts: int):
    """Hashes of what a line shares with any within one edit: ``parts - 1`` of its stretches, from the front and from the back."""
    def stretches(length):
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(F.floor(length / parts).cast("int").alias("q"), i.alias("i")))

    # of the line's own length for an equally long or longer partner, of one less for a shorter one
    own = F.length(line)
    return F.transform(F.array_distinct(F.concat(stretches(own), stretches(own - 1))), lambda k: F.xxhash64(
        k, F.substr(F.col(line), F.lit(1), k["i"] * k["q"]), F.right(F.col(line), (F.lit(parts - 1) - k["i"]) * k["q"])))


def _shared_keys(lines: DataFrame) -> DataFrame:
    """Ids (h1, h2) of lines that have one of their ``keys`` in common with another distinct line."""
    keyed = lines.select("h1", "h2", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key")
    return keyed.join(several, "key").select("h1", "h2").distinct()


def variant_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kinds) of a line: 0 the line whole and 1 the line less a character, under (rest); 2 the same under (i, rest)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(code)
    up = np.full(n + 1, _BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    front = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[:-1])])  # sum of code[j] * base**j
    total = front[-1]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    # without character i, those after it move one place to the front
    without = front[:-1] + (total - front[1:]) * inverse
    whole = mix(np.array([total], np.uint64) ^ np.uint64(n))
    rest = mix(without ^ np.uint64(n - 1))
    placed = mix(rest ^ mix(np.arange(1, n + 1, dtype=np.uint64)))
    rest = np.unique(rest)
    return np.concatenate([whole, rest, placed]), np.repeat(np.array([0, 1, 2], np.int32), [1, len(rest), n])


def _variants(lines: DataFrame) -> DataFrame:
    def each(batches):
        for batch in batches:
            ids, first, number = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for j, text in enumerate(batch.column(3)):
                keys, kinds = variant_keys(text.as_py())
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds), *(pa.array(np.repeat(x[j], n)) for x in (ids, first, number))],
                                                 ["key", "kind", "line_id", "doc", "number"])

    return lines.select("line_id", "doc", "number", "line").mapInArrow(each, "key long, kind int, line_id long, doc long, number int")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, repeat_words: int | None = None) -> DataFrame:
    """(doc, number) of the lines that go; numbers count from 0 within the text."""
    spark = docs.sparkSession
    long_enough = F.length("line") >= min_chars
    counted = long_enough if repeat_words is None else long_enough | (F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")) >= repeat_words)
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("number", "line")).where(
        counted).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))
    places, places_path = stage(lines.select("doc", "number", "h1", "h2",
                                       (_stretch_keys("line", 2) if repeat_words is None else F.when(long_enough, _stretch_keys("line", 2))).alias("keys")), "lines")
    first, first_path = stage(places.groupBy("h1", "h2").agg(F.min(F.struct("doc", "number")).alias("f")).select(
        "h1", "h2", F.col("f.doc").alias("doc"), F.col("f.number").alias("number")), "first-lines")

    hits, hits_path = stage(_shared_keys(places).join(first, ["h1", "h2"]), "line-hits")
    texts = matching(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), hits, "doc")
    picked = hits.join(texts, "doc").select("h1", "h2", "doc", "number", F.element_at(F.split("text", "\n"), F.col("number") + 1).alias("line"))
    few, few_path = stage(picked.where(F.xxhash64("line") == F.col("h1")), "near-lines")
    paths = [places_path, first_path, hits_path, few_path]
    for parts in (8, 32):
        few, path = stage(few.join(_shared_keys(few.withColumn("keys", _stretch_keys("line", parts))), ["h1", "h2"], "left_semi"), "near-lines")
        paths.append(path)
    few = few.withColumn("line_id", F.col("h1"))
    keyed, path = stage(_variants(few), "line-variants")
    paths.append(path)
    place = F.struct("doc", "number", "line_id", "kind")
    # per key: the earliest line of the kind-2 keys, and for (rest) keys the earliest whole and the earliest shortened line
    ends = keyed.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 2, place)).alias("swap"), F.min(F.when(F.col("kind") == 0, place)).alias("whole"),
        F.min(F.when(F.col("kind") == 1, place)).alias("short"), F.count("*").alias("m")).where("m > 1").drop("m")
    other = F.when(F.col("kind") == 2, F.col("swap")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("short"))
    met = (keyed.join(ends, "key").withColumn("other", other).where("other is not null")
           .where(F.struct("other.doc", "other.number") < F.struct("doc", "number"))
           .select("line_id", F.col("other.line_id").alias("earlier")).distinct())
    text_of = few.select("line_id", "line")
    close = (met.join(text_of, "line_id").join(text_of.select(F.col("line_id").alias("earlier"), F.col("line").alias("other")), "earlier")
             .where(F.abs(F.length("line") - F.length("other")) <= 1).where(F.levenshtein("line", "other", 1).between(0, 1))
             .select(F.col("line_id").alias("h1")).distinct())
    gone = few.join(close, "h1", "left_semi").select("h1", "h2").distinct()
    repeats = places.drop("keys").join(first.select("h1", "h2", F.col("doc").alias("d0"), F.col("number").alias("n0")), ["h1", "h2"]).where(
        (F.col("doc") != F.col("d0")) | (F.col("number") != F.col("n0"))).select("doc", "number")
    nearly = first.join(gone, ["h1", "h2"], "left_semi").select("doc", "number")
    out, _ = stage(repeats.unionByName(nearly).distinct(), "repeated-lines")
    discard(spark, *paths)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, repeat_words: int | None = None) -> DataFrame:
    """``docs`` with each text less its repeated lines, and the added columns ``n_lines`` and ``n_removed``.

    Lines are what ``\\n`` parts; lines of fewer than ``min_chars`` characters always stay, unless ``repeat_words`` is given: then those
    of at least so many words go if an earlier line is equal (one edit away does not count). Null and empty texts stay as they are, with 0 lines removed.
    A text whose every line repeats becomes empty. Rows with a null id are left alone and are no earlier line to
    others; rows that repeat an id count as one document: the same line number of any of them goes. Columns named ``n_lines`` or
    ``n_removed`` are replaced.
    """
    gone = repeated_lines(docs, id_col, text_col, min_chars, repeat_words).groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("number").alias("_gone"))
    joined = docs.select(as_row(docs), F.col(f"`{id_col}`").cast("long").alias("_doc")).join(gone, "_doc", "left")
    text = F.col(f"_row.`{text_col}`")
    parts = F.split(text.cast("string"), "\n")
    kept = F.concat_ws("\n", F.filter(parts, lambda _, i: ~F.array_contains("_gone", i)))
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")}
    columns[text_col] = F.when(F.col("_gone").isNull(), text).otherwise(kept)
    return joined.select(*(v.alias(c) for c, v in columns.items()), F.when(text.isNotNull(), F.size(parts)).otherwise(0).alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"))
