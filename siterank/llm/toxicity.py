"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon (words and word beginnings that toxic training texts use far more often than others) and the trees are fitted on a bounded sample
of labelled rows. Features are rates over the whole text: lexicon hits plain and disguised, hits close to
a second-person word, capitals, punctuation and disguised words. Every text is scored in one narrow pass.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from siterank.llm.common import discard, fold, stage

SAMPLE_ROWS = 12_000  # labelled rows that are read to fit, about
ENTRIES = 2000  # most words, and most beginnings, in the lexicon
STEM = 5
NEAR = 5  # words between a hit and a second-person word
TREES, DEPTH, STEP = 20, 4, 0.3
REMEMBERED = 1 << 17  # words whose features a task keeps
# Second-person words of the languages at hand, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours u du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes tus".split())
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
FEATURES = ("hits", "weight", "stems", "disguised_hits", "near_second", "second", "capitals", "shouted", "punctuation", "exclaimed", "odd_words",
            "long_runs", "single_letters", "any_hit", "distinct_hits")
_RUN = re.compile(r"(.)\1\1")


def core(word: str) -> str:
    """The word's letters in lower case."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def undisguised(word: str) -> str | None:
    """The letters a disguised word stands for; None for a plain word, punctuation at its ends aside."""
    inner = word.strip(".,;:!?\"'()[]{}%&#*-")
    if not inner or inner.isalpha() or inner.isdigit():
        return None
    return core(inner.translate(DISGUISE)) or None


@dataclass
class Lexicon:
    words: dict
    stems: dict


class WordFeatures(dict):
    """Rows of a table of word features, filled as words come; emptied when full."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.table = lexicon, np.zeros((1024, 14), np.float32)

    def row(self, word: str) -> list:
        letters = core(word)
        weight, stem = self.lexicon.words.get(letters, 0.0), self.lexicon.stems.get(letters[:STEM], 0.0) if len(letters) > STEM else 0.0
        other = undisguised(word)
        hidden = other is not None and not weight and (other in self.lexicon.words or (len(other) > STEM and other[:STEM] in self.lexicon.stems))
        upper = sum(map(str.isupper, word)) if not word.islower() else 0
        return [weight > 0, weight, stem > 0, hidden, letters in SECOND_PERSON, len(letters), upper, len(letters) > 2 and upper == len(letters),
                len(word) - sum(map(str.isalnum, word)), word.count("!") + word.count("?"), other is not None, _RUN.search(word) is not None,
                len(word) == 1 and len(letters) == 1, len(word)]

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = self.row(word)
        self[word] = i
        return i

    def features(self, text: str | None) -> list[float]:
        words = text.split() if text else []
        if not words:
            return [0.0] * len(FEATURES)
        sums, at, near, distinct = np.zeros(14), 0, 0, set()
        for lo in range(0, len(words), 1 << 16):
            part = words[lo:lo + (1 << 16)]
            if len(self) > REMEMBERED:
                self.clear()
            i = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            rows = self.table[i]
            sums += rows.sum(axis=0, dtype=np.float64)
            hits = np.flatnonzero((rows[:, 0] > 0) | (rows[:, 2] > 0) | (rows[:, 3] > 0))
            distinct.update(i[hits].tolist() if len(words) <= 1 << 16 else [core(part[k]) for k in hits])
            second = np.flatnonzero(rows[:, 4])
            if len(hits) and len(second):
                k = np.searchsorted(second, hits)
                gap = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - hits), np.abs(second[np.maximum(k - 1, 0)] - hits))
                near += int((gap <= NEAR).sum())
        n, chars, letters = len(words), max(1.0, sums[13]), max(1.0, sums[5])
        return [sums[0] / n, sums[1] / n, sums[2] / n, sums[3] / n, near / n, sums[4] / n, sums[6] / letters, sums[7] / n, sums[8] / chars,
                sums[9] / n, sums[10] / n, sums[11] / n, sums[12] / n, float(sums[0] + sums[2] + sums[3] > 0), math.log1p(len(distinct))]


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, text, y, held) of about ``rows`` labelled rows, chosen by a hash of the id; one in four is held for calibration."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max(label_col).cast("int").alias("y"))
    share = min(1.0, rows / max(1, marks.count()))
    at = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 24))
    some = marks.where(at < int(share * (1 << 24)) + 1).withColumn("held", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(4)) == 0)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(some), "id")  # at most about ``rows`` rows


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings in at least five and 1 % of the toxic texts whose odds there are over twenty times those elsewhere."""
    def each(batches):
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(map(core, set((text.as_py() or "").split()))) - {""}
                keys = sorted(words) + sorted({f"{w[:STEM]}*" for w in words if len(w) > STEM})
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([y] * len(keys), pa.int32())], ["key", "y"])

    n = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return Lexicon({}, {})
    seen = sample.select("text", "y").mapInArrow(each, "key string, y int").groupBy("key").agg(
        F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).where(F.col("t") >= max(5, toxic // 100))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1)))
    best = seen.withColumn("w", odds).where(F.col("w") >= math.log(20))
    pick = lambda df: {r.key.rstrip("*"): r.w for r in df.orderBy(F.desc("w"), "key").limit(ENTRIES).collect()}
    return Lexicon(pick(best.where("key not like '%*'")), pick(best.where("key like '%*'")))


def _with_features(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def each(batches):
        words = WordFeatures(shared.value)
        for batch in batches:
            values = [words.features(text.as_py()) for text in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.list_(pa.float64()))], [*keep, "features"])

    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = "".join(f"`{c}` {kept.schema[c].dataType.simpleString()}, " for c in keep)
    return kept.mapInArrow(each, f"{kinds}features array<double>")


@dataclass
class Model:
    lexicon: Lexicon
    trees: object
    curve: object
    constant: float | None = None


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``labels``: (id, 0 or 1). Other labels, null ids and ids without a document are passed over; of several labels of an id
    the largest holds. With labels of one kind only, or none, the score is constant: 1 if all are 1, else 0."""
    spark = docs.sparkSession
    sample, sample_path = stage(labelled_sample(docs, labels, id_col, text_col, label_col, rows), "labelled")
    lexicon = learn_lexicon(sample.where("not held"))
    featured, path = stage(_with_features(sample, lexicon, ["id", "y", "held"], "text").coalesce(4), "toxicity-features")
    kinds = {(r[0], r[1]) for r in featured.groupBy("held", "y").count().collect()}
    if len({y for held, y in kinds if not held}) < 2:
        return Model(lexicon, None, None, float(bool(kinds) and all(y == 1 for _, y in kinds)))
    train = featured.select("held", F.col("y").cast("double").alias("label"), array_to_vector("features").alias("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=5, minInstancesPerNode=2).fit(train.where("not held"))
    held = trees.transform(train.where("held")).select("label", vector_to_array("probability")[1].alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(held) if {y for h, y in kinds if h} == {0, 1} else None
    discard(spark, sample_path, path)
    return Model(lexicon, trees, curve)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, score, predicted) of every row. A null or empty text has no feature set; repeated ids keep their rows; other columns are ignored."""
    rows = _with_features(docs, model.lexicon, [id_col], text_col)
    if model.trees is None:
        out = rows.withColumn("score", F.lit(model.constant))
    else:
        raw = model.trees.transform(rows.withColumn("_id", F.col(id_col)).select("_id", array_to_vector("features").alias("features")))
        raw = raw.select("_id", vector_to_array("probability")[1].alias("raw"))
        out = (model.curve.transform(raw) if model.curve else raw.withColumnRenamed("raw", "score")).withColumnRenamed("_id", id_col)
    return out.select(id_col, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(fold(id_col, 5) != 0)
