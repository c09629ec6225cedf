"""Language ID by interpolated Kneser-Ney character models, one for each language.

A model holds the n-grams of all languages in one sorted array of hashes per order, each with a
row of log-probabilities, one for each language. A text goes to the language of the lowest cross-entropy per
character; it is rejected when that entropy lies beyond what any labelled calibration text showed.

The models are fitted on a bounded sample of labelled rows (``rows_per_language``), counted in Spark; every
text is then scored whole, in one narrow pass, in slices of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siterank.llm.common import fold
from siterank.llm.words import mix

ORDER = 4
ROWS_PER_LANGUAGE = 1500
NONE = "und"
SLACK = 2.5  # a text is accepted up to so many times the worst excess among the calibration texts
_SLICE = 1 << 20  # characters scored at once
_BASE = np.uint64(0x100000001B3)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than letters made one space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _ALPHA[np.minimum(code, len(_ALPHA) - 1)]
    far = code >= len(_ALPHA)
    if far.any():
        values, place = np.unique(code[far], return_inverse=True)
        alpha = alpha.copy()
        alpha[far] = np.array([chr(v).isalpha() for v in values])[place]
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    return np.where(alpha, code, np.uint32(32))[keep]


def _alphabet() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x3000)])


_ALPHA = _alphabet()


def _gram_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        h = h * _BASE + rows[:, i].astype(np.uint64) + np.uint64(1)
    return mix(h)


@dataclass
class Models:
    """Sorted hashes and log-probabilities of the n-grams of each order; weights left to shorter ones by each context."""
    languages: list
    hashes: list  # by order - 1
    scores: list
    contexts: list
    left: list
    base: float
    worst: np.ndarray | None = None  # by language: mean, and largest calibrated excess, of the entropy
    sharpness: float = 1.0

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each character given those before it, by language.

        The text is preceded by spaces. Only characters whose n-gram no language knows go on to shorter ones.
        """
        order = len(self.hashes)
        padded = np.concatenate([np.full(order - 1, 32, np.uint64), code.astype(np.uint64)]) + np.uint64(1)
        out = np.zeros((len(code), len(self.languages)), np.float32)
        todo = None  # all
        for k in range(order, 0, -1):
            h = np.zeros(len(code) if todo is None else len(todo), np.uint64)
            for i in range(order - k, order):
                before = h
                h = h * _BASE + (padded[i:i + len(code)] if todo is None else padded[i + todo])
            h = mix(h)
            i = np.minimum(np.searchsorted(self.hashes[k - 1], h), len(self.hashes[k - 1]) - 1)
            hit = self.hashes[k - 1][i] == h
            if todo is None:
                out[hit] = self.scores[k - 1][i[hit]]
                todo = np.flatnonzero(~hit)
            else:
                out[todo[hit]] += self.scores[k - 1][i[hit]]
                todo = todo[~hit]
            if not len(todo):
                return out
            if k > 1:
                c = mix(before[~hit])
                i = np.minimum(np.searchsorted(self.contexts[k - 1], c), len(self.contexts[k - 1]) - 1)
                known = self.contexts[k - 1][i] == c
                out[todo[known]] += self.left[k - 1][i[known]]
        out[todo] += self.left[0] + self.base
        return out

    def entropy(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of letters and spaces, and nats per character by language."""
        code = letters(text or "")
        if not (code != 32).any():
            return 0, np.zeros(len(self.languages))
        total = np.zeros(len(self.languages))
        lead = len(self.hashes) - 1
        for a in range(0, len(code), _SLICE):
            part = code[max(0, a - lead):a + _SLICE]
            total -= self.log_probabilities(part)[min(a, lead):].sum(axis=0, dtype=np.float64)
        return len(code), total / len(code)

    def excess(self, n: int, entropy: float, language: int) -> float:
        """How far the entropy lies above the language's mean, in units that don't depend on the length."""
        return (entropy - self.worst[language, 0]) * min(n, 400) ** 0.5

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, posterior, entropy per character, rejected."""
        n, h = self.entropy(text) if self.languages else (0, None)
        if not n:
            return NONE, 0.0, 0.0, True
        best = int(h.argmin())
        score = 1.0 / np.exp(-(h - h[best]) * n * self.sharpness).sum()
        return self.languages[best], float(score), float(h[best]), bool(self.excess(n, h[best], best) > self.worst[best, 1])


def kneser_ney(counts: dict, order: int) -> Models:
    """Models from ``{language: (n-grams as rows of code points, counts)}`` of the highest order."""
    languages = sorted(counts)
    levels = []  # by language, by order: (rows, counts)
    for lang in languages:
        rows, c = counts[lang]
        own = {order: (rows, c.astype(np.float64))}
        for k in range(order - 1, 0, -1):  # below the top, in how many contexts a gram occurs
            shorter, c = np.unique(own[k + 1][0][:, 1:], axis=0, return_counts=True)
            own[k] = (shorter, c.astype(np.float64))
        levels.append(own)
    alphabet = len(np.unique(np.concatenate([own[1][0] for own in levels]))) + 1
    hashes, scores, contexts, left = [], [], [], []
    lower = None
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([own[k][0] for own in levels]), axis=0)
        h = _gram_rows(union)
        by_hash = np.argsort(h)
        union, h = union[by_hash], h[by_hash]
        stems = np.unique(union[:, :-1], axis=0)
        stem_h = _gram_rows(stems) if k > 1 else np.zeros(1, np.uint64)
        by_hash = np.argsort(stem_h)
        stem_h = stem_h[by_hash]
        p, w = np.zeros((len(h), len(languages))), np.ones((len(stem_h), len(languages)))
        of_union = np.searchsorted(stem_h, _gram_rows(union[:, :-1])) if k > 1 else np.zeros(len(h), np.int64)
        for j, own in enumerate(levels):
            rows, c = own[k]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            stem = np.searchsorted(stem_h, _gram_rows(rows[:, :-1])) if k > 1 else np.zeros(len(c), np.int64)
            total, kinds = np.bincount(stem, c, len(stem_h)), np.bincount(stem, minlength=len(stem_h))
            seen = total > 0
            w[seen, j] = discount * kinds[seen] / total[seen]
            p[np.searchsorted(h, _gram_rows(rows)), j] = (c - discount) / total[stem]
        shorter = np.full((len(h), len(languages)), 1.0 / alphabet)
        if k > 1:
            shorter = lower[1][np.searchsorted(lower[0], _gram_rows(union[:, 1:]))]
        p += w[of_union] * shorter
        lower = (h, p)
        hashes.append(h)
        scores.append(np.log(p).astype(np.float32))
        contexts.append(stem_h)
        left.append(np.log(w).astype(np.float32) if k > 1 else np.log(w[0]).astype(np.float32))
    return Models(languages, hashes, scores, contexts, left, float(-np.log(alphabet)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        rows_per_language: int = ROWS_PER_LANGUAGE, order: int = ORDER) -> Models:
    """Models from the labelled rows of ``docs``.

    About ``rows_per_language`` rows of each language are read, chosen by a hash of the id. One in eight of them is
    kept for calibration: the sharpness of the posterior and the entropy beyond which a text is rejected.
    Rows with a null text or label, and texts without letters, teach nothing; a language needs one text.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                           F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 24)).alias("_at")).where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return Models([], [], [], [], [], 0.0)
    chosen = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(int((1 << 24) * min(1.0, rows_per_language / r[1])) + 1))])
    sample = labelled.where(F.col("_at") < F.element_at(chosen, F.col("lang")))
    names = [f"g{i}" for i in range(order)]

    def count(batches):
        for batch in batches:
            by_lang = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                code = letters(text.as_py())
                if (code != 32).any():
                    padded = np.concatenate([np.full(order - 1, 32, np.uint32), code])
                    by_lang.setdefault(lang, []).append(np.lib.stride_tricks.sliding_window_view(padded, order))
            for lang, parts in by_lang.items():
                rows = np.concatenate(parts)
                h = _gram_rows(rows)
                _, first, c = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(c)] + [pa.array(rows[first, i].astype(np.int32)) for i in range(order)],
                                                 ["lang", "c", *names])

    held = F.col("_at") % 8 == 0
    table = (sample.where(~held).select("text", "lang").mapInArrow(count, "lang string, c long, " + ", ".join(f"{n} int" for n in names))
             .groupBy("lang", *names).agg(F.sum("c").alias("c")).toArrow())
    if not len(table):
        return Models([], [], [], [], [], 0.0)
    # by language number: no Python object for each n-gram on the driver
    lang = table.column("lang").combine_chunks().dictionary_encode()
    number = lang.indices.to_numpy()
    rows = np.stack([table.column(n).to_numpy() for n in names], axis=1).astype(np.uint32)
    c = table.column("c").to_numpy()
    models = kneser_ney({x: (rows[number == k], c[number == k]) for k, x in enumerate(lang.dictionary.to_pylist())}, order)
    del table, lang, number, rows, c

    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        for batch in batches:
            out = [(lang, *shared.value.entropy(text.as_py())) for text, lang in zip(batch.column(0), batch.column(1).to_pylist())]
            out = [(lang, n, h.tolist()) for lang, n, h in out if n]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()),
                                              pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["lang", "n", "h"])

    seen = sample.where(held).select("text", "lang").mapInArrow(measure, "lang string, n long, h array<double>").collect()
    return calibrated(models, [(r.lang, r.n, np.array(r.h)) for r in seen if r.lang in models.languages])


def calibrated(models: Models, seen: list) -> Models:
    """Set sharpness and rejection from the (language, length, entropies) of labelled texts."""
    worst = np.full((len(models.languages), 2), [0.0, np.inf])
    for j, lang in enumerate(models.languages):
        own = [(n, h[j]) for x, n, h in seen if x == lang]
        if own:
            worst[j, 0] = np.median([h for _, h in own])
            models.worst = worst
            worst[j, 1] = max(1.0, SLACK * max(models.excess(n, h, j) for n, h in own))
    models.worst = worst
    if seen:
        right = np.array([models.languages.index(x) for x, _, _ in seen])
        n, h = np.array([x[1] for x in seen]), np.stack([x[2] for x in seen])

        def loss(t):
            z = -(h - h.min(axis=1, keepdims=True)) * n[:, None] * t
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), right]).mean())

        models.sharpness = min((2.0 ** -e for e in range(13)), key=loss)
    return models


def identify(docs: DataFrame, models: Models, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(``keep``, lang_pred, score, entropy, rejected) of every row.

    A null or empty text, and one without a letter, is ``und`` with score 0 and rejected. Of equal entropies the first language by
    name wins. Repeated ids keep their rows; columns outside ``keep`` are ignored; without any fitted language all are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    names = [*keep, "lang_pred", "score", "entropy", "rejected"]

    def each(batches):
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                out = [shared.value.predict(text.as_py()) for text in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())))], names)

    added = T.StructType().add("lang_pred", "string").add("score", "double").add("entropy", "double").add("rejected", "boolean")
    return kept.mapInArrow(each, T.StructType([kept.schema[c] for c in keep] + added.fields))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows outside the held-out fold."""
    return docs.where(fold(id_col, 5) != 0)
