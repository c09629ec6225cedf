"""Small tables with every odd case, and plain versions of what the operators compute."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "And the long tale of words goes on " * 3000
# names that operators use inside
INNER = ("_gone", "_doc", "_hit", "_word", "_bits", "_key", "_n", "_m", "_h1", "_h2", "_times", "_copy", "_row2")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, n int, h1 string, doc string, number int, size int, "
          "block string, score string, features string, b string, `a b` int" + "".join(f", {c} int" for c in INNER))


def odd_rows():
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today.\nA second line that is quite unlike the first one here."),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today.\nA second line that is quite unlike the first one here."),
        (3, "the QUICK brown fox jumps over the lazy dog near the old river bank today.\nA second line that is quite unlike the first one there."),
        (4, None), (5, ""), (6, "  \n\t "), (7, "word"), (8, "word"), (9, "one two three four"), (10, LONG), (11, LONG + " end"),
        (12, "Ünïcödé straße 漢字 🎉 é  nbsp 　wide"), (13, "12345 !!! ??? ..."), (14, "x" * 5000), (14, "x" * 5000), (15, "x" * 5000),
        (16, "Released under the MIT License."), (None, "a row without an id has some words too"), (17, "\n\n\n"), (18, "line one is here\r\nline two is here as well\r\n"),
    ]
    langs, sources = ["en", "de", None], ["s1", None, "", "s2"]
    return [(i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), k, 3, "h", "d", 9, 8, "z", "s", "f", "b", 1, *range(len(INNER))) for k, (i, t) in enumerate(texts)]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return WORD.findall(lowered(text))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(a, b, percent=75):
    inner = len(a & b)
    return bool(a) and bool(b) and 100 * inner >= percent * len(a | b)


def smallest_reachable(nodes, pairs):
    to = {n: n for n in nodes}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        to[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def near_copies(spark, groups=12, copies=6):
    """Texts of 40 words with a few words changed, so that links hold for some pairs and not for others."""
    import random
    rng = random.Random(4)
    rows, doc_id = [], 100
    passage = " ".join(f"shared{i}" for i in range(12))
    for g in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        for c in range(copies):
            own = list(base)
            for _ in range(c % 3):
                own[rng.randrange(40)] = f"v{rng.randrange(10**6)}"
            rows.append((doc_id, " ".join(own) + (f" {passage}" if g % 2 else ""), "en", "s"))
            doc_id += 7
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("id", F.lit(0))
