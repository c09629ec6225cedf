"""One query for each operator, over its whole table."""

from __future__ import annotations

from siterank.llm.embedding_dedup import near_vectors
from siterank.llm.hidden_markov import fold_held_out, score_texts
from siterank.llm.jaccard_join import jaccard_components
import public_tokenizers
from pyspark.sql import functions as F

from siterank.llm import bpe, langid, toxicity
from siterank.llm.common import fold
from siterank.llm.lexical_search import ranked_search
from siterank.llm.license_scan import TEMPLATES, scan_licenses
from siterank.llm.line_dedup import dedup_lines
from siterank.llm.minhash import edited_fingerprints
from siterank.llm.mixing import mix_sources
from siterank.llm.periodic_runs import periodic_runs
from siterank.llm.registry import ORACLES, QUERIES, query, table
from siterank.llm.suffix_dedup import without_repeats

__all__ = ["ORACLES", "QUERIES"]

WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

JACCARD_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*m >= 75*(x.n + y.n - m)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT l.b, r.reach FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY 1) c ON c.node = d.doc_id"""


@query("op5_jaccard_join", JACCARD_SQL)
def op5_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))

MIX_SQL = r"""
WITH z AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS src FROM s0),
s2 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(src - 1) % 3 + 1] AS weight, 3*source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w1, 0))::DOUBLE / sum(weight) OVER w2 AS lv FROM s2
       WINDOW w1 AS (ORDER BY cap/weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              w2 AS (ORDER BY cap/weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS MATERIALIZED (
  SELECT source, src, source_size, least(cap::DOUBLE, max(lv) OVER () * weight) AS target, ceil(source_size/128.0::DOUBLE)::BIGINT AS nb FROM s3),
n AS (SELECT *, least(floor(nb*target/source_size + 0.5)::BIGINT, 3*nb) AS ns FROM s WHERE source_size > 0),
slot AS (SELECT src, nb, unnest(range(ns)) AS slot FROM n),
drawn AS (
  SELECT src, (([2147483647, 2147483629, 2147483587][(slot // nb) % 3 + 1] % nb) * (slot % nb)
               + ('0x' || md5('0|turn|' || src || '|' || (slot // nb))[1:8])::BIGINT % nb) % nb AS block FROM slot),
t AS MATERIALIZED (SELECT src, block, count(*) AS times FROM drawn GROUP BY 1, 2),
p AS MATERIALIZED (
  SELECT z.*, s.src, s.source_size, s.target,
         coalesce(sum(size) OVER (PARTITION BY s.src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
b AS (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM p WHERE size > 0),
k AS (SELECT b.doc_id, sum((least(start + size, (b.block + 1)*128) - greatest(start, b.block*128)) * times)::BIGINT AS taken
      FROM b JOIN t ON t.src = b.src AND t.block = b.block GROUP BY 1)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken FROM p LEFT JOIN k USING (doc_id)"""


@query("op10_mix_sources", MIX_SQL)
def op10_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(langid.training_rows(docs))
    return langid.identify(docs, models).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def tokens(docs, id_cols=("doc_id",)):
    """Digests of the encoded and decoded texts."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, id_cols)
    digests = ids.withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as bigint)")).withColumn("ids_sha256", F.sha2("ids", 256))
    back = bpe.decode(digests, path, (*id_cols, "n_tokens", "ids_sha256"))
    return back.select(*id_cols, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    return tokens(table(spark, sf_dir, "documents"))

LINES_SQL = r"""
WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT doc_id, unnest(range(len(ls))) AS number, unnest(ls) AS line FROM l0),
f AS MATERIALIZED (SELECT line, min((doc_id, number)) AS place FROM l WHERE length(line) >= 20 GROUP BY 1),
k AS MATERIALIZED (SELECT line, place, unnest([length(line), length(line) - 1]) AS m FROM f),
h AS MATERIALIZED (
  SELECT DISTINCT line, place, unnest([('a', m//2, line[:m//2]), ('b', m//2, CASE WHEN m//2 > 0 THEN line[-(m//2):] ELSE '' END)]) AS key FROM k),
near AS (SELECT DISTINCT y.line FROM h x JOIN h y ON x.key = y.key
         WHERE x.place < y.place AND abs(length(x.line) - length(y.line)) <= 1 AND levenshtein(x.line, y.line) <= 1),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY number) FILTER (NOT gone) AS text, count(*) AS n_lines
  FROM (SELECT l.doc_id, l.number, l.line,
               coalesce((l.doc_id, l.number) <> f.place OR near.line IS NOT NULL, false) AS gone
        FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line) GROUP BY 1)
SELECT d.doc_id, d.lang, d.source, d.n_chars, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text,
       coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)"""


@query("op7_line_dedup", LINES_SQL)
def op7_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


@query("op9_embedding_dedup")
def op9_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_fingerprints")
def op6_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), held_out=fold_held_out())


TEMPLATES_SQL = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
SHINGLES_SQL = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
LICENSE_SQL = rf"""
WITH t0 AS (SELECT * FROM (VALUES {TEMPLATES_SQL}) AS v(template, license, text)),
t AS (SELECT template, license, list_distinct({SHINGLES_SQL}) AS sh
      FROM (SELECT *, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM t0) WHERE len(w) >= 5),
tt AS MATERIALIZED (SELECT template, license, len(sh) AS n, (2 ** ceil(log2(len(sh))))::BIGINT AS span, unnest(sh) AS g FROM t),
d AS (SELECT doc_id, unnest(range(len(w) - 4)) AS pos, unnest({SHINGLES_SQL}) AS g
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents) WHERE len(w) >= 5),
p AS MATERIALIZED (SELECT doc_id, pos, d.g, span FROM d JOIN (SELECT DISTINCT g, span FROM tt) u ON u.g = d.g),
w AS MATERIALIZED (SELECT doc_id, pos, g, span, unnest(CASE WHEN pos >= span THEN [pos // span - 1, pos // span] ELSE [0] END) AS win FROM p),
f AS (SELECT doc_id, span, win, min(pos) AS first FROM w GROUP BY ALL),
m AS (SELECT doc_id, w.span, win, template, license, n, count(DISTINCT w.g) AS m FROM w JOIN tt ON tt.g = w.g AND tt.span = w.span GROUP BY ALL)
SELECT m.doc_id, license, min(first)::BIGINT AS first_word, max(m / n) AS containment
FROM m JOIN f ON f.doc_id = m.doc_id AND f.span = m.span AND f.win = m.win WHERE 100*m >= 75*n GROUP BY 1, 2"""


@query("op8_license_scan", LICENSE_SQL)
def op8_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def planted_periods(docs):
    """Texts of which one in ten repeats itself from a place and with a period that its id chooses."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = r"""transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w -> transform(
        array(named_struct('n', cast(size(w) as bigint), 'a', if(size(w) > 0, g % size(w), 0L))), s -> array_join(transform(
            if(s.n > 0, sequence(0L, s.n - 1), array()), i -> w[cast(if(i < s.a, i, s.a + (i - s.a) % (1 + (s.n - s.a) div (3 + g % 8))) as int)]), ' '))[0])[0]"""
    return docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g")).select(
        "doc_id", F.when(F.col("h") % 10 == 0, F.expr(changed)).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    # runs come by start and period, so the first of equal ones wins
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), "
                  "(a, r) -> if(a is null or r.length * a.period > a.length * r.period, r, a))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def terms_sql(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


SEARCH_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {terms_sql('text')} AS w FROM documents),
tf AS MATERIALIZED (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
g AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
rare AS (SELECT term, floor(1000*ln((2*docs + 2)::DOUBLE / (2*df + 1)::DOUBLE))::BIGINT AS w
         FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), g),
s AS (SELECT item_id, doc_id, sum(times*w*((1000000000*tf) // (1000*tf + 12*(75 + (25*n*docs) // terms))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN rare USING (term), g GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""


@query("op11_ranked_search", SEARCH_SQL)
def op11_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
