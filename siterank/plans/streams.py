"""Queries over streams: the sinks of finished streams must equal the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siterank.constants import DEFAULTS
from siterank.plans.fitting import LEAST_SQUARES, NETS, REGRESSED, regressed_state, served_sql
from siterank.plans.joins import WIDE, doubles
from siterank.plans.registry import SAMPLES, SITES, query, r, rs
from siterank.session import new_path
from siterank.sources import views
from siterank.streaming.scoring import stream_sample_layers as sample_stream, stream_score as score_stream

FILL = ", ".join(f'coalesce("{c}", {d}::DOUBLE) AS "{c}"' for c, d in DEFAULTS.items())
NAMES = ", ".join(f'"{c}"' for c in DEFAULTS)
ROWS_PER_FILE, FILES_PER_BATCH = 100_000, 48
NULLS = ", ".join(f'CAST(NULL AS DOUBLE) AS "{c}"' for c in DEFAULTS)


def responses_sql(views_sql: str, source: str, temp: str, inertia: str) -> str:
    """Responses to all requests, in terms of ``source`` over the ``filled`` records."""
    return f"""WITH {views_sql},
good AS (SELECT site_id AS request_id, 'site' AS source, {NAMES} FROM sites
         UNION ALL SELECT event_id, 'event', {NULLS} FROM events WHERE json_valid(props)
         UNION ALL SELECT doc_id, 'document', {NULLS} FROM documents WHERE json_valid(text)),
filled AS (SELECT request_id, source, {FILL} FROM good),
inputs AS (SELECT * FROM {source}),
{served_sql('inputs', temp, inertia)}
SELECT request_id, source, 200 AS status, landing_score, {rs('slope')} AS slope FROM served
UNION ALL SELECT event_id, 'event', 400, NULL, NULL FROM events WHERE NOT json_valid(props)
UNION ALL SELECT doc_id, 'document', 400, NULL, NULL FROM documents WHERE NOT json_valid(text)"""


def _arrived(rows: DataFrame, path: str) -> int:
    """Write ``rows`` as files of bounded size, as many as they need; how many files make a batch, of bounded size too and at most half of them."""
    spark = rows.sparkSession
    rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    files = spark.read.format("binaryFile").load(path).select("path").count()
    return min(FILES_PER_BATCH, -(-files // 2))


def _responses(spark, sf, state):
    """Score a request stream; good and bad records land in two sinks."""
    source, target = new_path(spark, "requests"), new_path(spark, "responses")
    scored, bad = score_stream(spark, source, state, target, files_per_batch=_arrived(views.requests(spark, sf), source))
    good = spark.read.parquet(scored).select(
        "request_id", "source", F.lit(200).cast("long").alias("status"), "landing_score", r("slope"))
    rest = spark.read.parquet(bad).select(
        "request_id", "source", "status", F.lit(None).cast("double").alias("landing_score"),
        F.lit(None).cast("double").alias("slope"))
    return good.unionByName(rest)


@query("stream_score", responses_sql(SITES, "filled", "NULL", "NULL"))
def stream_score(spark, sf):
    return _responses(spark, sf, NETS)


@query("stream_score_fitted", responses_sql(f"{SAMPLES}, {LEAST_SQUARES}", "filled, ls", *REGRESSED))
def stream_score_fitted(spark, sf):
    """The same stream scored with fitted regressors from their store."""
    return _responses(spark, sf, regressed_state(spark, sf))


@query("stream_sample_layers", f"WITH {WIDE} SELECT * FROM wide")
def stream_sample_layers(spark, sf):
    """Sample all layers for a stream of clicks."""
    source, target = new_path(spark, "clicks"), new_path(spark, "sampled")
    batch = _arrived(views.points(spark, sf), source)
    return doubles(spark.read.parquet(sample_stream(spark, source, views.layers(spark, sf), target, files_per_batch=batch)))
