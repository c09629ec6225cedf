"""Request and click streams. Stateless: no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from siterank.constants import LAYER_KEYS
from siterank.operators.clean import route
from siterank.operators.dense_net import Net
from siterank.operators.raster import Stack, coregister
from siterank.plans.serving import predict_sites
from siterank.plans.state import ServingState
from siterank.sources.readers import decode_requests

REQUEST_SCHEMA = "request_id long, source string, body string"
CLICK_SCHEMA = "site_id long, lat double, lon double"


def route_requests(requests: DataFrame) -> DataFrame:
    """Decoded requests with status and error."""
    return route(decode_requests(requests))


def score_routed(routed: DataFrame, nets: Mapping[str, Net] | ServingState) -> tuple[DataFrame, DataFrame]:
    """(scored, quarantine) of routed requests."""
    good = routed.filter("status = 200").drop("_corrupt", "status", "error", "body")
    bad = routed.filter("status <> 200").select("request_id", "source", "status", "error")
    return predict_sites(good, nets, key="request_id"), bad


def score_requests(requests: DataFrame, nets: Mapping[str, Net] | ServingState) -> tuple[DataFrame, DataFrame]:
    """(scored, quarantine) of request rows; the same plan for batches and tables."""
    return score_routed(route_requests(requests), nets)


def _run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def stream_score(spark: SparkSession, source: str, nets: Mapping[str, Net] | ServingState, target: str,
                 files_per_batch: int = 100) -> tuple[str, str]:
    """Score a folder of request files as they arrive; returns the two sink paths.

    Each batch overwrites its own sub-folder, so a replayed batch cannot count twice.
    """
    stream = (spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source))

    def handle(batch: DataFrame, number: int) -> None:
        routed = route_requests(batch).drop("body", "_corrupt").persist()  # parsed once for both sinks, which need no texts
        try:
            scored, bad = score_routed(routed, nets)
            scored.write.mode("overwrite").parquet(f"{target}/scored/batch={number}")
            bad.write.mode("overwrite").parquet(f"{target}/quarantine/batch={number}")
        finally:
            routed.unpersist()

    _run(stream, handle, f"{target}/_progress")
    return f"{target}/scored", f"{target}/quarantine"


def stream_sample_layers(spark: SparkSession, source: str, scanlines: DataFrame, target: str,
                         files_per_batch: int = 100) -> str:
    """Join a click stream to static raster layers; returns the sink path."""
    stream = (spark.readStream.schema(CLICK_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source))

    stack = Stack.of(scanlines)

    def handle(batch: DataFrame, number: int) -> None:
        wide = coregister(batch, stack, LAYER_KEYS)
        wide.write.mode("overwrite").parquet(f"{target}/batch={number}")

    _run(stream, handle, f"{target}/_progress")
    return target
