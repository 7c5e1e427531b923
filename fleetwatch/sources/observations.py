"""Exported observation records of a tracing product to task events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeparse import parse_ts
from ..schemas import OBSERVATION

# fixed value: agent name of records without one
UNNAMED_AGENT = "langfuse-gen"


def read_observations(spark, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATION).json(path)


def to_task_events(observations: DataFrame, received_at=None) -> DataFrame:
    """Generations only. Ids are digests of the source ids, so a second pull is idempotent;
    an end before the start counts as the start."""
    now = received_at if received_at is not None else F.current_timestamp()
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    digest = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    start = F.coalesce(parse_ts(F.col("startTime")), now)
    end = F.coalesce(parse_ts(F.col("endTime")), start)
    trace = digest(F.coalesce(blank("traceId"), F.col("id")), 32)
    message = F.coalesce(blank("statusMessage"), F.lit("ERROR"))
    failed = F.coalesce(F.col("level") == "ERROR", F.lit(False)) | blank("statusMessage").isNotNull()
    word = F.substring(F.get(F.split(F.ltrim(message), r"\s+"), F.lit(0)), 1, 64)
    micros = F.greatest(F.unix_micros(start), F.unix_micros(end)) - F.unix_micros(start)
    return observations.where(F.col("type") == "GENERATION").select(
        F.concat(F.lit("otlp-"), trace, F.lit("-"), digest(F.col("id"), 16)).alias("event_id"),
        F.coalesce(blank("name"), F.lit(UNNAMED_AGENT)).alias("agent_id"),
        F.concat(F.coalesce("traceId", F.lit("None")), F.lit(":"), F.col("id")).alias("task_id"),
        trace.alias("session_id"),
        F.coalesce(blank("model"), blank("providedModelName"), F.lit("unknown")).alias("model_name"),
        F.coalesce("usage.input", F.lit(0)).alias("input_tokens"),
        F.coalesce("usage.output", F.lit(0)).alias("output_tokens"),
        F.coalesce("cost", "usage.totalCost", F.lit(0.0)).cast("decimal(12,6)").alias("cost_usd"),
        F.call_function("div", micros, F.lit(1000)).alias("latency_ms"),
        F.when(failed, F.coalesce(F.nullif(word, F.lit("")), F.lit("error"))).alias("error_class"),
        F.when(failed, "error").otherwise("ok").alias("status"), F.lit(False).alias("synthetic"),
        start.alias("ts"), F.lit(0).alias("retry_count"), F.lit(0.0).alias("ttft_s"),
        F.coalesce(blank("env"), F.lit("default")).alias("tenant_id"))
