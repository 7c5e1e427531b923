"""The given tables as domain tables.

``events`` feed task events, guard events and alarms; ``orders`` feed tickets;
``lineitem`` feeds long daily cost series; ``documents`` and ``conversations`` feed
payload digests and call sequences. Every column is an expression over the source row,
so column pruning and filters still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import SIGNAL_RULES

AS_OF = "2024-01-31 00:00:00"
ERROR_TEXTS = [
    "timeout while calling", "HTTP 401 auth", "json parse failed", "tool api 500",
    "schema drift: field", "partial response: truncated", "validation expected value",
    "handoff mismatch", "ambiguous spec", "ERR_NOVEL_42", "loop", "timed out api tool 500",
]


_READ: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The given table; the footer is read once per session, the rows never kept."""
    at = (spark.sparkContext.applicationId, id(spark), sf, name)
    if at not in _READ:
        _READ[at] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _READ[at]


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (index % len(values) + 1).cast("int"))


def _numbered(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(col).cast("string"), 12, "0"))


def _events(spark: SparkSession, sf: str, rows: DataFrame | None = None,
            since: str | None = None) -> DataFrame:
    """The files hold local timestamps, so a window start is compared before the cast:
    only then does Parquet skip row groups by it."""
    rows = table(spark, sf, "events") if rows is None else rows
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return (rows.withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")))


def _agent(col: str = "user_id") -> Column:
    return F.concat(F.lit("agent-"), F.col(col).cast("string"))


def _task() -> Column:
    block = F.call_function("div", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")),
                            F.lit(3))
    return F.concat(F.lit("task-"), F.col("user_id").cast("string"), F.lit("-"),
                    block.cast("string"))


def task_events(spark: SparkSession, sf: str, rows: DataFrame | None = None,
                since: str | None = None) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    status = (F.when(kind != "error", "ok")
              .when(k % 20 == 0, "quarantined").otherwise("error"))
    end_state = F.when(
        F.col("event_id") % 2 == 0,
        F.concat(F.lit('{"count": '), (k % 3).cast("string"), F.lit(', "box": "'), kind, F.lit('"}'))
    ).otherwise(
        F.concat(F.lit('{"box":"'), kind, F.lit('","count":'), (k % 3).cast("string"), F.lit("}")))
    return _events(spark, sf, rows, since).select(
        _numbered("evt-", "event_id").alias("event_id"), _agent().alias("agent_id"),
        _task().alias("task_id"),
        F.concat(F.lit("sess-"), F.call_function("div", F.col("event_id"), F.lit(4))
                 .cast("string")).alias("session_id"),
        F.concat(F.lit("model-"), (k % 4).cast("string")).alias("model_name"),
        (k * 10 + 100).alias("input_tokens"), (k * 3 + 50).alias("output_tokens"),
        F.col("value").cast("decimal(12,6)").alias("cost_usd"),
        (k * 100 + F.col("event_id") % 97).alias("latency_ms"),
        F.when(kind == "error", _pick(ERROR_TEXTS, k)).alias("error_class"),
        status.alias("status"), (F.col("user_id") % 7 == 0).alias("synthetic"), "ts",
        (k % 5).cast("int").alias("retry_count"), ((k % 40) / 100.0).alias("ttft_s"),
        F.when(k % 10 != 9, F.concat(F.lit("tmpl-"), (k % 6).cast("string")))
        .alias("task_template"),
        end_state.alias("end_state_json"))


def subject_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events that carry a data subject: (subject_id, event_id, ts)."""
    return _events(spark, sf).where(F.col("k") % 8 == 0).select(
        F.concat(F.lit("subj-"), (F.col("user_id") % 50).cast("string")).alias("subject_id"),
        _numbered("evt-", "event_id").alias("event_id"), "ts")


def guard_events(spark: SparkSession, sf: str, rows: DataFrame | None = None,
                 since: str | None = None) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    decides = kind.isin("signup", "error")
    return _events(spark, sf, rows, since).select(
        _numbered("grd-", "event_id").alias("event_id"), _agent().alias("agent_id"),
        _task().alias("task_id"),
        F.when(decides, "permission_decision").otherwise("tool_call").alias("event_type"),
        F.when(kind == "error", "deny").when(kind == "signup", "allow").alias("decision"),
        F.concat(kind, F.lit("-"), (k % 4).cast("string")).alias("tool_name"),
        F.concat(F.lit('{"q": '), (k % 4).cast("string"), F.lit(', "a": [1, 2]}'))
        .alias("arguments_json"),
        (F.col("user_id") % 7 == 0).alias("synthetic"), "ts")


def alarms(spark: SparkSession, sf: str) -> DataFrame:
    """One alarm per error event, raised k seconds after it."""
    k = F.col("k")
    e = _events(spark, sf).where(F.col("event_type") == "error")
    rule = lambda i: _pick([r[i] for r in SIGNAL_RULES], k)
    created = F.timestamp_micros(F.unix_micros("ts") + k * 1_000_000)
    is_open = k % 3 != 0
    shifted = lambda base, hours: F.timestamp_micros(
        F.unix_micros(base) + (hours * 3_600_000_000).cast("bigint"))
    return e.select(
        _numbered("alm-", "event_id").alias("alarm_id"), _agent().alias("agent_id"),
        F.lit(None).cast("string").alias("task_id"), rule(0).alias("signal"),
        rule(1).alias("event_type"), rule(2).alias("reason"), rule(5).alias("severity"),
        rule(3).alias("sla_hours"), shifted(created, rule(3)).alias("sla_deadline"),
        F.col("value").alias("trigger_value"), rule(4).alias("protection"),
        F.when(is_open, "open").otherwise("resolved").alias("status"),
        created.alias("created_at"), F.when(~is_open, "ops").alias("resolved_by"),
        F.when(~is_open, shifted(created, k % 12 + 1)).alias("resolved_at"),
        F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        (F.col("event_id") + 1).alias("evidence_seq"),
        F.when(~is_open, F.col("event_id") + 2).alias("evidence_seq_resolved"))


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    created = F.timestamp_micros(
        F.unix_micros(as_of("2024-01-01 00:00:00"))
        + (F.col("o_orderkey") % 30) * 86_400_000_000
        + (F.col("o_custkey") % 24) * 3_600_000_000 + F.col("o_orderkey") * 1000)
    return table(spark, sf, "orders").select(
        _numbered("esc-", "o_orderkey").alias("escalation_id"),
        _agent("o_custkey").alias("agent_id"),
        F.concat(F.lit("task-"), F.col("o_orderkey").cast("string")).alias("task_id"),
        F.lit("manual").alias("trigger_metric"),
        F.col("o_totalprice").alias("trigger_value"),
        F.lower("o_orderpriority").alias("reason"), F.lit("harness").alias("evidence_ref"),
        F.timestamp_micros(F.unix_micros(created) + 4 * 3_600_000_000).alias("sla_deadline"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"),
        F.when(F.col("o_orderstatus") != "O", "ops").alias("resolved_by"),
        F.lit(None).cast("timestamp").alias("resolved_at"), created.alias("created_at"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The given event file as a file stream."""
    return (spark.readStream.schema(table(spark, sf, "events").schema)
            .option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 100).parquet(sf))


def supplier_costs(spark: SparkSession, sf: str) -> DataFrame:
    """(agent_id, day, cost) from every line item, several years of days per supplier."""
    return (table(spark, sf, "lineitem")
            .select(F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("agent_id"),
                    F.to_date("l_shipdate").alias("day"),
                    F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
            .groupBy("agent_id", "day").agg(F.sum("price").cast("double").alias("cost")))


def agents(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer with fleet, role and tenant."""
    return table(spark, sf, "customer").select(
        _agent("c_custkey").alias("agent_id"), F.lower("c_mktsegment").alias("fleet_name"),
        _pick(["planner", "worker", "reviewer", "executor"], F.col("c_nationkey")).alias("role"),
        F.lit("custom").alias("framework"), F.lit("1").alias("agent_version"),
        F.when(F.col("c_acctbal") < 0, "paused").otherwise("active").alias("status"),
        as_of("2024-01-01 00:00:00").alias("created_at"),
        F.concat(F.lit("tenant-"), (F.col("c_custkey") % 3).cast("string")).alias("tenant_id"))
