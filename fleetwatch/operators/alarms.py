"""From fired facts to alarms, and the alarm and ticket life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .facts import seconds


def map_to_alarms(facts: DataFrame, rules: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Fired facts with their rule; ``suppressed`` while the agent is calibrating and
    the rule does not fire in that time. Agents without calibration state count as open."""
    return _with_rules(facts, rules, calibration).where("_known").drop("_known")


def _with_rules(facts: DataFrame, rules: DataFrame, calibration: DataFrame | None) -> DataFrame:
    """``map_to_alarms`` with the signals that have no rule, which are not ``_known``."""
    fired = facts.where("fired").join(F.broadcast(rules.withColumn("_known", F.lit(True))), "signal", "left")
    if calibration is not None:
        state = calibration.select(F.col("agent_id").alias("_agent"), "closed")
        fired = fired.join(state, (F.col("agent_id") == F.col("_agent")) & F.col("_known"), "left").drop("_agent")
        fired = fired.select("agent_id", *[c for c in fired.columns if c != "agent_id"])
        closed = F.coalesce("closed", F.lit(False))
    else:
        fired, closed = fired.withColumn("closed", F.lit(True)), F.lit(True)
    return (fired.withColumn("suppressed", ~closed & ~F.col("fires_in_calibration"))
            .drop("closed", "fires_in_calibration", "fired"))


def audit_notes(facts: DataFrame, rules: DataFrame, calibration: DataFrame,
                diverged: DataFrame | None = None) -> DataFrame:
    """D3: what was dropped on the way to an alarm: signals without a rule and alarms held
    back by calibration, plus divergent end states. Both come from one pass over the facts."""
    note = (F.when(F.col("_known").isNull(), "unknown_signal")
            .when(F.col("suppressed"), "calibration_suppressed"))
    notes = (_with_rules(facts, rules, calibration).select(note.alias("note"), "agent_id", "signal")
             .where(F.col("note").isNotNull()))
    if diverged is not None:
        notes = notes.unionByName(diverged.where("diverged").select(
            F.lit("output_quality").alias("note"), "agent_id",
            F.col("task_template").alias("signal")))
    return notes


def calibration_state(registrations: DataFrame, as_of: Column,
                      days: int = R.CALIBRATION_DAYS) -> DataFrame:
    """The calibration window of each agent; synthetic agents start closed."""
    until = F.col("first_seen") + seconds(days * 86_400)
    return registrations.select(
        "agent_id", until.alias("calibration_until"),
        (F.col("synthetic") | (as_of >= until)).alias("closed"))


def alarm_id(agent: Column, signal: Column, created: Column) -> Column:
    hour = F.date_format(created, "yyyyMMddHH")
    return F.concat(F.lit("alm_"), F.substring(
        F.sha2(F.concat_ws("|", agent, signal, hour), 256), 1, 16))


def raise_alarms(mapped: DataFrame, as_of: Column, existing: DataFrame | None = None) -> DataFrame:
    """One alarm row per agent, signal and hour. The id is a digest of that key, so a
    repeated run creates nothing new."""
    rows = (mapped.where(~F.col("suppressed"))
            .where(F.col("event_type").isin("escalation", "report_item"))
            .withColumn("created_at", as_of)
            .withColumn("alarm_id", alarm_id(F.col("agent_id"), F.col("signal"), F.col("created_at"))))
    # of equal keys the earliest row wins, then the smallest value: a repeated run stores the same
    parts = [c for c in rows.columns if c not in ("alarm_id", "created_at", "value")]
    rows = (rows.groupBy("alarm_id").agg(F.min(F.struct("created_at", "value", *parts)).alias("_row"))
            .select("alarm_id", "_row.*"))
    if existing is not None:
        rows = rows.join(existing.select("alarm_id"), "alarm_id", "left_anti")
    return rows.select(
        "alarm_id", "agent_id", "signal", "event_type", "reason", "severity", "sla_hours",
        (F.col("created_at") + F.make_dt_interval(
            secs=(F.col("sla_hours") * 3600).cast("decimal(18,6)"))).alias("sla_deadline"),
        F.col("value").alias("trigger_value"), "protection", F.lit("open").alias("status"),
        "created_at")


def raise_events(alarms: DataFrame) -> DataFrame:
    """Ledger payloads of new alarms: (event_type, payload, created_at, source_id)."""
    payload = F.to_json(F.struct(
        "agent_id", "alarm_id", "protection", "severity", "signal", "sla_hours",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")))
    return alarms.select(F.concat("event_type", F.lit("_created")).alias("event_type"),
                         payload.alias("payload"), "created_at",
                         F.col("alarm_id").alias("source_id"))


def clock_text(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def resolution_events(resolved: DataFrame) -> DataFrame:
    """Ledger payloads of accepted resolutions; refused requests leave no trace there."""
    payload = F.to_json(F.struct("alarm_id", "resolved_by", clock_text("requested_at").alias("ts")))
    return resolved.where("accepted").select(
        F.lit("alarm_resolved").alias("event_type"), payload.alias("payload"),
        F.col("requested_at").alias("created_at"), F.col("alarm_id").alias("source_id"))


def audit_events(notes: DataFrame, as_of: Column) -> DataFrame:
    """D3: ledger payloads of audit notes, one per note, agent and signal."""
    key = F.concat_ws("|", "note", "agent_id", "signal")
    return notes.select("note", "agent_id", "signal").distinct().select(
        F.lit("baseline_audit").alias("event_type"), F.to_json(F.struct("agent_id", "note", "signal")).alias("payload"),
        as_of.alias("created_at"), F.concat(F.lit("aud_"), F.substring(F.sha2(key, 256), 1, 16)).alias("source_id"))


def with_evidence(alarms: DataFrame, ledger: DataFrame) -> DataFrame:
    """Alarms with the numbers of the ledger rows that record their creation and their
    resolution; null where there is none."""
    rows = ledger.groupBy(F.col("source_id").alias("alarm_id")).agg(
        F.min(F.when(F.col("event_type").endswith("_created"), F.col("seq"))).alias("evidence_seq"),
        F.min(F.when(F.col("event_type") == "alarm_resolved", F.col("seq"))).alias("evidence_seq_resolved"))
    return alarms.drop("evidence_seq", "evidence_seq_resolved").join(rows, "alarm_id", "left")


def open_tickets(requests: DataFrame) -> DataFrame:
    """Manually opened tickets, due four hours after they were asked for."""
    return requests.select(
        "escalation_id", "agent_id", "task_id", F.lit("manual").alias("trigger_metric"),
        F.lit(0.0).alias("trigger_value"), "reason", F.lit("harness").alias("evidence_ref"),
        (F.col("created_at") + seconds(4 * 3600)).alias("sla_deadline"),
        F.lit("open").alias("status"), "created_at")


def resolve_requests(alarms: DataFrame, requests: DataFrame) -> DataFrame:
    """The earliest request per alarm decides. ``accepted`` is false for unknown ids and
    for alarms that are not open; those must not reach the ledger."""
    first = (requests.groupBy("alarm_id")
             .agg(F.min(F.struct("requested_at", "resolved_by")).alias("r"))
             .select("alarm_id", "r.requested_at", "r.resolved_by"))
    state = alarms.select("alarm_id", F.col("status").alias("_status"))
    return (first.join(state, "alarm_id", "left")
            .withColumn("accepted", F.coalesce(F.col("_status") == "open", F.lit(False)))
            .drop("_status"))


def apply_resolutions(alarms: DataFrame, log: DataFrame) -> DataFrame:
    """Current alarms after an action log of accepted resolutions."""
    done = log.where("accepted").select(
        "alarm_id", F.col("requested_at").alias("_at"), F.col("resolved_by").alias("_by"))
    hit = F.col("_at").isNotNull()
    return (alarms.join(done, "alarm_id", "left")
            .withColumn("status", F.when(hit, "resolved").otherwise(F.col("status")))
            .withColumn("resolved_at", F.coalesce("_at", "resolved_at"))
            .withColumn("resolved_by", F.coalesce("_by", "resolved_by"))
            .drop("_at", "_by"))


def open_queue(alarms: DataFrame) -> DataFrame:
    """Open alarms, earliest deadline first."""
    return alarms.where(F.col("status") == "open").orderBy("sla_deadline", "alarm_id")


def for_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """D12."""
    return rows.where(F.col("tenant_id") == tenant)
