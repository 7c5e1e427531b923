"""D: alarms, triage and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from .. import rules as R
from ..operators import alarms as ops
from ..operators import attribution, facts, ingest, ledger
from .base import cte, query, r6
from .facts_queries import AS_OF_SQL, calibration, fact_table, registrations


@query("d1_signal_rules", """
SELECT signal, event_type, reason, CAST(sla_hours AS DOUBLE) AS sla_hours, protection, severity, n
FROM rules JOIN (SELECT signal, count(*) AS n FROM alarms GROUP BY 1) USING (signal)""", ["rules", "alarms"])
def d1(spark, sf):
    n = A.alarms(spark, sf).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(R.signal_rules(spark)), "signal").drop("fires_in_calibration")


cte("mapped", ["facts", "calibration"], """
  SELECT f.agent_id, signal, r.event_type, r.reason, CAST(r.sla_hours AS DOUBLE) AS sla_hours,
         r.protection, r.severity, value, NOT coalesce(closed, FALSE) AND NOT fires AS suppressed
  FROM facts f JOIN rules r USING (signal) LEFT JOIN calibration c ON c.agent_id = f.agent_id
  WHERE f.fired""")


def mapped(spark, sf):
    state = calibration(spark, sf)
    return ops.map_to_alarms(fact_table(spark, sf, state), R.signal_rules(spark), state)


@query("d2_alarms", """
SELECT agent_id, signal, event_type, reason, severity, sla_hours, protection,
       round(value, 4) AS value, suppressed FROM mapped""", ["mapped"])
def d2(spark, sf):
    return mapped(spark, sf).select(
        "agent_id", "signal", "event_type", "reason", "severity", "sla_hours", "protection",
        F.round("value", 4).alias("value"), "suppressed")


@query("d3_audit_notes", """
SELECT 'calibration_suppressed' AS note, agent_id, signal FROM mapped WHERE suppressed
UNION ALL SELECT 'unknown_signal', agent_id, 'cost.monthly' FROM daily GROUP BY agent_id HAVING sum(cost) > 2000
UNION ALL SELECT 'output_quality', agent_id, task_template FROM end_states WHERE end_state <> reference""",
       ["mapped", "daily", "end_states"])
def d3(spark, sf):
    """A caller's own fact without a rule leaves a note next to the suppressed ones."""
    t = A.task_events(spark, sf)
    own = (t.groupBy("agent_id").agg(F.sum("cost_usd").cast("double").alias("value"))
           .select("agent_id", F.lit("cost.monthly").alias("signal"),
                   (F.col("value") > 2000).alias("fired"), "value"))
    state = calibration(spark, sf)
    return ops.audit_notes(fact_table(spark, sf, state).unionByName(own), R.signal_rules(spark),
                           state, facts.end_state_divergence(t))


@query("d4_calibration_state", "SELECT agent_id, calibration_until, closed FROM calibration", ["calibration"])
def d4(spark, sf):
    return calibration(spark, sf)


cte("raised", ["mapped"], f"""
  SELECT 'alm_' || substr(sha256(agent_id || '|' || signal || '|2024013100'), 1, 16) AS alarm_id,
         agent_id, signal, event_type, severity, sla_hours,
         {AS_OF_SQL} + to_seconds(CAST(sla_hours * 3600 AS BIGINT)) AS sla_deadline, {AS_OF_SQL} AS created_at
  FROM mapped WHERE NOT suppressed""")


def raised(spark, sf):
    return ops.raise_alarms(mapped(spark, sf), A.as_of())


@query("d5_raised_alarms", "SELECT alarm_id, agent_id, signal, event_type, severity, sla_deadline, created_at FROM raised",
       ["raised"])
def d5(spark, sf):
    return raised(spark, sf).select("alarm_id", "agent_id", "signal", "event_type", "severity",
                                    "sla_deadline", "created_at")


@query("d5_hourly_dedup", """
SELECT 'alm_' || substr(sha256(agent_id || '|' || signal || '|' || strftime(created_at, '%Y%m%d%H')), 1, 16) AS alarm_id,
       agent_id, signal, count(*) AS n
FROM alarms GROUP BY agent_id, signal, strftime(created_at, '%Y%m%d%H')""", ["alarms"])
def d5_hourly(spark, sf):
    """All candidate alarms folded onto their (agent, signal, hour) key."""
    a = A.alarms(spark, sf)
    return (a.groupBy(ops.alarm_id(F.col("agent_id"), F.col("signal"), F.col("created_at")).alias("alarm_id"),
                      "agent_id", "signal").agg(F.count(F.lit(1)).alias("n")))


def _ticket_requests(spark, sf):
    return (A.alarms(spark, sf).where(F.col("severity") == "Emergency")
            .select(F.concat(F.lit("esc-"), F.col("alarm_id")).alias("escalation_id"), "agent_id",
                    F.coalesce("task_id", F.lit("none")).alias("task_id"), "reason", "created_at"))


@query("d6_open_tickets", """
SELECT 'esc-' || alarm_id AS escalation_id, agent_id, reason, created_at,
       created_at + INTERVAL 4 HOUR AS sla_deadline, 'open' AS status
FROM alarms WHERE severity = 'Emergency'""", ["alarms"])
def d6(spark, sf):
    return ops.open_tickets(_ticket_requests(spark, sf)).select(
        "escalation_id", "agent_id", "reason", "created_at", "sla_deadline", "status")


def _resolve_requests(spark, sf):
    """Two requests for most alarms and some for ids that do not exist."""
    a = A.alarms(spark, sf)
    n = F.substring("alarm_id", 5, 12).cast("bigint")
    at = lambda us: F.timestamp_micros(F.unix_micros("created_at") + us)
    early = a.where(n % 4 != 0).select("alarm_id", F.lit("ana").alias("resolved_by"),
                                       at(n % 90 * 1_000_000).alias("requested_at"))
    late = a.where(n % 2 == 0).select("alarm_id", F.lit("bo").alias("resolved_by"),
                                      at(F.lit(45_000_000)).alias("requested_at"))
    ghost = a.where(n % 50 == 0).select(F.concat(F.lit("no-"), F.col("alarm_id")).alias("alarm_id"),
                                        F.lit("cy").alias("resolved_by"), at(F.lit(0)).alias("requested_at"))
    return early.unionByName(late).unionByName(ghost)


cte("resolve_requests", ["alarms"], """
  SELECT alarm_id, 'ana' AS resolved_by, created_at + to_seconds(n % 90) AS requested_at, status FROM alarms WHERE n % 4 <> 0
  UNION ALL SELECT alarm_id, 'bo', created_at + to_seconds(45), status FROM alarms WHERE n % 2 = 0
  UNION ALL SELECT 'no-' || alarm_id, 'cy', created_at, 'none' FROM alarms WHERE n % 50 = 0""")
_RESOLVED = """
SELECT alarm_id, min(requested_at) AS requested_at, any_value(status) = 'open' AS accepted,
       min(resolved_by) FILTER (requested_at = m) AS resolved_by
FROM resolve_requests JOIN (SELECT alarm_id, min(requested_at) AS m FROM resolve_requests GROUP BY 1)
     USING (alarm_id) GROUP BY alarm_id"""
cte("resolved", ["resolve_requests"], _RESOLVED)


@query("d7_resolve_requests", "SELECT * FROM resolved", ["resolved"])
def d7(spark, sf):
    return ops.resolve_requests(A.alarms(spark, sf), _resolve_requests(spark, sf))


@query("d7_alarms_after_resolution", """
SELECT a.alarm_id, CASE WHEN accepted THEN 'resolved' ELSE a.status END AS status,
       CASE WHEN accepted THEN requested_at ELSE a.resolved_at END AS resolved_at
FROM alarms a LEFT JOIN resolved USING (alarm_id)""", ["resolved"])
def d7_view(spark, sf):
    a = A.alarms(spark, sf)
    return ops.apply_resolutions(a, ops.resolve_requests(a, _resolve_requests(spark, sf))) \
        .select("alarm_id", "status", "resolved_at")


_CLOCK = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query("d7_resolution_events", f"""
SELECT 'alarm_resolved' AS event_type, alarm_id AS source_id, requested_at AS created_at,
       '{{"alarm_id":"' || alarm_id || '","resolved_by":"' || resolved_by || '","ts":"' || {_CLOCK.format("requested_at")} || '"}}' AS payload
FROM resolved WHERE accepted""", ["resolved"])
def d7_events(spark, sf):
    return ops.resolution_events(ops.resolve_requests(A.alarms(spark, sf), _resolve_requests(spark, sf)))


@query("d5_evidence_seq", """
SELECT alarm_id, max(seq) FILTER (kind = 0) AS evidence_seq, max(seq) FILTER (kind = 1) AS evidence_seq_resolved
FROM (SELECT alarm_id, kind, row_number() OVER (ORDER BY t, alarm_id) AS seq
      FROM (SELECT alarm_id, 0 AS kind, created_at AS t FROM alarms
            UNION ALL SELECT alarm_id, 1, requested_at + INTERVAL 1 SECOND FROM resolved WHERE accepted)) GROUP BY 1""", ["resolved"])
def d5_evidence(spark, sf):
    """Creations and resolutions in one chain; each alarm gets both numbers back."""
    a = A.alarms(spark, sf)
    done = ops.resolve_requests(a, _resolve_requests(spark, sf)).withColumn(
        "requested_at", F.timestamp_micros(F.unix_micros("requested_at") + 1_000_000))
    chain = ledger.append(ops.raise_events(a).unionByName(ops.resolution_events(done)))
    return ops.with_evidence(a, chain).select("alarm_id", "evidence_seq", "evidence_seq_resolved")


@query("d3_audit_events", """
SELECT 'baseline_audit' AS event_type, '{"agent_id":"' || agent_id || '","note":"' || note || '","signal":"' || signal || '"}' AS payload,
       'aud_' || substr(sha256(note || '|' || agent_id || '|' || signal), 1, 16) AS source_id
FROM (SELECT DISTINCT 'calibration_suppressed' AS note, agent_id, signal FROM mapped WHERE suppressed)""", ["mapped"])
def d3_events(spark, sf):
    state = calibration(spark, sf)
    notes = ops.audit_notes(fact_table(spark, sf, state), R.signal_rules(spark), state)
    return ops.audit_events(notes, A.as_of()).select("event_type", "payload", "source_id")


def _first_error(cond: str) -> str:
    return f"""
  SELECT alarm_id, signal, x.* FROM alarms a, LATERAL (
    SELECT task_id, error_class, t.ts, session_id FROM tasks t
    WHERE t.agent_id = a.agent_id AND status = 'error' AND t.ts BETWEEN a.created_at - INTERVAL 24 HOUR AND a.created_at
    ORDER BY t.ts, t.event_id LIMIT 1) x WHERE {cond}"""


cte("sug_window", ["alarms", "guards"], """
  SELECT a.alarm_id, a.signal, g.* FROM alarms a JOIN guards g ON g.agent_id = a.agent_id
   AND g.ts BETWEEN a.created_at - INTERVAL 24 HOUR AND a.created_at
  WHERE a.signal IN ('loop>=2', 'permission.deny>0.20', 'drift.tool_distribution>0.40')""")
cte("sug_task_window", ["alarms", "tasks"], """
  SELECT a.alarm_id, a.signal, a.agent_id AS who, t.* FROM alarms a JOIN tasks t ON t.agent_id = a.agent_id
   AND t.ts BETWEEN a.created_at - INTERVAL 24 HOUR AND a.created_at
  WHERE a.signal IN ('error.new_class_seen', 'error.rate>0.20', 'cost.daily>2x_ewma')""")
cte("sug_steps", ["sug_window", "sug_task_window"], """
  SELECT alarm_id, 'repeated call ' || arg_max(tool_name, ts) || ' (last at ' || strftime(max(ts), '%Y-%m-%d %H:%M:%S') || ')' AS step,
         0.90 AS conf, 'this tool was called three times in a row with equal arguments' AS why
  FROM sug_window WHERE signal = 'loop>=2' AND event_type = 'tool_call' GROUP BY 1
  UNION ALL
  SELECT f.alarm_id, f.error_class || ' on ' || f.task_id || ' (' || strftime(f.ts, '%Y-%m-%d %H:%M:%S') || ')', 0.75,
         'earliest error ' || f.error_class || ' in task ' || f.task_id
         || coalesce(', in one session with ' || o.partner, '')
  FROM (SELECT * FROM sug_task_window WHERE signal LIKE 'error.%' AND status = 'error'
        QUALIFY row_number() OVER (PARTITION BY alarm_id ORDER BY ts, event_id) = 1) f
  LEFT JOIN (SELECT x.alarm_id, min(t.agent_id) AS partner
             FROM (SELECT alarm_id, who, session_id FROM sug_task_window WHERE signal LIKE 'error.%' AND status = 'error'
                   QUALIFY row_number() OVER (PARTITION BY alarm_id ORDER BY ts, event_id) = 1) x
             JOIN tasks t ON t.session_id = x.session_id AND t.agent_id <> x.who GROUP BY 1) o ON o.alarm_id = f.alarm_id
  UNION ALL
  SELECT alarm_id, CASE WHEN signal LIKE 'permission%' THEN 'denied tool ''' ELSE 'pivot onto ''' END || tool_name || ''' (' || CAST(c AS VARCHAR) || 'x in 24h)',
         CASE WHEN signal LIKE 'permission%' THEN 0.80 ELSE 0.70 END,
         CASE WHEN signal LIKE 'permission%' THEN 'this tool was denied more often than any other before the alarm'
              ELSE 'this tool was called most often before the mix of tools shifted' END
  FROM (SELECT alarm_id, signal, tool_name, count(*) AS c FROM sug_window
        WHERE (signal LIKE 'permission%' AND event_type = 'permission_decision' AND decision = 'deny')
           OR (signal LIKE 'drift%' AND event_type = 'tool_call') GROUP BY 1, 2, 3
        QUALIFY row_number() OVER (PARTITION BY alarm_id ORDER BY c DESC, tool_name) = 1)
  UNION ALL
  SELECT alarm_id, 'task ' || task_id || ' on ' || model_name || ' ($' || format('{:.2f}', CAST(cost_usd AS DOUBLE)) || ')', 0.65,
         'no other task before the alarm cost as much'
  FROM (SELECT * FROM sug_task_window WHERE signal LIKE 'cost%'
        QUALIFY row_number() OVER (PARTITION BY alarm_id ORDER BY cost_usd DESC, event_id DESC) = 1)""")
cte("suggestions", ["sug_steps", "tickets"], """
  SELECT a.alarm_id, a.n, CASE WHEN a.signal LIKE 'escalation%' THEN t.agent_id ELSE a.agent_id END AS suggested_agent_id,
    CASE WHEN a.signal LIKE 'escalation%' THEN 'open ticket ' || t.task_id || ' (' ||
           CAST(CAST(round_even((epoch_us(a.created_at) - epoch_us(t.created_at)) / 3.6e9, 0) AS BIGINT) AS VARCHAR) || 'h, opened ' || strftime(t.created_at, '%Y-%m-%d %H:%M:%S') || ')'
         ELSE coalesce(step, 'insufficient trace') END AS suggested_step,
    CAST(CASE WHEN a.signal LIKE 'escalation%' THEN 0.60 ELSE coalesce(conf, 0.30) END AS DOUBLE) AS confidence,
    CASE WHEN a.signal LIKE 'escalation%' THEN 'no open ticket of the fleet has waited longer' WHEN step IS NOT NULL THEN why
         WHEN a.signal = 'loop>=2' THEN 'a loop was found, but no tool call before the alarm'
         WHEN a.signal LIKE 'error.%' THEN 'errors were counted, but none before the alarm'
         WHEN a.signal LIKE 'permission%' THEN 'denials were counted, but none before the alarm'
         WHEN a.signal LIKE 'drift.tool%' THEN 'the mix of tools shifted, but no call came before the alarm'
         WHEN a.signal LIKE 'cost%' THEN 'costs rose, but no task came before the alarm'
         ELSE 'no rule for the signal ' || a.signal END AS note
  FROM alarms a LEFT JOIN sug_steps s USING (alarm_id)
  CROSS JOIN (SELECT * FROM tickets WHERE status = 'open' ORDER BY created_at, escalation_id LIMIT 1) t""")


def suggestions(spark, sf):
    return attribution.suggest(A.alarms(spark, sf), A.task_events(spark, sf),
                               A.guard_events(spark, sf), A.tickets(spark, sf))


@query("d8_attribution", "SELECT alarm_id, suggested_agent_id, suggested_step, confidence, note FROM suggestions",
       ["suggestions"])
def d8(spark, sf):
    return suggestions(spark, sf).drop("method")


def _pending(spark, sf):
    """Suggestions of which a part already has a verdict, from the given quality labels."""
    verdict = A.table(spark, sf, "labels").select(
        F.concat(F.lit("alm-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("alarm_id"),
        (F.col("quality") == 1).alias("confirmed"))
    return (A.alarms(spark, sf).select("alarm_id", "agent_id")
            .join(verdict, "alarm_id", "left")
            .withColumn("confirmed_by", F.when(F.col("confirmed").isNotNull(), "lab"))
            .withColumn("confirmed_at", F.lit(None).cast("timestamp")))


def _verdict_requests(spark, sf):
    a = A.alarms(spark, sf)
    n = F.substring("alarm_id", 5, 12).cast("bigint")
    one = lambda who, ok, lag: a.where(n % 3 == lag % 3).select(
        "alarm_id", F.lit(who).alias("operator"), ok.alias("accepted"),
        F.timestamp_micros(F.unix_micros("created_at") + lag * 1_000_000).alias("at"))
    return one("ana", n % 2 == 0, 60).unionByName(one("bo", n % 2 == 1, 30)) \
        .unionByName(one("cy", n % 5 == 0, 31))


cte("pending", ["alarms"], """
  SELECT a.alarm_id, a.n, a.created_at, l.quality = 1 AS confirmed FROM alarms a LEFT JOIN labels l ON l.doc_id = a.n""")
cte("verdicts", ["pending"], """
  SELECT alarm_id, created_at + to_seconds(CASE WHEN n % 3 = 0 THEN 30 ELSE 31 END) AS at,
         CASE WHEN n % 3 = 0 THEN 'bo' ELSE 'cy' END AS operator,
         CASE WHEN n % 3 = 0 THEN n % 2 = 1 ELSE n % 5 = 0 END AS accepted
  FROM pending WHERE confirmed IS NULL AND n % 3 IN (0, 1)""")


@query("d9_verdicts", "SELECT * FROM verdicts", ["verdicts"])
def d9(spark, sf):
    return attribution.verdicts(_pending(spark, sf), _verdict_requests(spark, sf))


@query("d9_verdict_events", f"""
SELECT 'attribution_confirmed' AS event_type, alarm_id AS source_id, "at" AS created_at,
       '{{"accepted":' || CAST(accepted AS VARCHAR) || ',"alarm_id":"' || alarm_id || '","operator":"' || operator || '","ts":"'
       || {_CLOCK.format('"at"')} || '"}}' AS payload FROM verdicts""", ["verdicts"])
def d9_events(spark, sf):
    return attribution.verdict_events(attribution.verdicts(_pending(spark, sf), _verdict_requests(spark, sf)))


@query("d10_approval_rate", """
SELECT count(*) AS decided, count(*) FILTER (c) AS accepted, count(*) FILTER (NOT c) AS rejected,
       round(count(*) FILTER (c) / count(*), 6) AS rate
FROM (SELECT coalesce(confirmed, accepted) AS c FROM pending LEFT JOIN verdicts USING (alarm_id))
WHERE c IS NOT NULL""", ["verdicts"])
def d10(spark, sf):
    s = _pending(spark, sf)
    decided = attribution.apply_verdicts(s, attribution.verdicts(s, _verdict_requests(spark, sf)))
    return attribution.approval_rate(decided).select("decided", "accepted", "rejected", r6("rate"))


@query("d11_open_queue", "SELECT alarm_id, agent_id, signal, sla_deadline FROM alarms WHERE status = 'open'", ["alarms"])
def d11(spark, sf):
    return ops.open_queue(A.alarms(spark, sf)).select("alarm_id", "agent_id", "signal", "sla_deadline")


@query("d12_tenant_alarms", "SELECT alarm_id, agent_id, tenant_id FROM alarms WHERE tenant_id = 'tenant-1'", ["alarms"])
def d12(spark, sf):
    return ops.for_tenant(A.alarms(spark, sf), "tenant-1").select("alarm_id", "agent_id", "tenant_id")
