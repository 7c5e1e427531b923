"""G: fleet views and reports that need no ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..plans import reports, views
from .base import cte, query, r6
from .facts_queries import AS_OF_SQL, _JSD_TAIL, calibration, ewma_sql

DAY_AGO = f"{AS_OF_SQL} - INTERVAL 24 HOUR"
WEEK_AGO = f"{AS_OF_SQL} - INTERVAL 7 DAY"
MONTH_AGO = f"{AS_OF_SQL} - INTERVAL 30 DAY"
RANK_SQL = """CASE severity WHEN 'Emergency' THEN 0 WHEN 'Critical' THEN 1 WHEN 'High' THEN 2
     WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 ELSE 5 END"""
# window starts before the report time
DAY, WEEK, MONTH = "2024-01-30 00:00:00", "2024-01-24 00:00:00", "2024-01-01 00:00:00"
SINCE = "2024-01-10 00:00:00"
SINCE_SQL = f"TIMESTAMP '{SINCE}'"
_COST = "CAST(round(coalesce(sum({}), 0), 4) AS DOUBLE)"


@query("g1_summary", f"""
SELECT (SELECT count(*) FROM alarms WHERE status = 'open') AS open_alarms,
       (SELECT count(*) FROM alarms WHERE status = 'open' AND sla_deadline < {AS_OF_SQL}) AS breached,
       (SELECT count(*) FROM agents) AS agents, (SELECT count(*) FROM tasks WHERE ts >= {DAY_AGO}) AS events_24h""",
       ["alarms", "agents", "tasks"])
def g1(spark, sf):
    return views.summary(A.alarms(spark, sf), A.agents(spark, sf), A.task_events(spark, sf, since=DAY), A.as_of())


@query("g2_open_by_severity", f"""
SELECT alarm_id, agent_id, severity, {RANK_SQL} AS rank, sla_deadline FROM alarms WHERE status = 'open'""", ["alarms"])
def g2(spark, sf):
    return views.open_by_severity(A.alarms(spark, sf)).select(
        "alarm_id", "agent_id", "severity", "rank", "sla_deadline")


@query("g3_hourly", f"""
SELECT hour(ts) AS hour, count(*) AS tasks, count(*) FILTER (status = 'error') AS errors
FROM tasks WHERE ts >= {DAY_AGO} GROUP BY 1""", ["tasks"])
def g3(spark, sf):
    return views.hourly(A.task_events(spark, sf, since=DAY), A.as_of())


cte("per_agent", ["agents", "tasks"], f"""
  SELECT agent_id, coalesce(events, 0) AS events, coalesce(cost, 0) AS cost, coalesce(errors, 0) AS errors,
         coalesce(cost_total, 0) AS cost_total
  FROM agents LEFT JOIN (
    SELECT agent_id, count(*) FILTER (ts >= {DAY_AGO}) AS events, {_COST.format(f"cost_usd) FILTER (ts >= {DAY_AGO}")} AS cost,
           count(*) FILTER (ts >= {DAY_AGO} AND status = 'error') AS errors, {_COST.format('cost_usd')} AS cost_total
    FROM tasks WHERE ts >= {MONTH_AGO} GROUP BY 1) USING (agent_id)""")


@query("g4_per_agent", "SELECT * FROM per_agent", ["per_agent"])
def g4(spark, sf):
    return views.per_agent_ranked(A.agents(spark, sf), A.task_events(spark, sf, since=MONTH), A.as_of())


cte("week_series", ["tasks"], f"""
  SELECT agent_id, CAST(ts AS DATE) AS day, {_COST.format('cost_usd')} AS cost, CAST(sum(input_tokens) AS BIGINT) AS tokens_in,
         CAST(sum(output_tokens) AS BIGINT) AS tokens_out, count(*) FILTER (status = 'error') AS errors, count(*) AS tasks
  FROM tasks WHERE ts >= CAST(CAST({AS_OF_SQL} AS DATE) - 6 AS TIMESTAMP) GROUP BY 1, 2""")


def _day(df):
    return df.withColumn("day", F.col("day").cast("string"))


@query("g5_daily_series", "SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM week_series", ["week_series"])
def g5(spark, sf):
    return _day(views.daily_series(A.task_events(spark, sf, since=WEEK), A.as_of()))


@query("g6_daily_tool_mix", f"""
SELECT agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, tool_name, count(*) AS calls
FROM guards WHERE event_type = 'tool_call' AND ts >= CAST(CAST({AS_OF_SQL} AS DATE) - 6 AS TIMESTAMP) GROUP BY 1, 2, 3""",
       ["guards"])
def g6(spark, sf):
    return _day(views.daily_tool_mix(A.guard_events(spark, sf, since=WEEK), A.as_of()))


cte("mix", ["guards"], """
  SELECT agent_id, CAST(ts AS DATE) AS day, tool_name, count(*) AS calls,
         dense_rank() OVER (PARTITION BY agent_id ORDER BY CAST(ts AS DATE)) AS i
  FROM guards WHERE event_type = 'tool_call' GROUP BY 1, 2, 3""")
cte("mix_pairs", ["mix"], """
  SELECT d.agent_id, d.day, m.tool_name, sum(CASE WHEN m.i < d.i THEN calls ELSE 0 END) AS a,
         sum(CASE WHEN m.i = d.i THEN calls ELSE 0 END) AS b
  FROM (SELECT DISTINCT agent_id, day, i FROM mix) d
  JOIN mix m ON m.agent_id = d.agent_id AND m.i BETWEEN d.i - 6 AND d.i GROUP BY 1, 2, 3""")


@query("g7_daily_jsd", f"""
SELECT agent_id, CAST(day AS VARCHAR) AS day, round(jsd, 6) AS jsd, {_JSD_TAIL} FROM (
  SELECT agent_id, day, CASE WHEN count(p + q) > 0 THEN
         greatest(0, sum(0.5 * p * log2(p / (0.5 * (p + q))) + 0.5 * q * log2(q / (0.5 * (p + q))))) END AS jsd
  FROM (SELECT agent_id, day, a / nullif(sum(a) OVER w, 0) + 1e-6 AS p, b / nullif(sum(b) OVER w, 0) + 1e-6 AS q
        FROM mix_pairs WINDOW w AS (PARTITION BY agent_id, day)) GROUP BY 1, 2)""", ["mix_pairs"])
def g7(spark, sf):
    """The whole month, so that every day has its six reference days."""
    mix = views.daily_tool_mix(A.guard_events(spark, sf), A.as_of(), 31)
    return _day(views.daily_jsd(mix).select("agent_id", "day", r6("jsd"), "band"))


_CARD = ewma_sql("week_series", "week")


@query("g8_daily_z", f"""
SELECT agent_id, CAST(day AS VARCHAR) AS day, CASE WHEN i >= 3 AND s2 > 0 THEN round((cost - mu) / sqrt(s2), 4) END AS z
FROM {_CARD}""", [_CARD])
def g8(spark, sf):
    s = views.daily_series(A.task_events(spark, sf, since=WEEK), A.as_of())
    return _day(views.daily_z(s).select("agent_id", "day", F.round("z", 4).alias("z")))


cte("agent_tools", ["guards"], f"""
  SELECT agent_id, string_agg(tool_name || '=' || CAST(calls AS VARCHAR), ',' ORDER BY calls DESC, tool_name) AS tools FROM (
    SELECT agent_id, tool_name, count(*) AS calls FROM guards WHERE event_type = 'tool_call' AND ts >= {WEEK_AGO} GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY calls DESC, tool_name) <= 8) GROUP BY 1""")
cte("agent_alarms", ["alarms"], """
  SELECT agent_id, any_value(n_open) AS open_alarms, string_agg(signal || '/' || status, ',' ORDER BY created_at DESC, alarm_id) FILTER (r <= 10) AS recent_alarms
  FROM (SELECT *, count(*) FILTER (status = 'open') OVER (PARTITION BY agent_id) AS n_open,
               row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, alarm_id) AS r FROM alarms) GROUP BY 1""")
cte("agent_tickets", ["tickets"], """
  SELECT agent_id, any_value(n_open) AS open_tickets, string_agg(reason || '/' || status, ',' ORDER BY created_at DESC, escalation_id) FILTER (r <= 10) AS recent_tickets
  FROM (SELECT *, count(*) FILTER (status = 'open') OVER (PARTITION BY agent_id) AS n_open,
               row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, escalation_id) AS r FROM tickets) GROUP BY 1""")
cte("agent_state", ["per_agent", "agent_tools", "agent_alarms", "agent_tickets", "calibration"], """
  SELECT p.*, coalesce(open_alarms, 0) AS open_alarms, coalesce(open_tickets, 0) AS open_tickets,
         CASE WHEN closed THEN 'calibrated' WHEN calibration_until IS NOT NULL
              THEN 'calibrating until ' || strftime(calibration_until, '%Y-%m-%d %H:%M') ELSE 'unknown' END AS calibration,
         coalesce(tools, '') AS tools, coalesce(recent_alarms, '') AS recent_alarms, coalesce(recent_tickets, '') AS recent_tickets
  FROM per_agent p LEFT JOIN agent_tools USING (agent_id) LEFT JOIN agent_alarms USING (agent_id)
  LEFT JOIN agent_tickets USING (agent_id) LEFT JOIN calibration USING (agent_id)""")


def _flat_state(df):
    flat = lambda c, a, b, sep: F.coalesce(F.array_join(F.transform(
        c, lambda s: F.concat(s[a], F.lit(sep), s[b].cast("string"))), ","), F.lit("")).alias(c)
    return df.select("agent_id", "events", "cost", "errors", "cost_total", "open_alarms", "open_tickets",
                     "calibration", flat("tools", "tool_name", "calls", "="),
                     flat("recent_alarms", "signal", "status", "/"),
                     flat("recent_tickets", "reason", "status", "/"))


@query("g9_agent_state", "SELECT * FROM agent_state", ["agent_state"])
def g9(spark, sf):
    return _flat_state(views.agent_state(
        A.agents(spark, sf), A.task_events(spark, sf), A.guard_events(spark, sf), A.alarms(spark, sf),
        A.tickets(spark, sf), calibration(spark, sf), A.as_of()))


@query("g10_attribution_queue", """
SELECT alarm_id, a.agent_id, a.signal, severity, suggested_step, confidence FROM suggestions s JOIN alarms a USING (alarm_id)
LEFT JOIN labels l ON l.doc_id = a.n WHERE l.quality IS NULL ORDER BY confidence DESC, alarm_id LIMIT 12""",
       ["suggestions", "alarms"])
def g10(spark, sf):
    from .alarm_queries import _pending, suggestions
    s = suggestions(spark, sf).join(_pending(spark, sf).select("alarm_id", "confirmed"), "alarm_id")
    return views.attribution_queue(s, A.alarms(spark, sf)).select(
        "alarm_id", "agent_id", "signal", "severity", "suggested_step", "confidence")


@query("g11_sla_countdown", f"""
SELECT alarm_id, l AS seconds_left,
  CASE WHEN l < 0 THEN 'BREACHED ' || CAST(-l // 3600 AS VARCHAR) || 'h ' || lpad(CAST(-l % 3600 // 60 AS VARCHAR), 2, '0') || 'm ago'
       WHEN l >= 172800 THEN CAST(l // 86400 AS VARCHAR) || 'd ' || CAST(l % 86400 // 3600 AS VARCHAR) || 'h left'
       ELSE CAST(l // 3600 AS VARCHAR) || 'h ' || lpad(CAST(l % 3600 // 60 AS VARCHAR), 2, '0') || 'm left' END AS label
FROM (SELECT alarm_id, CAST(trunc((epoch_us(sla_deadline) - epoch_us({AS_OF_SQL})) / 1e6) AS BIGINT) AS l
      FROM alarms WHERE status = 'open')""", ["alarms"])
def g11(spark, sf):
    return views.sla_countdown(A.alarms(spark, sf), A.as_of()).select("alarm_id", "seconds_left", "label")


@query("g12_calibration_table", """
SELECT agent_id, CASE WHEN closed THEN 'calibrated' ELSE 'calibrating' END AS state,
       CASE WHEN NOT closed THEN greatest(0, CAST(floor((epoch_us(calibration_until) - epoch_us(TIMESTAMP '2024-01-15 06:00:00')) / 8.64e10) AS BIGINT)) END AS days_left
FROM calibration""", ["calibration"])
def g12(spark, sf):
    return views.calibration_table(calibration(spark, sf), A.as_of("2024-01-15 06:00:00")) \
        .select("agent_id", "state", "days_left")


@query("g13_drift_items", f"""
SELECT alarm_id, agent_id, signal, created_at FROM alarms WHERE event_type = 'report_item' AND created_at >= {WEEK_AGO}""",
       ["alarms"])
def g13(spark, sf):
    return reports.drift_items(A.alarms(spark, sf), A.as_of()).select("alarm_id", "agent_id", "signal", "created_at")


@query("g14_sla_summary", f"""
SELECT severity, count(*) AS n, count(*) FILTER (status = 'open') AS open,
       count(*) FILTER (status = 'open' AND sla_deadline < {AS_OF_SQL}) AS breached FROM alarms GROUP BY 1""", ["alarms"])
def g14(spark, sf):
    return reports.sla_summary(A.alarms(spark, sf), A.as_of())


cte("cost_ranking", ["tasks"], f"""
  SELECT agent_id, CAST(round(sum(cost_usd), 4) AS DOUBLE) AS cost_usd, count(*) AS tasks, round(avg(latency_ms), 0) AS avg_latency_ms
  FROM tasks WHERE ts >= {WEEK_AGO} GROUP BY 1 ORDER BY cost_usd DESC, agent_id LIMIT 5""")


@query("g15_cost_ranking", "SELECT * FROM cost_ranking", ["cost_ranking"])
def g15(spark, sf):
    return reports.cost_ranking(A.task_events(spark, sf, since=WEEK), A.as_of())


@query("g16_first_seen_classes", f"""
SELECT error_class, min(ts) AS first_ts FROM tasks WHERE error_class IS NOT NULL AND ts >= {WEEK_AGO} GROUP BY 1""", ["tasks"])
def g16(spark, sf):
    return reports.first_seen_classes(A.task_events(spark, sf, since=WEEK), A.as_of())


cte("anchors", ["alarms"], f"""
  SELECT alarm_id, severity, signal, evidence_seq, evidence_seq_resolved, created_at FROM alarms
  WHERE created_at >= {WEEK_AGO} ORDER BY created_at DESC, alarm_id LIMIT 50""")


@query("g17_evidence_anchors", "SELECT * FROM anchors WHERE evidence_seq IS NOT NULL", ["anchors"])
def g17(spark, sf):
    return reports.evidence_anchors(A.alarms(spark, sf), A.as_of())


cte("latencies", ["alarms", "tasks", "guards"], """
  SELECT alarm_id, agent_id, (epoch_us(created_at) - epoch_us(latest)) / 1000 AS latency_ms FROM (
    SELECT a.alarm_id, a.agent_id, a.created_at, max(e.ts) AS latest
    FROM alarms a JOIN (SELECT agent_id, ts FROM tasks UNION ALL SELECT agent_id, ts FROM guards) e
      ON e.agent_id = a.agent_id AND e.ts BETWEEN a.created_at - INTERVAL 60 SECOND AND a.created_at GROUP BY 1, 2, 3)""")


@query("g22_alarm_latencies", "SELECT alarm_id, agent_id, round(latency_ms, 6) AS latency_ms FROM latencies", ["latencies"])
def g22(spark, sf):
    return reports.alarm_latencies(A.alarms(spark, sf), A.task_events(spark, sf), A.guard_events(spark, sf)) \
        .select("alarm_id", "agent_id", r6("latency_ms"))


@query("g22_alarm_latency_card", """
SELECT count(*) AS count, round(max(latency_ms) FILTER (r = t), 1) AS p95_ms, round(max(latency_ms), 1) AS max_ms,
       CAST(500 AS DOUBLE) AS target_ms
FROM (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS r,
             round_even(0.95 * (count(*) OVER () - 1), 0) AS t FROM latencies)""", ["latencies"])
def g22_card(spark, sf):
    return reports.alarm_latency_card(reports.alarm_latencies(
        A.alarms(spark, sf), A.task_events(spark, sf), A.guard_events(spark, sf)))


@query("g24_agent_health", """
SELECT a.fleet_name, a.role, a.status AS agent_status, s.* FROM agents a JOIN agent_state s USING (agent_id)
WHERE agent_id = 'agent-3'""", ["agents", "agent_state"])
def g24(spark, sf):
    h = views.agent_health("agent-3", A.agents(spark, sf), A.task_events(spark, sf), A.guard_events(spark, sf),
                           A.alarms(spark, sf), A.tickets(spark, sf), calibration(spark, sf), A.as_of())
    return _flat_state(h).join(h.select("agent_id", "fleet_name", "role", "agent_status"), "agent_id")


@query("g25_agent_days", f"""
SELECT agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, {_COST.format('cost_usd')} AS cost, count(*) AS tasks,
       count(*) FILTER (status = 'error') AS e FROM tasks WHERE ts >= {SINCE_SQL} GROUP BY 1, 2""", ["tasks"])
def g25_days(spark, sf):
    return views.agent_days(A.task_events(spark, sf, since=SINCE), A.as_of(SINCE)).withColumn("d", F.col("d").cast("string"))


@query("g25_status_counts", "SELECT agent_id, status, count(*) AS n FROM tasks GROUP BY 1, 2", ["tasks"])
def g25_status(spark, sf):
    return views.status_counts(A.task_events(spark, sf))


@query("g25_top_tasks", f"""
SELECT agent_id, task_id, cost, row_number() OVER (PARTITION BY agent_id ORDER BY cost DESC, task_id) AS rank
FROM (SELECT agent_id, task_id, {_COST.format('cost_usd')} AS cost FROM tasks GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY cost DESC, task_id) <= 5""", ["tasks"])
def g25_top(spark, sf):
    return views.top_tasks(A.task_events(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("g26_window_count", f"SELECT count(*) AS c FROM tasks WHERE ts >= {SINCE_SQL}", ["tasks"])
def g26_count(spark, sf):
    return views.window_count(A.task_events(spark, sf, since=SINCE), A.as_of(SINCE))


@query("g26_agent_totals", f"""
SELECT agent_id, count(*) AS c, {_COST.format('cost_usd')} AS s, count(*) FILTER (status = 'error') AS e
FROM tasks WHERE ts >= {SINCE_SQL} GROUP BY 1""", ["tasks"])
def g26_totals(spark, sf):
    return views.agent_totals(A.task_events(spark, sf, since=SINCE), A.as_of(SINCE))


@query("g27_active_agents", f"""
SELECT agent_id, count(*) AS tasks FROM tasks WHERE ts >= {WEEK_AGO} GROUP BY 1 ORDER BY tasks DESC, agent_id LIMIT 3""", ["tasks"])
def g27(spark, sf):
    return views.active_agents(A.task_events(spark, sf, since=WEEK), A.as_of(WEEK), 3)
