"""X: measures defined next to the core facts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import mask_personal_data
from ..operators import facts, ingest, reliability as rel, tiers
from ..operators.commits import TableLog
from ..rules import CARD_MASK, CARD_PATTERN, EMAIL_MASK, EMAIL_PATTERN
from ..session import work_dir
from .base import query, r6
from .facts_queries import AS_OF_SQL, calibration


@query("x1_pass_hat_k", """
SELECT model_name, status_class, n, successes, round(CASE WHEN n >= 5 THEN CASE WHEN successes < 5 THEN 0 ELSE
  (successes / n) * ((successes - 1) / (n - 1)) * ((successes - 2) / (n - 2)) * ((successes - 3) / (n - 3)) * ((successes - 4) / (n - 4)) END END, 6) AS pass_k
FROM (SELECT model_name, coalesce(task_template, 'none') AS status_class, count(*) AS n, count(*) FILTER (status = 'ok') AS successes
      FROM tasks GROUP BY 1, 2)""", ["tasks"])
def x1(spark, sf):
    t = A.task_events(spark, sf).withColumn("status_class", F.coalesce("task_template", F.lit("none")))
    return rel.pass_hat_k(t, ["model_name", "status_class"], F.col("status") == "ok") \
        .select("model_name", "status_class", "n", "successes", r6("pass_k"))


@query("x2_variation", """
SELECT t.agent_id, round(stddev_pop(CAST(cost_usd AS DOUBLE)) / avg(CAST(cost_usd AS DOUBLE)), 6) AS cost_cv, any_value(s.cv) AS steps_cv
FROM tasks t JOIN (SELECT agent_id, round(stddev_pop(n) / avg(n), 6) AS cv FROM (
  SELECT agent_id, task_id, count(*) AS n FROM tasks GROUP BY 1, 2) GROUP BY 1) s USING (agent_id) GROUP BY 1""", ["tasks"])
def x2(spark, sf):
    t = A.task_events(spark, sf)
    steps = t.groupBy("agent_id", "task_id").agg(F.count(F.lit(1)).alias("n"))
    return (rel.variation(t, ["agent_id"], "cost_usd", "cost_cv")
            .join(rel.variation(steps, ["agent_id"], "n", "steps_cv"), "agent_id")
            .select("agent_id", r6("cost_cv"), r6("steps_cv")))


@query("x3_fault_curve", """
SELECT rate, round(s, 6) AS success, round((arg_min(s, rate) OVER () - s) * 100, 4) AS drop_points
FROM (SELECT retry_count / 20 AS rate, avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END) AS s FROM tasks GROUP BY 1)""", ["tasks"])
def x3(spark, sf):
    t = A.task_events(spark, sf).withColumn("rate", F.col("retry_count") / 20)
    return rel.fault_curve(t, "rate", F.col("status") == "ok").select(
        "rate", r6("success"), F.round("drop_points", 4).alias("drop_points"))


@query("x4_recovery_times", """
SELECT e.event_id, e.agent_id, round((epoch_us(min(g.ts)) - epoch_us(any_value(e.ts))) / 1e6, 6) AS seconds
FROM tasks e LEFT JOIN tasks g ON g.agent_id = e.agent_id AND g.status = 'ok' AND g.ts > e.ts
WHERE e.status <> 'ok' GROUP BY 1, 2""", ["tasks"])
def x4(spark, sf):
    return rel.recovery_times(A.task_events(spark, sf)).select("event_id", "agent_id", r6("seconds"))


@query("x5_violation_rate", """
SELECT task_template, count(*) AS runs, count(*) FILTER (end_state <> reference) AS violations,
       round(count(*) FILTER (end_state <> reference) / count(*), 6) AS rate,
       count(*) FILTER (end_state <> reference) / count(*) <= 0.02 AS within_limit FROM end_states GROUP BY 1""", ["end_states"])
def x5(spark, sf):
    return rel.violation_rate(facts.end_state_divergence(A.task_events(spark, sf))).select(
        "task_template", "runs", "violations", r6("rate"), "within_limit")


@query("x6_slow_steps", """
SELECT agent_id, recent_p95, prior_p95, coalesce(recent_p95 > 2 * prior_p95, FALSE) AS fired FROM (
  SELECT agent_id, quantile_disc(latency_ms, 0.95) FILTER (ts > latest - INTERVAL 72 HOUR) AS recent_p95,
         quantile_disc(latency_ms, 0.95) FILTER (ts <= latest - INTERVAL 72 HOUR) AS prior_p95
  FROM tasks JOIN (SELECT agent_id, max(ts) AS latest FROM tasks GROUP BY 1) USING (agent_id)
  WHERE ts > latest - INTERVAL 72 HOUR - INTERVAL 7 DAY GROUP BY 1)""", ["tasks"])
def x6_slow(spark, sf):
    return rel.slow_steps(A.task_events(spark, sf), 72)


_MAD_SQL = """
SELECT event_id, agent_id, round(0.6745 * (CAST({v} AS DOUBLE) - m) / nullif(mad, 0), 9) AS robust_z,
       coalesce(abs(0.6745 * (CAST({v} AS DOUBLE) - m) / nullif(mad, 0)) > 3, FALSE) AS alarm
FROM tasks JOIN (SELECT agent_id, median(abs(CAST({v} AS DOUBLE) - m)) AS mad, any_value(m) AS m FROM tasks
  JOIN (SELECT agent_id, median(CAST({v} AS DOUBLE)) AS m FROM tasks GROUP BY 1) USING (agent_id) GROUP BY 1) USING (agent_id)"""


@query("x6_cost_outliers", _MAD_SQL.format(v="cost_usd"), ["tasks"])
def x6_cost(spark, sf):
    return rel.task_outliers(A.task_events(spark, sf), "cost_usd").select("event_id", "agent_id", F.round("robust_z", 9).alias("robust_z"), "alarm")


@query("x6_latency_outliers", _MAD_SQL.format(v="latency_ms"), ["tasks"])
def x6_latency(spark, sf):
    return rel.task_outliers(A.task_events(spark, sf), "latency_ms").select("event_id", "agent_id", F.round("robust_z", 9).alias("robust_z"), "alarm")


@query("x6_first_token_card", """
SELECT agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(ttft_s), 6) AS ttft_s,
       row_number() OVER (PARTITION BY agent_id ORDER BY CAST(ts AS DATE)) AS n FROM tasks GROUP BY agent_id, CAST(ts AS DATE)""", ["tasks"])
def x6_ttft(spark, sf):
    return rel.first_token_card(A.task_events(spark, sf), 10).select(
        "agent_id", F.col("day").cast("string").alias("day"), r6("ttft_s"), "n")


@query("x6_odd_output_lengths", """
SELECT event_id, output_tokens, m AS median FROM tasks JOIN (SELECT agent_id, median(output_tokens) AS m FROM tasks GROUP BY 1) USING (agent_id)
WHERE abs(output_tokens - m) > 0.5 * m""", ["tasks"])
def x6_lengths(spark, sf):
    return rel.odd_output_lengths(A.task_events(spark, sf)).select("event_id", "output_tokens", "median")


@query("x6_escalation_ratio", """
SELECT CAST(week AS VARCHAR) AS week, tasks, tickets, round(tickets / tasks, 6) AS ratio,
       coalesce(tickets / tasks > 2 * lag(tickets / tasks) OVER (ORDER BY week), FALSE) AS fired
FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS tasks FROM tasks GROUP BY 1)
JOIN (SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS tickets FROM tickets GROUP BY 1) USING (week)""",
       ["tasks", "tickets"])
def x6_ratio(spark, sf):
    return rel.escalation_ratio(A.task_events(spark, sf), A.tickets(spark, sf)).select(
        F.col("week").cast("string").alias("week"), "tasks", "tickets", r6("ratio"), "fired")


@query("x6_ticket_quota", """
SELECT agent_id, count(*) AS open_tickets, count(*) > 5 AS fired FROM tickets WHERE status = 'open' GROUP BY 1""", ["tickets"])
def x6_quota(spark, sf):
    return rel.ticket_quota(A.tickets(spark, sf))


@query("x7_masked_texts", f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '{EMAIL_PATTERN}', '{EMAIL_MASK}', 'g'), '{CARD_PATTERN}', '{CARD_MASK}', 'g') AS masked
FROM documents""")
def x7(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", mask_personal_data(F.col("text")).alias("masked"))


@query("x8_warm_rows", f"""
SELECT event_id, ts FROM tasks WHERE ts < {AS_OF_SQL} - INTERVAL 10 DAY AND ts >= {AS_OF_SQL} - INTERVAL 20 DAY""", ["tasks"])
def x8(spark, sf):
    return ingest.warm_rows(A.task_events(spark, sf), A.as_of(), 10, 20).select("event_id", "ts")


@query("x8_compacted", """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 'warm' ELSE 'hot' END AS tier FROM tasks""", ["tasks"])
def x8_compacted(spark, sf):
    """Days that grew too old for the hot table, moved in two runs; late rows reach all days between
    them. Every row is in one tier."""
    log = TableLog(spark, work_dir(spark, "tiers"))
    rows = A.task_events(spark, sf).select("event_id", "agent_id", "ts")
    late = F.coalesce(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0, F.lit(False))
    for part, day in ((~late, 8), (late, 12)):
        tiers.land(log, rows.where(part), 2)
        tiers.to_warm(log, date(2024, 1, day))
    tier = lambda name: log.read(name, "event_id string").select("event_id", F.lit(name).alias("tier"))
    return tier("hot").unionByName(tier("warm"))


@query("x8_cut_runs", """
SELECT CASE WHEN CAST(substr(event_id, 5) AS BIGINT) % 3 <> 0 THEN event_id END AS event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 'warm' ELSE 'hot' END AS tier FROM tasks""", ["tasks"])
def x8_cut(spark, sf):
    """Runs that were cut after their writes and before their commit, and a batch that is
    delivered again. A third of the rows has no id to find a repetition by; every row is there once."""
    log = TableLog(spark, work_dir(spark, "cut-tiers"))
    n = F.substring("event_id", 5, 12).cast("bigint")
    rows = A.task_events(spark, sf).select(F.when(n % 3 != 0, F.col("event_id")).alias("event_id"), "agent_id", "ts")
    tiers.land(log, rows, 2, writer="feed", batch=0)
    log.stage("warm", ingest.by_day(rows), "event_date")
    tiers.to_warm(log, date(2024, 1, 8))
    log.stage("hot", ingest.by_day(rows), "event_date")
    tiers.land(log, rows, 2, writer="feed", batch=0)
    tiers.to_warm(log, date(2024, 1, 12))
    tier = lambda name: log.read(name, "event_id string, event_date date").select(
        "event_id", F.col("event_date").cast("string").alias("day"), F.lit(name).alias("tier"))
    return tier("hot").unionByName(tier("warm"))


@query("x8_cold_summaries", """
SELECT CAST(day AS VARCHAR) AS day, agent_id, count(*) AS events, CAST(sum(cost_usd) AS DOUBLE) AS cost, any_value(root) AS root
FROM (SELECT CAST(ts AS DATE) AS day, agent_id, cost_usd FROM tasks) JOIN (
  SELECT day, sha256(sha256(string_agg(h, '' ORDER BY b))) AS root FROM (
    SELECT day, b, sha256(string_agg(sha256(event_id), '' ORDER BY p)) AS h FROM (
      SELECT event_id, day, p, (p - 1) // 1024 AS b FROM (
        SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS p FROM tasks))
    GROUP BY 1, 2) GROUP BY 1) USING (day) GROUP BY 1, 2""", ["tasks"])
def x8_cold(spark, sf):
    return tiers.cold_summaries(A.task_events(spark, sf)).select(
        F.col("event_date").cast("string").alias("day"), "agent_id", "events", F.col("cost").cast("double").alias("cost"), "root")


@query("x9_baselines", """
SELECT agent_id, round(avg(CAST(cost_usd AS DOUBLE)), 8) AS mean_cost_usd, quantile_disc(latency_ms, 0.95) AS p95_latency_ms,
       round(any_value(mad), 6) AS mad_cost_usd, any_value(tools) AS tools
FROM tasks JOIN (SELECT agent_id, median(abs(CAST(cost_usd AS DOUBLE) - m)) AS mad FROM tasks
  JOIN (SELECT agent_id, median(CAST(cost_usd AS DOUBLE)) AS m FROM tasks GROUP BY 1) USING (agent_id) GROUP BY 1) USING (agent_id)
LEFT JOIN (SELECT agent_id, count(DISTINCT tool_name) AS tools FROM guards WHERE event_type = 'tool_call' GROUP BY 1) USING (agent_id)
GROUP BY 1""", ["tasks", "guards"])
def x9(spark, sf):
    t = A.task_events(spark, sf)
    return rel.baselines(t, A.guard_events(spark, sf), facts.daily_cost(t), calibration(spark, sf)).select(
        "agent_id", F.round("mean_cost_usd", 8).alias("mean_cost_usd"), "p95_latency_ms", r6("mad_cost_usd"),
        F.size("tool_mix").cast("bigint").alias("tools"))
