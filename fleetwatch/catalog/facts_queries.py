"""B and C: facts and statistics."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from .. import adapters as A
from .. import rules as R
from ..functions.hashing import call_signature
from ..operators import alarms as alarm_ops
from ..operators import facts, ingest, stats
from ..plans.evaluate import StateLog, Windows, evaluate, instant
from ..session import kept, work_dir
from .base import PRESEEN_SQL, classify_sql, cte, query, r6

DAY = 86_400
AS_OF_SQL = f"TIMESTAMP '{A.AS_OF}'"


def windows() -> Windows:
    """Windows wide enough for about two events per agent and day."""
    return Windows(error_s=7 * DAY, deny_s=7 * DAY, recent_h=72, prior_days=14, ewma_warmup=10)


@query("b0_activity_anchors", """
SELECT t.agent_id, t.latest AS task_latest, g.latest AS guard_latest, d.latest AS decision_latest
FROM (SELECT agent_id, max(ts) AS latest FROM tasks GROUP BY 1) t
LEFT JOIN (SELECT agent_id, max(ts) AS latest FROM guards GROUP BY 1) g USING (agent_id)
LEFT JOIN (SELECT agent_id, max(ts) AS latest FROM guards
           WHERE event_type = 'permission_decision' GROUP BY 1) d USING (agent_id)""",
       ["tasks", "guards"])
def b0(spark, sf):
    return facts.activity_anchors(A.task_events(spark, sf), A.guard_events(spark, sf))


cte("error_rates", ["tasks"], """
  SELECT agent_id, count(*) FILTER (status = 'error') AS hits, count(*) AS total
  FROM tasks JOIN (SELECT agent_id, max(ts) AS latest FROM tasks GROUP BY 1) USING (agent_id)
  WHERE status IN ('ok', 'error') AND ts >= latest - INTERVAL 7 DAY GROUP BY agent_id""")
cte("deny_rates", ["guards"], """
  SELECT agent_id, count(*) FILTER (decision = 'deny') AS hits, count(*) AS total
  FROM guards JOIN (SELECT agent_id, max(ts) AS latest FROM guards
                    WHERE event_type = 'permission_decision' GROUP BY 1) USING (agent_id)
  WHERE event_type = 'permission_decision' AND ts >= latest - INTERVAL 7 DAY GROUP BY agent_id""")


def _ratio(df):
    return df.select("agent_id", "hits", "total", r6("value"), "fired")


_RATIO_SQL = """
SELECT agent_id, hits, total, round(hits / total, 6) AS value, hits / total > 0.20 AS fired
FROM """


@query("b1_error_rate", _RATIO_SQL + "error_rates", ["error_rates"])
def b1(spark, sf):
    return _ratio(facts.error_rate(A.task_events(spark, sf), 7 * DAY))


@query("b1_error_rate_24s", """
SELECT agent_id, count(*) FILTER (status = 'error') AS hits, count(*) AS total,
       round(count(*) FILTER (status = 'error') / count(*), 6) AS value,
       count(*) FILTER (status = 'error') / count(*) > 0.20 AS fired
FROM tasks JOIN (SELECT agent_id, max(ts) AS latest FROM tasks GROUP BY 1) USING (agent_id)
WHERE status IN ('ok', 'error') AND ts >= latest - INTERVAL 24 SECOND GROUP BY agent_id""", ["tasks"])
def b1_default(spark, sf):
    return _ratio(facts.error_rate(A.task_events(spark, sf)))


@query("b2_deny_ratio", _RATIO_SQL + "deny_rates", ["deny_rates"])
def b2(spark, sf):
    return _ratio(facts.deny_ratio(A.guard_events(spark, sf), 7 * DAY))


@query("b3_retries", """
SELECT agent_id, CAST(max(retry_count) AS DOUBLE) AS value, max(retry_count) >= 3 AS fired
FROM tasks GROUP BY 1""", ["tasks"])
def b3(spark, sf):
    return facts.retries(A.task_events(spark, sf))


@query("b4_ticket_age_fleet", f"""
SELECT round((epoch_us({AS_OF_SQL}) - epoch_us(min(created_at))) / 3.6e9, 6) AS value,
       (epoch_us({AS_OF_SQL}) - epoch_us(min(created_at))) / 3.6e9 > 24 AS fired
FROM tickets WHERE status = 'open'""", ["tickets"])
def b4(spark, sf):
    return facts.fleet_ticket_age(A.tickets(spark, sf), A.as_of()).select(r6("value"), "fired")


@query("b4_ticket_age_per_agent", f"""
SELECT agent_id, round((epoch_us({AS_OF_SQL}) - epoch_us(min(created_at))) / 3.6e9, 6) AS value,
       (epoch_us({AS_OF_SQL}) - epoch_us(min(created_at))) / 3.6e9 > 24 AS fired
FROM tickets WHERE status = 'open' GROUP BY 1""", ["tickets"])
def b4_agent(spark, sf):
    return (facts.ticket_age(A.tickets(spark, sf), A.as_of())
            .select("agent_id", r6("value"), "fired"))


cte("tool_windows", ["guards"], """
  SELECT agent_id, tool_name, count(*) FILTER (ts <= latest - INTERVAL 72 HOUR) AS prior,
         count(*) FILTER (ts > latest - INTERVAL 72 HOUR) AS recent
  FROM guards JOIN (SELECT agent_id, max(ts) AS latest FROM guards GROUP BY 1) USING (agent_id)
  WHERE event_type = 'tool_call' AND ts > latest - INTERVAL 72 HOUR - INTERVAL 14 DAY
  GROUP BY 1, 2""")
cte("tool_jsd", ["tool_windows"], """
  SELECT agent_id, CASE WHEN count(p + q) > 0 THEN greatest(0, sum(0.5 * p * log2(p / (0.5 * (p + q))) + 0.5 * q * log2(q / (0.5 * (p + q))))) END AS jsd
  FROM (SELECT agent_id, prior / nullif(sum(prior) OVER w, 0) + 1e-6 AS p,
               recent / nullif(sum(recent) OVER w, 0) + 1e-6 AS q
        FROM tool_windows WINDOW w AS (PARTITION BY agent_id)) GROUP BY 1""")
_JSD_TAIL = """
       CASE WHEN jsd IS NULL THEN 'warming_up' WHEN jsd < 0.20 THEN 'healthy'
            WHEN jsd <= 0.40 THEN 'watch' ELSE 'alarm' END AS band"""


@query("b5_tool_windows", "SELECT * FROM tool_windows", ["tool_windows"])
def b5(spark, sf):
    return facts.tool_windows(A.guard_events(spark, sf), 72, 14)


@query("b6_tool_drift", f"""
SELECT agent_id, round(jsd, 6) AS jsd, {_JSD_TAIL}, coalesce(jsd > 0.40, FALSE) AS fired
FROM tool_jsd""", ["tool_jsd"])
def b6(spark, sf):
    return facts.tool_drift(A.guard_events(spark, sf), 72, 14) \
        .select("agent_id", r6("jsd"), "band", "fired")


cte("loop_rows", ["guards"], """
  SELECT *, tool_name || args AS sig, lag(tool_name || args, 1) OVER w AS p1,
         lag(tool_name || args, 2) OVER w AS p2
  FROM guards WHERE event_type = 'tool_call'
  WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id)""")
cte("loop_openings", ["loop_rows"], """
  SELECT task_id, min(ts) AS opened_at, arg_min(event_id, ts) AS event_id,
         arg_min(agent_id, ts) AS agent_id, arg_min(tool_name, ts) AS tool_name
  FROM loop_rows WHERE sig = p1 AND sig = p2 GROUP BY 1""")
cte("loop_hits", ["loop_openings"], """
  SELECT g.agent_id, count(DISTINCT g.task_id) AS looped_tasks
  FROM loop_rows g JOIN loop_openings o ON g.task_id = o.task_id AND g.ts >= o.opened_at
  GROUP BY 1""")


@query("b7_loop_openings", "SELECT * FROM loop_openings", ["loop_openings"])
def b7(spark, sf):
    return facts.loop_openings(A.guard_events(spark, sf))


@query("b7_loop_hits", "SELECT * FROM loop_hits", ["loop_hits"])
def b7_hits(spark, sf):
    return facts.loop_hits(A.guard_events(spark, sf))


@query("b7_repeated_turns", """
SELECT task_id, min(ts) AS opened_at FROM (
  SELECT CAST(conv_id AS VARCHAR) AS task_id, turn AS ts, n_words AS sig,
         lag(n_words, 1) OVER w AS p1, lag(n_words, 2) OVER w AS p2
  FROM (SELECT conv_id, turn, length(text) // 400 AS n_words FROM conversations)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE sig = p1 AND sig = p2 GROUP BY 1""")
def b7_turns(spark, sf):
    """Conversation turns as a call sequence: three turns in a row of one length class."""
    from ..operators.sequences import previous_values, range_bucket
    turns = A.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("ts"),
        F.call_function("div", F.length("text"), F.lit(400)).alias("sig"))
    seq = previous_values(turns, ["task_id"], range_bucket("ts", 4), ["ts"], "sig", 2)
    return (seq.where((F.col("sig") == F.col("prev_1")) & (F.col("sig") == F.col("prev_2")))
            .groupBy("task_id").agg(F.min("ts").alias("opened_at")))


@query("b8_call_signatures", """
SELECT event_id, sha256(CAST(length(tool_name) AS VARCHAR) || '|' || tool_name || '|' || args) AS sig
FROM guards""", ["guards"])
def b8(spark, sf):
    return A.guard_events(spark, sf).select(
        "event_id", call_signature(F.col("tool_name"), F.col("arguments_json")).alias("sig"))


@query("b9_classified_errors", f"""
SELECT event_id, agent_id, error_class, {classify_sql('error_class', "status = 'quarantined'")} AS class
FROM tasks WHERE error_class IS NOT NULL""", ["tasks"])
def b9(spark, sf):
    return facts.classified_errors(A.task_events(spark, sf)) \
        .select("event_id", "agent_id", "error_class", "class")


@query("b9_classified_texts", f"""
SELECT doc_id, {classify_sql('text')} AS class FROM documents""")
def b9_texts(spark, sf):
    from ..functions.text import classify_error
    return A.table(spark, sf, "documents").select("doc_id", classify_error(F.col("text")).alias("class"))


@query("b10_failure_families", f"""
SELECT family, coalesce(trigger_signal, '') AS trigger_signal, count(*) AS n FROM (
  SELECT {classify_sql('error_class', "status = 'quarantined'")} AS error_class
  FROM tasks WHERE error_class IS NOT NULL) JOIN families USING (error_class) GROUP BY 1, 2""",
       ["tasks", "families"])
def b10(spark, sf):
    c = facts.classified_errors(A.task_events(spark, sf)).select(F.col("class").alias("error_class"))
    return (c.join(F.broadcast(R.error_families(spark)), "error_class")
            .groupBy("family", F.coalesce("trigger_signal", F.lit("")).alias("trigger_signal"))
            .agg(F.count(F.lit(1)).alias("n")))


cte("new_classes", ["tasks"], f"""
  SELECT agent_id, class, min(ts) AS first_seen, count(*) AS n FROM (
    SELECT agent_id, ts, {classify_sql('error_class', "status = 'quarantined'")} AS class
    FROM tasks WHERE error_class IS NOT NULL)
  WHERE class NOT IN ({PRESEEN_SQL}) GROUP BY 1, 2""")


@query("b11_new_error_classes", "SELECT * FROM new_classes", ["new_classes"])
def b11(spark, sf):
    return facts.new_error_classes(A.task_events(spark, sf))


@query("b11_new_classes_since", """
SELECT agent_id, class, min(ts) AS first_seen, count(*) AS n FROM (
  SELECT agent_id, ts, """ + classify_sql("error_class", "status = 'quarantined'") + """ AS class
  FROM tasks WHERE error_class IS NOT NULL)
WHERE class NOT IN (""" + PRESEEN_SQL + """)
GROUP BY 1, 2 HAVING min(ts) >= TIMESTAMP '2024-01-15'""", ["tasks"])
def b11_since(spark, sf):
    """Second run: what the first half of the month already recorded stays out."""
    t = A.task_events(spark, sf)
    cut = F.col("ts") < A.as_of("2024-01-15 00:00:00")
    seen = facts.new_error_classes(t.where(cut)).select("agent_id", "class")
    return facts.new_error_classes(t.where(~cut), seen)


cte("daily", ["tasks"], """
  SELECT agent_id, CAST(ts AS DATE) AS day, CAST(sum(cost_usd) AS DOUBLE) AS cost
  FROM tasks GROUP BY 1, 2""")


@query("b12_daily_cost", """
SELECT agent_id, CAST(day AS VARCHAR) AS day, round(cost, 6) AS cost FROM daily""", ["daily"])
def b12(spark, sf):
    return facts.daily_cost(A.task_events(spark, sf)).select(
        "agent_id", F.col("day").cast("string").alias("day"), r6("cost"))


def ewma_sql(source: str, name: str) -> str:
    """CTEs for the control card by recursion over the day index."""
    cte(f"{name}_i", [source], f"""
  SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY day) AS i FROM {source}""")
    cte(f"{name}_card", [f"{name}_i"], f"""
  SELECT agent_id, day, cost, i, cost AS mu, CAST(0 AS DOUBLE) AS s2 FROM {name}_i WHERE i = 1
  UNION ALL
  SELECT x.agent_id, x.day, x.cost, x.i, 0.15::DOUBLE * x.cost + 0.85::DOUBLE * c.mu,
         0.10::DOUBLE * (x.cost - (0.15::DOUBLE * x.cost + 0.85::DOUBLE * c.mu))
                      * (x.cost - (0.15::DOUBLE * x.cost + 0.85::DOUBLE * c.mu)) + 0.90::DOUBLE * c.s2
  FROM {name}_card c JOIN {name}_i x ON x.agent_id = c.agent_id AND x.i = c.i + 1""")
    return f"{name}_card"


_CARD = ewma_sql("costs", "supp")
_CARD_TASKS = ewma_sql("daily", "task")
_CARD_COLS = """agent_id, CAST(day AS VARCHAR) AS day, i AS n, round(sqrt(s2), 4) AS sigma,
       CASE WHEN {arm} THEN round((cost - mu) / sqrt(s2), 4) END AS z, {arm} AS armed,
       {arm} AND (cost - mu) / sqrt(s2) > 2.5 AS alarm"""


def _card(df):
    """The early means have few decimals and sit on rounding ties; z and sigma, which are
    built from them, do not."""
    return df.select("agent_id", F.col("day").cast("string").alias("day"),
                     "n", F.round("sigma", 4).alias("sigma"),
                     F.round("z", 4).alias("z"), "armed", "alarm")


@query("c1_ewma_card", f"SELECT {_CARD_COLS.format(arm='(i >= 30 AND s2 > 0)')} FROM {_CARD}", [_CARD])
def c1(spark, sf):
    return _card(stats.ewma_card(A.supplier_costs(spark, sf), ["agent_id"], "day", "cost"))


@query("b13_cost_spikes", f"""
SELECT agent_id, CAST(day AS VARCHAR) AS day, round(cost, 6) AS cost, round(mu, 4) AS mu,
       round((cost - mu) / sqrt(s2), 4) AS z
FROM {_CARD} WHERE i >= 30 AND s2 > 0 AND (cost - mu) / sqrt(s2) > 2.5 AND mu > 0 AND cost > 2 * mu""",
       [_CARD])
def b13(spark, sf):
    return (facts.cost_spikes(A.supplier_costs(spark, sf)).where("fired")
            .select("agent_id", F.col("day").cast("string").alias("day"), r6("cost"),
                    F.round("mu", 4).alias("mu"), F.round("z", 4).alias("z")))


cte("end_states", ["tasks"], """
  SELECT agent_id, task_template, event_id, end_state, lag(end_state) OVER (
           PARTITION BY task_template ORDER BY ts, event_id) AS reference
  FROM tasks WHERE task_template IS NOT NULL""")


@query("b14_end_state_divergence", """
SELECT event_id, task_template, end_state, coalesce(reference, '') AS reference,
       coalesce(end_state <> reference, FALSE) AS diverged FROM end_states""", ["end_states"])
def b14(spark, sf):
    return facts.end_state_divergence(A.task_events(spark, sf)).select(
        "event_id", "task_template", "end_state",
        F.coalesce("reference", F.lit("")).alias("reference"), "diverged")


def _traffic(spark, sf):
    t = A.task_events(spark, sf)
    number = F.substring("event_id", 5, 12).cast("bigint")
    return t.select("model_name", F.to_date("ts").cast("string").alias("day"), "event_id", "ts",
                    (number % 61 == 0).alias("rerun"))


cte("traffic", ["tasks"], """
  SELECT model_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, ts, n % 61 = 0 AS rerun
  FROM tasks""")


@query("b15_shadow_budget", """
SELECT model_name, day, events, reruns, round(reruns / nullif(events, 0), 6) AS share,
       coalesce((reruns + 1) / nullif(events, 0) <= 0.01, FALSE) AS allowed
FROM (SELECT model_name, day, count(*) FILTER (NOT rerun) AS events,
             count(*) FILTER (rerun) AS reruns FROM traffic GROUP BY 1, 2)""", ["traffic"])
def b15(spark, sf):
    return facts.shadow_budget(_traffic(spark, sf), ["model_name", "day"], F.col("rerun")) \
        .select("model_name", "day", "events", "reruns", r6("share"), "allowed")


@query("b15_shadow_overruns", """
SELECT event_id, model_name, day, nth, events FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name, day ORDER BY ts, event_id) AS nth
  FROM traffic WHERE rerun)
JOIN (SELECT model_name, day, count(*) FILTER (NOT rerun) AS events FROM traffic GROUP BY 1, 2)
  USING (model_name, day)
WHERE events > 0 AND nth / events > 0.01""", ["traffic"])
def b15_over(spark, sf):
    return facts.shadow_overruns(_traffic(spark, sf), ["model_name", "day"], F.col("rerun")) \
        .select("event_id", "model_name", "day", "nth", "events")


@query("b16_false_positive_budget", """
SELECT agent_id, day, count(*) AS cycles, count(*) FILTER (fp) AS false_positives,
       round(count(*) FILTER (fp) / count(*), 6) AS ratio, count(*) FILTER (fp) / count(*) <= 0.05 AS within_budget
FROM (SELECT agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, hour(ts) AS h,
             bool_or(status = 'quarantined') AS fp FROM tasks GROUP BY 1, 2, 3) GROUP BY 1, 2""", ["tasks"])
def b16(spark, sf):
    cycles = (A.task_events(spark, sf)
              .groupBy("agent_id", F.to_date("ts").cast("string").alias("day"), F.hour("ts").alias("h"))
              .agg(F.bool_or(F.col("status") == "quarantined").alias("false_positive")))
    return facts.false_positive_budget(cycles).select(
        "agent_id", "day", "cycles", "false_positives", r6("ratio"), "within_budget")


cte("calibration", ["registrations"], f"""
  SELECT agent_id, first_seen + INTERVAL 14 DAY AS calibration_until,
         synthetic OR TIMESTAMP '2024-01-15 06:00:00' >= first_seen + INTERVAL 14 DAY AS closed
  FROM registrations""")
cte("newest_card", [_CARD_TASKS, "calibration"], f"""
  SELECT agent_id, arg_max(CASE WHEN i >= 10 AND s2 > 0 AND closed THEN (cost - mu) / sqrt(s2) END, day) AS z0,
         max(day) AS d FROM {_CARD_TASKS} JOIN calibration USING (agent_id) GROUP BY 1""")
cte("newest_cost", ["newest_card"], f"""
  SELECT agent_id, CASE WHEN i >= 10 AND s2 > 0 AND closed THEN (cost - mu) / sqrt(s2) END AS z,
         coalesce(i >= 10 AND s2 > 0 AND closed AND (cost - mu) / sqrt(s2) > 2.5 AND mu > 0 AND cost > 2 * mu, FALSE) AS fired
  FROM {_CARD_TASKS} JOIN calibration USING (agent_id) JOIN newest_card USING (agent_id) WHERE day = d""")
cte("fact_rows", ["error_rates", "deny_rates", "tool_jsd", "loop_hits", "new_classes", "newest_cost"], """
  SELECT agent_id, 'error.rate>0.20' AS signal, hits / total AS value, hits / total > 0.20 AS fired FROM error_rates
  UNION ALL SELECT agent_id, 'permission.deny>0.20', hits / total, hits / total > 0.20 FROM deny_rates
  UNION ALL SELECT agent_id, 'latency.retry>=3', max(retry_count), max(retry_count) >= 3 FROM tasks GROUP BY 1
  UNION ALL SELECT agent_id, 'drift.tool_distribution>0.40', jsd, coalesce(jsd > 0.40, FALSE) FROM tool_jsd
  UNION ALL SELECT agent_id, 'loop>=2', looped_tasks, TRUE FROM loop_hits
  UNION ALL SELECT agent_id, 'error.new_class_seen', count(*), TRUE FROM new_classes GROUP BY 1
  UNION ALL SELECT agent_id, 'cost.daily>2x_ewma', z, fired FROM newest_cost""")
cte("facts", ["fact_rows", "registrations", "rules", "tickets"], f"""
  SELECT agent_id, signal,
         CASE WHEN signal = 'escalation.age_max>24' THEN (SELECT epoch_us({AS_OF_SQL}) - epoch_us(min(created_at)) FROM tickets WHERE status = 'open') / 3.6e9 > 24
              ELSE coalesce(f.fired, FALSE) END AS fired,
         CASE WHEN signal = 'escalation.age_max>24' THEN (SELECT epoch_us({AS_OF_SQL}) - epoch_us(min(created_at)) FROM tickets WHERE status = 'open') / 3.6e9
              ELSE f.value END AS value
  FROM registrations CROSS JOIN rules LEFT JOIN fact_rows f USING (agent_id, signal)""")


def registrations(spark, sf):
    return ingest.register_agents(A.task_events(spark, sf), A.guard_events(spark, sf))


def calibration(spark, sf):
    """Calibration half way through the month, so that some windows are still open."""
    return alarm_ops.calibration_state(registrations(spark, sf), A.as_of("2024-01-15 06:00:00"))


def fact_table(spark, sf, state=None):
    state = state if state is not None else calibration(spark, sf)
    return evaluate(state, A.task_events(spark, sf), A.guard_events(spark, sf),
                    A.tickets(spark, sf), A.as_of(), windows(), state)


@query("b17_evaluate_facts", "SELECT agent_id, signal, fired, round(value, 4) AS value FROM facts", ["facts"])
def b17(spark, sf):
    return fact_table(spark, sf).select("agent_id", "signal", "fired", F.round("value", 4).alias("value"))


_STEPS: dict[tuple, StateLog] = {}
_FACTS_SQL = "SELECT agent_id, signal, fired, round(value, 4) AS value FROM facts"


def _state_log(spark, sf, *until: str) -> StateLog:
    """A state that took in the rows before each of the given days in turn; built once per session, like the ledger."""
    at = (spark.sparkContext.applicationId, id(spark), sf, until)
    if at not in _STEPS:
        log = StateLog(spark, work_dir(spark, "evaluation"), windows())
        for day in until:
            log.step(*_rows_for(spark, sf, log.latest()[0]), datetime.fromisoformat(day).replace(tzinfo=UTC))
        _STEPS[at] = log
    return _STEPS[at]


def _rows_for(spark, sf, covered: datetime | None):
    """Events from scans with a pushed filter: what is new since then and the beginnings of its windows."""
    w = windows()
    since = None if covered is None else str((covered - timedelta(hours=w.recent_h, days=w.prior_days)).replace(tzinfo=None))
    return A.task_events(spark, sf, since=since), A.guard_events(spark, sf, since=since)


def _from_log(spark, sf, log: StateLog):
    agents, (covered, state) = kept(calibration(spark, sf), "calibration"), log.latest()
    facts = evaluate(agents, *_rows_for(spark, sf, covered), A.tickets(spark, sf), A.as_of(), log.windows, agents,
                     state=state, since=instant(covered))
    return facts.select("agent_id", "signal", "fired", F.round("value", 4).alias("value"))


@query("b17_incremental", _FACTS_SQL, ["facts"])
def b17_incremental(spark, sf):
    """A stored state of the rows before a day, then the evaluation of all rows after it."""
    return _from_log(spark, sf, _state_log(spark, sf, "2024-01-17"))


@query("b17_daily_step", _FACTS_SQL, ["facts"])
def b17_daily_step(spark, sf):
    """Two stored steps, then the evaluation of the last day."""
    return _from_log(spark, sf, _state_log(spark, sf, "2024-01-29", "2024-01-30"))


@query("c2_jsd_return_flags", f"""
SELECT agent_id, round(jsd, 6) AS jsd, {_JSD_TAIL} FROM (
  SELECT agent_id, CASE WHEN count(p + q) > 0 THEN greatest(0, sum(0.5 * p * log2(p / (0.5 * (p + q))) + 0.5 * q * log2(q / (0.5 * (p + q))))) END AS jsd
  FROM (SELECT agent_id, a / nullif(sum(a) OVER w, 0) + 1e-6 AS p, b / nullif(sum(b) OVER w, 0) + 1e-6 AS q
        FROM (SELECT 'supp-' || CAST(l_suppkey AS VARCHAR) AS agent_id, l_returnflag || l_linestatus AS f,
                     count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS a,
                     count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS b FROM lineitem GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY agent_id)) GROUP BY 1)""")
def c2(spark, sf):
    return stats.jsd(_flags(spark, sf), ["agent_id"], "flag", "a", "b").select("agent_id", r6("jsd"), "band")


def _flags(spark, sf):
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return (A.table(spark, sf, "lineitem")
            .groupBy(F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("agent_id"),
                     F.concat("l_returnflag", "l_linestatus").alias("flag"))
            .agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b")))


@query("c3_mad_z", """
SELECT agent_id, n, median, round(mad, 6) AS mad, round(CASE WHEN mad > 0 THEN 0.6745 * (x - median) / mad END, 6) AS robust_z,
       coalesce(mad > 0 AND abs(0.6745 * (x - median) / mad) > 3, FALSE) AS alarm
FROM (SELECT agent_id, any_value(n) AS n, any_value(m) AS median, median(abs(cost - m)) AS mad, any_value(x) AS x
      FROM costs JOIN (SELECT agent_id, count(*) AS n, round(median(cost), 6) AS m, arg_max(cost, day) AS x
                       FROM costs GROUP BY 1) USING (agent_id) GROUP BY 1)""", ["costs"])
def c3(spark, sf):
    return stats.mad_z(A.supplier_costs(spark, sf), ["agent_id"], "day", "cost").select(
        "agent_id", "n", r6("median"), r6("mad"), r6("robust_z"), "alarm")


@query("c4_cusum", """
SELECT agent_id, CAST(day AS VARCHAR) AS day, round(s - least(0, min(s) OVER w), 6) AS g,
       s - least(0, min(s) OVER w) > 5 AS alarm
FROM (SELECT agent_id, day, sum(cost / 1000 - mu0 - 0.05::DOUBLE) OVER w AS s
      FROM costs JOIN (SELECT agent_id, median(cost) / 1000 AS mu0 FROM costs GROUP BY 1) USING (agent_id)
      WINDOW w AS (PARTITION BY agent_id ORDER BY day ROWS UNBOUNDED PRECEDING))
WINDOW w AS (PARTITION BY agent_id ORDER BY day ROWS UNBOUNDED PRECEDING)""", ["costs"])
def c4(spark, sf):
    """Shift of daily cost, in thousands, against each supplier's median day."""
    costs = A.supplier_costs(spark, sf)
    ref = costs.groupBy("agent_id").agg((F.median("cost") / 1000).alias("mu0"))
    series = costs.join(ref, "agent_id").withColumn("x", F.col("cost") / 1000)
    return stats.cusum(series, ["agent_id"], "day", "x", F.col("mu0")).select(
        "agent_id", F.col("day").cast("string").alias("day"), r6("g"), "alarm")


@query("c5_psi", """
SELECT agent_id, round(psi, 6) AS psi, coalesce(psi > 0.25, FALSE) AS large_shift FROM (
  SELECT agent_id, sum((q - p) * ln(q / p)) AS psi
  FROM (SELECT agent_id, a / nullif(sum(a) OVER w, 0) + 1e-6 AS p, b / nullif(sum(b) OVER w, 0) + 1e-6 AS q
        FROM (SELECT 'supp-' || CAST(l_suppkey AS VARCHAR) AS agent_id, l_returnflag || l_linestatus AS f,
                     count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS a,
                     count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS b FROM lineitem GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY agent_id)) GROUP BY 1)""")
def c5(spark, sf):
    return stats.psi(_flags(spark, sf), ["agent_id"], "flag", "a", "b").select(
        "agent_id", r6("psi"), "large_shift")


@query("c6_normalized_counts", """
SELECT agent_id, tool_name, round(recent / nullif(sum(recent) OVER (PARTITION BY agent_id), 0), 6) AS share
FROM tool_windows""", ["tool_windows"])
def c6(spark, sf):
    w = facts.tool_windows(A.guard_events(spark, sf), 72, 14)
    return stats.normalize_counts(w, ["agent_id"], "recent").select("agent_id", "tool_name", r6("share"))
