"""S: streams over the given event file, run to its end."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import adapters as A
from .. import rules as R
from ..functions.hashing import hmac_pads, hmac_sha256
from ..operators import ledger, tiers
from ..session import kept, work_dir
from ..streaming import detectors, ingest
from ..streaming.runner import to_parquet
from .base import cte, query, r6
from .facts_queries import AS_OF_SQL, ewma_sql
from .ingest_queries import SECRETS, _CONVERTED, otlp_requests


def _tasks(spark, sf):
    return A.task_events(spark, sf, A.event_stream(spark, sf))


def _guards(spark, sf):
    return A.guard_events(spark, sf, A.event_stream(spark, sf))


def _run(stream, spark, name, **options):
    return to_parquet(stream, work_dir(spark, name), work_dir(spark, f"{name}-checkpoint"), **options)


def _in_turn(spark, name, batches, run):
    """Each batch is written in parallel to a folder of its own, and the stream runs over what is new
    before the next one comes: batches keep their order and none passes through one task."""
    path = work_dir(spark, name)
    for i, rows in enumerate(batches):
        rows.write.option("compression", "zstd").parquet(f"{path}/{i:03d}")
        run(f"{path}/*")


@query("s1_signed_ingest", _CONVERTED, ["tasks"])
def s1(spark, sf):
    """Every request delivered twice, some with a wrong key: each good one counts once. A request is made and
    signed once for all its deliveries."""
    pads = hmac_pads(spark, SECRETS)
    r = otlp_requests(spark, sf)
    seconds = F.unix_seconds("received_at").cast("string")
    signed = r.select(F.col("request_id").alias("envelope_id"), F.lit("key-1").alias("key_id"), seconds.alias("ts_text"),
                      F.col("request_id").alias("nonce"), "body", "received_at").join(F.broadcast(pads), "key_id")
    msg = F.concat(F.concat("ts_text", F.lit("."), "nonce").cast("binary"), F.col("body").cast("binary"))
    signed = signed.withColumn("signature", hmac_sha256(F.col("ipad"), F.col("opad"), msg)).drop("ipad", "opad")
    delivery = lambda envelope, key: F.struct(envelope.alias("envelope_id"), key.alias("key_id"))
    good = delivery(F.col("envelope_id"), F.col("key_id"))
    forged = delivery(F.concat("envelope_id", F.lit("-forged")), F.lit("key-2"))
    path = work_dir(spark, "envelopes")
    rest = ["ts_text", "nonce", "signature", "body", "received_at"]
    signed.select(F.explode(F.array(good, good, forged)).alias("d"), *rest).select("d.*", *rest).write.parquet(path)
    events = ingest.signed_events(ingest.envelope_stream(spark, path), pads)
    return _run(events, spark, "signed").select(
        "event_id", "agent_id", "task_id", "session_id", "model_name", "input_tokens", "output_tokens",
        F.col("cost_usd").cast("double").alias("cost_usd"), "latency_ms", "error_class", "status", "ts",
        "retry_count", r6("ttft_s"), "task_template")


def _signed_batches(spark, sf):
    """Three batches: signed requests with forged copies, the same requests signed again under
    new nonces, and a replay of the first batch an hour later (by then too old). A request is made once and
    signed for all envelopes of a batch where it lies."""
    pads = hmac_pads(spark, SECRETS)
    r = kept(otlp_requests(spark, sf).select("request_id", "received_at", "body", F.unix_seconds("received_at").cast("string").alias("ts_text")),
             "requests")

    def batch(*envelopes):
        each = F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(label).alias("label")) for tag, label in envelopes])
        name = F.concat("_e.tag", "request_id")
        e = r.withColumn("_e", F.explode(each)).select(
            name.alias("envelope_id"), F.lit("key-1").alias("key_id"), "_e.label", "ts_text", name.alias("nonce"), "body",
            "received_at").join(F.broadcast(pads), "key_id")
        msg = F.concat(F.concat("ts_text", F.lit("."), "nonce").cast("binary"), F.col("body").cast("binary"))
        return (e.withColumn("signature", hmac_sha256(F.col("ipad"), F.col("opad"), msg)).withColumn("key_id", F.col("label"))
                .select("envelope_id", "key_id", "ts_text", "nonce", "signature", "body", "received_at"))
    folder, checkpoint = work_dir(spark, "signed-log"), work_dir(spark, "signed-log-checkpoint")
    first = ("a-", "key-1")
    batches = (batch(first, ("f-", "key-2")), batch(("b-", "key-1"), first),
               batch(first).withColumn("received_at", F.timestamp_micros(F.unix_micros("received_at") + 3_600_000_000)))
    _in_turn(spark, "resigned", batches, lambda path: ingest.signed_log(ingest.envelope_stream(spark, path, 1_000_000), pads, folder, checkpoint))
    return lambda name: spark.read.parquet(f"{folder}/{name}")


@query("s1_resigned_events", _CONVERTED, ["tasks"])
def s1_resigned(spark, sf):
    return _signed_batches(spark, sf)("events").select(
        "event_id", "agent_id", "task_id", "session_id", "model_name", "input_tokens", "output_tokens",
        F.col("cost_usd").cast("double").alias("cost_usd"), "latency_ms", "error_class", "status", "ts",
        "retry_count", r6("ttft_s"), "task_template")


@query("s1_balance", f"""
SELECT unnest(['landed', 'reject:bad_signature', 'reject:replay', 'reject:timestamp_skew', 'events', 'known events']) AS outcome,
       unnest([2 * r, r, r, r, e, e]) AS n
FROM (SELECT (SELECT count(DISTINCT n // 5) FROM tasks) AS r, (SELECT count(*) FROM ({_CONVERTED})) AS e)""", ["tasks"])
def s1_balance(spark, sf):
    """Input is landed or rejected; each converted span is a new or a known event."""
    t = _signed_batches(spark, sf)
    count = lambda df, c, n=F.lit(1): df.select(c.alias("outcome"), n.cast("bigint").alias("n"))
    rows = (count(t("landed"), F.lit("landed")).unionByName(count(t("rejected"), F.concat(F.lit("reject:"), "reason")))
            .unionByName(count(t("events"), F.lit("events"))).unionByName(count(t("known"), F.lit("known events"), F.col("n"))))
    return rows.groupBy("outcome").agg(F.sum("n").alias("n"))


@query("s1_deduplicated_events", "SELECT event_id, agent_id, ts FROM tasks", ["tasks"])
def s1_dedup(spark, sf):
    t = _tasks(spark, sf)
    return _run(ingest.deduplicated(t.unionByName(t), ["event_id"]).select("event_id", "agent_id", "ts"), spark, "dedup")


@query("s2_sliding_error_rate", """
SELECT agent_id, w AS "from", w + INTERVAL 24 HOUR AS "to", count(*) FILTER (status = 'error') AS hits, count(*) AS total,
       round(count(*) FILTER (status = 'error') / count(*), 6) AS value
FROM (SELECT agent_id, status, ts, unnest(range(date_trunc('hour', ts) - INTERVAL 18 HOUR - to_hours(CAST(hour(ts) % 6 AS INT)),
                                       date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 6 HOUR)) AS w FROM tasks)
WHERE status IN ('ok', 'error') AND w <= ts AND ts < w + INTERVAL 24 HOUR
  AND w + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM tasks) GROUP BY 1, 2""", ["tasks"])
def s2(spark, sf):
    return _run(detectors.sliding_error_rate(_tasks(spark, sf), "24 hours", "6 hours"), spark, "ratio") \
        .withColumn("value", F.round("value", 6))


_TASK_ROWS = "event_id string, agent_id string, status string, cost_usd double, ts timestamp"
_LATE = "(n % 10 = 0 AND ts < (SELECT max(ts) - INTERVAL 10 MINUTE FROM tasks WHERE n % 10 <> 0))"
cte("on_time", ["tasks"], f"  SELECT * FROM tasks WHERE NOT {_LATE}")


def _with_late_rows(spark, sf):
    """Three batches in time order, but every tenth event comes only after all others."""
    main, late, checkpoint = (work_dir(spark, f"delayed-{n}") for n in ("on-time", "late", "checkpoint"))
    t = A.task_events(spark, sf).select("event_id", "agent_id", "status", F.col("cost_usd").cast("double").alias("cost_usd"), "ts")
    held, middle = F.substring("event_id", 5, 12).cast("bigint") % 10 == 0, A.as_of("2024-01-15 00:00:00")
    batches = (t.where(~held & (F.col("ts") < middle)), t.where(~held & (F.col("ts") >= middle)), t.where(held))
    _in_turn(spark, "delayed", batches, lambda path: ingest.split_late(
        spark.readStream.schema(_TASK_ROWS).parquet(path), _TASK_ROWS, main, late, checkpoint))
    return ingest.landed_stream(spark, main, _TASK_ROWS), spark.read.schema(_TASK_ROWS).parquet(late)


@query("s2_on_time_daily", """
SELECT agent_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS "from", count(*) FILTER (status = 'error') AS hits, count(*) AS total
FROM on_time WHERE status IN ('ok', 'error')
  AND CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM on_time) GROUP BY 1, 2""", ["on_time"])
def s2_on_time(spark, sf):
    """The error share of closed days over what was in time; s2_late_rows has the others."""
    rows, _ = _with_late_rows(spark, sf)
    return _run(detectors.sliding_error_rate(rows, "1 day", "1 day"), spark, "daily").select("agent_id", "from", "hits", "total")


@query("s2_late_rows", f"SELECT event_id FROM tasks WHERE {_LATE}", ["tasks"])
def s2_late(spark, sf):
    return _with_late_rows(spark, sf)[1].select("event_id")


@query("s3_on_time_costs", """
SELECT agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(CAST(cost_usd AS DOUBLE)), 6) AS cost FROM on_time
WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM on_time) GROUP BY 1, 2""", ["on_time"])
def s3_on_time(spark, sf):
    rows, _ = _with_late_rows(spark, sf)
    return _run(detectors.daily_costs(rows), spark, "daily-costs").select("agent_id", F.to_date("day").cast("string").alias("day"), r6("cost"))


cte("closed_days", ["daily"], """
  SELECT * FROM daily WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM tasks)""")
_CARD = ewma_sql("closed_days", "live")
_ARM = "(i >= 10 AND s2 > 0 AND day >= first_day + 14)"


@query("s3_cost_card", f"""
SELECT agent_id, CAST(day AS VARCHAR) AS day, i AS n, CASE WHEN {_ARM} THEN round((cost - mu) / sqrt(s2), 4) END AS z, {_ARM} AS armed,
       {_ARM} AND (cost - mu) / sqrt(s2) > 2.5 AND mu > 0 AND cost > 2 * mu AS fired
FROM {_CARD} JOIN (SELECT agent_id, min(day) AS first_day FROM closed_days GROUP BY 1) USING (agent_id)""", [_CARD])
def s3(spark, sf):
    return _run(detectors.cost_card(_tasks(spark, sf), 10), spark, "card").select(
        "agent_id", F.to_date("day").cast("string").alias("day"), "n",
        F.when(F.col("armed"), F.round("z", 4)).alias("z"), "armed", "fired")


@query("s4_loop_openings", "SELECT * FROM loop_openings", ["loop_openings"])
def s4(spark, sf):
    return _run(detectors.loop_openings(_runs(spark, sf)), spark, "loops", idle_batches=False)


def _runs(spark, sf):
    path = work_dir(spark, "call-runs")
    detectors.land_runs(_guards(spark, sf), path, work_dir(spark, "call-runs-checkpoint"))
    return detectors.run_stream(spark, path)


@query("s4_call_runs", """
SELECT task_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) // 60 AS minute, count(*) AS n FROM guards
WHERE event_type = 'tool_call' GROUP BY 1, 2""", ["guards"])
def s4_runs(spark, sf):
    """What reaches the state of the loop breaker: one row per task and minute stands for all its calls."""
    path = work_dir(spark, "call-runs")
    detectors.land_runs(_guards(spark, sf), path, work_dir(spark, "call-runs-checkpoint"))
    return spark.read.parquet(path).select("task_id", "minute", "n")


@query("s5_new_class_log", "SELECT * FROM new_classes", ["new_classes"])
def s5(spark, sf):
    path = work_dir(spark, "classes")
    detectors.new_class_log(_tasks(spark, sf), path, work_dir(spark, "classes-checkpoint"))
    return spark.read.parquet(path).drop("batch_id")


cte("stream_alarms", ["tasks"], """
  SELECT 'alm_' || substr(sha256(agent_id || '|latency.retry>=3|' || strftime(ts, '%Y%m%d%H')), 1, 16) AS alarm_id, agent_id
  FROM tasks WHERE retry_count >= 3 GROUP BY agent_id, strftime(ts, '%Y%m%d%H')""")


def _alarm_log(spark, sf):
    t = _tasks(spark, sf).where(F.col("retry_count") >= R.RETRY_LIMIT)
    fired = t.select("agent_id", F.lit("latency.retry>=3").alias("signal"),
                     F.col("retry_count").cast("double").alias("value"), "ts")
    root = work_dir(spark, "alarm-log")
    detectors.alarm_log(fired, R.signal_rules(spark), root, work_dir(spark, "alarms-checkpoint"))
    return detectors.alarm_tables(spark, root)


@query("s6_closed_windows", """
SELECT agent_id, min(ts) + INTERVAL 14 DAY AS calibration_until FROM tasks GROUP BY 1
HAVING min(ts) + INTERVAL 14 DAY < (SELECT max(ts) - INTERVAL 10 MINUTE FROM tasks)""", ["tasks"])
def s6(spark, sf):
    """Three batches in time order; timers end windows in the second and third."""
    out, checkpoint = work_dir(spark, "calibrations"), work_dir(spark, "calibrations-checkpoint")
    t = A.task_events(spark, sf).select("agent_id", "ts")
    cuts = [A.as_of(f"2024-01-{d} 00:00:00") for d in ("12", "20")]
    batches = (t.where(F.col("ts") < cuts[0]), t.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), t.where(F.col("ts") >= cuts[1]))
    _in_turn(spark, "calibrating", batches, lambda path: to_parquet(
        detectors.calibration_ends(spark.readStream.schema(t.schema).parquet(path), 14), out, checkpoint))
    return spark.read.parquet(out)


@query("s6_known_windows", """
SELECT agent_id, min(ts) + INTERVAL 14 DAY AS calibration_until FROM tasks GROUP BY 1
HAVING min(ts) + INTERVAL 14 DAY < (SELECT max(ts) - INTERVAL 10 MINUTE FROM tasks)""", ["tasks"])
def s6_known(spark, sf):
    """The windows come from a batch evaluation as initial state; the stream sees the second half of
    the month, in which an agent may be silent until its window ends."""
    t = A.task_events(spark, sf).select("agent_id", "ts")
    known = t.groupBy("agent_id").agg((F.min("ts") + F.make_dt_interval(days=F.lit(14))).alias("calibration_until"))
    path = work_dir(spark, "second-half")
    t.where(F.col("ts") >= A.as_of("2024-01-15 00:00:00")).write.parquet(path)
    return _run(detectors.calibration_ends(spark.readStream.schema(t.schema).parquet(path), 14, known), spark, "known-windows")


@query("s7_alarm_log", """
SELECT alarm_id, agent_id, 'latency.retry>=3' AS signal, TRUE AS in_ledger FROM stream_alarms""", ["stream_alarms"])
def s7(spark, sf):
    alarms, chain = _alarm_log(spark, sf)
    held = chain.select(F.col("source_id").alias("alarm_id"), F.lit(True).alias("in_ledger"))
    return alarms.join(held, "alarm_id", "left").select("alarm_id", "agent_id", "signal", "in_ledger")


@query("s7_chain", """
SELECT count(*) AS entries, count(*) AS checked, TRUE AS ok,
       CAST(sum(CAST(('0x' || substr(alarm_id, 5, 8)) AS BIGINT)) AS BIGINT) AS ids FROM (SELECT DISTINCT alarm_id FROM stream_alarms)""", ["stream_alarms"])
def s7_chain(spark, sf):
    """Facts in three batches, the oldest last and some repeated: each alarm once, one chain."""
    t = A.task_events(spark, sf).where(F.col("retry_count") >= R.RETRY_LIMIT).select(
        "agent_id", F.lit("latency.retry>=3").alias("signal"), F.col("retry_count").cast("double").alias("value"), "ts")
    middle = A.as_of("2024-01-15 00:00:00")
    root, checkpoint = work_dir(spark, "fact-log"), work_dir(spark, "facts-checkpoint")
    _in_turn(spark, "facts", (t.where(F.col("ts") >= middle), t.where(F.col("ts") < middle), t), lambda path: detectors.alarm_log(
        spark.readStream.schema(t.schema).parquet(path), R.signal_rules(spark), root, checkpoint))
    alarms, chain = detectors.alarm_tables(spark, root)
    ids = alarms.agg(F.sum(F.conv(F.substring("alarm_id", 5, 8), 16, 10).cast("bigint")).alias("ids"), F.count(F.lit(1)).alias("entries"))
    verdict = ledger.verify_chain(chain)
    return ids.select("entries", verdict.select("checked").scalar().alias("checked"), verdict.select("ok").scalar().alias("ok"), "ids")


@query("s8_ticket_escalation", f"""
SELECT 'alm_' || substr(sha256(agent_id || '|escalation.age_max>24|2024013100'), 1, 16) AS alarm_id, agent_id, 'Emergency' AS severity
FROM tickets WHERE status = 'open' GROUP BY agent_id
HAVING min(created_at) < {AS_OF_SQL} - INTERVAL 24 HOUR""", ["tickets"])
def s8(spark, sf):
    return detectors.escalate_aged_tickets(A.tickets(spark, sf), R.signal_rules(spark), A.as_of()) \
        .select("alarm_id", "agent_id", "severity")


@query("s9_hot_tier_copy", "SELECT event_id, agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM tasks", ["tasks"])
def s9(spark, sf):
    copy = ingest.copy_to_hot_tier(_tasks(spark, sf), work_dir(spark, "hot"), work_dir(spark, "hot-checkpoint"))
    return copy.select("event_id", "agent_id", F.col("event_date").cast("string").alias("event_date"))


@query("s9_hot_tier_log", """
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 'warm' ELSE 'hot' END AS tier FROM tasks""", ["tasks"])
def s9_log(spark, sf):
    """The stream copy as commits, after which old days move to the warm table."""
    rows = _tasks(spark, sf).select("event_id", "agent_id", "ts")
    log = ingest.copy_to_hot_log(rows, work_dir(spark, "hot-log"), work_dir(spark, "hot-log-checkpoint"))
    tiers.to_warm(log, date(2024, 1, 12))
    tier = lambda name: log.read(name, "event_id string, event_date date").select(
        "event_id", F.col("event_date").cast("string").alias("event_date"), F.lit(name).alias("tier"))
    return tier("hot").unionByName(tier("warm"))


@query("s10_late_events", """
SELECT event_id, ts < TIMESTAMP '2024-01-15'
       AND ts < (SELECT max(ts) - INTERVAL 10 MINUTE FROM tasks) AS late FROM tasks""", ["tasks"])
def s10(spark, sf):
    """The second half of the month arrives first, then the first half."""
    t = A.task_events(spark, sf).select("event_id", "agent_id", "ts")
    old = F.col("ts") < A.as_of("2024-01-15 00:00:00")
    ddl = "event_id string, agent_id string, ts timestamp"
    main, late, checkpoint = work_dir(spark, "on-time"), work_dir(spark, "late"), work_dir(spark, "late-checkpoint")
    _in_turn(spark, "out-of-order", (t.where(~old), t.where(old)), lambda path: ingest.split_late(
        spark.readStream.schema(ddl).parquet(path), ddl, main, late, checkpoint))
    flag = lambda p, v: spark.read.schema(ddl).parquet(p).select("event_id", F.lit(v).alias("late"))
    return flag(main, False).unionByName(flag(late, True))
