"""A: sources and ingest. Requests, envelopes and records are derived from ``events``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.hashing import hmac_pads, hmac_sha256
from ..functions.timeparse import ns_to_ts, parse_ts
from ..operators import ingest, tiers
from ..operators.commits import TableLog
from ..session import work_dir
from ..sources import observations, otlp, registry, signed
from .base import cte, query, r6
from .facts_queries import AS_OF_SQL, registrations

_n = lambda c="event_id": F.substring(c, 5, 12).cast("bigint")


def otlp_requests(spark, sf):
    """Five events per request. Every fourth request has a single object in place of its
    lists, every ninth is cut off and every fourteenth lacks the spans."""
    # dealt out by request before its text is made, which is many times longer
    t = A.task_events(spark, sf).withColumn("n", _n()).withColumn("r", F.call_function("div", F.col("n"), F.lit(5))).repartition("r")
    k = F.call_function("div", F.col("input_tokens") - 100, F.lit(10))
    text = lambda key, v: F.struct(F.lit(key).alias("key"), F.struct(
        v.cast("string").alias("stringValue"), F.lit(None).cast("string").alias("intValue"),
        F.lit(None).cast("double").alias("doubleValue")).alias("value"))
    whole = lambda key, v: F.struct(F.lit(key).alias("key"), F.struct(
        F.lit(None).cast("string").alias("stringValue"), v.cast("string").alias("intValue"),
        F.lit(None).cast("double").alias("doubleValue")).alias("value"))
    real = lambda key, v: F.struct(F.lit(key).alias("key"), F.struct(
        F.lit(None).cast("string").alias("stringValue"), F.lit(None).cast("string").alias("intValue"),
        v.cast("double").alias("doubleValue")).alias("value"))
    attrs = F.filter(F.array(
        F.when(k % 10 != 0, text("gen_ai.operation.name", F.lit("chat"))),
        text("swx.agent.id", F.lit("overwritten")),
        text("swx.agent.id", F.when(k % 10 == 1, "").otherwise(F.col("agent_id"))),
        text("swx.task.id", F.col("task_id")), text("gen_ai.request.model", F.col("model_name")),
        whole("gen_ai.usage.input_tokens", F.col("input_tokens")),
        whole("gen_ai.usage.output_tokens", F.col("output_tokens")),
        real("swx.cost.usd", F.col("cost_usd")), whole("swx.retry.count", F.col("retry_count")),
        real("swx.ttft.s", F.col("ttft_s")),
        F.when(F.col("error_class").isNotNull(), text("error.type", F.col("error_class"))),
        F.when(F.col("task_template").isNotNull(), text("swx.task.template", F.col("task_template")))),
        lambda a: a.isNotNull())
    start = (F.unix_micros("ts") * 1000).cast("string")
    end = ((F.unix_micros("ts") + F.col("latency_ms") * 1000) * 1000).cast("string")
    old = F.col("n") % 2 == 0
    span = F.struct(
        F.col("session_id").alias("traceId"), F.col("event_id").alias("spanId"),
        F.when(k % 20 == 0, "gen_ai.chat").otherwise("http").alias("name"),
        F.when(old, start).alias("timeUnixNano"), F.when(old, end).alias("timeEndedUnixNano"),
        F.when(~old, start).alias("startTimeUnixNano"), F.when(~old, end).alias("endTimeUnixNano"),
        attrs.alias("attributes"),
        F.struct(F.when(F.col("status") == "error", 2).otherwise(0).alias("code")).alias("status"))
    g = (t.groupBy("r").agg(F.to_json(F.sort_array(F.collect_list(span))).alias("spans"),
                            F.max("ts").alias("received_at")))
    scope = F.concat(F.lit('{"spans":'), F.col("spans"), F.lit("}"))
    res = F.concat(F.lit('{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-'),
                   (F.col("r") % 3).cast("string"), F.lit('"}}]},"scopeSpans":'),
                   F.when(F.col("r") % 4 == 0, scope).otherwise(F.concat(F.lit("["), scope, F.lit("]"))), F.lit("}"))
    body = F.concat(F.lit('{"resourceSpans":'),
                    F.when(F.col("r") % 4 == 0, res).otherwise(F.concat(F.lit("["), res, F.lit("]"))), F.lit("}"))
    return g.select(F.concat(F.lit("req-"), F.col("r").cast("string")).alias("request_id"), "received_at",
                    F.when(F.col("r") % 9 == 4, F.substring(body, 1, 300))
                    .when(F.col("r") % 14 == 5, '{"other": 1}').otherwise(body).alias("body"))


GOOD = "(n // 5) % 9 <> 4 AND (n // 5) % 14 <> 5"


@query("a1_flatten_traces", f"""
SELECT 'req-' || CAST(n // 5 AS VARCHAR) AS request_id, session_id AS trace_id, event_id AS span_id,
       CASE WHEN k % 20 = 0 THEN 'gen_ai.chat' ELSE 'http' END AS name FROM tasks WHERE {GOOD}""", ["tasks"])
def a1(spark, sf):
    return otlp.flatten(otlp_requests(spark, sf)).select(
        "request_id", F.col("traceId").alias("trace_id"), F.col("spanId").alias("span_id"), "name")


@query("a2_attribute_map", f"""
SELECT event_id AS span_id, CASE WHEN k % 10 = 1 THEN '' ELSE agent_id END AS agent, model_name AS model,
       CAST(input_tokens AS VARCHAR) AS tokens,
       CAST(9 + CASE WHEN k % 10 <> 0 THEN 1 ELSE 0 END + CASE WHEN error_class IS NOT NULL THEN 1 ELSE 0 END
            + CASE WHEN task_template IS NOT NULL THEN 1 ELSE 0 END - 1 AS BIGINT) AS keys
FROM tasks WHERE {GOOD}""", ["tasks"])
def a2(spark, sf):
    m = F.col("m")
    return (otlp.flatten(otlp_requests(spark, sf))
            .select(F.col("spanId").alias("span_id"), otlp.attribute_map(F.col("attributes")).alias("m"))
            .select("span_id", m["swx.agent.id"].alias("agent"), m["gen_ai.request.model"].alias("model"),
                    m["gen_ai.usage.input_tokens"].alias("tokens"), F.size("m").cast("bigint").alias("keys")))


def converted(spark, sf):
    return otlp.to_task_events(otlp.flatten(otlp_requests(spark, sf)))


_CONVERTED = f"""
SELECT 'otlp-' || session_id || '-' || event_id AS event_id,
       CASE WHEN k % 10 = 1 THEN 'svc-' || CAST(n // 5 % 3 AS VARCHAR) ELSE agent_id END AS agent_id, task_id, session_id,
       model_name, input_tokens, output_tokens, CAST(cost_usd AS DOUBLE) AS cost_usd, latency_ms, error_class,
       CASE WHEN status = 'error' THEN 'error' ELSE 'ok' END AS status, ts, CAST(retry_count AS INT) AS retry_count,
       round(ttft_s, 6) AS ttft_s, task_template
FROM tasks WHERE {GOOD} AND (k % 10 <> 0 OR k % 20 = 0)"""


@query("a3_span_events", _CONVERTED, ["tasks"])
def a3(spark, sf):
    return converted(spark, sf).select(
        "event_id", "agent_id", "task_id", "session_id", "model_name", "input_tokens", "output_tokens",
        F.col("cost_usd").cast("double").alias("cost_usd"), "latency_ms", "error_class", "status", "ts",
        "retry_count", r6("ttft_s"), "task_template")


@query("a4_span_clock", f"""
SELECT event_id, CASE WHEN k % 7 = 0 THEN {AS_OF_SQL} ELSE ts END AS ts FROM tasks""", ["tasks"])
def a4(spark, sf):
    t = A.task_events(spark, sf)
    k = F.call_function("div", F.col("input_tokens") - 100, F.lit(10))
    ns = F.when(k % 7 == 0, F.lit("0")).otherwise((F.unix_micros("ts") * 1000 + 999).cast("string"))
    return t.select("event_id", ns_to_ts(ns, A.as_of()).alias("ts"))


@query("a5_parsed_timestamps", """
SELECT event_id, CASE k % 6 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN date_trunc('day', ts)
       WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN ts - INTERVAL 3 HOUR END AS ts FROM tasks""", ["tasks"])
def a5(spark, sf):
    t = A.task_events(spark, sf)
    k = F.call_function("div", F.col("input_tokens") - 100, F.lit(10)) % 6
    fmt = lambda p: F.date_format("ts", p)
    text = (F.when(k == 0, fmt("yyyy-MM-dd HH:mm:ss.SSSSSS"))
            .when(k == 1, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
            .when(k == 2, fmt("yyyyMMdd")).when(k == 3, fmt("yyyyMMdd'T'HHmmss"))
            .when(k == 4, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+03:00"))).otherwise("soon"))
    return t.select("event_id", parse_ts(text).alias("ts"))


SECRETS = {"key-0": b"alpha", "key-1": b"beta" * 30, "key-2": b"gamma"}


def envelopes(spark, sf):
    """A signed envelope per event and, for some, a second delivery of the same one."""
    pads = hmac_pads(spark, {**SECRETS, "key-3": b"not configured"})
    t = A.task_events(spark, sf).withColumn("n", _n())
    k = F.call_function("div", F.col("input_tokens") - 100, F.lit(10))
    at = F.unix_seconds("ts") - F.when(k % 11 == 2, 301).otherwise(k % 11)
    e = t.select(
        F.col("event_id").alias("envelope_id"), F.concat(F.lit("key-"), (F.col("n") % 4).cast("string")).alias("key_id"),
        F.when(k % 11 == 1, "soon").otherwise(at.cast("string")).alias("ts_text"),
        F.when(k % 11 == 3, "").otherwise(F.concat(F.lit("n"), F.col("n").cast("string"))).alias("nonce"),
        F.col("end_state_json").alias("body"), F.col("ts").alias("received_at"), k.alias("k"), "n")
    msg = F.concat(F.concat("ts_text", F.lit("."), "nonce").cast("binary"), F.col("body").cast("binary"))
    e = e.join(F.broadcast(pads), "key_id").withColumn("signature", hmac_sha256(F.col("ipad"), F.col("opad"), msg))
    e = e.withColumn("signature", F.when(F.col("k") % 11 == 4, F.upper("signature")).otherwise(F.col("signature"))) \
        .drop("ipad", "opad")
    again = e.where(F.col("n") % 5 == 0).withColumn("envelope_id", F.concat("envelope_id", F.lit("-again"))) \
        .withColumn("received_at", F.timestamp_micros(F.unix_micros("received_at") + 1_000_000))
    return e.unionByName(again).drop("n", "k")


cte("envelope_checks", ["tasks"], """
  SELECT envelope_id, CASE WHEN n % 4 = 3 THEN 'unknown_key' WHEN k % 11 = 1 THEN 'bad_timestamp'
         WHEN k % 11 = 2 THEN 'timestamp_skew' WHEN k % 11 = 3 THEN 'missing_nonce' WHEN k % 11 = 4 THEN 'bad_signature'
         WHEN again THEN 'replay' ELSE '' END AS reason
  FROM (SELECT event_id AS envelope_id, n, k, FALSE AS again FROM tasks
        UNION ALL SELECT event_id || '-again', n, k, TRUE FROM tasks WHERE n % 5 = 0)""")


def verified(spark, sf):
    return signed.verify(envelopes(spark, sf), hmac_pads(spark, SECRETS))


@query("a6_signed_batches", "SELECT envelope_id, reason FROM envelope_checks", ["envelope_checks"])
def a6(spark, sf):
    return verified(spark, sf).select("envelope_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query("a6_redelivered", """
SELECT envelope_id, reason FROM envelope_checks UNION ALL
SELECT envelope_id, CASE WHEN reason = '' THEN 'replay' ELSE reason END FROM envelope_checks""", ["envelope_checks"])
def a6_redelivered(spark, sf):
    """Every delivery arrives twice under the same id, as at-least-once transport does."""
    e = envelopes(spark, sf)
    return signed.verify(e.unionByName(e), hmac_pads(spark, SECRETS)) \
        .select("envelope_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query("a8_nested", """
SELECT event_id AS request_id, (['unread scopeSpans', '', 'unread spans', '', 'unread attributes'])[CAST(n % 5 + 1 AS INT)] AS reason,
       CAST(([1, 1, 0, 2, 1])[CAST(n % 5 + 1 AS INT)] AS BIGINT) AS spans FROM tasks""", ["tasks"])
def a8_nested(spark, sf):
    """Requests with a part that cannot be read, and with one object in place of a span list. The ids are dealt
    out before the requests are made, since a file of few row groups would be parsed by as few tasks."""
    t = A.task_events(spark, sf).select("event_id", "ts").repartition("event_id").withColumn("n", _n())
    span = F.concat(F.lit('{"traceId":"t","spanId":"'), F.col("event_id"), F.lit('","name":"x"}'))
    scope = lambda spans: F.concat(F.lit('{"scopeSpans":[{"spans":'), spans, F.lit("}]}"))
    listed = lambda *parts: F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    odd = F.concat(F.lit('{"spanId":"'), F.col("event_id"), F.lit('","attributes":"none"}'))
    resources = (F.when(F.col("n") % 5 == 0, listed(scope(listed(span)), F.lit('{"scopeSpans":7}')))
                 .when(F.col("n") % 5 == 1, listed(scope(span)))
                 .when(F.col("n") % 5 == 2, listed(scope(F.lit('"oops"'))))
                 .when(F.col("n") % 5 == 3, listed(scope(listed(span, span)))).otherwise(listed(scope(listed(odd)))))
    r = t.select(F.col("event_id").alias("request_id"), F.col("ts").alias("received_at"),
                 F.concat(F.lit('{"resourceSpans":'), resources, F.lit("}")).alias("body"))
    spans = otlp.flatten(r).groupBy("request_id").agg(F.count(F.lit(1)).alias("spans"))
    return (r.select("request_id").join(otlp.malformed(r).select("request_id", "reason"), "request_id", "left")
            .join(spans, "request_id", "left")
            .select("request_id", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("spans", F.lit(0)).alias("spans")))


@query("a7_reject_accounting", """
SELECT CASE WHEN reason = '' THEN 'accepted' ELSE 'reject:' || reason END AS outcome, count(*) AS n FROM envelope_checks GROUP BY 1""",
       ["envelope_checks"])
def a7(spark, sf):
    return signed.accounting(verified(spark, sf))


@query("a8_malformed_requests", """
SELECT DISTINCT 'req-' || CAST(n // 5 AS VARCHAR) AS request_id,
       CASE WHEN (n // 5) % 9 = 4 THEN 'bad json' ELSE 'no resourceSpans' END AS reason
FROM tasks WHERE (n // 5) % 9 = 4 OR (n // 5) % 14 = 5""", ["tasks"])
def a8(spark, sf):
    return otlp.malformed(otlp_requests(spark, sf)).select("request_id", "reason")


@query("a9_tenant_stamp", f"""
SELECT 'otlp-' || session_id || '-' || event_id AS event_id, 'alpha' AS tenant_id FROM tasks
WHERE {GOOD} AND (k % 10 <> 0 OR k % 20 = 0)""", ["tasks"])
def a9(spark, sf):
    return ingest.stamp_tenant(converted(spark, sf), "alpha").select("event_id", "tenant_id")


@query("a10_tenant_for_email", """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'default' ELSE coalesce('tenant-' || n_name, 'default') END AS tenant_id
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""")
def a10(spark, sf):
    c = A.table(spark, sf, "customer")
    host = F.concat(F.lit("Mail.Nation"), F.col("c_nationkey").cast("string"), F.lit(".example"))
    people = c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "nobody")
                      .otherwise(F.concat(F.lit("a@b@"), host)).alias("email"))
    tenants = A.table(spark, sf, "nation").where(F.col("n_nationkey") < 20).select(
        F.concat(F.lit("tenant-"), F.col("n_name")).alias("tenant_id"), F.col("n_name").alias("display_name"),
        F.concat(F.lit("mail.nation"), F.col("n_nationkey").cast("string"), F.lit(".example")).alias("sso_domain"))
    return ingest.tenant_for_email(people, tenants).select("c_custkey", "tenant_id")


def _observations(spark, sf):
    """Records as JSON text parsed with the declared schema."""
    t = A.task_events(spark, sf).withColumn("n", _n()).withColumn(
        "k", F.call_function("div", F.col("input_tokens") - 100, F.lit(10)))
    k = F.col("k")
    iso = lambda us: F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    us = F.unix_micros("ts")
    rec = F.struct(
        F.concat(F.lit("obs-"), F.col("n").cast("string")).alias("id"),
        F.when(k % 6 != 0, F.concat(F.lit("tr-"), F.call_function("div", F.col("n"), F.lit(3)).cast("string"))).alias("traceId"),
        F.when(k % 4 == 0, "SPAN").otherwise("GENERATION").alias("type"),
        F.when(k % 9 != 0, F.col("agent_id")).alias("name"), F.when(k % 5 != 0, F.col("model_name")).alias("model"),
        F.when(k % 2 == 0, F.lit("vendor")).alias("providedModelName"), iso(us).alias("startTime"),
        F.when(k % 13 == 0, iso(us - 5_000_000)).when(k % 7 != 0, iso(us + k * 1000)).alias("endTime"),
        F.when(F.col("status") != "ok", "ERROR").otherwise("DEFAULT").alias("level"),
        F.when(k % 3 == 0, F.col("error_class")).alias("statusMessage"),
        F.concat(F.lit("env-"), (k % 3).cast("string")).alias("env"),
        F.when(k % 3 != 0, F.col("cost_usd").cast("double")).alias("cost"),
        F.struct(F.col("input_tokens").alias("input"), F.when(k % 8 != 0, F.col("output_tokens")).alias("output"),
                 F.when(k % 2 == 0, F.lit(0.5)).alias("totalCost")).alias("usage"))
    from ..schemas import OBSERVATION
    return t.select(F.from_json(F.to_json(rec), OBSERVATION).alias("o")).select("o.*")


@query("a11_observations", """
SELECT 'otlp-' || trace || '-' || substr(sha256(id), 1, 16) AS event_id, CASE WHEN k % 9 <> 0 THEN agent_id ELSE 'langfuse-gen' END AS agent_id,
       coalesce(tr, 'None') || ':' || id AS task_id,
       CASE WHEN k % 5 <> 0 THEN model_name WHEN k % 2 = 0 THEN 'vendor' ELSE 'unknown' END AS model_name, input_tokens,
       CASE WHEN k % 8 <> 0 THEN output_tokens ELSE 0 END AS output_tokens,
       CAST(CASE WHEN k % 3 <> 0 THEN cost_usd WHEN k % 2 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS cost_usd,
       CASE WHEN k % 13 = 0 OR k % 7 = 0 THEN 0 ELSE k END AS latency_ms,
       CASE WHEN status <> 'ok' THEN CASE WHEN k % 3 = 0 THEN split_part(error_class, ' ', 1) ELSE 'ERROR' END END AS error_class,
       CASE WHEN status <> 'ok' THEN 'error' ELSE 'ok' END AS status, ts, 'env-' || CAST(k % 3 AS VARCHAR) AS tenant_id
FROM (SELECT *, substr(sha256(coalesce(tr, id)), 1, 32) AS trace FROM (
  SELECT *, 'obs-' || CAST(n AS VARCHAR) AS id, CASE WHEN k % 6 <> 0 THEN 'tr-' || CAST(n // 3 AS VARCHAR) END AS tr FROM tasks))
WHERE k % 4 <> 0""", ["tasks"])
def a11(spark, sf):
    return observations.to_task_events(_observations(spark, sf)).select(
        "event_id", "agent_id", "task_id", "model_name", "input_tokens", "output_tokens",
        F.col("cost_usd").cast("double").alias("cost_usd"), "latency_ms", "error_class", "status", "ts", "tenant_id")


@query("a12_new_events", """
SELECT event_id, agent_id, latency_ms FROM tasks WHERE ts >= TIMESTAMP '2024-01-15'""", ["tasks"])
def a12(spark, sf):
    """The whole feed arrives again with altered duplicates; half of it is stored already."""
    t = A.task_events(spark, sf).select("event_id", "agent_id", "latency_ms", "ts", F.lit(1).alias("attempt"))
    resent = t.withColumn("latency_ms", F.col("latency_ms") + 1).withColumn("attempt", F.lit(2))
    stored = t.where(F.col("ts") < A.as_of("2024-01-15 00:00:00"))
    return ingest.new_events(t.unionByName(resent), stored, ["attempt"]).select("event_id", "agent_id", "latency_ms")


@query("a13_registered_agents", "SELECT agent_id, first_seen, synthetic, 'worker' AS role FROM registrations", ["registrations"])
def a13(spark, sf):
    return registrations(spark, sf)


@query("a15_rows_since", """
SELECT event_id, ts FROM tasks WHERE ts > TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 200""", ["tasks"])
def a15(spark, sf):
    return ingest.rows_since(A.task_events(spark, sf), A.as_of("2024-01-10 00:00:00"), 200).select("event_id", "ts")


@query("a16_copy_increment", """
SELECT event_id, ts FROM tasks WHERE ts > (SELECT max(ts) FROM tasks WHERE ts < TIMESTAMP '2024-01-20')""", ["tasks"])
def a16(spark, sf):
    t = A.task_events(spark, sf)
    return ingest.copy_increment(t, t.where(F.col("ts") < A.as_of("2024-01-20 00:00:00"))).select("event_id", "ts")


@query("a17_latest_copy", """
SELECT event_id, agent_id, latency_ms + CASE WHEN n % 3 = 0 THEN 7 ELSE 0 END AS latency_ms FROM tasks""", ["tasks"])
def a17(spark, sf):
    t = A.task_events(spark, sf).select("event_id", "agent_id", "ts", "latency_ms", F.lit(1).alias("ingested_at"))
    newer = t.where(_n() % 3 == 0).withColumn("latency_ms", F.col("latency_ms") + 7).withColumn("ingested_at", F.lit(2))
    return ingest.latest_copy(t.unionByName(newer)).select("event_id", "agent_id", "latency_ms")


def _late_batches(spark, sf):
    """The second half of the month, then the first half with a part of the second once more."""
    t = A.task_events(spark, sf).select("event_id", "agent_id", "ts")
    old = F.col("ts") < A.as_of("2024-01-15 00:00:00")
    return t.where(~old), t.where(old | (F.dayofmonth("ts") == 20))


@query("a12_landed_new", "SELECT event_id, agent_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM tasks", ["tasks"])
def a12_landed(spark, sf):
    """Two batches that share a day, with a move to the warm table in between: each event once."""
    log = TableLog(spark, work_dir(spark, "landed"))
    for rows in _late_batches(spark, sf):
        tiers.land_new(log, rows)
        tiers.to_warm(log, date(2024, 1, 25))
    one = lambda name: log.read(name, "event_id string, agent_id string, event_date date")
    return one("hot").unionByName(one("warm")).select("event_id", "agent_id", F.col("event_date").cast("string").alias("event_date"))


@query("a16_copied_folders", """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 2 ELSE 1 END AS run FROM tasks""", ["tasks"])
def a16_copied(spark, sf):
    """Rows below the newest copied time are copied by the run after they came, and once."""
    source, target = TableLog(spark, work_dir(spark, "copy-source")), TableLog(spark, work_dir(spark, "copy-target"))
    t = A.task_events(spark, sf).select("event_id", "agent_id", "ts")
    old, out = F.col("ts") < A.as_of("2024-01-15 00:00:00"), None
    for run, rows in enumerate((t.where(~old), t.where(old)), 1):
        tiers.land(source, rows)
        before = target.snapshot().of("hot")
        tiers.copy_new(source, target)
        tiers.copy_new(source, target)  # nothing new
        got = target.read("hot", "event_id string", [f for f in target.snapshot().of("hot") if f not in before])
        got = got.select("event_id", F.lit(run).alias("run"))
        out = got if out is None else out.unionByName(got)
    return out


@query("a18_hot_rows", f"SELECT event_id, ts FROM tasks WHERE ts >= {AS_OF_SQL} - INTERVAL 10 DAY", ["tasks"])
def a18(spark, sf):
    return ingest.hot_rows(A.task_events(spark, sf), A.as_of(), 10).select("event_id", "ts")


@query("a18_dropped_days", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM tasks WHERE ts >= TIMESTAMP '2024-01-21' GROUP BY 1""", ["tasks"])
def a18_dropped(spark, sf):
    """What a table by day still holds after its expired days were dropped."""
    path = work_dir(spark, "retention")
    ingest.write_by_day(A.task_events(spark, sf).select("event_id", "agent_id", "ts"), path)
    tiers.drop_days(spark, path, date(2024, 1, 21))
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _attribute_rows(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    e = A.table(spark, sf, "events").select("event_id", k.alias("k"), "value", "event_type")
    ks = F.col("k").cast("string")
    return e.select("event_id", F.concat(
        F.lit('{"gen_ai.request.model": "m", "service.name": "s", "swx.retry.count": '), ks,
        F.when(F.col("k") % 2 == 0, F.lit(', "gen_ai.request.top_k": "five"')).otherwise(F.lit(', "gen_ai.request.top_k": 2.5')),
        F.when(F.col("k") % 3 == 0, F.lit(', "gen_ai.system": "old"')).otherwise(F.lit("")),
        F.when(F.col("k") % 5 == 0, F.lit(', "custom": true')).otherwise(F.lit("")),
        F.when(F.col("k") % 7 == 0, F.lit(', "gen_ai.response.finish_reasons": ["stop", 1]'))
        .otherwise(F.lit(', "gen_ai.response.finish_reasons": ["stop"]')), F.lit("}")).alias("attributes"))


@query("a22_attribute_validation", """
SELECT event_id, 5 + CAST(k % 3 = 0 AS INT) + CAST(k % 5 = 0 AS INT) AS checked,
       concat_ws(',', CASE WHEN k % 5 = 0 THEN 'custom' END, CASE WHEN k % 3 = 0 THEN 'gen_ai.system' END) AS unknown,
       concat_ws(',', CASE WHEN k % 2 = 0 THEN 'gen_ai.request.top_k:int:str' END,
                      CASE WHEN k % 7 = 0 THEN 'gen_ai.response.finish_reasons:str[]:list' END) AS mismatches,
       NOT (k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0) AS ok FROM ev""", ["ev"])
def a22(spark, sf):
    typed = registry.typed_attributes(_attribute_rows(spark, sf), "event_id", "attributes")
    return registry.validate(typed, registry.registry(spark), "event_id").select(
        "event_id", "checked", F.array_join("unknown", ",").alias("unknown"),
        F.array_join("mismatches", ",").alias("mismatches"), "ok")


cte("kept", ["tasks"], """
  SELECT session_id AS trace_id, CASE WHEN bool_or(status = 'error') THEN 'error'
         WHEN (max(epoch_us(ts) + latency_ms * 1000) - min(epoch_us(ts))) / 1e3 >= 3600000 THEN 'slow'
         WHEN CAST('0x' || substr(sha256(session_id), 1, 8) AS BIGINT) % 100 < 5 THEN 'sampled' END AS reason
  FROM tasks GROUP BY 1""")


@query("a23_sampled_traces", "SELECT trace_id, reason FROM kept WHERE reason IS NOT NULL", ["kept"])
def a23(spark, sf):
    return ingest.sampled_traces(_spans(spark, sf), slow_ms=3_600_000)


@query("a23_kept_spans", "SELECT event_id FROM tasks JOIN kept ON trace_id = session_id WHERE reason IS NOT NULL", ["kept"])
def a23_spans(spark, sf):
    s = _spans(spark, sf)
    return ingest.keep_sampled(s, ingest.sampled_traces(s, slow_ms=3_600_000)).select("event_id")


def _spans(spark, sf):
    ns = F.unix_micros("ts") * 1000
    return A.task_events(spark, sf).select(
        F.col("session_id").alias("trace_id"), "event_id", F.when(F.col("status") == "error", 2).otherwise(0).alias("status_code"),
        ns.alias("start_ns"), (ns + F.col("latency_ms") * 1_000_000).alias("end_ns"))
