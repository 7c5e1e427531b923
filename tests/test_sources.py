"""Trace requests, signed envelopes, records, timestamps, attribute types."""

import hashlib
import hmac
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetwatch import schemas
from fleetwatch.catalog import stream_queries
from fleetwatch.functions.hashing import call_signature, hmac_pads
from fleetwatch.functions.text import mask_personal_data
from fleetwatch.functions.timeparse import parse_ts
from fleetwatch.operators import ingest
from fleetwatch.sources import observations, otlp, registry, signed

NOW = datetime(2026, 1, 1, 12)


def _span(attrs, **kw):
    value = lambda v: {"intValue": str(v)} if isinstance(v, int) else {"doubleValue": v} if isinstance(v, float) \
        else {"arrayValue": {"values": [{"stringValue": x} for x in v]}} if isinstance(v, list) else {"stringValue": v}
    return {"traceId": "t1", "spanId": "s1", "name": "chat", "timeUnixNano": "1700000000123456789",
            "attributes": [{"key": k, "value": value(v)} for k, v in attrs], **kw}


def _events(spark, *bodies):
    rows = [(f"r{i}", NOW, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    req = spark.createDataFrame(rows, "request_id string, received_at timestamp, body string")
    return otlp.to_task_events(otlp.flatten(req)).collect(), req


def _request(span, resource=()):
    return {"resourceSpans": [{"resource": {"attributes": [{"key": k, "value": {"stringValue": v}} for k, v in resource]},
                               "scopeSpans": [{"spans": [span]}]}]}


OP = ("gen_ai.operation.name", "chat")


def test_full_span(spark):
    rows, _ = _events(spark, _request(_span(
        [OP, ("swx.agent.id", "a"), ("swx.task.id", "k"), ("gen_ai.usage.input_tokens", 900), ("swx.cost.usd", 0.0),
         ("gen_ai.usage.cost", 0.25), ("swx.retry.count", 2), ("swx.ttft.s", 0.5), ("error.type", "boom")],
        timeEndedUnixNano="1700000001623456789", status={"code": 2})))
    r = rows[0].asDict()
    assert (r["event_id"], r["agent_id"], r["task_id"], r["session_id"]) == ("otlp-t1-s1", "a", "k", "t1")
    assert (r["input_tokens"], r["output_tokens"], float(r["cost_usd"]), r["latency_ms"]) == (900, 0, 0.25, 1500)
    assert (r["status"], r["error_class"], r["retry_count"], r["ttft_s"]) == ("error", "boom", 2, 0.5)
    assert r["ts"] == datetime(2023, 11, 14, 22, 13, 20, 123456) and r["model_name"] == "unknown"


@pytest.mark.parametrize("attrs, resource, agent", [
    ([OP, ("swx.agent.id", ""), ("gen_ai.agent.id", "g")], [("service.name", "s")], "g"),
    ([OP], [("swx.agent.id", "ra"), ("service.name", "s")], "ra"), ([OP], [("gen_ai.agent.id", "rg")], "rg"),
    ([OP], [("service.name", "s")], "s"), ([OP], [], "unknown-agent"),
    ([OP, ("swx.agent.id", "old"), ("swx.agent.id", "new")], [], "new")])
def test_agent_chain(spark, attrs, resource, agent):
    assert _events(spark, _request(_span(attrs), resource))[0][0]["agent_id"] == agent


def test_objects_for_lists_filtering_and_missing_fields(spark):
    single = _request(_span([OP]))
    single["resourceSpans"] = single["resourceSpans"][0]
    single["resourceSpans"]["scopeSpans"] = single["resourceSpans"]["scopeSpans"][0]
    no_time = _request({"traceId": "t", "name": "gen_ai.x"})
    other = _request(_span([("x", "y")]))
    rows, req = _events(spark, single, no_time, other, "{oops", '{"a": 1}', '{"resourceSpans": []}')
    assert [r["event_id"] for r in rows][0] == "otlp-t1-s1" and len(rows) == 2
    assert rows[1]["ts"] == NOW and rows[1]["latency_ms"] == 0
    assert {r["request_id"]: r["reason"] for r in otlp.malformed(req).collect()} == {
        "r3": "bad json", "r4": "no resourceSpans"}


def test_attribute_map(spark):
    _, req = _events(spark, _request(_span([OP, ("n", 3), ("d", 0.5), ("l", ["a", "b"]), ("n", 4)])))
    m = otlp.flatten(req).select(otlp.attribute_map(F.col("attributes"))).first()[0]
    assert m == {"gen_ai.operation.name": "chat", "n": "4", "d": "0.5", "l": '["a","b"]'}


def test_signed_envelopes(spark):
    secret, at = b"s" * 80, int(NOW.timestamp())
    sign = lambda ts, nonce, body: hmac.new(secret, f"{ts}.{nonce}".encode() + body.encode(), hashlib.sha256).hexdigest()
    row = lambda i, key="k", ts=str(at), nonce="n", body="{}", sig=None, lag=0: (
        f"e{i}", key, ts, nonce, sig if sig is not None else sign(ts, nonce or "", body), body,
        datetime.fromtimestamp(at + lag))
    rows = [row(0), row(1, lag=1), row(2, key="z"), row(3, ts="soon"), row(4, ts=str(at - 301), nonce="a"),
            row(5, nonce=""), row(6, nonce=None), row(7, nonce="b", sig="bad"), row(8, nonce="c"),
            row(9, ts=str(at - 300), nonce="d"), row(10, nonce="e", sig="bad"), row(11, nonce="e", lag=2)]
    got = signed.verify(spark.createDataFrame(rows, schemas.ENVELOPES), hmac_pads(spark, {"k": secret}))
    assert [r["reason"] for r in sorted(got.collect(), key=lambda r: int(r["envelope_id"][1:]))] == [
        None, "replay", "unknown_key", "bad_timestamp", "timestamp_skew", "missing_nonce", "missing_nonce",
        "bad_signature", None, None, "bad_signature", None]


def test_observations(spark):
    recs = [{"id": "o1", "traceId": None, "type": "GENERATION", "level": "ERROR", "startTime": "2026-01-01T00:00:01Z",
             "endTime": "2026-01-01T00:00:00Z", "usage": {"input": 5, "totalCost": 0.5}},
            {"id": "o2", "traceId": "t", "type": "GENERATION", "name": "a", "statusMessage": "rate limit hit", "cost": 0.0,
             "startTime": "2026-01-01T00:00:01Z", "endTime": "2026-01-01T00:00:03Z", "env": "prod", "model": "m"},
            {"id": "o3", "type": "SPAN"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in recs], "j string") \
        .select(F.from_json("j", schemas.OBSERVATION).alias("o")).select("o.*")
    a, b = observations.to_task_events(df, F.lit(NOW)).orderBy("task_id").collect()
    assert (a["task_id"], a["error_class"], a["latency_ms"], float(a["cost_usd"]), a["tenant_id"]) == \
        ("None:o1", "ERROR", 0, 0.5, "default")
    assert (b["task_id"], b["error_class"], b["latency_ms"], float(b["cost_usd"]), b["tenant_id"]) == \
        ("t:o2", "rate", 2000, 0.0, "prod")
    assert b["event_id"] == f"otlp-{hashlib.sha256(b't').hexdigest()[:32]}-{hashlib.sha256(b'o2').hexdigest()[:16]}"


@pytest.mark.parametrize("text, want", [
    ("2026-01-02", datetime(2026, 1, 2)), ("2026-01-02T03:04:05Z", datetime(2026, 1, 2, 3, 4, 5)),
    ("2026-01-02 03:04:05.000006+03:00", datetime(2026, 1, 2, 0, 4, 5, 6)), ("20260102T030405", datetime(2026, 1, 2, 3, 4, 5)),
    (" 20260102 ", datetime(2026, 1, 2)), ("12:00", None), ("2026", None), ("2026-13-01", None), (None, None)])
def test_timestamps(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parse_ts(F.col("t"))).first()[0] == want


def test_registry(spark):
    known = registry.registry(spark, {"swx.agent.id": "str"})
    assert registry.registry(spark).where(F.startswith("key", F.lit("gen_ai."))).count() == 79
    assert registry.registry(spark).where(F.startswith("key", F.lit("swx."))).count() == 30
    rows = [(1, '{"gen_ai.request.model": "m", "swx.agent.id": "a", "error.x": 1}'),
            (2, '{"gen_ai.request.top_k": 2.5, "gen_ai.request.stream": "yes", "gen_ai.nope": 1, "own": 2}'),
            (3, '{"gen_ai.response.finish_reasons": [], "gen_ai.input.messages": {"a": 1}, "gen_ai.request.seed": true}'), (4, "{}")]
    typed = registry.typed_attributes(spark.createDataFrame(rows, "id int, a string"), "id", "a")
    got = {r["id"]: (r["ok"], r["checked"], r["unknown"], r["mismatches"]) for r in registry.validate(typed, known, "id").collect()}
    assert got[1] == (True, 3, [], [])
    assert got[2] == (False, 4, ["gen_ai.nope", "own"], ["gen_ai.request.stream:bool:str"])
    assert got[3] == (False, 3, [], ["gen_ai.request.seed:int:bool"]) and got[4] == (True, 0, [], [])


def test_call_signature(spark):
    df = spark.createDataFrame([("x", "12"), ("x1", "2"), ("x", '{"a":1,"b":2}'), ("x", '{ "b": 2, "a": 1 }'), ("x", "{bad")],
                               "t string, a string")
    h = [r[0] for r in df.select(call_signature(F.col("t"), F.col("a"))).collect()]
    assert h[0] != h[1] and h[2] == h[3] and len(set(h)) == 4


def test_masking(spark):
    df = spark.createDataFrame([("mail a.b@c.org, card 4111 1111 1111 1111.",), ("nothing 123",)], "t string")
    assert [r[0] for r in df.select(mask_personal_data(F.col("t"))).collect()] == [
        "mail [REDACTED_EMAIL], card [REDACTED_CARD].", "nothing 123"]


def test_cursor_reads(spark):
    t = [datetime(2026, 1, 1, h) for h in (10, 11, 12)]
    df = spark.createDataFrame([(f"e{i}", ts) for i, ts in enumerate(t)], "event_id string, ts timestamp")
    ids = lambda *a, **k: [r["event_id"] for r in ingest.rows_since(df, *a, **k).collect()]
    assert ids(None, 10) == ["e0", "e1", "e2"] and ids(F.lit(t[1]), 10) == ["e2"]
    assert ids(F.lit(t[1]), 10, True) == ["e1", "e2"] and ids(None, 0) == [] and ids(None, 1) == ["e0"]
    assert ids(F.lit(t[1]), 10, after_event=F.lit("e0")) == ["e1", "e2"]


def test_first_write_wins(spark):
    ddl = "event_id string, v int, n int"
    new = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 3, 1), ("c", 4, 1)], ddl)
    old = spark.createDataFrame([("c", 9, 0)], ddl)
    assert sorted(tuple(r) for r in ingest.new_events(new, old, ["n"]).collect()) == [("a", 2, 1), ("b", 3, 1)]


def test_redelivery_under_the_same_id_is_a_replay(spark):
    secret, at = b"s3", int(NOW.timestamp())
    sign = lambda nonce: hmac.new(secret, f"{at}.{nonce}{{}}".encode(), hashlib.sha256).hexdigest()
    row = lambda i, nonce: (i, "k", str(at), nonce, sign(nonce), "{}", NOW)
    rows = [row("a", "n1"), row("a", "n1"), row("b", "n2"), row("b", "n2"), row("b", "n2"), row("c", "n3")]
    got = signed.verify(spark.createDataFrame(rows, schemas.ENVELOPES), hmac_pads(spark, {"k": secret}))
    assert sorted((r["envelope_id"], r["reason"] or "") for r in got.collect()) == [
        ("a", ""), ("a", "replay"), ("b", ""), ("b", "replay"), ("b", "replay"), ("c", "")]


def test_an_envelope_with_a_null_is_never_accepted(spark):
    secret = b"s3"
    at = int(NOW.timestamp())
    good = lambda ts: hmac.new(secret, f"{ts}.n{{}}".encode(), hashlib.sha256).hexdigest()
    full = ("e", "k", str(at), "n", good(at), "{}", NOW)
    rows = [full] + [tuple(None if i == j else v for j, v in enumerate(full)) for i in range(1, 7)]
    rows.append(("e", "k", "0", "n", good(0), "{}", None))  # signed, of 1970, without arrival time
    for row, reason in zip(rows, [None, "unknown_key", "bad_timestamp", "missing_nonce", "bad_signature", "bad_signature", "timestamp_skew", "timestamp_skew"]):
        got = signed.verify(spark.createDataFrame([row], schemas.ENVELOPES), hmac_pads(spark, {"k": secret})).first()
        assert got["reason"] == reason, row
    nameless = spark.createDataFrame([(None, *full[1:])] * 2, schemas.ENVELOPES)
    assert sorted(r["reason"] or "" for r in signed.verify(nameless, hmac_pads(spark, {"k": secret})).collect()) == ["", "replay"]


def test_a_flood_of_one_nonce_is_spread(spark):
    secret, at = b"s3", int(NOW.timestamp())
    mac = hmac.new(secret, f"{at}.n{{}}".encode(), hashlib.sha256).hexdigest()
    flood = spark.range(0, 20_000, 1, 8).select(
        F.concat(F.lit("e"), F.col("id")).alias("envelope_id"), F.lit("k").alias("key_id"), F.lit(str(at)).alias("ts_text"), F.lit("n").alias("nonce"),
        F.lit(mac).alias("signature"), F.lit("{}").alias("body"), F.timestamp_seconds(F.lit(at) + F.abs(F.col("id") - 777) % 100).alias("received_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    checked = signed.verify(flood, hmac_pads(spark, {"k": secret})).withColumn("task", F.spark_partition_id()).cache()
    assert [r["envelope_id"] for r in signed.accepted(checked).collect()] == ["e10077"]  # the least id of those that came first
    assert checked.where("reason = 'replay'").count() == 19_999
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in checked.groupBy("task").count().collect()) < 12_000
    checked.unpersist()


def test_unreadable_parts_are_reported(spark):
    good = '{"traceId":"t","spanId":"s","name":"x"}'
    bodies = {"ok": '{"resourceSpans":[{"scopeSpans":[{"spans":[%s]}]}]}' % good,
              "object": '{"resourceSpans":[{"scopeSpans":[{"spans":%s}]}]}' % good,
              "half": '{"resourceSpans":[{"scopeSpans":[{"spans":[%s]}]},{"scopeSpans":5}]}' % good,
              "spans": '{"resourceSpans":[{"scopeSpans":[{"spans":"no"}]}]}',
              "attributes": '{"resourceSpans":[{"scopeSpans":[{"spans":[{"spanId":"s","attributes":"no"}]}]}]}'}
    df = spark.createDataFrame([(k, datetime(2024, 1, 1), v) for k, v in bodies.items()], "request_id string, received_at timestamp, body string")
    assert {r["request_id"]: r["reason"] for r in otlp.malformed(df).collect()} == {
        "half": "unread scopeSpans", "spans": "unread spans", "attributes": "unread attributes"}
    spans = [r["request_id"] for r in otlp.flatten(df).collect()]
    assert sorted(spans) == ["attributes", "half", "object", "ok"]


def test_requests_of_two_files_have_own_ids(spark, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text('{"resourceSpans":[]}\n')
    ids = [r["request_id"] for r in otlp.read_requests(spark, str(tmp_path)).collect()]
    assert len(ids) == len(set(ids)) == 2


def test_a_request_is_parsed_once(spark):
    bodies = ['{"resourceSpans":[null,{"scopeSpans":[]},{"scopeSpans":[{"spans":[null,{"spanId":"a","attributes":[]}]}]}]}',
              '{"resourceSpans":[]}', '{"resourceSpans":{"scopeSpans":{"spans":{"spanId":"b"}}}}', "{"]
    req = spark.createDataFrame([(f"r{i}", NOW, b) for i, b in enumerate(bodies)],
                                "request_id string, received_at timestamp, body string").repartition("request_id")
    spans, bad = otlp.flatten(req), otlp.malformed(req)
    assert sorted((r.request_id, r.spanId or "") for r in spans.collect()) == [("r0", ""), ("r0", "a"), ("r2", "b")]
    assert {r.request_id: r.reason for r in bad.collect()} == {"r0": "unread scopeSpans", "r3": "bad json"}
    for df in (spans, bad):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert sum("from_json(" in line for line in plan) == 1
        assert not any("Filter" in line and "from_json(" in line for line in plan)


def test_deliveries_are_signed_once(spark, tmp_path, monkeypatch):
    """All three deliveries of a request are written by the task that signed it."""
    monkeypatch.setattr(stream_queries, "work_dir", lambda _, name: str(tmp_path / name))
    rows = stream_queries.s1(spark, "/root/testdata/sf0.001")
    e = spark.read.parquet(str(tmp_path / "envelopes")).withColumn("file", F.input_file_name())
    found = e.groupBy("nonce").agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("n"),
                                   F.count_if(F.col("key_id") == "key-2").alias("forged")).select("files", "n", "forged").distinct().collect()
    assert [tuple(r) for r in found] == [(1, 3, 1)] and rows.count() > 0
