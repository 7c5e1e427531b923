"""OTLP/JSON trace requests to task events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeparse import ns_to_ts

_VALUE = ("struct<stringValue:string, intValue:string, doubleValue:string, boolValue:string,"
          " arrayValue:struct<values:array<struct<stringValue:string>>>>")
_ATTRS = f"array<struct<key:string, value:{_VALUE}>>"
_SPAN = ("struct<traceId:string, spanId:string, name:string, timeUnixNano:string,"
         " timeEndedUnixNano:string, startTimeUnixNano:string, endTimeUnixNano:string,"
         f" attributes:{_ATTRS}, status:struct<code:string>>")
_RESOURCE = f"struct<attributes:{_ATTRS}>"
_SCOPES = f"array<struct<spans:array<{_SPAN}>>>"
REQUEST = f"struct<resourceSpans:array<struct<resource:{_RESOURCE}, scopeSpans:{_SCOPES}>>>"


def _listed(json: Column) -> Column:
    """A single object in place of a list becomes a list of one."""
    return F.when(F.startswith(json, F.lit("{")), F.concat(F.lit("["), json, F.lit("]"))).otherwise(json)


def _parsed(requests: DataFrame) -> DataFrame:
    """Adds ``_spans``, the resource list. Regular requests are parsed once; a request with a
    single object where a list belongs is parsed again, level by level. What cannot be read on
    a level is null there, which ``malformed`` reports."""
    body = F.col("body")
    outer = F.from_json(_listed(F.get_json_object(body, "$.resourceSpans")),
                        f"array<struct<resource:{_RESOURCE}, scopeSpans:string>>")
    lenient = F.transform(outer, lambda r: F.struct(
        r["resource"].alias("resource"),
        F.transform(F.from_json(_listed(r["scopeSpans"]), "array<struct<spans:string>>"), lambda s: F.struct(
            F.from_json(_listed(s["spans"]), f"array<{_SPAN}>").alias("spans"))).alias("scopeSpans")))
    odd = lambda p: p.isNull() | _unread_scope(p) | _unread_spans(p)
    # the list of one gives the parse a name inside the expression, so that no rule of the optimizer can write it out twice
    regular = F.array(F.from_json(body, REQUEST)["resourceSpans"])
    return requests.withColumn("_spans", F.get(F.transform(regular, lambda p: F.when(odd(p), lenient).otherwise(p)), F.lit(0)))


def _unread_scope(resources: Column) -> Column:
    return F.exists(resources, lambda r: r["scopeSpans"].isNull())


def _unread_spans(resources: Column) -> Column:
    return F.exists(resources, lambda r: F.exists(r["scopeSpans"], lambda s: s["spans"].isNull()))


def _unread_attributes(resources: Column, body: Column) -> Column:
    """A list of attributes that is there but cannot be read."""
    unread = F.exists(resources, lambda r: F.exists(r["scopeSpans"], lambda s: F.exists(
        s["spans"], lambda p: p["attributes"].isNull())))
    return unread & body.rlike(r'"attributes"\s*:\s*[^\s\[n]')


def malformed(requests: DataFrame) -> DataFrame:
    """Requests to quarantine, with the reason. A request with a part that cannot be read
    is reported although its other parts go on."""
    body, spans = F.col("body"), F.col("_spans")
    reason = (F.when(spans.isNull(), F.when(F.try_parse_json("body").isNull(), "bad json").otherwise("no resourceSpans"))
              .when(_unread_scope(spans), "unread scopeSpans").when(_unread_spans(spans), "unread spans")
              .when(_unread_attributes(spans, body), "unread attributes"))
    # a generated column: a filter on the expression itself would parse every request once more, below any repartitioning
    return (_parsed(requests).select("request_id", F.explode_outer(F.array(reason)).alias("reason"), "body")
            .where(F.col("reason").isNotNull()))


def flatten(requests: DataFrame) -> DataFrame:
    """A1: one row per span of the requests (request_id, received_at, body), with the
    attributes of its resource."""
    keep = [c for c in requests.columns if c != "body"]
    # outer, as the engine would filter by the size of the parsed list first; the next level drops the nulls
    res = _parsed(requests).select(*keep, F.explode_outer("_spans").alias("_r"))
    scopes = res.select(*keep, F.col("_r.resource.attributes").alias("resource_attributes"),
                        F.explode("_r.scopeSpans").alias("_s"))
    return (scopes.select(*keep, "resource_attributes", F.explode("_s.spans").alias("_p"))
            .select(*keep, "resource_attributes", "_p.*"))


def _value_text(v: Column) -> Column:
    items = F.to_json(F.transform(v["arrayValue"]["values"], lambda e: e["stringValue"]))
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"], v["boolValue"], items)


def _newest_first(attrs: Column, name: str) -> Column:
    return F.struct(F.reverse(F.transform(attrs, lambda a: a["key"])).alias("keys"),
                    F.reverse(F.transform(attrs, lambda a: a["value"])).alias("values")).alias(name)


class Attributes:
    """Last-wins lookups in a KeyValue list that ``_newest_first`` has turned around."""

    def __init__(self, turned: Column):
        self.keys, self.values = turned["keys"], turned["values"]

    def __getitem__(self, key: str | Column) -> Column:
        return _value_text(F.get(self.values, (F.array_position(self.keys, key) - 1).cast("int")))

    def text(self, key: str) -> Column:
        """Null for a missing and for an empty value."""
        return F.nullif(self[key], F.lit(""))


def attribute_map(attrs: Column) -> Column:
    """A2: the list as a map of text values; the last of equal keys wins."""
    pairs = Attributes(_newest_first(attrs, "_a"))
    keys = F.array_distinct(F.transform(attrs, lambda a: a["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: pairs[k]))


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").cast("bigint"), F.lit(0))


def to_task_events(spans: DataFrame, default_fleet: str = "default") -> DataFrame:
    """A3: task events of generative spans. The agent comes from the span, then from its
    resource, then from the service name. Latency is in milliseconds."""
    spans = spans.select("*", _newest_first(F.col("attributes"), "_s"),
                         _newest_first(F.col("resource_attributes"), "_r"))
    s, r = Attributes(F.col("_s")), Attributes(F.col("_r"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("span"))
    start = F.coalesce(F.coalesce("timeUnixNano", "startTimeUnixNano").try_cast("bigint"), F.lit(0))
    end = F.coalesce(F.coalesce("timeEndedUnixNano", "endTimeUnixNano").try_cast("bigint"), F.lit(0))
    ms = F.greatest(F.lit(0), F.call_function("div", end - start, F.lit(1_000_000)))
    span_id = F.coalesce("spanId", F.substring(F.sha2(F.to_json("attributes"), 256), 1, 16))
    return (spans.where(s["gen_ai.operation.name"].isNotNull() | F.startswith(name, F.lit("gen_ai")))
            .select(
        F.concat(F.lit("otlp-"), F.coalesce("traceId", F.lit("")), F.lit("-"), span_id).alias("event_id"),
        F.coalesce(s.text("swx.agent.id"), s.text("gen_ai.agent.id"), r.text("swx.agent.id"),
                   r.text("gen_ai.agent.id"), r.text("service.name"), F.lit("unknown-agent")).alias("agent_id"),
        F.coalesce(s.text("swx.task.id"), F.nullif("traceId", F.lit("")), F.lit("task")).alias("task_id"),
        F.coalesce("traceId", F.lit("")).alias("session_id"),
        F.coalesce(s.text("gen_ai.request.model"), s.text("gen_ai.response.model"), F.lit("unknown")).alias("model_name"),
        _whole(s["gen_ai.usage.input_tokens"]).alias("input_tokens"),
        _whole(s["gen_ai.usage.output_tokens"]).alias("output_tokens"),
        F.coalesce(F.nullif(s["swx.cost.usd"].try_cast("decimal(12,6)"), F.lit(0).cast("decimal(12,6)")),
                   s["gen_ai.usage.cost"].try_cast("decimal(12,6)"), F.lit(0).cast("decimal(12,6)")).alias("cost_usd"),
        F.when(end > 0, ms).otherwise(F.lit(0)).cast("bigint").alias("latency_ms"),
        F.coalesce(s.text("error.type"), s.text("swx.error.class")).alias("error_class"),
        F.when(F.col("status.code").try_cast("int") == 2, "error").otherwise("ok").alias("status"),
        F.lit(False).alias("synthetic"),
        ns_to_ts(start.cast("string"), F.col("received_at")).alias("ts"),
        _whole(s["swx.retry.count"]).cast("int").alias("retry_count"),
        F.coalesce(s["swx.ttft.s"].try_cast("double"), F.lit(0.0)).alias("ttft_s"),
        s.text("swx.task.template").alias("task_template"),
        s.text("swx.end_state.json").alias("end_state_json"),
        s.text("swx.subject.id").alias("data_subject_id"),
        F.coalesce(s.text("swx.fleet.name"), r.text("swx.fleet.name"), F.lit(default_fleet)).alias("fleet_name"),
        s.text("swx.tenant").alias("tenant_id"), "received_at"))


def read_requests(spark, path: str) -> DataFrame:
    """One request per text line; the file path and line text make the id."""
    lines = spark.read.text(path, wholetext=False)
    return lines.select(F.sha2(F.concat_ws("\n", "_metadata.file_path", "value"), 256).alias("request_id"),
                        F.current_timestamp().alias("received_at"), F.col("value").alias("body"))
