"""Attributes against a pinned registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: registered attribute keys by type --------------------------------
STANDARD = {
    "str": """
        gen_ai.agent.description gen_ai.agent.id gen_ai.agent.name gen_ai.agent.version
        gen_ai.conversation.id gen_ai.data_source.id gen_ai.evaluation.explanation
        gen_ai.evaluation.name gen_ai.evaluation.score.label gen_ai.main_agent.description
        gen_ai.main_agent.id gen_ai.main_agent.name gen_ai.memory.query.text
        gen_ai.memory.record.id gen_ai.memory.store.id gen_ai.operation.name
        gen_ai.output.type gen_ai.prompt.name gen_ai.prompt.variable gen_ai.prompt.version
        gen_ai.provider.name gen_ai.request.model gen_ai.request.previous_response.id
        gen_ai.request.reasoning.level gen_ai.request.stream_cursor gen_ai.response.id
        gen_ai.response.model gen_ai.response.status gen_ai.retrieval.query.text
        gen_ai.skill.description gen_ai.skill.name gen_ai.skill.resource.name
        gen_ai.skill.source.uri gen_ai.token.modality gen_ai.tool.call.id
        gen_ai.tool.description gen_ai.tool.name gen_ai.tool.type gen_ai.workflow.name""",
    "str[]": """
        gen_ai.request.encoding_formats gen_ai.request.stop_sequences
        gen_ai.response.finish_reasons""",
    "int": """
        gen_ai.embeddings.dimension.count gen_ai.memory.record.count
        gen_ai.request.choice.count gen_ai.request.max_tokens gen_ai.request.seed
        gen_ai.request.top_k gen_ai.retrieval.top_k
        gen_ai.usage.audio.cache_read.input_tokens gen_ai.usage.audio.input_tokens
        gen_ai.usage.audio.output_tokens gen_ai.usage.cache_read.input_tokens
        gen_ai.usage.cache_write.input_tokens gen_ai.usage.image.cache_read.input_tokens
        gen_ai.usage.image.input_tokens gen_ai.usage.image.output_tokens
        gen_ai.usage.input_tokens gen_ai.usage.output_tokens
        gen_ai.usage.reasoning.output_tokens gen_ai.usage.text.cache_read.input_tokens
        gen_ai.usage.text.input_tokens gen_ai.usage.text.output_tokens""",
    "double": """
        gen_ai.evaluation.score.value gen_ai.request.frequency_penalty
        gen_ai.request.presence_penalty gen_ai.request.temperature gen_ai.request.top_p
        gen_ai.response.time_to_first_chunk""",
    "bool": "gen_ai.conversation.compacted gen_ai.request.stream",
    "json": """
        gen_ai.input.messages gen_ai.memory.records gen_ai.output.messages
        gen_ai.retrieval.documents gen_ai.system_instructions gen_ai.tool.call.arguments
        gen_ai.tool.call.result gen_ai.tool.definitions""",
}
EXTENSION = {
    "str": """
        swx.fleet.name swx.agent.role swx.agent.version swx.task.template swx.task.instance
        swx.end_state.json swx.metamorphic.kind swx.metamorphic.baseline_ref
        swx.permission.decision swx.loop.hash swx.reasoning.slice.hash swx.drift.kind
        swx.guard.event swx.hitl.reason swx.hitl.escalation_id swx.evidence.event_type
        swx.evidence.payload_hash swx.evidence.prev_hash swx.scenario swx.model_tag""",
    "int": "swx.retry.count swx.mask.count swx.evidence.seq",
    "double": "swx.ttft.s swx.budget.usd swx.cost.usd swx.usage.cost swx.drift.score",
    "bool": "swx.slo.adopted swx.synthetic",
}
PASSED_PREFIXES = ["error.", "otel.", "service.", "deployment.", "k8s.", "host.", "telemetry."]


def registry(spark: SparkSession, extra: dict[str, str] | None = None) -> DataFrame:
    """(key, expected), about 110 rows; ``extra`` adds keys of one's own."""
    rows = [(key, tag) for group in (STANDARD, EXTENSION)
            for tag, keys in group.items() for key in keys.split()]
    rows += list((extra or {}).items())
    return spark.createDataFrame(rows, "key string, expected string")


def typed_attributes(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, key, actual) for every attribute of a JSON object column; an empty object or
    invalid JSON gives one row with a null key."""
    v = rows.select(id_col, F.try_parse_json(json_col).alias("_v"))
    each = v.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
    t = F.schema_of_variant("value")
    actual = (F.when(t == "BOOLEAN", "bool").when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
              .when(t.isin("DOUBLE", "FLOAT") | F.startswith(t, F.lit("DECIMAL")), "double")
              .when(t == "STRING", "str").when(t.isin("ARRAY<STRING>", "ARRAY<VOID>"), "str[]")
              .when(F.startswith(t, F.lit("ARRAY")), "list").otherwise("json"))
    return each.select(id_col, "key", actual.alias("actual"))


def validate(attributes: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Per row: ok, checked, unknown keys and type mismatches (``key:expected:actual``),
    both sorted. A count that arrives as a double is fine."""
    governed = F.col("key").rlike(r"^(gen_ai|swx)\.")
    passed = F.lit(False)
    for p in PASSED_PREFIXES:
        passed = passed | F.startswith(F.col("key"), F.lit(p))
    joined = attributes.join(F.broadcast(known), "key", "left")
    unknown = F.when(governed, F.col("expected").isNull()).otherwise(~passed)
    wrong = (governed & F.col("expected").isNotNull() & (F.col("actual") != F.col("expected"))
             & ~((F.col("expected") == "int") & (F.col("actual") == "double")))
    listed = lambda cond, value: F.sort_array(F.collect_list(F.when(cond, value)))
    return (joined.groupBy(id_col)
            .agg(F.count("key").alias("checked"), listed(unknown, F.col("key")).alias("unknown"),
                 listed(wrong, F.concat_ws(":", "key", "expected", "actual")).alias("mismatches"))
            .withColumn("ok", (F.size("unknown") == 0) & (F.size("mismatches") == 0)))
