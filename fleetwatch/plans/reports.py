"""Weekly fleet report, data-protection report and quality measurements as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequences import range_bucket
from ..operators.stats import nearest_rank
from ..rules import ERASE_SLA_DAYS, severity_rank


def _days_ago(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(days))


def drift_items(alarms: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """G13."""
    return (alarms.where((F.col("event_type") == "report_item")
                         & (F.col("created_at") >= _days_ago(as_of, days)))
            .orderBy(F.desc("created_at"), "alarm_id"))


def sla_summary(alarms: DataFrame, as_of: Column) -> DataFrame:
    """G14."""
    is_open = F.col("status") == "open"
    return alarms.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_open).alias("open"),
        F.count_if(is_open & (F.col("sla_deadline") < as_of)).alias("breached"))


def cost_ranking(tasks: DataFrame, as_of: Column, days: int = 7, k: int = 5) -> DataFrame:
    """G15."""
    return (tasks.where(F.col("ts") >= _days_ago(as_of, days)).groupBy("agent_id")
            .agg(F.round(F.sum("cost_usd"), 4).cast("double").alias("cost_usd"),
                 F.count(F.lit(1)).alias("tasks"), F.round(F.avg("latency_ms"), 0).alias("avg_latency_ms"))
            .orderBy(F.desc("cost_usd"), "agent_id").limit(k))


def first_seen_classes(tasks: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Earliest sight of each error text inside the window."""
    return (tasks.where(F.col("error_class").isNotNull() & (F.col("ts") >= _days_ago(as_of, days)))
            .groupBy("error_class").agg(F.min("ts").alias("first_ts"))
            .orderBy(F.desc("first_ts"), "error_class"))


def evidence_anchors(alarms: DataFrame, as_of: Column, days: int = 7, k: int = 50) -> DataFrame:
    """Ledger positions of the newest k alarms; the limit comes before the null filter."""
    return (alarms.where(F.col("created_at") >= _days_ago(as_of, days))
            .orderBy(F.desc("created_at"), "alarm_id").limit(k)
            .where(F.col("evidence_seq").isNotNull())
            .select("alarm_id", "severity", "signal", "evidence_seq", "evidence_seq_resolved",
                    "created_at"))


def weekly_digest(alarms: DataFrame, tasks: DataFrame, ledger: DataFrame, seals: DataFrame,
                  as_of: Column, days: int = 7) -> DataFrame:
    """All report sections as rows (section, rank, subject, detail)."""
    from ..operators.ledger import latest_seal

    def section(df: DataFrame, no: int, order: list[Column], subject: Column, detail: Column) -> DataFrame:
        w = W.partitionBy(F.lit(no)).orderBy(*order)
        return df.select(F.lit(no).alias("section"),
                         F.row_number().over(w).cast("bigint").alias("rank"),
                         subject.alias("subject"), detail.alias("detail"))

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    drift = drift_items(alarms, as_of, days)
    # sections without a limit carry no global rank, which would order them in one task
    drift = drift.select(F.lit(1).alias("section"), F.lit(0).cast("bigint").alias("rank"),
                         F.concat_ws(" ", "alarm_id", "agent_id").alias("subject"),
                         F.concat_ws(" ", "signal", "severity", text("evidence_seq")).alias("detail"))
    sla = section(sla_summary(alarms, as_of), 2, [severity_rank(), F.col("severity")],
                  F.col("severity"), F.concat_ws(" ", text("n"), text("open"), text("breached")))
    anchors = section(evidence_anchors(alarms, as_of, days), 3,
                      [F.desc("created_at"), F.col("alarm_id")], F.col("alarm_id"),
                      F.concat_ws(" ", text("evidence_seq"), text("evidence_seq_resolved")))
    cost = section(cost_ranking(tasks, as_of, days), 4, [F.desc("cost_usd"), F.col("agent_id")],
                   F.col("agent_id"), F.concat_ws(" ", F.format_string("%.2f", "cost_usd"), text("tasks")))
    classes = first_seen_classes(tasks, as_of, days).select(
        F.lit(5).alias("section"), F.lit(0).cast("bigint").alias("rank"),
        F.col("error_class").alias("subject"), F.date_format("first_ts", "yyyy-MM-dd HH:mm").alias("detail"))
    entries = ledger.groupBy().agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(6).alias("section"), F.lit(1).cast("bigint").alias("rank"),
        F.lit("ledger entries").alias("subject"), text("n").alias("detail"))
    seal = latest_seal(seals).select(
        F.lit(6).alias("section"), F.lit(2).cast("bigint").alias("rank"),
        F.concat(F.lit("latest seal "), F.col("seal_id")).alias("subject"),
        F.concat_ws(" ", F.substring("root_hash", 1, 16), text("covers_through_seq")).alias("detail"))
    out = drift
    for part in (sla, anchors, cost, classes, entries, seal):
        out = out.unionByName(part)
    return out


def subject_register(subjects: DataFrame) -> DataFrame:
    """G19."""
    return (subjects.select(
        "subject_id", "display_name", "key_version", "registered_at", "erased_at",
        F.when(F.col("erased_at").isNull(), "active").otherwise("erased").alias("state"))
        .orderBy("registered_at", "subject_id"))


def erasure_breaches(subjects: DataFrame, requests: DataFrame | None = None,
                     sla_days: int = ERASE_SLA_DAYS) -> DataFrame:
    """Erasures later than the limit, counted from the request where one is known and
    from registration otherwise."""
    rows = subjects.where(F.col("erased_at").isNotNull())
    start = F.col("registered_at")
    if requests is not None:
        rows = rows.join(requests.groupBy("subject_id").agg(F.min("requested_at").alias("_asked")),
                         "subject_id", "left")
        start = F.coalesce("_asked", "registered_at")
    days = (F.unix_seconds("erased_at") - F.unix_seconds(start)) / 86_400
    return rows.withColumn("_d", days).where(F.col("_d") > sla_days).select(
        "subject_id", F.round("_d", 1).alias("days"))


def erasure_anchors(ledger: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row: bound and erased entries of the ledger and subjects with live keys."""
    live = subjects.groupBy().agg(F.count_if(F.col("erased_at").isNull()).alias("n")).scalar()
    of = lambda t: F.count_if(F.col("event_type") == t).alias(t)
    return (ledger.groupBy().agg(of("subject_event_bound"), of("subject_erased"))
            .withColumn("live_keys", live))


def alarm_latencies(alarms: DataFrame, tasks: DataFrame, guards: DataFrame,
                    window_s: int = 60) -> DataFrame:
    """Per alarm, milliseconds since the agent's newest event in the window before it.

    Rows are cut into windows of the same length. The newest event is either earlier in
    the alarm's own slot (a running maximum) or the last one of the slot before."""
    us = lambda c: F.unix_micros(c)
    width = window_s * 1_000_000
    event = lambda df: df.select("agent_id", us("ts").alias("t"), F.lit(None).cast("string").alias("alarm_id"))
    rows = (event(tasks).unionByName(event(guards))
            .unionByName(alarms.select("agent_id", us("created_at").alias("t"), "alarm_id"))
            .withColumn("slot", range_bucket("t", width)))
    seen = F.when(F.col("alarm_id").isNull(), F.col("t"))
    w = W.partitionBy("agent_id", "slot").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    here = rows.withColumn("own", F.max(seen).over(w)).where(F.col("alarm_id").isNotNull())
    last = (rows.where(F.col("alarm_id").isNull()).groupBy("agent_id", (F.col("slot") + 1).alias("slot"))
            .agg(F.max("t").alias("prior")))
    latest = F.coalesce("own", F.when(F.col("prior") >= F.col("t") - width, F.col("prior")))
    return (here.join(last, ["agent_id", "slot"], "left")
            .withColumn("latest", latest).where(F.col("latest").isNotNull())
            .select("alarm_id", "agent_id", ((F.col("t") - F.col("latest")) / 1000).alias("latency_ms")))


def alarm_latency_card(latencies: DataFrame, target_ms: float = 500.0) -> DataFrame:
    """One row with count, nearest-rank p95, maximum and the target."""
    card = nearest_rank(latencies, "latency_ms", 0.95)
    return card.select(F.col("n").alias("count"), F.round("quantile", 1).alias("p95_ms"),
                       F.round("max", 1).alias("max_ms"), F.lit(target_ms).alias("target_ms"))
