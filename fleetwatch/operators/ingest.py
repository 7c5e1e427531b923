"""Landing events: dedup, registration, tenants, incremental copy, retention, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R


def register_agents(tasks: DataFrame, guards: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Agents by first sight in either stream. The first event decides whether the
    agent counts as synthetic."""
    cols = ["agent_id", "ts", "synthetic"]
    both = tasks.select(*cols).unionByName(guards.select(*cols))
    first = (both.groupBy("agent_id")
             .agg(F.min(F.struct("ts", F.coalesce("synthetic", F.lit(False)).alias("synthetic")))
                  .alias("f"))
             .select("agent_id", F.col("f.ts").alias("first_seen"), F.col("f.synthetic"),
                     F.lit("worker").alias("role")))
    return first if known is None else first.join(known.select("agent_id"), "agent_id", "left_anti")


def new_events(incoming: DataFrame, stored: DataFrame | None = None,
               arrival: Sequence[str] = ("ts",)) -> DataFrame:
    """First write wins on ``event_id``, against the stored table and inside the batch."""
    cols = incoming.columns
    rest = [c for c in cols if c != "event_id"]
    first = (incoming.groupBy("event_id")
             .agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("r"))
             .select("event_id", "r.*").select(*cols))
    return first if stored is None else first.join(stored.select("event_id"), "event_id", "left_anti")


def stamp_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """A9."""
    return rows.withColumn("tenant_id", F.lit(tenant))


def tenant_for_email(people: DataFrame, tenants: DataFrame, email: str = "email") -> DataFrame:
    """A10: tenant of the mail domain, ``default`` without a match. ``tenants`` is a small
    dimension; the engine broadcasts it while it stays under the size limit."""
    domain = F.when(F.contains(F.col(email), F.lit("@")),
                    F.lower(F.substring_index(F.col(email), "@", -1)))
    by_domain = (tenants.where(F.col("sso_domain").isNotNull()).groupBy("sso_domain")
                 .agg(F.min("tenant_id").alias("tenant_id")))
    return (people.withColumn("_d", domain)
            .join(by_domain, F.col("_d") == F.col("sso_domain"), "left")
            .withColumn("tenant_id", F.coalesce("tenant_id", F.lit("default")))
            .drop("_d", "sso_domain"))


def rows_since(events: DataFrame, cursor: Column | None, limit: int, inclusive: bool = False,
               after_event: Column | None = None) -> DataFrame:
    """The next ``limit`` rows in (ts, event_id) order. ``after_event`` continues
    inside one timestamp, so more rows than the limit may share it."""
    rows = events
    if cursor is not None and after_event is not None:
        rows = rows.where((F.col("ts") > cursor)
                          | ((F.col("ts") == cursor) & (F.col("event_id") > after_event)))
    elif cursor is not None:
        rows = rows.where(F.col("ts") >= cursor if inclusive else F.col("ts") > cursor)
    return rows.orderBy("ts", "event_id").limit(limit)


def copy_increment(source: DataFrame, target: DataFrame) -> DataFrame:
    """A16 as a batch: all source rows at or after the newest copied row that the target
    does not hold yet. The boundary timestamp is compared by key, so nothing is re-sent."""
    newest = target.agg(F.max("ts").alias("m")).select("m").scalar()
    tail = source.where(F.coalesce(F.col("ts") >= newest, F.lit(True)))
    held = target.where(F.col("ts") >= newest).select("agent_id", "ts", "event_id")
    return tail.join(held, ["agent_id", "ts", "event_id"], "left_anti")


def latest_copy(rows: DataFrame, version: str = "ingested_at") -> DataFrame:
    """The newest version of each (agent_id, ts, event_id)."""
    rest = [c for c in rows.columns if c not in ("agent_id", "ts", "event_id")]
    return (rows.groupBy("agent_id", "ts", "event_id")
            .agg(F.max_by(F.struct(*rest), F.col(version)).alias("r"))
            .select("agent_id", "ts", "event_id", "r.*"))


def hot_rows(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Rows the hot tier keeps."""
    return rows.where(F.col("ts") >= as_of - F.make_dt_interval(days=F.lit(days)))


def warm_rows(rows: DataFrame, as_of: Column, first_day: int = 30, last_day: int = 90) -> DataFrame:
    """Rows between the hot and the cold tier."""
    return rows.where((F.col("ts") < as_of - F.make_dt_interval(days=F.lit(first_day)))
                      & (F.col("ts") >= as_of - F.make_dt_interval(days=F.lit(last_day))))


def by_day(rows: DataFrame, files_per_day: int = 1) -> DataFrame:
    """Rows with their ``event_date``, dealt and sorted so that a write by day has few files and
    later reads skip files by date and row groups by agent. Hot days are spread over several files."""
    spread = F.pmod(F.xxhash64("agent_id", "event_id"), F.lit(files_per_day))
    return (rows.withColumn("event_date", F.to_date("ts"))
            .repartition("event_date", spread).sortWithinPartitions("event_date", "agent_id", "ts"))


def write_by_day(rows: DataFrame, path: str, files_per_day: int = 1) -> None:
    """Parquet partitioned by ``event_date``."""
    by_day(rows, files_per_day).write.mode("append").partitionBy("event_date").parquet(path)


def sampled_traces(spans: DataFrame, slow_ms: int = R.TRACE_SLOW_MS,
                   percent: int = R.TRACE_SAMPLE_PERCENT) -> DataFrame:
    """(trace_id, reason) of the traces to keep: any error, slow, or in the hash sample."""
    bucket = F.conv(F.substring(F.sha2("trace_id", 256), 1, 8), 16, 10).cast("bigint") % 100
    return (spans.groupBy("trace_id")
            .agg(F.bool_or(F.col("status_code") == 2).alias("error"),
                 ((F.max("end_ns") - F.min("start_ns")) / 1e6).alias("ms"))
            .withColumn("reason", F.when(F.col("error"), "error").when(F.col("ms") >= slow_ms, "slow")
                        .when(bucket < percent, "sampled"))
            .where(F.col("reason").isNotNull()).select("trace_id", "reason"))


def keep_sampled(spans: DataFrame, kept: DataFrame) -> DataFrame:
    return spans.join(kept, "trace_id", "left_semi")
