"""Signed ingest, the hot-tier copy and late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import tiers
from ..operators.commits import TableLog
from ..sources import otlp, signed
from .runner import batch_head, batch_tables, each_batch, earlier_batches, to_parquet, write_batch

WATERMARK = "10 minutes"


def envelope_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.schema(schemas.ENVELOPES)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def deduplicated(events: DataFrame, keys: list[str], delay: str = WATERMARK) -> DataFrame:
    """First arrival per key; state is dropped once the watermark has passed it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def signed_events(envelopes: DataFrame, pads: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Authentic envelopes, each (key, nonce) once, as task events."""
    ok = signed.accepted(signed.authenticity(envelopes, pads))
    once = ok.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["key_id", "nonce"])
    requests = once.select(F.col("envelope_id").alias("request_id"), "received_at", "body")
    return otlp.to_task_events(otlp.flatten(requests))


def copy_to_hot_tier(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append-only copy partitioned by day; the checkpoint makes it exactly-once."""
    return to_parquet(events.withColumn("event_date", F.to_date("ts")), path, checkpoint, ["event_date"])


def copy_to_hot_log(events: DataFrame, root: str, checkpoint: str, files_per_day: int = 1) -> TableLog:
    """S9 into the hot table of a commit log, from which ``tiers.to_warm`` moves old days: each
    batch is one commit, and a batch that comes again adds nothing."""
    log = TableLog(events.sparkSession, root)

    def land(batch: DataFrame, batch_id: int) -> None:
        if not log.is_done("hot", batch_id):
            tiers.land(log, batch, files_per_day, "hot", batch_id)

    each_batch(events, land, checkpoint)
    return log


def split_late(events: DataFrame, schema: str, path: str, late_path: str, checkpoint: str,
               delay_s: int = 600) -> None:
    """Rows older than the newest earlier row minus the delay go to their own table and
    are never dropped. Stateful operators read the table of the others as a stream, so their
    watermark, which never runs ahead of that limit, finds no late row."""
    spark = events.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        head = batch_head(spark, f"{path}-heads", batch_id, "newest timestamp")
        newest = head.select("newest").scalar()
        late = F.coalesce(F.col("ts") < newest - F.make_dt_interval(secs=F.lit(delay_s)), F.lit(False))
        write_batch(batch.where(~late), path, batch_id)
        write_batch(batch.where(late), late_path, batch_id)
        seen = batch.select("ts").unionByName(head.select(F.col("newest").alias("ts")))
        write_batch(seen.groupBy().agg(F.max("ts").alias("newest")), f"{path}-heads", batch_id)

    each_batch(events, land, checkpoint)


def landed_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``split_late`` found in time, as a stream."""
    return spark.readStream.schema(schema + ", batch_id bigint").parquet(path).drop("batch_id")


def signed_log(envelopes: DataFrame, pads: DataFrame, folder: str, checkpoint: str, files_per_day: int = 8) -> None:
    """S1 as tables below ``folder``, first write wins and nothing is lost: ``landed`` holds the
    accepted envelopes, ``rejected`` the others with their reason, ``events`` each event id once,
    ``known`` the ids that were there before.

    A nonce is looked up among the landed envelopes of the hours in question (an older replay
    fails the timestamp test), an event id among the events of its day, so what a batch reads
    does not grow with the life of the stream. Folders are by day, and each day is dealt to a few
    files. Checked envelopes and parsed events are stored once, since several tables are made of them, and only
    until the batch ends. Who came first is decided without the bodies; these are dealt out once, to the
    files of their day, where they meet the verdict, and those of rejected envelopes not at all."""
    spark = envelopes.sparkSession
    landed, events, known, rejected = (f"{folder}/{n}" for n in ("landed", "events", "known", "rejected"))
    day_of, hour_of = (lambda at: F.date_format(at, "yyyyMMdd").alias("day")), (lambda at: F.date_format(at, "yyyyMMddHH").alias("hour"))
    shifted = F.explode(F.array(*[F.col("received_at") + F.make_dt_interval(hours=F.lit(h)) for h in (-1, 0, 1)])).alias("at")

    def part(path: str, batch_id: int, schema: str, wanted: DataFrame) -> DataFrame:
        # the days (and hours) of the batch; the engine prunes the folders by them
        wanted = wanted.distinct()
        return earlier_batches(spark, path, batch_id, schema).join(wanted, wanted.columns, "left_semi")

    def by_day(rows: DataFrame, day: str, key: str) -> DataFrame:
        return rows.withColumn("_file", F.pmod(F.xxhash64(key), F.lit(files_per_day))).repartition(day, "_file")

    def land(batch: DataFrame, batch_id: int) -> None:
        with batch_tables(spark) as stored:
            write(batch, batch_id, stored)

    def write(batch: DataFrame, batch_id: int, stored: Callable[[DataFrame, str], DataFrame]) -> None:
        checked = signed.authenticity(batch, pads).select(
            "envelope_id", "key_id", "nonce", "received_at", "reason", F.when(F.col("reason").isNull(), F.col("body")).alias("body"))
        checked = stored(checked.withColumn("_row", F.monotonically_increasing_id()), "signed-checked")
        near = checked.select(shifted).select(day_of("at"), hour_of("at"))
        before = part(landed, batch_id, "key_id string, nonce string, hour string, day string", near) \
            .select("key_id", "nonce").distinct().withColumn("_seen", F.lit(True))
        verdicts = signed.first_arrivals(checked.drop("body")).join(before, ["key_id", "nonce"], "left").withColumn(
            "reason", F.when(F.col("reason").isNull() & F.col("_seen"), "replay").otherwise(F.col("reason"))).drop("_seen")
        verdicts = stored(verdicts, "signed-verdicts")
        write_batch(verdicts.where(F.col("reason").isNotNull()).select("envelope_id", "key_id", "received_at", "reason"),
                    rejected, batch_id)
        # both sides are dealt out alike, so they meet in the files of their day without another exchange
        good = by_day(signed.accepted(verdicts).select("_row", "nonce", day_of("received_at")), "day", "nonce").drop("nonce")
        bodies = by_day(signed.accepted(checked).select("*", hour_of("received_at"), day_of("received_at")), "day", "nonce")
        accepted = bodies.join(good, ["day", "_file", "_row"]).select(
            "envelope_id", "key_id", "nonce", "body", "received_at", "hour", "day")
        write_batch(accepted, landed, batch_id, "day")
        fresh = spark.read.schema("envelope_id string, body string, received_at timestamp").parquet(f"{landed}/batch_id={batch_id}") \
            .select("envelope_id", "body", "received_at")
        rows = otlp.to_task_events(otlp.flatten(fresh.withColumnRenamed("envelope_id", "request_id")))
        rest = [c for c in rows.columns if c not in ("event_id", "received_at")]
        rows = (rows.groupBy("event_id").agg(F.min(F.struct("received_at", *rest)).alias("r"), F.count(F.lit(1)).alias("n"))
                .select("event_id", "r.*", "n").withColumn("event_date", F.to_date("ts").cast("string")))
        rows = stored(rows, "signed-rows")
        old = part(events, batch_id, "event_id string, event_date string", rows.select("event_date")) \
            .select("event_id").withColumn("_known", F.lit(True))
        rows = rows.join(old, "event_id", "left")
        write_batch(rows.select("event_id", (F.col("n") - F.when(F.col("_known"), 0).otherwise(1)).alias("n"))
                    .where("n > 0"), known, batch_id)
        new = rows.where(F.col("_known").isNull()).drop("n", "_known")
        write_batch(by_day(new, "event_date", "event_id").drop("_file"), events, batch_id, "event_date")

    each_batch(envelopes, land, checkpoint)
