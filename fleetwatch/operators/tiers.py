"""Retention and tiers as jobs over tables partitioned by ``event_date``, either plain
folders or the hot and warm tables of one commit log."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import TableLog, partition_value
from .ingest import by_day, new_events
from .sequences import range_bucket, rank_rows, time_bucket

BLOCK = 1024


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def days_of(spark: SparkSession, path: str) -> list[date]:
    """The days that have a folder below ``path``."""
    at, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(date.fromisoformat(n.removeprefix("event_date=")) for n in names if n.startswith("event_date="))


def drop_days(spark: SparkSession, path: str, before: date) -> list[date]:
    """Deletes the folders of all days before ``before``; no row is read."""
    gone = [d for d in days_of(spark, path) if d < before]
    for d in gone:
        at, fs = _folder(spark, f"{path}/event_date={d}")
        fs.delete(at, True)
    return gone


def land(log: TableLog, rows: DataFrame, files_per_day: int = 1, writer: str | None = None,
         batch: int | None = None) -> None:
    """Adds rows to the hot table of the log; a repeated batch of a writer adds nothing."""
    log.commit({"hot": log.stage("hot", by_day(rows, files_per_day), "event_date")}, writer=writer, batch=batch)


def land_new(log: TableLog, incoming: DataFrame, files_per_day: int = 1, arrival: Sequence[str] = ("ts",)) -> None:
    """A12 against the tables of the log: the first write of an event_id wins, within the batch and against
    what is hot or warm. Only the days of the batch are looked at; the days prune the folders at run time."""
    first = new_events(incoming, arrival=arrival).withColumn("event_date", F.to_date("ts"))
    days = first.select("event_date").distinct()
    now = log.snapshot()
    for table in ("hot", "warm"):
        held = log.read(table, "event_id string, event_date date", now.of(table)).join(days, "event_date", "left_semi")
        first = first.join(held.select("event_date", "event_id"), ["event_date", "event_id"], "left_anti")
    log.commit({"hot": log.stage("hot", by_day(first.drop("event_date"), files_per_day), "event_date")})


def copy_new(source: TableLog, target: TableLog, table: str = "hot", files_per_day: int = 1) -> list[str]:
    """Copies what came since the last copy, whatever its timestamps. A folder of the source never
    changes, so the target marks the folders it holds, in the commit that adds their rows: late rows are
    copied once, folders that were copied before are not read, and a run that is cut copies nothing."""
    marks = f"copied-{table}"
    new = sorted(set(source.snapshot().of(table)) - set(target.snapshot().of(marks)))
    if new:
        rows = source.read(table, folders=new).drop("event_date")
        target.commit({table: target.stage(table, by_day(rows, files_per_day), "event_date"), marks: new})
    return new


def _old(folders: list[str], before: date) -> dict[str, date]:
    """The folders of days before ``before``. Rows without a day never grow old."""
    days = {f: partition_value(f, "event_date") for f in folders}
    known = {f: date.fromisoformat(d) for f, d in days.items() if d != "__HIVE_DEFAULT_PARTITION__"}
    return {f: d for f, d in known.items() if d < before}


def hot_days(log: TableLog, table: str = "hot") -> list[date]:
    return sorted(set(_old(log.snapshot().of(table), date.max).values()))


def expire(log: TableLog, before: date, table: str = "hot") -> list[date]:
    """All days before ``before`` leave the table; no row is read."""
    gone = _old(log.snapshot().of(table), before)
    if gone:
        log.commit({}, {table: list(gone)})
    return sorted(set(gone.values()))


def to_warm(log: TableLog, before: date, files_per_day: int = 1) -> list[date]:
    """Days before ``before`` leave the hot table as few, sorted files of the warm one. One
    commit adds the warm files and takes the hot ones away, so a row is in exactly one of them whatever
    is cut short, with or without an id. Rows that come meanwhile are in other folders and stay hot.
    A row whose event_id its warm day holds already is a repetition and is left out."""
    now = log.snapshot()
    moving = _old(now.of("hot"), before)
    if not moving:
        return []
    rows = log.read("hot", folders=list(moving))
    days = set(moving.values())
    held = [f for f, d in _old(now.of("warm"), before).items() if d in days]
    if held:
        known = log.read("warm", folders=held).select("event_date", "event_id")
        rows = rows.join(known, ["event_date", "event_id"], "left_anti")
    warm = log.stage("warm", by_day(rows.drop("event_date"), files_per_day), "event_date")
    log.commit({"warm": warm}, {"hot": list(moving)})
    return sorted(days)


def cold_summaries(rows: DataFrame, levels: int = 3) -> DataFrame:
    """(event_date, agent_id, events, cost, root): what stays of a day. ``root`` is the same
    for all agents of the day: hashes of the event ids in (ts, event_id) order, folded in
    blocks of 1024, ``levels`` times."""
    rows = rows.withColumn("event_date", F.to_date("ts"))
    nodes = rank_rows(rows.select("event_date", "ts", "event_id"), ["event_date"], time_bucket("ts", 60), ["ts", "event_id"], "pos") \
        .select("event_date", (F.col("pos") - 1).alias("pos"), F.sha2("event_id", 256).alias("hash"))
    for _ in range(levels):
        inside = F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda s: s["hash"])
        nodes = (nodes.groupBy("event_date", range_bucket("pos", BLOCK).alias("block")).agg(F.sha2(F.array_join(inside, ""), 256).alias("hash"))
                 .select("event_date", F.col("block").alias("pos"), "hash"))
    per_agent = rows.groupBy("event_date", "agent_id").agg(F.count(F.lit(1)).alias("events"), F.sum("cost_usd").alias("cost"))
    return per_agent.join(nodes.select("event_date", F.col("hash").alias("root")), "event_date")
