"""The facts as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import rules as R
from ..functions.hashing import call_signature
from ..operators import alarms as alarm_ops
from ..operators import facts, ledger
from ..operators.commits import TableLog
from .ingest import WATERMARK
from .runner import each_batch, earlier_batches, write_batch

ALARM_ROWS = ("alarm_id string, agent_id string, signal string, event_type string, reason string,"
              " severity string, sla_hours double, sla_deadline timestamp, trigger_value double,"
              " protection string, status string, created_at timestamp")
LEDGER_ROWS = ("seq bigint, event_type string, payload_hash string, prev_hash string,"
               " signature binary, created_at timestamp, source_id string")


def sliding_error_rate(tasks: DataFrame, length: str = "24 seconds", slide: str = "1 second",
                       delay: str = WATERMARK) -> DataFrame:
    """Error share per agent and sliding window, emitted once the window has closed."""
    return (tasks.where(F.col("status").isin("ok", "error")).withWatermark("ts", delay)
            .groupBy(F.window("ts", length, slide).alias("w"), "agent_id")
            .agg(F.count_if(F.col("status") == "error").alias("hits"), F.count(F.lit(1)).alias("total"))
            .select("agent_id", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "hits", "total",
                    (F.col("hits") / F.col("total")).alias("value")))


def daily_costs(tasks: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Closed agent-days of a task stream."""
    return (tasks.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "agent_id")
            .agg(F.sum("cost_usd").cast("double").alias("cost"))
            .select("agent_id", F.col("w.start").alias("day"), "cost"))


class _CostCard(StatefulProcessor):
    """Control-card state of one agent: mean, variance, count and the first day."""

    def __init__(self, min_obs: int, calibration_days: int):
        self.min_obs, self.calibration = max(min_obs, 1), pd.Timedelta(days=calibration_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.card = handle.getValueState("card", "mu double, s2 double, n bigint, first_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("day")
        mu, s2, n, first_us = self.card.get() if self.card.exists() else (0.0, 0.0, 0, None)
        out = []
        for day, cost in zip(days["day"], days["cost"]):
            first_us = first_us if first_us is not None else int(day.value // 1000)
            if n == 0:
                mu, s2 = cost, 0.0
            else:
                mu = R.EWMA_ALPHA * cost + (1 - R.EWMA_ALPHA) * mu
                s2 = R.EWMA_BETA * (cost - mu) ** 2 + (1 - R.EWMA_BETA) * s2
            n += 1
            closed = day >= pd.Timestamp(first_us, unit="us") + self.calibration
            armed = bool(n >= self.min_obs and closed and s2 > 0)
            z = (cost - mu) / s2 ** 0.5 if armed else float("nan")
            fired = armed and z > R.EWMA_Z_LIMIT and mu > 0 and cost > R.COST_MULTIPLE * mu
            out.append((key[0], day, cost, n, mu, z, armed, fired))
        self.card.update((float(mu), float(s2), int(n), int(first_us)))
        yield pd.DataFrame(out, columns=["agent_id", "day", "cost", "n", "mu", "z", "armed", "fired"])

    def close(self) -> None:
        pass


def cost_card(tasks: DataFrame, min_obs: int = R.EWMA_WARMUP, calibration_days: int = R.CALIBRATION_DAYS,
              delay: str = WATERMARK) -> DataFrame:
    """S3: the control card of closed agent-days; alarms wait for the end of the agent's
    calibration, counted in event time from its first day. One small row per agent-day
    reaches the state, not the traffic."""
    schema = ("agent_id string, day timestamp, cost double, n bigint, mu double, z double,"
              " armed boolean, fired boolean")
    return daily_costs(tasks, delay).groupBy("agent_id").transformWithStateInPandas(
        _CostCard(min_obs, calibration_days), outputStructType=schema, outputMode="Append", timeMode="None")


class _Calibration(StatefulProcessor):
    """End of the calibration window of one agent, kept until a timer reports it."""

    def __init__(self, days: int):
        self.length_ms = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until timestamp")

    def _wait(self, until: pd.Timestamp) -> None:
        self.until.update((until.to_pydatetime(),))
        self.handle.registerTimer(-(-until.value // 1_000_000))

    def handleInitialState(self, key, known: pd.DataFrame, timerValues) -> None:
        self._wait(pd.Timestamp(known["calibration_until"].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(pd.Timestamp(r["first"].min()) for r in rows)
        if not self.until.exists():
            self._wait(first + pd.Timedelta(milliseconds=self.length_ms))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"agent_id": [key[0]], "calibration_until": [pd.Timestamp(self.until.get()[0])]})

    def close(self) -> None:
        pass


def calibration_ends(events: DataFrame, days: int = R.CALIBRATION_DAYS, known: DataFrame | None = None,
                     delay: str = WATERMARK) -> DataFrame:
    """(agent_id, calibration_until) once per agent, by an event-time timer: as soon as the
    watermark, which every agent's events move, passes the end of the window. A silent agent needs no
    event of its own. The window counts from the agent's first event, or is given by ``known``, the state
    of a batch evaluation. One row per agent and hour reaches the state, not the traffic."""
    first = (events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "agent_id")
             .agg(F.min("ts").alias("first")).select("agent_id", "first", F.window_time("w").alias("at")))
    if known is not None:
        known = known.select("agent_id", "calibration_until").groupBy("agent_id")
    return first.groupBy("agent_id").transformWithStateInPandas(
        _Calibration(days), outputStructType="agent_id string, calibration_until timestamp",
        outputMode="Append", timeMode="EventTime", initialState=known)


RUN_ROWS = ("task_id string, minute bigint, first_ts timestamp, n bigint, head_sig string, head bigint,"
            " head_calls array<struct<ts:timestamp,event_id:string,agent_id:string,tool_name:string>>,"
            " tail_sig string, tail bigint, hit struct<ts:timestamp,event_id:string,agent_id:string,tool_name:string>")


def call_runs(guards: DataFrame, run: int = R.LOOP_RUN) -> DataFrame:
    """One row per task and minute of calls: the first run of equal calls (signature, length and
    the calls that could complete a run from before), the last run, and the first call that completes
    a run inside the minute. Minutes of a task in order give its runs; a task with a third of all
    calls is as many rows as it has minutes."""
    calls = guards.where(F.col("event_type") == "tool_call").select(
        "task_id", F.call_function("div", F.unix_seconds("ts"), F.lit(60)).alias("minute"), "ts", "event_id", "agent_id", "tool_name",
        call_signature(F.col("tool_name"), F.col("arguments_json")).alias("sig"))
    order = W.partitionBy("task_id", "minute").orderBy("ts", "event_id")
    new = ~F.coalesce(F.col("sig") == F.lag("sig").over(order), F.lit(False))
    placed = (calls.withColumn("nth", F.row_number().over(order)).withColumn("start", F.when(new, F.col("nth")))
              .withColumn("start", F.max("start").over(order)))
    length = F.col("nth") - F.col("start") + 1
    call = F.struct("ts", "event_id", "agent_id", "tool_name")
    head = F.col("start") == 1
    early = F.when(head & (F.col("nth") < run), F.struct("nth", call.alias("call")))
    return placed.groupBy("task_id", "minute").agg(
        F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"), F.min_by("sig", "nth").alias("head_sig"), F.count_if(head).alias("head"),
        F.transform(F.sort_array(F.collect_list(early)), lambda x: x["call"]).alias("head_calls"),
        F.max_by("sig", "nth").alias("tail_sig"), F.max_by(length, "nth").cast("bigint").alias("tail"),
        F.min(F.when(length >= run, call)).alias("hit"))


def land_runs(guards: DataFrame, path: str, checkpoint: str) -> None:
    """S4, first half: the runs of each micro-batch, found by Spark and stored under its batch id."""
    each_batch(guards, lambda batch, batch_id: write_batch(call_runs(batch), path, batch_id), checkpoint)


def run_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(f"{RUN_ROWS}, batch_id bigint").parquet(path)


class _LoopBreaker(StatefulProcessor):
    """Last signature, run length and opening mark of one task."""

    def __init__(self, run: int, ttl_ms: int | None):
        self.run, self.ttl_ms = run, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "sig string, run bigint, opened boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sig, length, opened = self.tail.get() or (None, 0, False)
        if opened:
            return
        # what has no time comes last
        for m in sorted(rows, key=lambda m: (m.minute is None, m.minute or 0, m.first_us or 0)):
            joins = sig is not None and sig == m.head_sig
            call = m.hit
            if joins and length + m.head >= self.run:
                call = m.head_calls[max(0, self.run - length - 1)]
            if call is not None:
                self.tail.update((m.tail_sig, m.tail, True))
                yield Row(task_id=key[0], opened_us=call["us"], event_id=call["event_id"], agent_id=call["agent_id"], tool_name=call["tool_name"])
                return
            sig, length = m.tail_sig, m.tail + (length if joins and m.head == m.n else 0)
        self.tail.update((sig, length, False))

    def close(self) -> None:
        pass


def loop_openings(runs: DataFrame, ttl_ms: int | None = 7 * 86_400_000) -> DataFrame:
    """S4, second half: the call that opens the breaker of a task, at most once per task, from
    the stream of its runs. State and Python see one row per task and minute, never the calls; the
    state of a task is one row and goes ``ttl_ms`` after its last change (None: never), a week by default. Run it with
    ``idle_batches=False`` where the run should end with its input. Tasks are many and short, so the processor
    takes single rows, not a pandas frame per task; times pass as microseconds, whatever the time zone."""
    us = lambda c: F.struct(F.unix_micros(c["ts"]).alias("us"), c["event_id"], c["agent_id"], c["tool_name"])
    short = runs.select("task_id", "minute", F.unix_micros("first_ts").alias("first_us"), "n", "head_sig", "head",
                        F.transform("head_calls", us).alias("head_calls"), "tail_sig", "tail",
                        F.when(F.col("hit").isNotNull(), us(F.col("hit"))).alias("hit"))
    schema = "task_id string, opened_us bigint, event_id string, agent_id string, tool_name string"
    return short.groupBy("task_id").transformWithState(
        _LoopBreaker(R.LOOP_RUN, ttl_ms), outputStructType=schema, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None").select(
            "task_id", F.timestamp_micros("opened_us").alias("opened_at"), "event_id", "agent_id", "tool_name")


def new_class_log(tasks: DataFrame, path: str, checkpoint: str) -> None:
    """(agent_id, class, first_seen, n) once per agent and class, against all earlier
    batches."""
    spark = tasks.sparkSession
    schema = "agent_id string, class string, first_seen timestamp, n bigint"

    def land(batch: DataFrame, batch_id: int) -> None:
        seen = earlier_batches(spark, path, batch_id, schema)
        write_batch(facts.new_error_classes(batch, seen), path, batch_id)

    each_batch(tasks, land, checkpoint)


def alarm_log(fired: DataFrame, rules: DataFrame, root: str, checkpoint: str) -> None:
    """Fired facts (agent_id, signal, value, ts) as alarms, one per agent, signal and
    hour, each with its ledger entry. Alarms, ledger rows and the head of the chain of a batch are one
    commit below ``root``, so no reader ever finds an alarm without its entry or the other way round,
    wherever a run is cut. The stored alarms decide what is new, however late a fact comes; only
    those of the batch's own days are read. A repeated batch finds that it is done.
    The stream is the only ledger writer."""
    spark = fired.sparkSession
    log = TableLog(spark, root)

    def land(batch: DataFrame, batch_id: int) -> None:
        now = log.snapshot()
        if now.done.get("alarms", -1) >= batch_id:
            return
        mapped = alarm_ops.map_to_alarms(batch.withColumn("fired", F.lit(True)), rules)
        days = batch.select(F.to_date("ts").alias("event_date")).distinct()
        stored = log.read("alarms", f"{ALARM_ROWS}, event_date date", now.of("alarms")).join(days, "event_date", "left_semi")
        rows = alarm_ops.raise_alarms(mapped, F.col("ts"), stored.drop("event_date"))
        alarms = log.stage("alarms", rows.withColumn("event_date", F.to_date("created_at")), "event_date")
        new = log.read("alarms", f"{ALARM_ROWS}, event_date date", alarms).drop("event_date")
        head = log.read("heads", "seq bigint, payload_hash string", now.of("heads"))
        entries = log.stage("ledger", ledger.append(alarm_ops.raise_events(new), head=head))
        chain = log.read("ledger", LEDGER_ROWS, entries).select("seq", "payload_hash")
        heads = log.stage("heads", ledger.chain_head(chain.unionByName(head)))
        log.commit({"alarms": alarms, "ledger": entries, "heads": heads}, {"heads": now.of("heads")}, "alarms", batch_id)

    each_batch(fired, land, checkpoint)


def alarm_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(alarms, ledger) as committed below ``root``."""
    log = TableLog(spark, root)
    now = log.snapshot()
    return (log.read("alarms", f"{ALARM_ROWS}, event_date date", now.of("alarms")).drop("event_date"),
            log.read("ledger", LEDGER_ROWS, now.of("ledger")))


def escalate_aged_tickets(tickets: DataFrame, rules: DataFrame, as_of: Column,
                          stored: DataFrame | None = None) -> DataFrame:
    """The periodic job that turns tickets open for too long into alarms."""
    aged = facts.ticket_age(tickets, as_of).withColumn("signal", F.lit("escalation.age_max>24"))
    return alarm_ops.raise_alarms(alarm_ops.map_to_alarms(aged, rules), as_of, stored)
