"""Behavioural facts per agent, for the whole fleet in one plan.

Windows end at each agent's newest event, so the anchor is a partial aggregate joined
back to the rows; the engine broadcasts it when it is small and splits skewed agents
when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.hashing import call_signature
from ..functions.text import canonical_json, classify_error
from .sequences import previous_values, rank_rows, time_bucket
from .stats import ewma_card, jsd

# A task's calls lie close together; a template's runs are few keys with many rows.
SEQUENCE_BUCKET_S = 600
TEMPLATE_BUCKET_S = 60
_DAY_S = 86_400


def seconds(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n).cast("decimal(18,6)"))


def latest_activity(rows: DataFrame) -> DataFrame:
    """Newest row per agent."""
    return rows.groupBy("agent_id").agg(F.max("ts").alias("latest"))


def activity_anchors(tasks: DataFrame, guards: DataFrame) -> DataFrame:
    """The three anchors per agent: tasks, guard events, permission decisions."""
    long = (tasks.select("agent_id", F.lit("task").alias("src"), "ts")
            .unionByName(guards.select(
                "agent_id", F.when(F.col("event_type") == "permission_decision", "decision")
                .otherwise("guard").alias("src"), "ts")))
    newest = lambda *s: F.max(F.when(F.col("src").isin(*s), F.col("ts")))
    return long.groupBy("agent_id").agg(
        newest("task").alias("task_latest"), newest("guard", "decision").alias("guard_latest"),
        newest("decision").alias("decision_latest"))


def _recent(rows: DataFrame, window_s: float, anchor_rows: DataFrame | None = None) -> DataFrame:
    anchors = latest_activity(rows if anchor_rows is None else anchor_rows)
    return (rows.join(anchors, "agent_id")
            .where(F.col("ts") >= F.col("latest") - seconds(window_s)))


def _ratio(rows: DataFrame, hit: Column, limit: float) -> DataFrame:
    return (rows.groupBy("agent_id")
            .agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total"))
            .withColumn("value", F.col("hits") / F.col("total"))
            .withColumn("fired", F.col("value") > limit))


def error_rate(tasks: DataFrame, window_s: float = R.ERROR_WINDOW_S,
               limit: float = R.ERROR_RATE_LIMIT) -> DataFrame:
    """B1: share of errors among ok and error tasks in the window up to the newest task."""
    counted = tasks.where(F.col("status").isin("ok", "error"))
    return _ratio(_recent(counted, window_s, tasks), F.col("status") == "error", limit)


def deny_ratio(guards: DataFrame, window_s: float = R.DENY_WINDOW_S,
               limit: float = R.DENY_RATIO_LIMIT) -> DataFrame:
    """B2: share of denials among permission decisions up to the newest decision."""
    decisions = guards.where(F.col("event_type") == "permission_decision")
    return _ratio(_recent(decisions, window_s), F.col("decision").eqNullSafe("deny"), limit)


def retries(tasks: DataFrame, limit: int = R.RETRY_LIMIT) -> DataFrame:
    """Most retries of any task."""
    return (tasks.groupBy("agent_id").agg(F.max("retry_count").cast("double").alias("value"))
            .withColumn("fired", F.coalesce(F.col("value") >= limit, F.lit(False))))


def ticket_age(tickets: DataFrame, as_of: Column, limit_h: float = R.TICKET_AGE_LIMIT_H) -> DataFrame:
    """B4, per agent: age in hours of its oldest open ticket."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.min("created_at"))) / 3.6e9
    return (tickets.where((F.col("status") == "open") & F.col("created_at").isNotNull())
            .groupBy("agent_id").agg(age.alias("value"))
            .withColumn("fired", F.col("value") > limit_h))


def fleet_ticket_age(tickets: DataFrame, as_of: Column,
                     limit_h: float = R.TICKET_AGE_LIMIT_H) -> DataFrame:
    """The oldest open ticket of the fleet, one row (value, fired)."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.min("created_at"))) / 3.6e9
    return (tickets.where(F.col("status") == "open").groupBy().agg(age.alias("value"))
            .withColumn("fired", F.coalesce(F.col("value") > limit_h, F.lit(False))))


def tool_windows(guards: DataFrame, recent_h: int = 24, prior_days: int = 7) -> DataFrame:
    """Calls per agent and tool in (latest-24h, latest] and in the seven days before,
    both from one pass."""
    day = F.col("latest") - seconds(recent_h * 3600)
    week = day - seconds(prior_days * _DAY_S)
    calls = (guards.where(F.col("event_type") == "tool_call")
             .join(latest_activity(guards), "agent_id").where(F.col("ts") > week))
    return calls.groupBy("agent_id", "tool_name").agg(
        F.count_if(F.col("ts") <= day).alias("prior"),
        F.count_if(F.col("ts") > day).alias("recent"))


def tool_drift(guards: DataFrame, recent_h: int = 24, prior_days: int = 7) -> DataFrame:
    """Divergence of the recent tool mix from the prior one."""
    return (jsd(tool_windows(guards, recent_h, prior_days), ["agent_id"], "tool_name",
                "prior", "recent")
            .withColumn("fired", F.col("band") == "alarm"))


def _calls(guards: DataFrame) -> DataFrame:
    """Calls with their signature, which rows that were stored may bring along."""
    sig = F.col("_sig") if "_sig" in guards.columns else call_signature(F.col("tool_name"), F.col("arguments_json"))
    return (guards.where(F.col("event_type") == "tool_call")
            .select("task_id", "agent_id", "ts", "event_id", "tool_name", sig.alias("sig")))


def loop_openings(guards: DataFrame, bucket_s: int = SEQUENCE_BUCKET_S,
                  also: Sequence[str] = ("agent_id", "tool_name")) -> DataFrame:
    """Per task, the first call that is the third equal one in a row, with its columns ``also``."""
    calls = _calls(guards).select("task_id", "ts", "event_id", "sig", *also)
    seq = previous_values(calls, ["task_id"], time_bucket("ts", bucket_s),
                          ["ts", "event_id"], "sig", R.LOOP_RUN - 1)
    third = seq.where((F.col("sig") == F.col("prev_1")) & (F.col("sig") == F.col("prev_2")))
    first = F.min(F.struct("ts", "event_id", *also))
    return (third.groupBy("task_id").agg(first.alias("o"))
            .select("task_id", F.col("o.ts").alias("opened_at"), F.col("o.event_id"),
                    *[F.col(f"o.{c}") for c in also]))


def looped_tasks(guards: DataFrame, opened: DataFrame) -> DataFrame:
    """(agent_id, task_id) of agents with calls at or after the opening of a task."""
    o = opened.select("task_id", F.struct("opened_at", F.col("event_id").alias("opened_event")).alias("o"))
    calls = guards.where(F.col("event_type") == "tool_call").join(o, "task_id")
    after = ((F.col("ts") > F.col("o.opened_at"))
             | ((F.col("ts") == F.col("o.opened_at"))
                & (F.col("event_id") >= F.col("o.opened_event"))))
    return calls.where(after).select("agent_id", "task_id").distinct()


def loop_hits(guards: DataFrame, bucket_s: int = SEQUENCE_BUCKET_S) -> DataFrame:
    """Agents with calls at or after the opening of a task, with the number of tasks."""
    return (looped_tasks(guards, loop_openings(guards, bucket_s))
            .groupBy("agent_id").agg(F.count(F.lit(1)).alias("looped_tasks")))


def classified_errors(tasks: DataFrame) -> DataFrame:
    """Tasks with an error text and their class."""
    return (tasks.where(F.col("error_class").isNotNull() & (F.col("error_class") != ""))
            .withColumn("class", classify_error(F.col("error_class"),
                                                F.col("status") == "quarantined")))


def new_error_classes(tasks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """First time an agent shows a class that is neither mechanical nor a loop.
    ``seen`` (agent_id, class) holds what earlier runs recorded."""
    fresh = (classified_errors(tasks)
             .where(~F.col("class").isin("loop", *R.PRESEEN_CLASSES))
             .groupBy("agent_id", "class")
             .agg(F.min("ts").alias("first_seen"), F.count(F.lit(1)).alias("n")))
    return fresh if seen is None else fresh.join(seen, ["agent_id", "class"], "left_anti")


def daily_cost(tasks: DataFrame) -> DataFrame:
    """Cost per agent and day; decimals are summed exactly."""
    return (tasks.groupBy("agent_id", F.to_date("ts").alias("day"))
            .agg(F.sum("cost_usd").cast("double").alias("cost")))


def cost_spikes(costs: DataFrame, min_obs: int = R.EWMA_WARMUP,
                calibrated: str | None = None) -> DataFrame:
    """The control card with ``fired`` on days that alarm and cost more than twice
    the moving mean."""
    return (ewma_card(costs, ["agent_id"], "day", "cost", min_obs, calibrated)
            .withColumn("fired", F.col("alarm") & (F.col("mu") > 0)
                        & (F.col("cost") > F.col("mu") * R.COST_MULTIPLE)))


def end_state_divergence(tasks: DataFrame, bucket_s: int = TEMPLATE_BUCKET_S) -> DataFrame:
    """Runs whose end state differs from the previous run of the same template. Few
    templates carry all runs, so each is cut by time."""
    runs = (tasks.where(F.coalesce(F.length("task_template"), F.lit(0)) > 0)
            .where(F.coalesce(F.length("end_state_json"), F.lit(0)) > 0)
            .select("task_template", "agent_id", "event_id", "ts",
                    F.coalesce(canonical_json(F.col("end_state_json")),
                               F.col("end_state_json")).alias("end_state")))
    seq = previous_values(runs, ["task_template"], time_bucket("ts", bucket_s),
                          ["ts", "event_id"], "end_state")
    return (seq.withColumnRenamed("prev_1", "reference")
            .withColumn("diverged", F.coalesce(F.col("end_state") != F.col("reference"),
                                               F.lit(False))))


def shadow_budget(traffic: DataFrame, keys: list[str], rerun: Column) -> DataFrame:
    """Per key, ordinary events, reruns, share and whether one more rerun is allowed.
    No traffic means no proof of budget, hence not allowed."""
    share = F.col("reruns") / F.when(F.col("events") > 0, F.col("events"))
    one_more = (F.col("reruns") + 1) / F.when(F.col("events") > 0, F.col("events"))
    return (traffic.groupBy(*keys)
            .agg(F.count_if(~rerun).alias("events"), F.count_if(rerun).alias("reruns"))
            .withColumn("share", share)
            .withColumn("allowed", F.coalesce(one_more <= R.SHADOW_BUDGET, F.lit(False))))


def shadow_overruns(traffic: DataFrame, keys: list[str], rerun: Column,
                    bucket_s: int = SEQUENCE_BUCKET_S) -> DataFrame:
    """The reruns that pushed the share of their key over the budget."""
    totals = traffic.groupBy(*keys).agg(F.count_if(~rerun).alias("events"))
    ranked = rank_rows(traffic.where(rerun), keys, time_bucket("ts", bucket_s),
                       ["ts", "event_id"], "nth")
    return (ranked.join(totals, keys).where(F.col("events") > 0)
            .where(F.col("nth") / F.col("events") > R.SHADOW_BUDGET))


def false_positive_budget(cycles: DataFrame) -> DataFrame:
    """Share of false positives per agent-day of hourly cycles, within 5 %."""
    return (cycles.groupBy("agent_id", "day")
            .agg(F.count(F.lit(1)).alias("cycles"),
                 F.count_if("false_positive").alias("false_positives"))
            .withColumn("ratio", F.coalesce(F.col("false_positives") / F.col("cycles"), F.lit(0.0)))
            .withColumn("within_budget", F.col("ratio") <= R.FALSE_POSITIVE_BUDGET))
