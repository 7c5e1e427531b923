"""Fleet views: the tables an operator looks at, for the whole fleet in one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.stats import ewma_card, jsd
from ..rules import severity_rank



def _errors() -> Column:
    return F.count_if(F.col("status") == "error")


def _ago(as_of: Column, hours: int) -> Column:
    return as_of - F.make_dt_interval(hours=F.lit(hours))


def _dollars(c: Column) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0)), 4).cast("double")


def summary(alarms: DataFrame, agents: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """G1: one row of fleet counters."""
    is_open = F.col("status") == "open"
    count = lambda df: df.groupBy().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return (alarms.groupBy()
            .agg(F.count_if(is_open).alias("open_alarms"),
                 F.count_if(is_open & (F.col("sla_deadline") < as_of)).alias("breached"))
            .withColumn("agents", count(agents))
            .withColumn("events_24h", count(tasks.where(F.col("ts") >= _ago(as_of, 24)))))


def open_by_severity(alarms: DataFrame) -> DataFrame:
    """Open alarms, most urgent first."""
    return (alarms.where(F.col("status") == "open").withColumn("rank", severity_rank())
            .orderBy("rank", "sla_deadline", "alarm_id"))


def hourly(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Tasks and errors of the last 24 hours by hour of day."""
    return (tasks.where(F.col("ts") >= _ago(as_of, 24)).groupBy(F.hour("ts").alias("hour"))
            .agg(F.count(F.lit(1)).alias("tasks"), _errors().alias("errors")))


def per_agent(agents: DataFrame, tasks: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Last-day and last-month figures of every agent, idle ones included, from a
    single pass over the month."""
    day = F.col("ts") >= _ago(as_of, 24)
    cost = F.col("cost_usd")
    agg = (tasks.where(F.col("ts") >= _ago(as_of, 24 * days)).groupBy("agent_id")
           .agg(F.count_if(day).alias("events"), _dollars(F.when(day, cost)).alias("cost"),
                F.count_if(day & (F.col("status") == "error")).alias("errors"),
                _dollars(cost).alias("cost_total")))
    return (agents.select("agent_id").join(agg, "agent_id", "left")
            .na.fill(0, ["events", "errors"]).na.fill(0.0, ["cost", "cost_total"]))


def per_agent_ranked(agents: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    return per_agent(agents, tasks, as_of).orderBy(F.desc("cost_total"), "agent_id")


def daily_series(tasks: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Cost, tokens, errors and tasks per agent and day, today included."""
    first = F.date_sub(F.to_date(as_of), days - 1)
    return (tasks.where(F.col("ts") >= first.cast("timestamp"))
            .groupBy("agent_id", F.to_date("ts").alias("day"))
            .agg(_dollars(F.col("cost_usd")).alias("cost"), F.sum("input_tokens").alias("tokens_in"),
                 F.sum("output_tokens").alias("tokens_out"), _errors().alias("errors"),
                 F.count(F.lit(1)).alias("tasks")))


def daily_tool_mix(guards: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Calls per agent, day and tool."""
    first = F.date_sub(F.to_date(as_of), days - 1)
    return (guards.where((F.col("event_type") == "tool_call")
                         & (F.col("ts") >= first.cast("timestamp")))
            .groupBy("agent_id", F.to_date("ts").alias("day"), "tool_name")
            .agg(F.count(F.lit(1)).alias("calls")))


def daily_jsd(mix: DataFrame, reference_days: int = 6) -> DataFrame:
    """Divergence of each day's tool mix from the up to six observed days before it.

    Each observed day is sent to itself and to the days that look back on it (a fixed
    fan-out over the already counted mix), then one grouped divergence does the rest."""
    w = W.partitionBy("agent_id").orderBy("day")
    days = (mix.select("agent_id", "day").distinct()
            .withColumn("i", F.row_number().over(w)))
    numbered = mix.join(days, ["agent_id", "day"])
    spread = numbered.select(
        "agent_id", "tool_name", "calls", "i",
        F.explode(F.sequence(F.lit(0), F.lit(reference_days))).alias("ahead"))
    spread = spread.select(
        "agent_id", "tool_name", (F.col("i") + F.col("ahead")).alias("i"),
        F.when(F.col("ahead") > 0, F.col("calls")).otherwise(0).alias("before"),
        F.when(F.col("ahead") == 0, F.col("calls")).otherwise(0).alias("today"))
    out = jsd(spread, ["agent_id", "i"], "tool_name", "before", "today")
    return out.join(days, ["agent_id", "i"]).select("agent_id", "day", "jsd", "band")


def daily_z(series: DataFrame) -> DataFrame:
    """Control-card z for display, armed after three days."""
    return ewma_card(series, ["agent_id"], "day", "cost", min_obs=3)


def _newest(rows: DataFrame, k: int, order: list[Column], keep: list[str], out: str) -> DataFrame:
    """k rows per agent as an array. The row-number limit is applied on the map side first,
    so a hot agent sends k rows per task and not its history."""
    top = (rows.withColumn("_rn", F.row_number().over(W.partitionBy("agent_id").orderBy(*order)))
           .where(F.col("_rn") <= k))
    return (top.groupBy("agent_id")
            .agg(F.sort_array(F.collect_list(F.struct("_rn", *keep))).alias(out)))


def agent_state(agents: DataFrame, tasks: DataFrame, guards: DataFrame, alarms: DataFrame,
                tickets: DataFrame, calibration: DataFrame, as_of: Column,
                all_time_tools: bool = False) -> DataFrame:
    """Everything one agent page shows, for all agents."""
    is_open = F.count_if(F.col("status") == "open")
    calls = guards.where(F.col("event_type") == "tool_call")
    if not all_time_tools:
        calls = calls.where(F.col("ts") >= _ago(as_of, 24 * 7))
    mix = calls.groupBy("agent_id", "tool_name").agg(F.count(F.lit(1)).alias("calls"))
    tools = _newest(mix, 8, [F.desc("calls"), F.col("tool_name")], ["tool_name", "calls"], "tools")
    last_alarms = _newest(alarms, 10, [F.desc("created_at"), F.col("alarm_id")],
                          ["signal", "severity", "status", "created_at", "resolved_at"], "recent_alarms")
    last_tickets = _newest(tickets, 10, [F.desc("created_at"), F.col("escalation_id")],
                           ["trigger_metric", "trigger_value", "reason", "status", "created_at"],
                           "recent_tickets")
    state = F.when(F.col("closed"), "calibrated").when(
        F.col("calibration_until").isNotNull(),
        F.concat(F.lit("calibrating until "), F.date_format("calibration_until", "yyyy-MM-dd HH:mm"))
    ).otherwise("unknown")
    return (per_agent(agents, tasks, as_of)
            .join(alarms.groupBy("agent_id").agg(is_open.alias("open_alarms")), "agent_id", "left")
            .join(tickets.groupBy("agent_id").agg(is_open.alias("open_tickets")), "agent_id", "left")
            .join(calibration.select("agent_id", "calibration_until", "closed"), "agent_id", "left")
            .join(tools, "agent_id", "left").join(last_alarms, "agent_id", "left")
            .join(last_tickets, "agent_id", "left")
            .na.fill(0, ["open_alarms", "open_tickets"])
            .withColumn("calibration", state).drop("calibration_until", "closed"))


def agent_health(agent_id: str, agents: DataFrame, tasks: DataFrame, guards: DataFrame,
                 alarms: DataFrame, tickets: DataFrame, calibration: DataFrame,
                 as_of: Column) -> DataFrame:
    """One agent's state; the filter reaches every scan, an unknown agent gives no row."""
    only = lambda df: df.where(F.col("agent_id") == agent_id)
    who = only(agents)
    return who.select("agent_id", "fleet_name", "role", F.col("status").alias("agent_status")).join(
        agent_state(who, only(tasks), only(guards), only(alarms), only(tickets),
                    only(calibration), as_of), "agent_id")


def attribution_queue(suggestions: DataFrame, alarms: DataFrame, k: int = 12) -> DataFrame:
    """The k most confident suggestions that wait for a verdict."""
    a = alarms.select("alarm_id", "agent_id", "signal", "severity", "status")
    return (suggestions.where(F.col("confirmed").isNull()).join(a, "alarm_id")
            .orderBy(F.desc("confidence"), "alarm_id").limit(k))


def sla_countdown(alarms: DataFrame, as_of: Column) -> DataFrame:
    """Seconds to the deadline of each open alarm, negative once breached, and a label."""
    left = F.call_function("div", F.unix_micros("sla_deadline") - F.unix_micros(as_of), F.lit(1_000_000))
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    s, late = F.col("seconds_left"), -F.col("seconds_left")
    hm = lambda c: F.format_string("%dh %02dm", div(c, 3600), div(c % 3600, 60))
    return (alarms.where(F.col("status") == "open").withColumn("seconds_left", left)
            .withColumn("label", F.when(s < 0, F.concat(F.lit("BREACHED "), hm(late), F.lit(" ago")))
                        .when(s >= 48 * 3600, F.format_string(
                            "%dd %dh left", div(s, 86_400), div(s % 86_400, 3600)))
                        .otherwise(F.concat(hm(s), F.lit(" left")))))


def calibration_table(calibration: DataFrame, as_of: Column) -> DataFrame:
    """Calibration state with whole days left, open windows first."""
    left = F.floor((F.unix_micros("calibration_until") - F.unix_micros(as_of)) / 8.64e10)
    return (calibration
            .withColumn("days_left", F.when(~F.col("closed"), F.greatest(left, F.lit(0))))
            .withColumn("state", F.when(F.col("closed"), "calibrated").otherwise("calibrating"))
            .orderBy("closed", "agent_id"))


def active_agents(tasks: DataFrame, since: Column, k: int = 1) -> DataFrame:
    """Agents with recent tasks, for the page's picker."""
    return (tasks.where(F.col("ts") >= since).groupBy("agent_id")
            .agg(F.count(F.lit(1)).alias("tasks")).orderBy(F.desc("tasks"), "agent_id").limit(k))


def newest_rows(rows: DataFrame, order: list[str], k: int = 12) -> DataFrame:
    """Recent subjects or custody rows."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(k)


def window_count(tasks: DataFrame, since: Column) -> DataFrame:
    """G26."""
    return tasks.where(F.col("ts") >= since).agg(F.count(F.lit(1)).alias("c"))


def agent_totals(tasks: DataFrame, since: Column) -> DataFrame:
    """Count, cost and errors per agent since a date, fleet-wide."""
    return (tasks.where(F.col("ts") >= since).groupBy("agent_id")
            .agg(F.count(F.lit(1)).alias("c"), _dollars(F.col("cost_usd")).alias("s"),
                 _errors().alias("e")))


def agent_days(tasks: DataFrame, since: Column) -> DataFrame:
    """Cost, tasks and errors per agent and day."""
    return (tasks.where(F.col("ts") >= since).groupBy("agent_id", F.to_date("ts").alias("d"))
            .agg(_dollars(F.col("cost_usd")).alias("cost"), F.count(F.lit(1)).alias("tasks"),
                 _errors().alias("e")))


def status_counts(tasks: DataFrame) -> DataFrame:
    """G25."""
    return tasks.groupBy("agent_id", "status").agg(F.count(F.lit(1)).alias("n"))


def top_tasks(tasks: DataFrame, k: int = 5) -> DataFrame:
    """The k most expensive tasks of every agent."""
    cost = tasks.groupBy("agent_id", "task_id").agg(_dollars(F.col("cost_usd")).alias("cost"))
    w = W.partitionBy("agent_id").orderBy(F.desc("cost"), "task_id")
    return (cost.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
