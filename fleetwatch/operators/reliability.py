"""Reliability measures, further metric thresholds, masking and baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .facts import latest_activity, seconds
from .sequences import time_bucket
from .stats import ewma_card, grouped_mad, grouped_median, wide_mad_z

_DAY_S = 86_400


def pass_hat_k(attempts: DataFrame, keys: list[str], success: Column, k: int = 5) -> DataFrame:
    """Chance that k replays drawn from a class's replays all succeed, C(c,k)/C(n,k);
    null for classes with fewer than k replays."""
    n, c = F.col("n"), F.col("successes")
    draws = reduce(lambda a, b: a * b, [(c - i) / (n - i) for i in range(k)])
    return (attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("successes"))
            .withColumn("pass_k", F.when(n >= k, F.when(c < k, F.lit(0.0)).otherwise(draws))))


def variation(runs: DataFrame, keys: list[str], value: str, out: str = "cv") -> DataFrame:
    """Population coefficient of variation."""
    v = F.col(value).cast("double")
    mean = F.avg(v)
    return runs.groupBy(*keys).agg((F.stddev_pop(v) / F.when(mean != 0, mean)).alias(out))


def fault_curve(attempts: DataFrame, rate: str, success: Column) -> DataFrame:
    """Success by injected fault rate and its drop, in points, against the lowest rate."""
    by_rate = attempts.groupBy(rate).agg(F.avg(F.when(success, 1.0).otherwise(0.0)).alias("success"))
    base = by_rate.groupBy().agg(F.min_by("success", rate).alias("b")).scalar()
    return by_rate.withColumn("drop_points", (base - F.col("success")) * 100)


def recovery_times(tasks: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Per failed task, seconds until the agent's next good one; null when there is none.
    The next good task is looked up inside the hour and then in the following hours'
    earliest good tasks, so a busy agent is not ordered in one piece."""
    good = F.when(F.col("status") == "ok", F.col("ts"))
    rows = tasks.select("agent_id", "event_id", "status", "ts", time_bucket("ts", bucket_s).alias("_b"))
    ahead = (W.partitionBy("agent_id", "_b").orderBy("ts", "event_id")
             .rowsBetween(1, W.unboundedFollowing))
    later = (W.partitionBy("agent_id").orderBy("_b").rowsBetween(1, W.unboundedFollowing))
    hours = (rows.groupBy("agent_id", "_b").agg(F.min(good).alias("_g"))
             .withColumn("_next", F.first("_g", ignorenulls=True).over(later)).drop("_g"))
    at = F.coalesce("_here", "_next")
    return (rows.withColumn("_here", F.min(good).over(ahead)).where(F.col("status") != "ok")
            .join(hours, ["agent_id", "_b"])
            .select("event_id", "agent_id", ((F.unix_micros(at) - F.unix_micros("ts")) / 1e6).alias("seconds")))


def violation_rate(divergence: DataFrame, limit: float = 0.02) -> DataFrame:
    """Share of runs whose end state diverged, per template."""
    return (divergence.groupBy("task_template")
            .agg(F.count(F.lit(1)).alias("runs"), F.count_if("diverged").alias("violations"))
            .withColumn("rate", F.col("violations") / F.col("runs"))
            .withColumn("within_limit", F.col("rate") <= limit))


def slow_steps(tasks: DataFrame, recent_h: int = 24, prior_days: int = 7, factor: float = 2.0) -> DataFrame:
    """Agents whose recent p95 latency is over twice that of the days before."""
    day = F.col("latest") - seconds(recent_h * 3600)
    p95 = lambda cond: F.percentile_approx(F.when(cond, F.col("latency_ms")), 0.95, 10_000)
    near = tasks.join(latest_activity(tasks), "agent_id").where(F.col("ts") > day - seconds(prior_days * _DAY_S))
    return (near.groupBy("agent_id").agg(p95(F.col("ts") > day).alias("recent_p95"),
                                         p95(F.col("ts") <= day).alias("prior_p95"))
            .withColumn("fired", F.coalesce(F.col("recent_p95") > F.col("prior_p95") * factor, F.lit(False))))


def task_outliers(tasks: DataFrame, value: str) -> DataFrame:
    """Tasks whose cost or latency is far from the median of their agent."""
    return wide_mad_z(tasks.select("event_id", "agent_id", value), ["agent_id"], value)


def first_token_card(tasks: DataFrame, min_obs: int = 30) -> DataFrame:
    """Control card over each agent's daily mean time to first token."""
    daily = tasks.groupBy("agent_id", F.to_date("ts").alias("day")).agg(F.avg("ttft_s").alias("ttft_s"))
    return ewma_card(daily, ["agent_id"], "day", "ttft_s", min_obs)


def odd_output_lengths(tasks: DataFrame, band: float = 0.5) -> DataFrame:
    """Tasks whose output length leaves the median of their agent by more than half."""
    med = grouped_median(tasks, ["agent_id"], "output_tokens").select("agent_id", "median")
    return (tasks.select("event_id", "agent_id", "output_tokens").join(med, "agent_id")
            .where(F.abs(F.col("output_tokens") - F.col("median")) > F.col("median") * band))


def escalation_ratio(tasks: DataFrame, tickets: DataFrame, factor: float = 2.0) -> DataFrame:
    """Tickets per task by week, fired when over twice the week before."""
    week = lambda c: F.date_trunc("week", c).cast("date").alias("week")
    t = tasks.groupBy(week("ts")).agg(F.count(F.lit(1)).alias("tasks"))
    h = tickets.groupBy(week("created_at")).agg(F.count(F.lit(1)).alias("tickets"))
    # one row per calendar week
    w = W.partitionBy(F.lit(0)).orderBy("week")
    return (t.join(h, "week", "left").na.fill(0, ["tickets"])
            .withColumn("ratio", F.col("tickets") / F.col("tasks"))
            .withColumn("fired", F.coalesce(F.col("ratio") > F.lag("ratio").over(w) * factor, F.lit(False))))


def ticket_quota(tickets: DataFrame, quota: int = 5) -> DataFrame:
    """Open tickets per agent against the quota."""
    return (tickets.where(F.col("status") == "open").groupBy("agent_id")
            .agg(F.count(F.lit(1)).alias("open_tickets")).withColumn("fired", F.col("open_tickets") > quota))


def baselines(tasks: DataFrame, guards: DataFrame, costs: DataFrame, calibration: DataFrame) -> DataFrame:
    """The baseline row of every agent: tool mix, mean and MAD of task cost, p95 latency,
    control-card state and the end of calibration."""
    mix = (guards.where(F.col("event_type") == "tool_call").groupBy("agent_id", "tool_name")
           .agg(F.count(F.lit(1)).alias("n")).groupBy("agent_id")
           .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool_name", "n")))).alias("tool_mix")))
    cost = tasks.groupBy("agent_id").agg(F.avg("cost_usd").cast("double").alias("mean_cost_usd"),
                                         F.percentile_approx("latency_ms", 0.95, 10_000).alias("p95_latency_ms"))
    mad = grouped_mad(tasks, ["agent_id"], "cost_usd").select("agent_id", F.col("mad").alias("mad_cost_usd"))
    card = (ewma_card(costs, ["agent_id"], "day", "cost").groupBy("agent_id")
            .agg(F.max_by(F.struct(F.col("mu").alias("ewma_mu"), (F.col("sigma") * F.col("sigma")).alias("ewma_sigma2")),
                          "day").alias("c")).select("agent_id", "c.*"))
    return (cost.join(mad, "agent_id", "left").join(mix, "agent_id", "left").join(card, "agent_id", "left")
            .join(calibration.select("agent_id", "calibration_until"), "agent_id", "left"))
