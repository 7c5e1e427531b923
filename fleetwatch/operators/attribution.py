"""Which agent and step most likely caused an alarm, and what operators said.

Each rung needs "the first / last / biggest / most frequent event of the agent in the 24
hours before the alarm". Events are rolled up per agent: seconds from rows (one scan, stored),
minutes from seconds, hours from minutes; an alarm reads whole hours, minutes and seconds from
these and raw rows only in the two seconds at its window's ends. No alarm is ever paired with all events of its agent or of a busy hour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import kept
from .alarms import clock_text

METHOD = "heuristic.v1"
LOOKBACK_H = 24

# fixed values: signals served by each rung
_ERROR_SIGNALS = ["error.new_class_seen", "error.rate>0.20"]


# what a suggestion rests on, by signal
WHY = {
    "loop>=2": "this tool was called three times in a row with equal arguments",
    "permission.deny>0.20": "this tool was denied more often than any other before the alarm",
    "drift.tool_distribution>0.40": "this tool was called most often before the mix of tools shifted",
    "cost.daily>2x_ewma": "no other task before the alarm cost as much",
}
WHY_TICKET = "no open ticket of the fleet has waited longer"
MISSING = {
    "loop>=2": "a loop was found, but no tool call before the alarm",
    "error.new_class_seen": "errors were counted, but none before the alarm",
    "error.rate>0.20": "errors were counted, but none before the alarm",
    "permission.deny>0.20": "denials were counted, but none before the alarm",
    "drift.tool_distribution>0.40": "the mix of tools shifted, but no call came before the alarm",
    "cost.daily>2x_ewma": "costs rose, but no task came before the alarm",
    "escalation.age_max>24": "a ticket was too old, but none is open",
}
NO_TRACE = "insufficient trace"


def _by_signal(texts: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[F.col("signal")]


def _div(c: Column, by: int) -> Column:
    return F.call_function("div", c, F.lit(by))


def _lookback(alarms: DataFrame, signals: list[str], rows: DataFrame, states: dict[str, Column],
              merge: dict[str, Callable[[str], Column]], by: list[str]) -> DataFrame:
    """Merged states per alarm (and ``by``) over the events of its window. Every ``merge``
    must be an aggregate that can be applied to its own results.

    A window is cut into its whole hours, the whole minutes of its two partial hours and the
    whole seconds of its two partial minutes; only in its first and last second it meets rows.
    An alarm asks for the days, the two hours, two minutes and two seconds that hold these and meets
    what is there, so it is some eight rows however long the window. Nothing is broadcast: the size
    of the asking rows is a guess from the files, and it must not rest on the driver. Rows of days of an
    agent for which no alarm asks are left out at once and reach no level."""
    windows = (alarms.where(F.col("signal").isin(*signals))
               .withColumn("_from", F.col("created_at") - F.make_dt_interval(hours=F.lit(LOOKBACK_H)))
               .select("alarm_id", "agent_id", "_from", F.col("created_at").alias("_to"),
                       F.unix_seconds("_from").alias("_f"), F.unix_seconds("created_at").alias("_t")))
    folded = [fn(name).alias(name) for name, fn in merge.items()]
    rows = rows.select("agent_id", *by, "ts", *[c.alias(n) for n, c in states.items()], F.unix_seconds("ts").alias("_in"))
    keep, f, t = ["alarm_id", *by, *states], F.col("_f"), F.col("_t")
    days = windows.select("agent_id", F.explode(F.sequence(_div(f, 86_400), _div(t, 86_400))).alias("_day")).distinct()
    rows = _stored(rows.withColumn("_day", _div(F.col("_in"), 86_400)).hint("merge").join(days, ["agent_id", "_day"], "left_semi").drop("_day"))
    # the rows come from the one full scan; the smallest level is stored, too, and each larger one comes from the one below
    levels = {1: _stored(rows.groupBy("agent_id", F.col("_in").alias("_at"), *by).agg(*folded))}
    for unit, below in ((60, 1), (3600, 60)):
        up = levels[below].withColumn("_at", _div(F.col("_at"), unit // below))
        levels[unit] = up.groupBy("agent_id", "_at", *by).agg(*folded)

    def met(asked: Column, found: DataFrame) -> DataFrame:
        return windows.withColumn("_in", F.explode(asked)).hint("merge").join(found, ["agent_id", "_in"])

    ends = lambda unit: F.array_distinct(F.array(_div(f, unit), _div(t, unit)))
    asked = {3600: F.sequence(_div(f, 86_400), _div(t, 86_400)), 60: ends(3600), 1: ends(60)}
    out = (met(ends(1), rows)
           .where((F.col("ts") >= F.col("_from")) & (F.col("ts") <= F.col("_to"))).select(*keep))
    for unit, above in ((3600, 86_400), (60, 3600), (1, 60)):
        found = levels[unit].withColumn("_in", _div(F.col("_at"), above // unit))
        whole = (F.col("_at") > _div(f, unit)) & (F.col("_at") < _div(t, unit))
        out = out.unionByName(met(asked[unit], found).where(whole).select(*keep))
    return out.groupBy("alarm_id", *by).agg(*folded)


def _stored(df: DataFrame) -> DataFrame:
    return kept(df, "rollup")


def _clock(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def suggest(alarms: DataFrame, tasks: DataFrame, guards: DataFrame,
            tickets: DataFrame) -> DataFrame:
    """One suggestion per alarm. Equal counts go to the tool first in name order."""
    a = alarms.select("alarm_id", "agent_id", "signal", "created_at")
    call = F.col("event_type") == "tool_call"
    denial = (F.col("event_type") == "permission_decision") & F.col("decision").eqNullSafe("deny")
    tool_states = _lookback(
        a, ["loop>=2", "permission.deny>0.20", "drift.tool_distribution>0.40"], guards,
        {"last": F.when(call, F.struct("ts", "event_id", "tool_name")),
         "calls": F.when(call, 1).otherwise(0), "denied": F.when(denial, 1).otherwise(0)},
        {"last": F.max, "calls": F.sum, "denied": F.sum}, ["tool_name"])
    top = lambda c: F.min(F.when(F.col(c) > 0, F.struct((-F.col(c)).alias("neg"), "tool_name"))).alias(c)
    tools = tool_states.groupBy("alarm_id").agg(F.max("last").alias("last"), top("calls"), top("denied"))
    label_count = lambda c: F.concat(F.col(f"{c}.tool_name"), F.lit("' ("),
                                     (-F.col(f"{c}.neg")).cast("string"), F.lit("x in 24h)"))

    task_states = _lookback(
        a, [*_ERROR_SIGNALS, "cost.daily>2x_ewma"], tasks,
        {"first": F.when(F.col("status") == "error",
                         F.struct("ts", "event_id", "task_id", "error_class", "session_id")),
         "dearest": F.struct("cost_usd", "event_id", "task_id", "model_name")},
        {"first": F.min, "dearest": F.max}, [])
    # the two smallest agents of a session: one of them is the smallest other one
    nth = F.row_number().over(W.partitionBy("_session").orderBy("agent_id"))
    members = (tasks.select(F.col("session_id").alias("_session"), "agent_id").distinct().withColumn("_nth", nth)
               .where(F.col("_nth") <= 2).groupBy("_session")
               .agg(F.min("agent_id").alias("_lo"), F.max("agent_id").alias("_next")))
    asked = (a.where(F.col("signal").isin(*_ERROR_SIGNALS)).select("alarm_id", "agent_id")
             .join(task_states.select("alarm_id", F.col("first.session_id").alias("_session")), "alarm_id"))
    partners = (asked.join(members, "_session")
                .select("alarm_id", F.when(F.col("_lo") != F.col("agent_id"), F.col("_lo"))
                        .otherwise(F.nullif("_next", "agent_id")).alias("_partner")))
    rows = (a.join(tools, "alarm_id", "left").join(task_states, "alarm_id", "left")
            .join(partners, "alarm_id", "left"))
    partner = F.col("_partner")
    label = F.coalesce("first.error_class", F.lit("None"))
    is_ = lambda *signals: F.col("signal").isin(*signals)
    step = (F.when(is_("loop>=2"), F.concat(F.lit("repeated call "), F.col("last.tool_name"),
                                            F.lit(" (last at "), _clock(F.col("last.ts")), F.lit(")")))
            .when(is_(*_ERROR_SIGNALS), F.concat(label, F.lit(" on "), F.col("first.task_id"), F.lit(" ("),
                                                 _clock(F.col("first.ts")), F.lit(")")))
            .when(is_("permission.deny>0.20"), F.concat(F.lit("denied tool '"), label_count("denied")))
            .when(is_("drift.tool_distribution>0.40"), F.concat(F.lit("pivot onto '"), label_count("calls")))
            .when(is_("cost.daily>2x_ewma"), F.concat(
                F.lit("task "), F.col("dearest.task_id"), F.lit(" on "), F.col("dearest.model_name"), F.lit(" ($"),
                F.format_string("%.2f", F.col("dearest.cost_usd").cast("double")), F.lit(")"))))
    conf = (F.when(is_("loop>=2"), 0.90).when(is_(*_ERROR_SIGNALS), 0.75)
            .when(is_("permission.deny>0.20"), 0.80).when(is_("drift.tool_distribution>0.40"), 0.70)
            .when(is_("cost.daily>2x_ewma"), 0.65))
    first_error = F.concat(F.lit("earliest error "), label, F.lit(" in task "), F.col("first.task_id"),
                           F.coalesce(F.concat(F.lit(", in one session with "), partner), F.lit("")))
    why = F.when(is_(*_ERROR_SIGNALS), first_error).otherwise(_by_signal(WHY))
    rows = rows.select("alarm_id", "agent_id", "signal", "created_at", step.alias("step"),
                       conf.alias("conf"), why.alias("why"))

    oldest = (tickets.where(F.col("status") == "open").groupBy()
              .agg(F.min(F.struct("created_at", "escalation_id", "agent_id", "task_id")).alias("t"))
              .select("t").scalar())
    rows = rows.withColumn("_t", F.when(F.col("signal") == "escalation.age_max>24", oldest))
    has_ticket = F.col("_t.agent_id").isNotNull()
    age_h = F.bround((F.unix_micros("created_at") - F.unix_micros(F.col("_t.created_at"))) / 3.6e9)
    ticket_step = F.concat(F.lit("open ticket "), F.col("_t.task_id"), F.lit(" ("),
                           age_h.cast("bigint").cast("string"), F.lit("h, opened "),
                           _clock(F.col("_t.created_at")), F.lit(")"))
    missing = F.coalesce(_by_signal(MISSING), F.concat(F.lit("no rule for the signal "), F.col("signal")))
    pick = lambda ticket, rung, otherwise: (
        F.when(has_ticket, ticket).when(F.col("step").isNotNull(), rung).otherwise(otherwise))
    return rows.select(
        "alarm_id", F.coalesce(F.col("_t.agent_id"), F.col("agent_id")).alias("suggested_agent_id"),
        pick(ticket_step, F.col("step"), F.lit(NO_TRACE)).alias("suggested_step"),
        pick(F.lit(0.60), F.col("conf"), F.lit(0.30)).alias("confidence"),
        F.lit(METHOD).alias("method"),
        pick(F.lit(WHY_TICKET), F.col("why"), missing).alias("note"))


def verdicts(suggestions: DataFrame, requests: DataFrame) -> DataFrame:
    """The earliest verdict per pending suggestion; all later ones are void."""
    first = (requests.groupBy("alarm_id")
             .agg(F.min(F.struct("at", "operator", "accepted")).alias("v"))
             .select("alarm_id", "v.*"))
    pending = suggestions.where(F.col("confirmed").isNull()).select("alarm_id")
    return first.join(pending, "alarm_id", "left_semi")


def verdict_events(decided: DataFrame) -> DataFrame:
    """Ledger payloads of the verdicts that count."""
    payload = F.to_json(F.struct("accepted", "alarm_id", "operator", clock_text("at").alias("ts")))
    return decided.select(F.lit("attribution_confirmed").alias("event_type"), payload.alias("payload"),
                          F.col("at").alias("created_at"), F.col("alarm_id").alias("source_id"))


def apply_verdicts(suggestions: DataFrame, decided: DataFrame) -> DataFrame:
    d = decided.select("alarm_id", "accepted", F.col("operator").alias("_by"), F.col("at").alias("_at"))
    return (suggestions.join(d, "alarm_id", "left")
            .withColumn("confirmed", F.coalesce("confirmed", "accepted"))
            .withColumn("confirmed_by", F.coalesce("confirmed_by", "_by"))
            .withColumn("confirmed_at", F.coalesce("confirmed_at", "_at"))
            .drop("accepted", "_by", "_at"))


def approval_rate(suggestions: DataFrame) -> DataFrame:
    """One row (decided, accepted, rejected, rate); the rate is null without verdicts."""
    return (suggestions.where(F.col("confirmed").isNotNull())
            .agg(F.count(F.lit(1)).alias("decided"), F.count_if("confirmed").alias("accepted"),
                 F.count_if(~F.col("confirmed")).alias("rejected"))
            .withColumn("rate", F.col("accepted") / F.when(F.col("decided") > 0, F.col("decided"))))
