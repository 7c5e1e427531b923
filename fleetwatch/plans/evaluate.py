"""Every fact of every agent in one long table."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import UTC, datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.hashing import call_signature
from ..operators import facts
from ..operators.commits import TableLog, partition_value
from ..operators.stats import jsd
from ..session import kept


@dataclass
class Windows:
    """Window lengths of the facts; the defaults are the protocol's."""
    error_s: float = R.ERROR_WINDOW_S
    deny_s: float = R.DENY_WINDOW_S
    recent_h: int = 24
    prior_days: int = 7
    ewma_warmup: int = R.EWMA_WARMUP


def _task_facts(tasks: DataFrame, window_s: float) -> DataFrame:
    """Error share and retries per agent from one anchor pass and one window pass. The
    anchor row itself lies in the window, so no agent is lost."""
    anchors = tasks.groupBy("agent_id").agg(F.max("ts").alias("latest"),
                                            F.max("retry_count").cast("double").alias("retries"))
    status = F.col("status")
    recent = (tasks.select("agent_id", "ts", "status").join(anchors, "agent_id")
              .where(F.col("ts") >= F.col("latest") - facts.seconds(window_s)))
    total = F.count_if(status.isin("ok", "error"))
    return recent.groupBy("agent_id").agg(
        (F.count_if(status == "error") / F.when(total > 0, total)).alias("errors"),
        F.max("retries").alias("retries"))


def _guard_facts(guards: DataFrame, w: Windows) -> DataFrame:
    """Tool divergence and deny share per agent, likewise from two passes."""
    decision = F.col("event_type") == "permission_decision"
    call = F.col("event_type") == "tool_call"
    anchors = guards.groupBy("agent_id").agg(F.max("ts").alias("g"),
                                             F.max(F.when(decision, F.col("ts"))).alias("d"))
    day = F.col("g") - facts.seconds(w.recent_h * 3600)
    week = day - facts.seconds(w.prior_days * 86_400)
    judged = decision & (F.col("ts") >= F.col("d") - facts.seconds(w.deny_s))
    rows = (guards.select("agent_id", "ts", "event_type", "tool_name", "decision")
            .join(anchors, "agent_id").where((call & (F.col("ts") > week)) | judged))
    counts = rows.groupBy("agent_id", F.when(call, F.col("tool_name")).alias("tool_name")).agg(
        F.count_if(call & (F.col("ts") <= day)).alias("prior"),
        F.count_if(call & (F.col("ts") > day)).alias("recent"),
        F.count_if(judged & F.col("decision").eqNullSafe("deny")).alias("denied"),
        F.count_if(judged).alias("judged"))
    return (jsd(counts, ["agent_id"], "tool_name", "prior", "recent", ["denied", "judged"])
            .withColumn("deny", F.col("denied") / F.when(F.col("judged") > 0, F.col("judged"))))


def _minute(at: Column) -> Column:
    return F.date_trunc("minute", at)


def _task_minutes(tasks: DataFrame) -> DataFrame:
    """Sums per agent and minute, from which the error share of any window can be merged."""
    status = F.col("status")
    return tasks.groupBy("agent_id", _minute(F.col("ts")).alias("minute")).agg(
        F.count_if(status == "error").alias("errors"), F.count_if(status.isin("ok", "error")).alias("total"))


def _guard_minutes(guards: DataFrame) -> DataFrame:
    """Calls per agent, minute and tool, decisions per agent and minute."""
    call, decision = (F.col("event_type") == t for t in ("tool_call", "permission_decision"))
    return (guards.where(call | decision)
            .groupBy("agent_id", _minute(F.col("ts")).alias("minute"), F.when(call, F.col("tool_name")).alias("tool_name"))
            .agg(F.count_if(call).alias("calls"), F.count_if(decision & F.col("decision").eqNullSafe("deny")).alias("denied"),
                 F.count_if(decision).alias("judged")))


def _edge_rows(rows: DataFrame, new: DataFrame, since: Column, lengths: list[float]) -> DataFrame:
    """The rows of the minutes in which windows of these lengths begin that end at rows of ``new``:
    per length a slice of time as long as the new rows take, whatever the length."""
    ends = [F.max(_minute(F.col("ts") - facts.seconds(s)) + facts.seconds(60)).alias("e") for s in lengths]
    slices = [(F.col("ts") >= since - facts.seconds(s)) & (F.col("ts") < new.agg(e).select("e").scalar())
              for s, e in zip(lengths, ends)]
    # the first condition is the one that certainly reaches the scan
    return rows.where(F.col("ts") >= since - facts.seconds(max(lengths))).where(reduce(or_, slices))


def _inside(start: Column, strict: bool = False) -> Column:
    """Whether a stored minute (``ts`` null) lies after the one in which the window begins, or a row
    of that minute lies in the window."""
    ts, edge = F.col("ts"), _minute(start)
    return F.when(ts.isNull(), F.col("minute") > edge).otherwise(
        (F.col("minute") == edge) & (ts > start if strict else ts >= start))


def _with_edges(minutes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored minutes and single rows in one table; the rows are minutes with a ``ts``."""
    return minutes.withColumn("ts", F.lit(None).cast("timestamp")).unionByName(edges.withColumn("minute", _minute(F.col("ts"))))


def _merged_task_facts(minutes: DataFrame, tasks: DataFrame, new: DataFrame, since: Column, window_s: float, once) -> DataFrame:
    """``_task_facts`` of the agents in ``new``, from stored minutes and the rows at the window's edge."""
    status = F.col("status")
    anchors = new.groupBy("agent_id").agg((F.max("ts") - facts.seconds(window_s)).alias("start"),
                                          F.max("retry_count").cast("double").alias("retries"))
    edges = once(_edge_rows(tasks, new, since, [window_s]).select(
        "agent_id", "ts", F.coalesce(status == "error", F.lit(False)).cast("bigint").alias("errors"),
        F.coalesce(status.isin("ok", "error"), F.lit(False)).cast("bigint").alias("total")), "task-edges")
    total = F.sum("total")
    return (_with_edges(minutes, edges).join(anchors, "agent_id").where(_inside(F.col("start")))
            .groupBy("agent_id").agg((F.sum("errors") / F.when(total > 0, total)).alias("errors"),
                                     F.max("retries").alias("retries")))


def _merged_guard_facts(minutes: DataFrame, guards: DataFrame, new: DataFrame, since: Column, w: Windows, once) -> DataFrame:
    """``_guard_facts`` of the agents in ``new``, likewise."""
    call, decision = (F.col("event_type") == t for t in ("tool_call", "permission_decision"))
    recent_s, week_s = w.recent_h * 3600, w.recent_h * 3600 + w.prior_days * 86_400
    begin = lambda c, s: c - facts.seconds(s)
    newest, judgement = F.max("ts"), F.max(F.when(decision, F.col("ts")))
    anchors = new.groupBy("agent_id").agg(begin(newest, recent_s).alias("day"), begin(newest, week_s).alias("week"),
                                          begin(judgement, w.deny_s).alias("deny_from"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    edges = once(_edge_rows(guards, new, since, [recent_s, week_s, w.deny_s]).where(call | decision).select(
        "agent_id", "ts", F.when(call, F.col("tool_name")).alias("tool_name"), one(call).alias("calls"),
        one(decision & (F.col("decision") == "deny")).alias("denied"), one(decision).alias("judged")), "guard-edges")
    week, day, judged = _inside(F.col("week"), True), _inside(F.col("day"), True), _inside(F.col("deny_from"))
    some = lambda inside, c: F.sum(F.when(inside, F.col(c)).otherwise(0))
    counts = (_with_edges(minutes, edges).join(anchors, "agent_id")
              .where(((F.col("calls") > 0) & (week | day)) | ((F.col("judged") > 0) & judged))
              .groupBy("agent_id", "tool_name").agg(
                  (some(week, "calls") - some(day, "calls")).alias("prior"), some(day, "calls").alias("recent"),
                  some(judged, "denied").alias("denied"), some(judged, "judged").alias("judged")))
    # an agent whose newest rows reach no call and no decision has moved on from its former divergence
    return (anchors.select("agent_id").join(jsd(counts, ["agent_id"], "tool_name", "prior", "recent", ["denied", "judged"]),
                                            "agent_id", "left")
            .withColumn("band", F.coalesce("band", F.lit("warming_up")))
            .withColumn("deny", F.col("denied") / F.when(F.col("judged") > 0, F.col("judged"))))


@dataclass
class State:
    """What an evaluation keeps of all rows it has seen.

    ``tasks`` (agent_id, errors, retries) and ``guards`` (agent_id, deny, jsd, band) are the
    window facts of each agent's newest rows; ``costs`` its days, ``classes`` its error classes,
    ``looped`` the tasks in which it met an open breaker, ``opened`` the tasks with one and
    ``tails`` the last calls of the other tasks. ``task_minutes`` and ``guard_minutes`` are sums per
    agent and minute, as far back as a window that ends at a coming row can reach; several rows of a minute add up."""
    tasks: DataFrame
    guards: DataFrame
    costs: DataFrame
    classes: DataFrame
    looped: DataFrame
    opened: DataFrame
    tails: DataFrame
    task_minutes: DataFrame
    guard_minutes: DataFrame

    def saved(self, folder: str) -> State:
        """Written below ``folder`` and read again."""
        out = {}
        for f in fields(self):
            df = getattr(self, f.name)
            df.write.parquet(f"{folder}/{f.name}")
            out[f.name] = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{f.name}")
        return State(**out)


# tables of a state to which a step only adds; the others have one row per agent or open task and are replaced
ADDED = ("costs", "classes", "looped", "opened", "task_minutes", "guard_minutes")


def _replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(old.columns))


def _reach(w: Windows) -> dict[str, float]:
    """Seconds from a row to the earliest minute that a window ending there can hold."""
    return {"task_minutes": w.error_s, "guard_minutes": max(w.deny_s, w.recent_h * 3600 + w.prior_days * 86_400)}


def _in_reach(state: State, name: str, w: Windows, since: Column) -> DataFrame:
    return getattr(state, name).where(F.col("minute") >= _minute(since - facts.seconds(_reach(w)[name])))


def _step(tasks: DataFrame, guards: DataFrame, w: Windows, state: State | None, since: Column | None,
          stored: bool = False) -> State:
    """What the rows from ``since`` on add to the state, or all its tables if there is none. When they are ``stored``,
    the new rows are read and their calls signed once, and so is what several tables need written once."""
    once = kept if stored else lambda rows, purpose: rows
    call_columns = ["event_type", "task_id", "agent_id", "ts", "event_id", "tool_name", "arguments_json"]
    from_since = lambda rows: rows if since is None else rows.where(F.col("ts") >= since)
    new_tasks, new_guards = from_since(tasks), from_since(guards)
    signature = call_signature(F.col("tool_name"), F.col("arguments_json"))
    running_columns = [*call_columns, "_sig"]
    new_guards = new_guards.withColumn("_sig", F.when(F.col("event_type") == "tool_call", signature))
    if stored:
        new_tasks = kept(new_tasks.select("agent_id", "ts", "status", "retry_count", "cost_usd", "error_class"), "new-tasks")
        new_guards = kept(new_guards.select(*running_columns, "decision"), "new-guards")
    calls = new_guards.where(F.col("event_type") == "tool_call").select(running_columns)
    if state is None:
        running = calls
        t, g = _task_facts(new_tasks, w.error_s), _guard_facts(new_guards, w)
        # minutes before these no window of a later row reaches
        reached = lambda rows, name: rows.where(F.col("ts") >= rows.agg(
            F.max(_minute(F.col("ts") - facts.seconds(_reach(w)[name]))).alias("m")).select("m").scalar())
        task_minutes = _task_minutes(reached(new_tasks, "task_minutes"))
        guard_minutes = _guard_minutes(reached(new_guards, "guard_minutes"))
    else:
        task_minutes, guard_minutes = once(_task_minutes(new_tasks), "task-minutes"), once(_guard_minutes(new_guards), "guard-minutes")
        # only a task with new calls can open its breaker; the others keep their tails
        touched = calls.select(F.col("task_id").alias("_task")).distinct()
        met = F.col("task_id").eqNullSafe(F.col("_task"))
        resumed = state.tails.join(touched, met, "left_semi").withColumn("_sig", signature)
        running = resumed.unionByName(calls).join(state.opened.select("task_id"), "task_id", "left_anti")
        t = _merged_task_facts(_in_reach(state, "task_minutes", w, since).unionByName(task_minutes), tasks, new_tasks, since, w.error_s, once)
        t = (t.join(state.tasks.select("agent_id", F.col("retries").alias("_r")), "agent_id", "left")
             .withColumn("retries", F.greatest("retries", "_r")).drop("_r"))
        g = _merged_guard_facts(_in_reach(state, "guard_minutes", w, since).unionByName(guard_minutes), guards, new_guards, since, w, once)
        # a new guard row that is no decision leaves the deny share as it was
        g = (g.join(state.guards.select("agent_id", F.col("deny").alias("_d")), "agent_id", "left")
             .withColumn("deny", F.when(F.col("judged") > 0, F.col("deny")).otherwise(F.col("_d"))))
    t, g = once(t, "task-facts"), once(g.select("agent_id", "deny", "jsd", "band"), "guard-facts")
    costs = new_tasks.groupBy("agent_id", F.to_date("ts").alias("day")).agg(F.sum("cost_usd").alias("cost"))
    classes = facts.new_error_classes(new_tasks).select("agent_id", "class")
    opened = once(facts.loop_openings(running, also=()).select("task_id", "opened_at", "event_id"), "opened")
    looped = facts.looped_tasks(running, opened)
    if state is not None:
        after = calls.select("agent_id", "task_id").join(state.opened.select("task_id"), "task_id", "left_semi")
        looped = looped.unionByName(after.select("agent_id", "task_id"))
    last = F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("ts"), F.desc("event_id")))
    tails = (running.select(call_columns).withColumn("_nth", last).where(F.col("_nth") < R.LOOP_RUN).drop("_nth")
             .join(opened.select("task_id"), "task_id", "left_anti").select(call_columns))
    if state is not None:
        untouched = state.tails.join(touched, met, "left_anti").join(state.opened.select("task_id"), "task_id", "left_anti")
        tails = tails.unionByName(untouched.select(call_columns))
    return State(t, g, costs, classes, looped, opened, tails, task_minutes, guard_minutes)


def _summed(costs: DataFrame) -> DataFrame:
    """Days of which several steps saw a part; the type of the sum stays."""
    return costs.groupBy("agent_id", "day").agg(F.sum("cost").cast(costs.schema["cost"].dataType).alias("cost"))


def _merged(state: State, new: State, w: Windows, since: Column) -> State:
    both = lambda name: getattr(state, name).unionByName(getattr(new, name))
    live = lambda name: _in_reach(state, name, w, since).unionByName(getattr(new, name))
    return State(_replaced(state.tasks, new.tasks, ["agent_id"]), _replaced(state.guards, new.guards, ["agent_id"]),
                 _summed(both("costs")), both("classes").distinct(), both("looped").distinct(), both("opened"), new.tails,
                 live("task_minutes"), live("guard_minutes"))


def advance(tasks: DataFrame, guards: DataFrame, windows: Windows | None = None,
            state: State | None = None, since: Column | None = None, stored: bool = False) -> State:
    """The state after the rows from ``since`` on. With a state, its minutes give the windows of
    the new rows; of older rows only the minutes in which those windows begin are read (filters on
    ``ts`` that reach the scan). An agent without new rows keeps the facts of its last ones. ``stored`` writes the new
    rows and what several tables need of them first."""
    w = windows or Windows()
    new = _step(tasks, guards, w, state, since, stored)
    return new if state is None else _merged(state, new, w, since)


class StateLog:
    """A state in a commit log, extended step by step. A step adds folders to the tables in ``ADDED``, replaces the
    others, and is one commit that also says up to which time rows are in: a run that is cut leaves the
    state before it, a repeated step adds nothing. Minutes lie in folders by day, and only days in reach are read."""

    def __init__(self, spark: SparkSession, root: str, windows: Windows | None = None):
        self.log, self.windows = TableLog(spark, root), windows or Windows()

    def latest(self) -> tuple[datetime | None, State | None]:
        """The time (UTC) before which all rows are in the state, and the state; both None before the first step."""
        now = self.log.snapshot()
        at = now.done.get("steps")
        if at is None:
            return None, None
        at = datetime.fromtimestamp(0, UTC) + timedelta(microseconds=at)
        out = {}
        for f in fields(State):
            folders = now.of(f.name)
            if f.name in _MINUTES:
                # a day of margin for the session's time zone
                first = (at - timedelta(seconds=_reach(self.windows)[f.name], days=1)).date().isoformat()
                folders = [x for x in folders if partition_value(x, "day") >= first]
            rows = self.log.read(f.name, _SCHEMAS.get(f.name), folders)
            out[f.name] = rows.drop("day") if f.name in _MINUTES else rows
        # a day of costs, a class or a looped task may have been added by several steps
        out["costs"] = _summed(out["costs"])
        out["classes"], out["looped"] = out["classes"].distinct(), out["looped"].distinct()
        return at, State(**out)

    def step(self, tasks: DataFrame, guards: DataFrame, until: datetime) -> State:
        """Takes in the rows from where the state ends to ``until``, which they must be complete to; returns the state."""
        covered, old = self.latest()
        if covered is not None and covered >= until:
            return old
        since = None if covered is None else instant(covered)
        before = lambda rows: rows.where(F.col("ts") < instant(until))
        new = _step(before(tasks), before(guards), self.windows, old, since, stored=True)
        whole = new if old is None else _merged(old, new, self.windows, since)
        add = {}
        for f in fields(State):
            rows = getattr(new if f.name in ADDED else whole, f.name)
            if f.name in _MINUTES:
                add[f.name] = self.log.stage(f.name, rows.where(F.col("minute").isNotNull()).withColumn("day", F.to_date("minute")), "day")
            else:
                add[f.name] = self.log.stage(f.name, rows)
        now = self.log.snapshot()
        self.log.commit(add, {f.name: now.of(f.name) for f in fields(State) if f.name not in ADDED}, "steps", _micros(until))
        return self.latest()[1]


_MINUTES = ("task_minutes", "guard_minutes")
# costs keep the type that the sum of their column has
_SCHEMAS = {
    "tasks": "agent_id string, errors double, retries double",
    "guards": "agent_id string, deny double, jsd double, band string",
    "classes": "agent_id string, class string",
    "looped": "agent_id string, task_id string",
    "opened": "task_id string, opened_at timestamp, event_id string",
    "tails": "event_type string, task_id string, agent_id string, ts timestamp, event_id string, tool_name string, arguments_json string",
    "task_minutes": "agent_id string, minute timestamp, errors bigint, total bigint, day date",
    "guard_minutes": "agent_id string, minute timestamp, tool_name string, calls bigint, denied bigint, judged bigint, day date",
}


def instant(at: datetime) -> Column:
    """The time as a literal that does not depend on the session's time zone."""
    return F.timestamp_micros(F.lit(_micros(at)))


def _micros(at: datetime) -> int:
    return (at - datetime.fromtimestamp(0, UTC)) // timedelta(microseconds=1)


def evaluate(agents: DataFrame, tasks: DataFrame, guards: DataFrame, tickets: DataFrame,
             as_of: Column, windows: Windows | None = None,
             calibration: DataFrame | None = None, output_quality: bool = False,
             per_agent_tickets: bool = False, state: State | None = None, since: Column | None = None) -> DataFrame:
    """(agent_id, signal, fired, value) for every agent and signal.

    Facts over the same rows share a pass, and every fact is down to one row per agent
    before they meet. The cost fact reads the newest day of the card and needs a closed
    calibration. Divergent end states feed ``drift.output_quality`` only on request. With
    ``state`` and ``since`` only the rows since then are read, and those at the beginning of their windows."""
    w = windows or Windows()
    s = advance(tasks, guards, w, state, since, stored=state is not None)
    t, g = s.tasks, s.guards
    costs = s.costs.withColumn("cost", F.col("cost").cast("double"))
    if calibration is not None:
        costs = (costs.join(calibration.select("agent_id", "closed"), "agent_id", "left")
                 .withColumn("closed", F.coalesce("closed", F.lit(False))))
    card = facts.cost_spikes(costs, w.ewma_warmup, "closed" if calibration is not None else None)
    newest = card.groupBy("agent_id").agg(F.max_by(F.struct("z", "fired"), "day").alias("c"))
    loops = s.looped.groupBy("agent_id").agg(F.count(F.lit(1)).alias("looped_tasks"))
    fresh = s.classes.groupBy("agent_id").agg(F.count(F.lit(1)).alias("classes"))
    fact = lambda signal, value, fired: F.struct(
        F.lit(signal).alias("signal"), value.cast("double").alias("value"),
        F.coalesce(fired, F.lit(False)).alias("fired"))
    v = F.col
    listed = {
        "t": (t, [fact("error.rate>0.20", v("errors"), v("errors") > R.ERROR_RATE_LIMIT),
                  fact("latency.retry>=3", v("retries"), v("retries") >= R.RETRY_LIMIT)]),
        "g": (g, [fact("permission.deny>0.20", v("deny"), v("deny") > R.DENY_RATIO_LIMIT),
                  fact("drift.tool_distribution>0.40", v("jsd"), v("band") == "alarm")]),
        "l": (loops, [fact("loop>=2", v("looped_tasks"), v("looped_tasks") > 0)]),
        "n": (fresh, [fact("error.new_class_seen", v("classes"), v("classes") > 0)]),
        "c": (newest, [fact("cost.daily>2x_ewma", v("c.z"), v("c.fired"))]),
    }
    if output_quality:
        diverged = (facts.end_state_divergence(tasks).groupBy("agent_id")
                    .agg(F.count_if("diverged").alias("runs")))
        listed["q"] = (diverged, [fact("drift.output_quality", v("runs"), v("runs") > 0)])
    if per_agent_tickets:
        listed["k"] = (facts.ticket_age(tickets, as_of),
                       [fact("escalation.age_max>24", v("value"), v("fired"))])
    found = None
    for df, items in listed.values():
        # dealt by another key than the facts are: parts that lie alike would be one stage whose tasks hold the sorts of all
        part = df.select("agent_id", F.array(*items).alias("_p")).repartition("agent_id", F.lit(len(items)))
        found = part if found is None else found.unionByName(part)

    # the grid joins the union through one grouping per agent, not per agent and signal
    by_signal = found.groupBy("agent_id").agg(F.map_from_entries(F.transform(
        F.flatten(F.collect_list("_p")), lambda p: F.struct(p["signal"], F.struct(p["value"], p["fired"])))).alias("_f"))
    grid = (agents.select("agent_id").join(by_signal, "agent_id", "left")
            .select("agent_id", "_f", F.explode(F.array(*[F.lit(s) for s in R.SIGNALS])).alias("signal")))
    table = grid.select("agent_id", "signal", F.coalesce(F.col("_f")[F.col("signal")]["fired"],
                                                         F.lit(False)).alias("fired"),
                        F.col("_f")[F.col("signal")]["value"].alias("value"))
    if not per_agent_tickets:
        aging = F.col("signal") == "escalation.age_max>24"
        oldest = (facts.fleet_ticket_age(tickets, as_of)
                  .select(F.struct("value", "fired").alias("o")).scalar())
        table = table.select(
            "agent_id", "signal", F.when(aging, oldest["fired"]).otherwise(F.col("fired")).alias("fired"),
            F.when(aging, oldest["value"]).otherwise(F.col("value")).alias("value"))
    return table
