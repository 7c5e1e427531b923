"""Six calm days, then one injected scenario per agent; all rules in one evaluation."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetwatch import rules as R
from fleetwatch import schemas
from fleetwatch.operators import alarms, facts
from fleetwatch.plans.evaluate import evaluate

DAY0 = datetime(2026, 9, 1)
EXPECTED = {
    "s1": ("cost.daily>2x_ewma", "Critical", 24.0), "s2": ("drift.tool_distribution>0.40", "Medium", 168.0),
    "s3": ("loop>=2", "Emergency", 0.5), "s4": ("error.new_class_seen", "Critical", 24.0),
    "s5": ("permission.deny>0.20", "Critical", 4.0), "s7": ("error.rate>0.20", "Critical", 4.0),
    "s8": ("error.new_class_seen", "Critical", 24.0),
}


class Feed:
    def __init__(self):
        self.tasks, self.guards = [], []

    def task(self, agent, task, ts, cost=1.2, error=None, status="ok", retry=0):
        self.tasks.append((f"e{len(self.tasks):06d}", agent, task, f"s-{task}", "m", 900, 350, Decimal(str(round(cost, 6))),
                           1000, error, status, True, ts, retry, 0.4, None, None))

    def guard(self, agent, task, ts, tool, args, kind="tool_call", decision=None):
        self.guards.append((f"g{len(self.guards):06d}", agent, task, kind, decision, tool, args, True, ts))

    def calm(self, agent, day, cost=12.0):
        for i in range(10):
            ts = day + timedelta(hours=8 + i)
            task = f"{agent}-{day:%d}-{i}"
            for tool in ("search", "read", "write"):
                self.guard(agent, task, ts, tool, f'{{"q": "{i}"}}')
            self.task(agent, task, ts, cost / 10)


@pytest.fixture(scope="module")
def fleet(spark):
    f = Feed()
    for agent in ["calm", *EXPECTED]:
        days = 40 if agent == "s1" else 6
        for d in range(days):
            f.calm(agent, DAY0 - timedelta(days=days - 6) + timedelta(days=d), 11.5 + d % 3 * 0.5)
    day = DAY0 + timedelta(days=6)
    f.calm("calm", day)
    f.calm("s1", day, 42.0)
    for i in range(10):
        for j in range(3):
            f.guard("s2", f"s2-x{i}", day + timedelta(hours=8 + i), "scraper", f'{{"q": "{i}-{j}"}}')
        f.task("s2", f"s2-x{i}", day + timedelta(hours=8 + i))
    for args in ('{"a": 1, "b": 2}', '{"b":2,"a":1}', '{"a":1, "b":2}'):
        f.guard("s3", "s3-loop", day + timedelta(hours=10), "sql", args)
    f.task("s3", "s3-loop", day + timedelta(hours=10), error="loop", status="quarantined")
    f.task("s4", "s4-new", day + timedelta(hours=10), error="ERR_NOVEL_42", status="error")
    for i in range(10):
        f.guard("s5", "s5-perm", day + timedelta(hours=11, milliseconds=100 * i), "refund", "{}",
                "permission_decision", "deny" if i % 2 == 0 else "allow")
        f.task("s7", f"s7-{i}", day + timedelta(hours=12, seconds=i), error="timeout" if i % 2 == 0 else None,
               status="error" if i % 2 == 0 else "ok")
    f.task("s8", "s8-a", day + timedelta(hours=9), error="schema drift: unexpected field", status="error")
    f.task("s8", "s8-b", day + timedelta(hours=10), error="partial response: truncated json", status="error")
    tasks = spark.createDataFrame(f.tasks, schemas.TASK_EVENTS)
    guards = spark.createDataFrame(f.guards, schemas.GUARD_EVENTS)
    return tasks, guards, tasks.select("agent_id").distinct()


def _tickets(spark, hours):
    at = DAY0 + timedelta(days=7)
    return spark.createDataFrame(
        [("t1", "s6", "task", "manual", 0.0, "quality", "x", at, "open", None, None, at - timedelta(hours=hours))],
        schemas.TICKETS)


def _evaluate(spark, fleet, hours=1, **kw):
    tasks, guards, agents = fleet
    as_of = F.lit(DAY0 + timedelta(days=7))
    facts_long = evaluate(agents, tasks, guards, _tickets(spark, hours), as_of, **kw)
    return facts_long, alarms.map_to_alarms(facts_long, R.signal_rules(spark))


def test_every_scenario_is_found_and_calm_traffic_is_silent(spark, fleet):
    _, mapped = _evaluate(spark, fleet)
    got = {}
    for r in mapped.collect():
        got.setdefault(r["agent_id"], {})[r["signal"]] = (r["severity"], r["sla_hours"])
    for agent, (signal, severity, sla) in EXPECTED.items():
        assert got[agent][signal] == (severity, sla), agent
    assert "calm" not in got


def test_aged_ticket_fires_for_the_fleet(spark, fleet):
    _, mapped = _evaluate(spark, fleet, hours=30)
    aged = [r for r in mapped.collect() if r["signal"] == "escalation.age_max>24"]
    assert {r["agent_id"] for r in aged} == {"calm", *EXPECTED} and aged[0]["severity"] == "Emergency"


def test_open_calibration_holds_back_all_but_sentinels(spark, fleet):
    tasks, _, agents = fleet
    reg = agents.select("agent_id", F.lit(DAY0).alias("first_seen"), F.lit(False).alias("synthetic"))
    state = alarms.calibration_state(reg, F.lit(DAY0 + timedelta(days=7)))
    facts_long, _ = _evaluate(spark, fleet, calibration=state)
    mapped = alarms.map_to_alarms(facts_long, R.signal_rules(spark), state)
    by = {(r["agent_id"], r["signal"]): r["suppressed"] for r in mapped.collect()}
    assert by[("s3", "loop>=2")] is False and by[("s4", "error.new_class_seen")] is False
    assert by[("s5", "permission.deny>0.20")] is True and ("s1", "cost.daily>2x_ewma") not in by
    notes = {(r["note"], r["signal"]) for r in alarms.audit_notes(facts_long, R.signal_rules(spark), state).collect()}
    assert ("calibration_suppressed", "permission.deny>0.20") in notes
    late = alarms.calibration_state(reg, F.lit(DAY0 + timedelta(days=14)))
    assert late.where("closed").count() == late.count()


def test_alarm_rows_are_stable(spark, fleet):
    _, mapped = _evaluate(spark, fleet)
    at = F.lit(datetime(2026, 9, 8, 10, 20))
    first = alarms.raise_alarms(mapped, at)
    again = alarms.raise_alarms(mapped, F.lit(datetime(2026, 9, 8, 10, 55)), first)
    later = alarms.raise_alarms(mapped, F.lit(datetime(2026, 9, 8, 11, 5)), first)
    assert first.count() > 0 and again.count() == 0 and later.count() == first.count()


def test_loop_stays_open_and_breaks_on_other_calls(spark):
    f = Feed()
    t = datetime(2026, 1, 1)
    for i, args in enumerate(["1", "1", "2", "1", "1", "1", "3"]):
        f.guard("a", "t", t + timedelta(minutes=40 * i), "x", args)
    f.guard("b", "t", t + timedelta(days=2), "y", "9")
    g = spark.createDataFrame(f.guards, schemas.GUARD_EVENTS)
    o = facts.loop_openings(g).collect()
    assert [r["event_id"] for r in o] == ["g000005"]
    assert {r["agent_id"] for r in facts.loop_hits(g).collect()} == {"a", "b"}


@pytest.mark.parametrize("raw, quarantined, expected", [
    ("timed out api tool 500", False, "timeout"), ("HTTP 403", False, "auth"), ("schema drift", False, "schema_drift"),
    ("loop", False, "unknown"), ("loop", True, "loop"), (None, False, ""), ("TRUNCATED", False, "partial_response"),
    ("bad Schema", False, "parse"), ("handoff", False, "interagent_mismatch"), ("unclear", False, "spec_ambiguity"),
    ("expected 3", False, "verification_fail"), ("429", False, "tool_fail")])
def test_classification(spark, raw, quarantined, expected):
    from fleetwatch.functions.text import classify_error
    df = spark.createDataFrame([(raw, quarantined)], "raw string, q boolean")
    assert df.select(classify_error(F.col("raw"), F.col("q"))).first()[0] == expected


def test_end_state_ignores_key_order_and_crosses_hours(spark):
    f = Feed()
    for i, state in enumerate(['{"a":1,"b":[1,2]}', '{"b": [1, 2], "a": 1}', '{"a":1,"b":[2,1]}', '{"a":1}']):
        f.task("a", "t", datetime(2026, 1, 1) + timedelta(hours=5 * i))
        f.tasks[-1] = f.tasks[-1][:15] + ("tpl", state)
    rows = facts.end_state_divergence(spark.createDataFrame(f.tasks, schemas.TASK_EVENTS)).orderBy("ts").collect()
    assert [r["diverged"] for r in rows] == [False, False, True, True]


def test_windows_are_inclusive_at_the_start(spark):
    f = Feed()
    t = datetime(2026, 1, 1)
    for s, status in ((0, "error"), (24, "ok"), (-1, "error")):
        f.task("a", "t", t + timedelta(seconds=s), error="x" if status == "error" else None, status=status)
    r = facts.error_rate(spark.createDataFrame(f.tasks, schemas.TASK_EVENTS)).first()
    assert (r["hits"], r["total"], r["fired"]) == (1, 2, True)


def test_audit_notes_take_the_facts_once(spark):
    facts_ = spark.createDataFrame([("a", "loop>=2", True, 1.0), ("a", "odd", True, 1.0), ("b", "odd", False, 1.0), ("c", "latency.retry>=3", True, 3.0)],
                                   "agent_id string, signal string, fired boolean, value double").repartition("agent_id")
    state = spark.createDataFrame([("a", False), ("a", False), ("c", True)], "agent_id string, closed boolean")
    rules = R.signal_rules(spark)
    held = alarms.map_to_alarms(facts_, rules, state).where("suppressed").count()
    notes = alarms.audit_notes(facts_, rules, state)
    got = sorted(tuple(r) for r in notes.collect())
    assert got == sorted([("unknown_signal", "a", "odd")] + [("calibration_suppressed", "a", "loop>=2")] * held)
    assert notes._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_fact_parts_do_not_share_a_stage(spark):
    tasks = spark.createDataFrame([], schemas.TASK_EVENTS)
    guards = spark.createDataFrame([], schemas.GUARD_EVENTS)
    tickets = spark.createDataFrame([], "agent_id string, status string, created_at timestamp")
    rows = evaluate(spark.createDataFrame([("a",)], "agent_id string"), tasks, guards, tickets, F.lit(DAY0).cast("timestamp"))
    assert rows.count() == len(R.SIGNALS)
    assert rows._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression") == 5
