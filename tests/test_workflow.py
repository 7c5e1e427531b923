"""Privacy, attribution, triage, streams over several batches, and plan shapes."""

import random
from dataclasses import fields
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetwatch import adapters as A
from fleetwatch import catalog, schemas
from fleetwatch import rules as R
from fleetwatch.operators import alarms, attribution, facts, ledger, privacy
from fleetwatch.operators.commits import TableLog
from fleetwatch.plans import evaluate as evaluate_plan
from fleetwatch.plans import reports
from fleetwatch.plans.evaluate import State, StateLog, Windows, advance
from fleetwatch.session import work_dir
from fleetwatch.streaming import detectors, ingest
from fleetwatch.streaming.runner import to_parquet

SF = "/root/testdata/sf0.001"
T = datetime(2026, 1, 10, 12, 30)


def test_privacy_life_cycle(spark, tmp_path):
    req = spark.createDataFrame(
        [("s1", "Ann", '{"m":1}', "ops", "consent", T), ("s1", "Late", '{"m":9}', "ops", "consent", T + timedelta(1)),
         ("s2", "Bob", '{"m":2}', "ops", "contract", T), ("s3", "Cy", '{"m":3}', "ops", "", T)],
        "subject_id string, display_name string, pii string, actor string, lawful_basis string, requested_at timestamp")
    key, wrong = F.lit(bytearray(b"k" * 32)), F.lit(bytearray(b"w" * 32))
    subjects, keys = privacy.register(req, key, str(tmp_path / "r"))
    read = lambda s, k, m=key: {r["subject_id"]: r["pii"] for r in privacy.read_personal_data(s, k, m).collect()}
    assert read(subjects, keys) == {"s1": '{"m":1}', "s2": '{"m":2}'}
    assert read(subjects, keys, wrong) == {"s1": None, "s2": None}
    swapped = subjects.withColumn("subject_id", F.when(F.col("subject_id") == "s1", "s2").otherwise("s1"))
    assert read(swapped, keys) == {"s1": None, "s2": None}
    assert {r["reason"] for r in privacy.rejected_registrations(req, subjects).collect()} == {
        "lawful basis required", "already registered"}
    ask = spark.createDataFrame([("s1", "dpo", T + timedelta(40)), ("s1", "dpo", T + timedelta(41)), ("s9", "dpo", T)],
                                "subject_id string, actor string, requested_at timestamp")
    s2, k2, res = privacy.erase(subjects, keys, ask)
    assert {(r["subject_id"], r["erased"], r["reason"]) for r in res.collect()} == {
        ("s1", True, None), ("s9", False, "unknown subject")}
    assert read(s2, k2) == {"s1": None, "s2": '{"m":2}'}
    assert s2.where("subject_id = 's1'").first()["display_name"] == "[ERASED]"
    note = privacy.custody(k2, "s1").first()
    assert note["note"].endswith("crypto-shredded by dpo") and note["revoked_at"] == T + timedelta(40)
    assert [r["days"] for r in reports.erasure_breaches(s2).collect()] == [40.0]
    s3, k3, again = privacy.erase(s2, k2, ask)
    assert again.where("subject_id = 's1'").first()["reason"] == "already erased"
    assert k3.where("subject_id = 's1'").first()["revoked_at"] == T + timedelta(40)


def _alarm(signal, i):
    return (f"al{i}", "a", None, signal, "escalation", "quality", "High", 4.0, T + timedelta(hours=4), None, "", "open",
            T, None, None, None, None, None)


def test_attribution_ladder(spark):
    sig = R.SIGNALS
    al = spark.createDataFrame([_alarm(s, i) for i, s in enumerate(sig)], schemas.ALARMS)
    task = lambda i, agent, ts, cost, status="ok", err=None: (
        f"e{i}", agent, f"t{i}", "s", "m", 1, 1, cost, 1, err, status, False, ts, 0, 0.0, None, None)
    from decimal import Decimal as D
    h = timedelta(hours=1)
    tasks = spark.createDataFrame([
        task(1, "a", T - 24 * h, D("5"), "error", "edge"), task(2, "a", T - 24 * h - timedelta(seconds=1), D("99"), "error", "old"),
        task(3, "a", T - 3 * h, D("7.5"), "error", "mid"), task(4, "a", T + timedelta(seconds=1), D("88"), "error", "future"),
        task(5, "b", T - 3 * h, D("50"))], schemas.TASK_EVENTS)
    g = lambda i, ts, tool, kind="tool_call", dec=None: (f"g{i}", "a", "t", kind, dec, tool, "{}", False, ts)
    guards = spark.createDataFrame([
        g(1, T, "last"), g(2, T - 5 * h, "many"), g(3, T - 6 * h, "many"), g(4, T - 25 * h, "stale"), g(5, T - 25 * h, "stale"),
        g(6, T - 25 * h, "stale"), g(7, T - h, "pay", "permission_decision", "deny"), g(8, T - h, "aaa", "permission_decision", "deny"),
        g(9, T - h, "zzz", "permission_decision", "allow")], schemas.GUARD_EVENTS)
    tick = spark.createDataFrame([("x", "c", "tk", "manual", 0.0, "q", "r", T, "open", None, None, T - 30 * h)], schemas.TICKETS)
    got = {r["alarm_id"]: r for r in attribution.suggest(al, tasks, guards, tick).collect()}
    by = {s: got[f"al{i}"] for i, s in enumerate(sig)}
    assert by["loop>=2"]["suggested_step"] == "repeated call last (last at 2026-01-10 12:30:00)"
    assert by["error.rate>0.20"]["suggested_step"] == "edge on t1 (2026-01-09 12:30:00)"
    assert by["error.rate>0.20"]["note"].endswith("in one session with b")
    assert by["permission.deny>0.20"]["suggested_step"] == "denied tool 'aaa' (1x in 24h)"
    assert by["drift.tool_distribution>0.40"]["suggested_step"] == "pivot onto 'many' (2x in 24h)"
    assert by["cost.daily>2x_ewma"]["suggested_step"] == "task t3 on m ($7.50)"
    assert by["escalation.age_max>24"]["suggested_agent_id"] == "c"
    assert by["escalation.age_max>24"]["suggested_step"].startswith("open ticket tk (30h")
    assert (by["latency.retry>=3"]["confidence"], by["latency.retry>=3"]["suggested_step"]) == (0.30, "insufficient trace")
    bare = attribution.suggest(al, tasks.limit(0), guards.limit(0), tick.limit(0)).collect()
    assert {r["confidence"] for r in bare} == {0.30} and len(bare) == len(sig)


def test_verdicts_and_approval(spark):
    s = spark.createDataFrame([(f"al{i}", None, None, None) for i in range(3)],
                              "alarm_id string, confirmed boolean, confirmed_by string, confirmed_at timestamp")
    assert attribution.approval_rate(s).first().asDict() == {"decided": 0, "accepted": 0, "rejected": 0, "rate": None}
    v = spark.createDataFrame([("al0", "o", True, T), ("al0", "p", False, T + timedelta(1)), ("al1", "o", False, T), ("zz", "o", True, T)],
                              "alarm_id string, operator string, accepted boolean, at timestamp")
    done = attribution.apply_verdicts(s, attribution.verdicts(s, v))
    assert attribution.approval_rate(done).first().asDict() == {"decided": 2, "accepted": 1, "rejected": 1, "rate": 0.5}
    assert attribution.verdicts(done, v).count() == 0


def test_resolutions(spark):
    al = spark.createDataFrame([_alarm("loop>=2", 1), _alarm("loop>=2", 2)[:11] + ("resolved",) + _alarm("x", 2)[12:]], schemas.ALARMS)
    req = spark.createDataFrame([("al1", "ana", T), ("al1", "bo", T + timedelta(1)), ("al2", "bo", T), ("no", "bo", T)],
                                "alarm_id string, resolved_by string, requested_at timestamp")
    log = alarms.resolve_requests(al, req)
    assert {(r["alarm_id"], r["accepted"], r["resolved_by"]) for r in log.collect()} == {
        ("al1", True, "ana"), ("al2", False, "bo"), ("no", False, "bo")}
    assert alarms.open_queue(alarms.apply_resolutions(al, log)).count() == 0


def _two_files(spark, df, cut, tmp_path):
    src = str(tmp_path / "src")
    df.where(F.col("ts") < cut).coalesce(1).write.mode("append").parquet(src)
    df.where(F.col("ts") >= cut).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), src


def _sorted(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_loop_state_survives_batches(spark, tmp_path):
    g = A.guard_events(spark, SF)
    stream, _ = _two_files(spark, g, A.as_of("2024-01-15 09:00:00"), tmp_path)
    runs = str(tmp_path / "runs")
    detectors.land_runs(stream, runs, str(tmp_path / "k"))
    got = to_parquet(detectors.loop_openings(detectors.run_stream(spark, runs)), str(tmp_path / "o"), str(tmp_path / "c"), idle_batches=False)
    cols = ["task_id", "opened_at", "event_id", "agent_id", "tool_name"]
    assert _sorted(got, *cols) == _sorted(facts.loop_openings(g), *cols)


def test_alarm_log_is_one_chain_and_repeats_nothing(spark, tmp_path):
    t = A.task_events(spark, SF).where("retry_count >= 3").select(
        "agent_id", F.lit("latency.retry>=3").alias("signal"), F.col("retry_count").cast("double").alias("value"), "ts")
    stream, src = _two_files(spark, t, A.as_of("2024-01-15 09:20:00"), tmp_path)
    root, k = str(tmp_path / "log"), str(tmp_path / "k")
    detectors.alarm_log(stream, R.signal_rules(spark), root, k)
    alarms_, chain = detectors.alarm_tables(spark, root)
    n = chain.count()
    assert ledger.verify_chain(chain).first().asDict() == {"ok": True, "checked": n}
    assert alarms_.select("alarm_id").distinct().count() == n
    # a restart on the same checkpoint finds nothing new; a redelivered file adds no alarm
    detectors.alarm_log(stream, R.signal_rules(spark), root, k)
    t.coalesce(1).write.mode("append").parquet(src)
    detectors.alarm_log(stream, R.signal_rules(spark), root, k)
    alarms_, chain = detectors.alarm_tables(spark, root)
    assert alarms_.count() == n and chain.count() == n


@pytest.mark.parametrize("cut", [1, 2, 3, 4])
def test_a_cut_alarm_batch_leaves_no_alarm_without_entry(spark, tmp_path, monkeypatch, cut):
    """The run is lost before one of its three writes or before the commit."""
    t = A.task_events(spark, SF).where("retry_count >= 3").select(
        "agent_id", F.lit("latency.retry>=3").alias("signal"), F.col("retry_count").cast("double").alias("value"), "ts")
    t.write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "src"))
    root, k, calls = str(tmp_path / "log"), str(tmp_path / "k"), []
    stage, commit = TableLog.stage, TableLog.commit

    def step(fn):
        def run(self, *args, **kw):
            calls.append(fn)
            if len(calls) == cut:
                raise RuntimeError("driver lost")
            return fn(self, *args, **kw)
        return run

    with monkeypatch.context() as m:
        m.setattr(TableLog, "stage", step(stage))
        m.setattr(TableLog, "commit", step(commit))
        with pytest.raises(Exception):
            detectors.alarm_log(stream, R.signal_rules(spark), root, k)
    alarms_, chain = detectors.alarm_tables(spark, root)
    assert alarms_.count() == chain.count() == 0
    detectors.alarm_log(stream, R.signal_rules(spark), root, k)
    alarms_, chain = detectors.alarm_tables(spark, root)
    assert alarms_.select("alarm_id").exceptAll(chain.select("source_id")).count() == 0
    assert alarms_.count() == chain.count() > 0 and ledger.verify_chain(chain).first()["ok"]


def test_call_runs_stand_for_all_calls(spark, tmp_path):
    """A task with most calls is one row per minute, and runs cross minutes and batches."""
    t0 = datetime(2024, 1, 1)
    calls = [("big", i, "x" if i % 500 else "y") for i in range(3000)] + [("slow", i * 70, "z") for i in range(4)] + [("two", i * 40, "ab"[i // 2 % 2]) for i in range(40)]
    g = spark.createDataFrame([(f"g{task}{i:05d}", "a", task, "tool_call", None, "tool", f'{{"q": "{q}"}}', True, t0 + timedelta(seconds=i)) for task, i, q in calls],
                              schemas.GUARD_EVENTS)
    runs = detectors.call_runs(g)
    assert {r["task_id"]: r["count"] for r in runs.groupBy("task_id").count().collect()} == {"big": 50, "slow": 4, "two": 27}
    assert runs.agg(F.sum("n")).first()[0] == len(calls)
    for cut in (65, 1500):
        folder = tmp_path / str(cut)
        stream, _ = _two_files(spark, g, F.lit(t0 + timedelta(seconds=cut)), folder)
        detectors.land_runs(stream, str(folder / "runs"), str(folder / "k"))
        got = to_parquet(detectors.loop_openings(detectors.run_stream(spark, str(folder / "runs"))), str(folder / "o"), str(folder / "c"), idle_batches=False)
        cols = ["task_id", "opened_at", "event_id", "agent_id", "tool_name"]
        assert _sorted(got, *cols) == _sorted(facts.loop_openings(g), *cols)


def test_a_silent_agent_ends_its_calibration_by_timer(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "agent_id string, ts timestamp"
    batches = [[("silent", t0), ("busy", t0 + timedelta(hours=3))], [("busy", t0 + timedelta(days=2))], [("busy", t0 + timedelta(days=3, hours=1))], [("busy", t0 + timedelta(days=5))]]
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "src"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
        out = to_parquet(detectors.calibration_ends(stream, 3), str(tmp_path / "o"), str(tmp_path / "c"))
        got.append(sorted((r["agent_id"], r["calibration_until"]) for r in spark.read.schema("agent_id string, calibration_until timestamp").parquet(str(tmp_path / "o")).collect()))
    silent, busy = ("silent", t0 + timedelta(days=3)), ("busy", t0 + timedelta(days=3, hours=3))
    assert got == [[], [], [silent], [busy, silent]]



def test_new_class_log_over_batches(spark, tmp_path):
    t = A.task_events(spark, SF)
    stream, _ = _two_files(spark, t, A.as_of("2024-01-15 09:00:00"), tmp_path)
    detectors.new_class_log(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "o"))
    cols = ["agent_id", "class", "first_seen"]
    assert _sorted(got, *cols) == _sorted(facts.new_error_classes(t), *cols)


def test_cost_card_over_batches(spark, tmp_path):
    t = A.task_events(spark, SF)
    stream, _ = _two_files(spark, t, A.as_of("2024-01-15 09:00:00"), tmp_path)
    got = to_parquet(detectors.cost_card(stream, 5), str(tmp_path / "o"), str(tmp_path / "c"))
    want = {(r["agent_id"], str(r["day"])): r for r in facts.cost_spikes(facts.daily_cost(t), 5).collect()}
    rows = got.collect()
    assert len(rows) > 300
    for r in rows:
        w = want[(r["agent_id"], str(r["day"].date()))]
        assert r["n"] == w["n"] and r["mu"] == pytest.approx(w["mu"])


def test_hot_copy_is_partitioned_and_exactly_once(spark, tmp_path):
    t = A.task_events(spark, SF)
    stream, _ = _two_files(spark, t, A.as_of("2024-01-15 09:00:00"), tmp_path)
    for _ in range(2):
        got = ingest.copy_to_hot_tier(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    assert got.count() == t.count() == got.select("event_id").distinct().count()
    plan = got.where("event_date = '2024-01-20'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


@pytest.mark.parametrize("name", ["b1_error_rate", "b7_loop_hits", "b17_evaluate_facts", "d2_alarms", "d8_attribution",
                                  "e4_verify_chain", "e7_verify_seals", "g1_summary", "g9_agent_state", "x6_cost_outliers"])
def test_plans_have_no_cross_join(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["g26_window_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan and "GreaterThanOrEqual(ts,2024-01-10T00:00)" in plan
    costs = catalog.QUERIES["b12_daily_cost"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in costs


def test_the_earliest_alarm_of_a_key_wins(spark):
    at = [datetime(2024, 1, 1, 5, m) for m in (9, 3, 3)]
    fired = spark.createDataFrame([("a", "latency.retry>=3", v, t, True) for v, t in zip((9.0, 5.0, 4.0), at)],
                                  "agent_id string, signal string, value double, ts timestamp, fired boolean")
    rows = alarms.raise_alarms(alarms.map_to_alarms(fired, R.signal_rules(spark)), F.col("ts")).collect()
    assert [(r["trigger_value"], r["created_at"].minute) for r in rows] == [(4.0, 3)]


def test_a_cluster_without_shared_folder_is_refused():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("X", (), {"master": "spark://host:7077"})
    with pytest.raises(ValueError):
        work_dir(Session(), "x")


@pytest.fixture
def long_plans(spark):
    """Plans print folders whole, however long their path is."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("below", ["s", "a-rather-long-folder-name" * 6])
def test_incremental_evaluation_reads_only_what_is_new(spark, tmp_path, long_plans, below):
    tmp_path = tmp_path / below
    since = A.as_of("2024-01-20 00:00:00")
    A.task_events(spark, SF).write.parquet(str(tmp_path / "tasks"))
    A.guard_events(spark, SF).write.parquet(str(tmp_path / "guards"))
    t, g = (spark.read.parquet(str(tmp_path / n)) for n in ("tasks", "guards"))
    before = advance(t.where(F.col("ts") < since), g.where(F.col("ts") < since)).saved(str(tmp_path / "state"))
    after = advance(t, g, state=before, since=since)
    whole = advance(t, g)
    for name in ("tasks", "guards", "costs", "classes", "looped", "opened", "tails"):
        got, want = getattr(after, name), getattr(whole, name)
        got, want = (sorted(map(str, x.select(*[F.round(c, 6).alias(c) if d == "double" else c for c, d in want.dtypes]).collect())) for x in (got, want))
        assert got == want, name
        plan = getattr(after, name)._jdf.queryExecution().toString()
        scans = [x for x in plan.split("\n") if "FileScan parquet" in x and (f"{tmp_path}/tasks]" in x or f"{tmp_path}/guards]" in x)]
        assert scans and all("GreaterThanOrEqual(ts" in x for x in scans), name


FACTS = ("tasks", "guards", "costs", "classes", "looped", "opened", "tails")


def _texts(df):
    return sorted(map(str, df.select(*[F.round(c, 9).alias(c) if d == "double" else c for c, d in sorted(df.dtypes)]).collect()))


def _many_rows(spark, n=700):
    """Rows on a grid of 15 s, so that windows begin on rows, on full minutes and between them;
    one agent has a third of all rows, others come back after long breaks, some columns are null."""
    draw, start = random.Random(3), datetime(2024, 3, 1, 10, 0, tzinfo=UTC)
    tasks, guards = [], []
    for i in range(n):
        agent = "a0" if draw.random() < 0.33 else f"a{draw.randrange(1, 40)}"
        at = start + timedelta(seconds=15 * draw.randrange(0, 900))
        tasks.append((f"t{i}", agent, at, draw.choice(["ok", "ok", "error", "quarantined", None]), draw.randrange(0, 5),
                      draw.random(), draw.choice([None, "timeout", "HTTP 401"])))
        kind = draw.choice(["tool_call", "tool_call", "permission_decision", "other"])
        guards.append((f"g{i}", agent, f"{agent}-{draw.randrange(3)}", at, kind, draw.choice(["x", "y", None]),
                       '{"a":1}', draw.choice(["deny", "allow", None])))
    return (spark.createDataFrame(tasks, "event_id string, agent_id string, ts timestamp, status string, retry_count int, cost_usd double, error_class string"),
            spark.createDataFrame(guards, "event_id string, agent_id string, task_id string, ts timestamp, event_type string,"
                                  " tool_name string, arguments_json string, decision string"))


def test_state_log_merges_minutes_to_the_facts_of_all_rows(spark, tmp_path):
    t, g = _many_rows(spark)
    w = Windows(error_s=1500, deny_s=615, recent_h=0.25, prior_days=0.03)
    log, start = StateLog(spark, str(tmp_path / "state"), w), datetime(2024, 3, 1, 10, 0, tzinfo=UTC)
    assert log.latest() == (None, None)
    for minutes in (70, 70, 101.75, 140, 226):
        until = start + timedelta(minutes=minutes)
        got = log.step(t, g, until)
        assert log.latest()[0] == until
        seen = F.col("ts") < evaluate_plan.instant(until)
        want = advance(t.where(seen), g.where(seen), w)
        # an agent whose newest rows reach nothing has a row without values, or none
        valued = lambda s: {**{n: getattr(s, n) for n in FACTS}, "guards": s.guards.where("jsd IS NOT NULL OR deny IS NOT NULL")}
        for name in FACTS:
            assert _texts(valued(got)[name]) == _texts(valued(want)[name]), (minutes, name)
    folders = log.log.snapshot()
    # four steps, the second call of one of them added nothing
    assert len(folders.of("costs")) == 4 and len(folders.of("tasks")) == 1 and folders.version == 3


def test_a_cut_step_leaves_the_state_before_it(spark, tmp_path, monkeypatch):
    t, g = _many_rows(spark, 60)
    start = datetime(2024, 3, 1, 10, 0, tzinfo=UTC)
    log = StateLog(spark, str(tmp_path / "state"))
    log.step(t, g, start + timedelta(minutes=90))
    held = lambda: [_texts(getattr(log.latest()[1], f.name)) for f in fields(State)]
    before = held()
    with monkeypatch.context() as m:
        m.setattr(type(log.log), "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            log.step(t, g, start + timedelta(minutes=226))
    assert held() == before
    assert _texts(log.step(t, g, start + timedelta(minutes=226)).tasks) == _texts(advance(t, g).tasks)


def test_minutes_replace_the_look_back(spark, tmp_path):
    """Of the older rows a step asks for the slices in which windows begin, not for the week between."""
    day = lambda n: datetime(2024, 1, n, tzinfo=UTC)
    A.task_events(spark, SF).write.parquet(str(tmp_path / "tasks"))
    A.guard_events(spark, SF).write.parquet(str(tmp_path / "guards"))
    t, g = (spark.read.parquet(str(tmp_path / n)) for n in ("tasks", "guards"))
    log = StateLog(spark, str(tmp_path / "state"))
    state, since = log.step(t, g, day(20)), evaluate_plan.instant(day(20))
    new = g.where((F.col("ts") >= since) & (F.col("ts") < A.as_of("2024-01-21 00:00:00")))
    edges = evaluate_plan._edge_rows(g.where(F.col("ts") < A.as_of("2024-01-21 00:00:00")), new, since, [86_400, 8 * 86_400, 1])
    days = {r["d"].day for r in edges.select(F.to_date("ts").alias("d")).distinct().collect()}
    assert {12, 19, 20} <= days <= {12, 13, 19, 20}
    assert state.task_minutes.agg(F.min("minute")).first()[0].day >= 18


def test_lookback_broadcasts_nothing_and_counts_whole_windows(spark):
    """what asks for windows grows with the alarms, so it must not pass the driver."""
    rnd = random.Random(7)
    at = lambda: T - timedelta(seconds=rnd.randrange(40 * 3600), microseconds=rnd.randrange(3) * 400_000)
    rows = [(rnd.choice("ab"), at(), rnd.choice("xy")) for _ in range(600)]
    asked = [(f"al{i}", "a", "s", at()) for i in range(20)] + [("on the hour", "b", "s", T.replace(minute=0)), ("none", "b", None, T)]
    al = spark.createDataFrame(asked, "alarm_id string, agent_id string, signal string, created_at timestamp")
    df = spark.createDataFrame(rows, "agent_id string, ts timestamp, tool_name string")
    out = attribution._lookback(al, ["s"], df, {"n": F.lit(1), "last": F.col("ts")}, {"n": F.sum, "last": F.max}, ["tool_name"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for alarm, agent, signal, to in asked:
        for who, ts, tool in rows:
            if signal == "s" and who == agent and to - timedelta(hours=24) <= ts <= to:
                n, last = want.get((alarm, tool), (0, ts))
                want[alarm, tool] = (n + 1, max(last, ts))
    assert {(r["alarm_id"], r["tool_name"]): (r["n"], r["last"]) for r in out.collect()} == want


def test_signed_log_deals_days_to_few_files(spark, tmp_path):
    """one folder per day with a bounded number of files; a nonce seen in an earlier batch is a replay."""
    from fleetwatch.functions.hashing import hmac_pads
    pads, rows = hmac_pads(spark, {"k": b"secret"}), []
    import hashlib
    import hmac
    for h in range(48):
        at = T.replace(minute=0) - timedelta(hours=h)
        seconds, nonce = str(int((at - datetime(1970, 1, 1)).total_seconds())), f"n{h}"
        sign = hmac.new(b"secret", f"{seconds}.{nonce}".encode() + b"{}", hashlib.sha256).hexdigest()
        rows.append((f"e{h}", "k", seconds, nonce, sign, "{}", at))
    spark.createDataFrame(rows, schemas.ENVELOPES).write.parquet(str(tmp_path / "in" / "0"))
    run = lambda: ingest.signed_log(ingest.envelope_stream(spark, str(tmp_path / "in" / "*")), pads, str(tmp_path / "log"), str(tmp_path / "cp"))
    run()
    spark.createDataFrame(rows[:5], schemas.ENVELOPES).write.parquet(str(tmp_path / "in" / "1"))
    run()
    folders = [p for p in (tmp_path / "log" / "landed" / "batch_id=0").iterdir() if p.is_dir()]
    assert len(folders) == 3 and all(len(list(p.glob("part-*"))) <= 8 for p in folders)
    assert spark.read.parquet(str(tmp_path / "log" / "landed")).count() == 48
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "log" / "rejected")).collect()] == ["replay"] * 5


def test_the_loop_breaker_takes_rows_and_asks_its_state_once():
    class Tail:
        value, asked = None, 0

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.value = value

    run = lambda minute, n, sig, calls: Row(task_id="t", minute=minute, first_us=minute, n=n, head_sig=sig, head=n, tail_sig=sig, tail=n,
                                            head_calls=[{"us": c, "event_id": f"e{c}", "agent_id": "a", "tool_name": "x"} for c in calls], hit=None)
    breaker = detectors._LoopBreaker(3, None)
    breaker.tail = Tail()
    assert list(breaker.handleInputRows(("t",), iter([run(2, 1, "s", [20]), run(1, 1, "s", [10])]), None)) == []
    assert breaker.tail.value == ("s", 2, False) and breaker.tail.asked == 1
    out = list(breaker.handleInputRows(("t",), iter([run(3, 2, "s", [30, 31])]), None))
    assert [(r.task_id, r.opened_us, r.event_id) for r in out] == [("t", 30, "e30")]
    assert list(breaker.handleInputRows(("t",), iter([run(4, 2, "s", [40, 41])]), None)) == []


def test_a_stored_step_reads_the_new_rows_once(spark, tmp_path, long_plans, monkeypatch):
    """what a step adds comes from rows that were read, and whose calls were signed, once; a null task is a task, too."""
    t, g = _many_rows(spark, 300)
    g = g.withColumn("task_id", F.when(F.col("task_id") != "a0-1", F.col("task_id")))
    t.write.parquet(str(tmp_path / "tasks"))
    g.write.parquet(str(tmp_path / "guards"))
    t, g = (spark.read.parquet(str(tmp_path / n)) for n in ("tasks", "guards"))
    written, first = [], datetime(2024, 3, 1, 10, 0, tzinfo=UTC)
    keep = evaluate_plan.kept
    monkeypatch.setattr(evaluate_plan, "kept", lambda rows, purpose: written.append((purpose, rows)) or keep(rows, purpose))
    log = StateLog(spark, str(tmp_path / "state"))
    for n, minutes in enumerate((100, 226)):
        written.clear()
        state = log.step(t, g, first + timedelta(minutes=minutes))
        source = lambda rows, name: f"{tmp_path}/{name}]" in rows._jdf.queryExecution().toString()
        from_tasks, from_guards = ([p for p, rows in written if source(rows, name)] for name in ("tasks", "guards"))
        assert from_tasks == ["new-tasks", "task-edges"][:n + 1] and from_guards == ["new-guards", "guard-edges"][:n + 1]
    whole = advance(t, g)
    for name in ("tasks", "costs", "classes", "looped", "opened", "tails"):
        assert _texts(getattr(state, name)) == _texts(getattr(whole, name)), name


def test_signed_log_deals_out_bodies_once(spark, tmp_path, monkeypatch):
    """of a batch only the bodies of authentic envelopes are exchanged, and once; the tables of a batch are compressed
    and those that only serve it are gone when it ends."""
    import hashlib
    import hmac
    import os
    import re

    from pyspark.sql import DataFrameWriter

    from fleetwatch.functions.hashing import hmac_pads

    def envelope(i, nonce, minutes, secret=b"secret", key="k"):
        at = T.replace(hour=23, minute=50) + timedelta(minutes=minutes)
        seconds, body = str(int((at - datetime(1970, 1, 1)).total_seconds())), f'{{"resourceSpans": [], "i": {i}}}'
        sign = hmac.new(secret, f"{seconds}.{nonce}{body}".encode(), hashlib.sha256).hexdigest()
        return (f"e{i}", key, seconds, nonce, sign, body, at)

    first = [envelope(i, f"n{i}", i) for i in range(20)]
    odd = [envelope(30, "n3", 9), envelope(31, "n31", 1, b"wrong"), envelope(32, "n32", 2, key="none"), envelope(33, None, 3),
           (*envelope(34, "n34", 4)[:6], None)]
    then = [envelope(40, "n40", 5), envelope(41, "n4", 30)]
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.append(
        (path, self._df._jdf.queryExecution().explainString(self._df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))) or write(self, path, *a, **k))
    base, kept = spark.conf.get("spark.checkpoint.dir"), lambda: {n for n in os.listdir(base) if n.startswith("signed-")} if os.path.exists(base) else set()
    before, table = kept(), lambda name: spark.read.parquet(str(tmp_path / "log" / name))
    for n, rows in enumerate((first + odd + first[:2], then + first[5:7])):
        frame = spark.createDataFrame(rows, schemas.ENVELOPES)
        write(frame.write, str(tmp_path / "in" / str(n)))
        plans.clear()
        ingest.signed_log(ingest.envelope_stream(spark, str(tmp_path / "in" / "*")), hmac_pads(spark, {"k": b"secret"}),
                          str(tmp_path / "log"), str(tmp_path / "cp"))
        exchanges = [x for _, plan in plans for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\bbody#", plan)]
        assert len(exchanges) == 1 and kept() == before
    nonce = lambda rows: sorted((r[3], r[5], r[6].replace(tzinfo=None)) for r in rows)
    assert nonce(first + then[:1]) == sorted((r["nonce"], r["body"], r["received_at"]) for r in table("landed").collect())
    reasons = sorted((r["envelope_id"], r["reason"]) for r in table("rejected").collect())
    assert reasons == sorted([("e0", "replay"), ("e1", "replay"), ("e30", "replay"), ("e31", "bad_signature"), ("e32", "unknown_key"),
                              ("e33", "missing_nonce"), ("e34", "timestamp_skew"), ("e41", "replay"), ("e5", "replay"), ("e6", "replay")])
    files = [f.name for f in (tmp_path / "log").rglob("part-*")]
    assert files and all(".zstd." in f for f in files)


def test_lookback_keeps_only_days_that_alarms_ask_for(spark, monkeypatch):
    """rows of an agent on days outside all windows reach no level, and the join that leaves them out broadcasts nothing."""
    events = [(agent, T - timedelta(days=d, minutes=m), "x") for agent in "abc" for d in range(20) for m in range(10)]
    df = spark.createDataFrame(events, "agent_id string, ts timestamp, tool_name string")
    asked = [("1", "a", "s", T - timedelta(days=3)), ("2", "a", "s", T - timedelta(days=3, hours=1)), ("3", "b", "other", T), ("4", None, "s", T), ("5", "b", "s", None)]
    al = spark.createDataFrame(asked, "alarm_id string, agent_id string, signal string, created_at timestamp")
    written, keep = [], attribution.kept
    monkeypatch.setattr(attribution, "kept", lambda rows, purpose: written.append(rows) or keep(rows, purpose))
    out = attribution._lookback(al, ["s"], df, {"n": F.lit(1)}, {"n": F.sum}, ["tool_name"])
    assert {(r["alarm_id"], r["n"]) for r in out.collect()} == {("1", 11), ("2", 10)}
    assert [rows.count() for rows in written] == [20, 20]
    assert not any("Broadcast" in rows._jdf.queryExecution().executedPlan().toString() for rows in written)
