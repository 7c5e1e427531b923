"""Commits over several tables, and moving days from the hot to the warm table."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fleetwatch.operators import commits, ingest, privacy, tiers
from fleetwatch.operators.commits import Conflict, TableLog

SCHEMA = "event_id string, agent_id string, ts timestamp"
DAYS = f"{SCHEMA}, event_date date"


def rows(spark, *ids):
    """Ids like 3a: an event of the third of January; 3- has no id."""
    return spark.createDataFrame([(i if i[1] != "-" else None, "x", datetime(2024, 1, int(i[0]), 12)) for i in ids], SCHEMA)


def ids(log, table):
    return sorted(f"{r['ts'].day}-" if r["event_id"] is None else r["event_id"] for r in log.read(table, DAYS).collect())


@pytest.fixture
def log(spark, tmp_path):
    return TableLog(spark, str(tmp_path / "log"))


def test_readers_see_committed_folders_only(spark, log):
    assert log.read("t", "n long").count() == 0
    a = log.stage("t", spark.range(3).withColumnRenamed("id", "n"))
    b = log.stage("u", spark.range(2).withColumnRenamed("id", "n"))
    assert log.read("t", "n long").count() == 0
    log.commit({"t": a, "u": b}, writer="w", batch=4)
    assert (log.read("t", "n long").count(), log.read("u", "n long").count()) == (3, 2)
    # the same batch again changes nothing, a later one does
    log.commit({"t": log.stage("t", spark.range(9).withColumnRenamed("id", "n"))}, writer="w", batch=4)
    assert log.read("t", "n long").count() == 3 and log.is_done("w", 4) and not log.is_done("w", 5)
    log.commit({"t": b and log.stage("t", spark.range(1).withColumnRenamed("id", "n"))}, {"u": b}, writer="w", batch=5)
    assert (log.read("t", "n long").count(), log.read("u", "n long").count()) == (4, 0)


def test_a_commit_on_what_is_gone_is_refused(spark, log):
    a = log.stage("t", spark.range(3))
    log.commit({"t": a})
    log.commit({}, {"t": a})
    with pytest.raises(Conflict):
        log.commit({"t": log.stage("t", spark.range(1))}, {"t": a})


def test_two_writers_take_two_numbers(spark, log, monkeypatch):
    a, b = log.stage("t", spark.range(3)), log.stage("t", spark.range(4))
    create, other = TableLog._created, TableLog(spark, log.root)

    def late(self, name, text):
        if self is log and not other.snapshot().live:
            other.commit({"t": b})  # in between
        return create(self, name, text)

    monkeypatch.setattr(TableLog, "_created", late)
    assert log.commit({"t": a}) == 1
    assert log.read("t", "id long").count() == 7


def test_a_cut_commit_file_does_not_count(spark, log):
    log.commit({"t": log.stage("t", spark.range(3))})
    more = log.stage("t", spark.range(5))
    log._created(f"log/{1:012d}.json", '{"op": "add", "table": "t", "dir": "%s"}' % more[0])
    assert log.read("t", "id long").count() == 3
    assert log.commit({"t": more}) == 2
    assert log.read("t", "id long").count() == 8


def test_the_log_is_repeated_whole_from_time_to_time(spark, log, monkeypatch):
    monkeypatch.setattr(commits, "WHOLE", 3)
    folders = [log.stage("t", spark.range(i)) for i in range(1, 9)]
    for i, f in enumerate(folders):
        log.commit({"t": f}, {"t": folders[i - 1]} if i % 2 else None, "w", i)
    assert sorted(log.snapshot().of("t")) == sorted(f for i, fs in enumerate(folders) if i % 2 for f in fs)
    assert log.read("t", "id long").count() == 2 + 4 + 6 + 8 and log.is_done("w", 7)
    log.compact("t")
    assert len(log.snapshot().of("t")) == 1 and log.read("t", "id long").count() == 20


def test_purge_deletes_what_nobody_reads(spark, log):
    a, b = log.stage("t", spark.range(3)), log.stage("t", spark.range(4))
    log.commit({"t": a})
    log.commit({"t": b}, {"t": a})
    under_way = log.stage("t", spark.range(5))
    assert log.purge() == 1 and log._names("t") == sorted([*b, *under_way])
    assert log.purge(older_than_s=-5) == 1 and log._names("t") == b
    assert log.read("t", "id long").count() == 4


def test_late_rows_of_a_moved_day_reach_the_warm_table(spark, log):
    tiers.land(log, rows(spark, "3a", "3b", "3-", "4a", "6a"))
    assert tiers.to_warm(log, date(2024, 1, 5)) == [date(2024, 1, 3), date(2024, 1, 4)]
    tiers.land(log, rows(spark, "3c", "3a", "3-", "6b"))  # 3a once more, 3c and another row without id late
    assert tiers.to_warm(log, date(2024, 1, 5)) == [date(2024, 1, 3)]
    assert ids(log, "warm") == ["3-", "3-", "3a", "3b", "3c", "4a"]
    assert ids(log, "hot") == ["6a", "6b"]
    assert tiers.to_warm(log, date(2024, 1, 5)) == []
    assert tiers.hot_days(log) == [date(2024, 1, 6)]


@pytest.mark.parametrize("cut", ["stage", "commit", "after"])
def test_a_run_cut_anywhere_leaves_each_row_once(spark, log, monkeypatch, cut):
    tiers.land(log, rows(spark, "3a", "3b", "3-", "4a", "6a"), writer="feed", batch=0)

    def lost(self, *args, **kw):
        if cut == "after":
            done(self, *args, **kw)
        raise RuntimeError("executor lost")

    done = getattr(TableLog, "stage" if cut == "stage" else "commit")
    with monkeypatch.context() as m:
        m.setattr(TableLog, "stage" if cut == "stage" else "commit", lost)
        with pytest.raises(RuntimeError):
            tiers.to_warm(log, date(2024, 1, 5))
    assert sorted(ids(log, "hot") + ids(log, "warm")) == ["3-", "3a", "3b", "4a", "6a"]
    tiers.to_warm(log, date(2024, 1, 5))
    tiers.land(log, rows(spark, "3a", "3b", "3-", "4a", "6a"), writer="feed", batch=0)  # the batch is delivered again
    assert (ids(log, "warm"), ids(log, "hot")) == (["3-", "3a", "3b", "4a"], ["6a"])


def test_rows_that_come_during_the_move_stay_hot(spark, log, monkeypatch):
    tiers.land(log, rows(spark, "3a"))
    arrange = tiers.by_day

    def and_meanwhile(*args):
        monkeypatch.setattr(tiers, "by_day", arrange)
        tiers.land(log, rows(spark, "3b"))
        return arrange(*args)

    monkeypatch.setattr(tiers, "by_day", and_meanwhile)
    tiers.to_warm(log, date(2024, 1, 5))
    assert (ids(log, "warm"), ids(log, "hot")) == (["3a"], ["3b"])
    tiers.to_warm(log, date(2024, 1, 5))
    assert (ids(log, "warm"), tiers.hot_days(log)) == (["3a", "3b"], [])


def test_expired_days_leave_without_being_read(spark, log):
    tiers.land(log, rows(spark, "3a", "4a", "6a"))
    assert tiers.expire(log, date(2024, 1, 5)) == [date(2024, 1, 3), date(2024, 1, 4)]
    assert ids(log, "hot") == ["6a"] and log.purge() == 2


def test_first_write_wins_against_hot_and_warm(spark, log):
    tiers.land_new(log, rows(spark, "3a", "3a", "4a", "6a"))
    tiers.to_warm(log, date(2024, 1, 5))
    tiers.land_new(log, rows(spark, "3a", "3b", "6a", "6b", "7a"))
    assert (ids(log, "warm"), ids(log, "hot")) == (["3a", "4a"], ["3b", "6a", "6b", "7a"])


def test_late_rows_are_copied_once(spark, log, tmp_path, monkeypatch):
    target = TableLog(spark, str(tmp_path / "copy"))
    tiers.land(log, rows(spark, "6a", "6-"))
    assert len(tiers.copy_new(log, target)) == 1 and tiers.copy_new(log, target) == []
    tiers.land(log, rows(spark, "3a", "6b"))  # below and at the newest copied day
    read = []
    keep = TableLog.read
    monkeypatch.setattr(TableLog, "read", lambda self, table, schema=None, folders=None: read.extend(folders or []) or keep(self, table, schema, folders))
    with monkeypatch.context() as m:
        m.setattr(TableLog, "commit", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tiers.copy_new(log, target)
    new = tiers.copy_new(log, target)
    assert len(new) == 2 and set(read) == set(new)  # the first folder is not read again
    assert ids(target, "hot") == ["3a", "6-", "6a", "6b"]


def test_days_of_plain_folders_are_dropped(spark, tmp_path):
    path = str(tmp_path / "days")
    ingest.write_by_day(rows(spark, "3a", "4a", "6a"), path)
    assert tiers.drop_days(spark, path, date(2024, 1, 5)) == [date(2024, 1, 3), date(2024, 1, 4)]
    assert tiers.days_of(spark, path) == [date(2024, 1, 6)]


@pytest.mark.parametrize("cut", ["stage", "commit", "purge"])
def test_an_erasure_that_is_cut_is_made_good(spark, tmp_path, monkeypatch, cut):
    path, master = str(tmp_path / "subjects"), F.unhex(F.sha2(F.lit("m"), 256))
    at = datetime(2024, 1, 1)
    people = spark.createDataFrame([(f"s{i}", f"n{i}", "{}", "ops", "contract", at) for i in range(200)],
                                   "subject_id string, display_name string, pii string, actor string, lawful_basis string, requested_at timestamp")
    privacy.register(people, master, path)
    gone = spark.createDataFrame([("s3",), ("s77",)], "subject_id string")

    def lost(self, *args, **kw):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(TableLog, cut, lost)
        with pytest.raises(RuntimeError):
            privacy.shred(spark, path, gone)
    assert privacy.registered(spark, path)[0].count() == 200
    privacy.shred(spark, path, gone)
    readable = privacy.read_personal_data(*privacy.registered(spark, path), master)
    assert {r["subject_id"] for r in readable.where("pii IS NULL").collect()} == {"s3", "s77"} and readable.count() == 200
    # no file below the folder still holds a key of theirs, listed or not; what the cut run staged is not older than a day
    if cut != "commit":
        assert spark.read.parquet(f"{path}/subjects").where("subject_id IN ('s3', 's77') AND wrapped_key IS NOT NULL").count() == 0
