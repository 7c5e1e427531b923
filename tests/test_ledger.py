"""Chain, Merkle roots, seals and archive against hashlib."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetwatch import schemas
from fleetwatch.operators import archive, commits, ledger
from fleetwatch.rules import UNSIGNED_MARK

T0 = datetime(2026, 1, 1)


def _h(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def _rows(n):
    return [(i + 1, "x", _h(i), _h(i - 1) if i else "GENESIS", bytearray(UNSIGNED_MARK), T0) for i in range(n)]


def _ledger(spark, rows):
    return spark.createDataFrame(rows, schemas.LEDGER)


def _root(hashes):
    level = [bytes.fromhex(h) for h in hashes]
    while len(level) > 1:
        level += level[-1:] if len(level) % 2 else []
        level = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2])]
    return level[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1024, 1025, 2049, 5000])
def test_merkle_root(spark, n):
    assert ledger.merkle_root(_ledger(spark, _rows(n))).first()["root"] == _root([_h(i) for i in range(n)])


def test_merkle_root_of_nothing(spark):
    assert ledger.merkle_root(_ledger(spark, [])).first()["root"] == hashlib.sha256(b"GENESIS").hexdigest()


def test_extra_levels_change_nothing(spark):
    rows = _rows(1500)
    assert ledger.merkle_root(_ledger(spark, rows), 4).first()["root"] == _root([_h(i) for i in range(1500)])


def test_prefix_roots(spark, monkeypatch):
    """Small blocks, so that several levels of shared and own blocks take part."""
    monkeypatch.setattr(ledger, "BLOCK", 4)
    monkeypatch.setattr(ledger, "_HEIGHT", 2)
    l = _ledger(spark, _rows(70))
    covers = list(range(1, 71))
    got = ledger.prefix_roots(l, spark.createDataFrame([(c,) for c in covers], "covers long")).collect()
    assert {r["covers"]: r["root"] for r in got} == {c: _root([_h(i) for i in range(c)]) for c in covers}
    assert ledger.merkle_root(l).first()["root"] == _root([_h(i) for i in range(70)])


def _entries(spark, n, start=0):
    rows = [("x", f'{{"b": {i}, "a": 1}}', T0 + timedelta(minutes=7 * (i // 3)), f"s{i:05d}") for i in range(start, start + n)]
    return spark.createDataFrame(rows, "event_type string, payload string, created_at timestamp, source_id string")


def test_append_in_two_batches(spark, tmp_path):
    path = str(tmp_path / "l")
    ledger.append(_entries(spark, 40)).write.parquet(path)
    stored = spark.read.parquet(path)
    both = stored.unionByName(ledger.append(_entries(spark, 25, 40), stored))
    rows = both.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 66))
    want = [hashlib.sha256(f'{{"a":1,"b":{i}}}'.encode()).hexdigest() for i in range(65)]
    assert [r["payload_hash"] for r in rows] == want
    assert [r["prev_hash"] for r in rows] == ["GENESIS"] + want[:-1]
    assert ledger.verify_chain(both).first().asDict() == {"ok": True, "checked": 65}


@pytest.mark.parametrize("at, change, reason", [
    (10, {3: "0" * 64}, "broken link"), (0, {3: "x"}, "broken link"), (7, {2: _h(7).upper()}, "malformed hash"),
    (7, {2: None}, "malformed hash"), (4, {4: bytearray(b"short")}, "malformed signature"), (4, {4: None}, "malformed signature")])
def test_tampering_is_located(spark, monkeypatch, at, change, reason):
    monkeypatch.setattr(ledger, "CHAIN_RANGE", 4)
    rows = [list(r) for r in _rows(20)]
    for col, v in change.items():
        rows[at][col] = v
    l = _ledger(spark, rows)
    assert ledger.verify_chain(l).first().asDict() == {"ok": False, "checked": at}
    first = ledger.chain_breaks(l).orderBy("seq").first()
    assert (first["seq"], first["reason"]) == (at + 1, reason)


def test_real_signatures_are_accepted_and_empty_ledger_is_ok(spark):
    rows = [list(r) for r in _rows(3)]
    rows[1][4] = bytearray(64)
    assert ledger.verify_chain(_ledger(spark, rows)).first()["ok"]
    assert ledger.verify_chain(_ledger(spark, [])).first().asDict() == {"ok": True, "checked": 0}


def _message(root, covers):
    return root.encode() + covers.to_bytes(8, "big")


def test_seal_and_verify(spark):
    l = _ledger(spark, _rows(9))
    root = _root([_h(i) for i in range(9)])
    token = bytearray(b"head" + hashlib.sha256(_message(root, 9)).digest())
    s = ledger.seal(l, F.lit(T0), countersign=F.lit(token)).first()
    assert (s["root_hash"], s["covers_through_seq"]) == (root, 9)
    assert ledger.seal(l, F.lit(T0), countersign=F.lit(bytearray(b"other"))).count() == 0
    assert ledger.seal(_ledger(spark, []), F.lit(T0)).count() == 0
    ddl = "seal_id string, root_hash string, covers_through_seq long, countersign binary, signature_ok boolean"
    five = _root([_h(i) for i in range(5)])
    seals = spark.createDataFrame([
        ("good", root, 9, token, True), ("plain", five, 5, None, True), ("unsigned", five, 5, None, None),
        ("wrong", "0" * 64, 5, None, True), ("beyond", root, 10, None, True), ("unbound", five, 5, token, True)], ddl)
    got = {r["seal_id"]: (r["ok"], r["reason"]) for r in ledger.verify_seals(l, seals).collect()}
    assert got == {"good": (True, None), "plain": (True, None), "unsigned": (False, "root or signature mismatch"),
                   "wrong": (False, "root or signature mismatch"), "beyond": (False, "covers seq beyond ledger"),
                   "unbound": (False, "countersign binding failed")}
    bad = [list(r) for r in _rows(9)]
    bad[6][2] = "nothex"
    got = {r["seal_id"]: r["reason"] for r in ledger.verify_seals(_ledger(spark, bad), seals).collect()}
    assert got["good"] == "corrupt payload hash in covered range" and got["plain"] is None
    card = lambda l, s: ledger.integrity_card(l, s).first()["status"]
    assert card(l, seals.limit(0)) == "pass" and card(l, seals) == "fail"
    assert card(_ledger(spark, []), seals.limit(0)) == "empty"


def test_roots_from_stored_nodes(spark, tmp_path, monkeypatch):
    """Blocks of four: every prefix of a ledger that grew in steps, from its stored nodes."""
    monkeypatch.setattr(ledger, "BLOCK", 4)
    monkeypatch.setattr(ledger, "_HEIGHT", 2)
    log = commits.TableLog(spark, str(tmp_path / "nodes"))
    l = _ledger(spark, _rows(70))
    assert ledger.extend_nodes(l.where("seq <= 3"), log) == 0
    assert [ledger.extend_nodes(l.where(f"seq <= {n}"), log) for n in (21, 22, 70)] == [2, 2, 3]
    got = log.read("nodes", ledger.NODE_ROWS)
    assert {r["level"]: r["count"] for r in got.groupBy("level").count().collect()} == {1: 17, 2: 4, 3: 1}
    covers = [1, 3, 4, 5, 16, 17, 21, 63, 64, 65, 70]
    roots = ledger.prefix_roots(l, spark.createDataFrame([(c,) for c in covers], "covers long"), log=log)
    assert {r["covers"]: r["root"] for r in roots.collect()} == {c: _root([_h(i) for i in range(c)]) for c in covers}
    s = ledger.seal(l, F.lit(T0), log=log).first()
    assert (s["root_hash"], s["covers_through_seq"]) == (_root([_h(i) for i in range(70)]), 70)
    assert ledger.seal(_ledger(spark, []), F.lit(T0), log=log).count() == 0


def test_a_seal_reads_new_blocks_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 4)
    monkeypatch.setattr(ledger, "_HEIGHT", 2)
    _ledger(spark, _rows(70)).write.parquet(str(tmp_path / "ledger"))
    l, log = spark.read.parquet(str(tmp_path / "ledger")), commits.TableLog(spark, str(tmp_path / "nodes"))
    ledger.extend_nodes(l.where("seq <= 41"), log)
    read = []
    keep = ledger._nodes
    monkeypatch.setattr(ledger, "_nodes", lambda rows: read.append(rows) or keep(rows))
    ledger.extend_nodes(l, log)
    roots = ledger.prefix_roots(l, spark.createDataFrame([(70,)], "covers long"), log=log)
    assert roots.first()["root"] == _root([_h(i) for i in range(70)])
    plans = [r._jdf.queryExecution().toString() for r in read]
    assert any("GreaterThan(seq,40)" in p for p in plans) and any("GreaterThan(seq,68)" in p for p in plans)


def test_payload_problems(spark):
    rows = [("a", '{"v": 1}'), ("b", '{"v": NaN}'), ("c", '{"v": -Infinity}'), ("d", "{"), ("e", None), ("f", '{"v": "NaN"}')]
    got = ledger.payload_problems(spark.createDataFrame(rows, "source_id string, payload string")).collect()
    assert {r["source_id"]: r["reason"] for r in got} == {
        "b": "non-finite number", "c": "non-finite number", "d": "invalid json", "e": "missing payload"}


def test_archive_round_trip_and_tampering(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = _rows(25)
    first = archive.archive_ledger(_ledger(spark, rows[:15]), path, 10).orderBy("chunk").collect()
    assert [(r["first_seq"], r["last_seq"], r["rows"]) for r in first] == [(1, 10, 10), (11, 15, 5)]
    second = archive.archive_ledger(_ledger(spark, rows), path, 10).orderBy("chunk").collect()
    assert [(r["first_seq"], r["last_seq"]) for r in second] == [(1, 10), (11, 20), (21, 25)]
    assert second[0]["sha256"] == first[0]["sha256"]
    assert second[0]["chain_digest"] == hashlib.sha256("".join(_h(i) for i in range(10)).encode()).hexdigest()
    assert [r["reason"] for r in archive.verify_archive(spark, path).collect()] == [None] * 3
    # the manifest keeps its hashes while one stored chunk is replaced
    key = second[1]["key"]
    one = spark.read.parquet(f"{path}/chunks/key={key}").withColumn("event_type", F.lit("forged"))
    forged = one.collect()
    spark.createDataFrame(forged, one.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/chunks/key={key}")
    got = {r["key"]: r["reason"] for r in archive.verify_archive(spark, path).collect()}
    assert got[key] == "chunk hash mismatch" and list(got.values()).count(None) == 2


def test_a_second_run_reads_new_numbers_only(spark, tmp_path):
    path, at = str(tmp_path / "a"), str(tmp_path / "ledger")
    _ledger(spark, _rows(35)).write.parquet(at)
    whole = spark.read.parquet(at)
    archive.archive_ledger(whole, path, 10, upto_seq=25)
    assert archive.archived_through(spark, path, 10) == 20
    rest = archive.pending_rows(whole, path, 10)
    assert "GreaterThan(seq,20)" in rest._jdf.queryExecution().toString() and rest.count() == 15
    before = {r["key"]: r["sha256"] for r in archive.manifest_of(spark, path).collect()}
    # the files of whole chunks are not opened again: one that is damaged is found by the check, not by the next run
    key = "chunk_000000000001_000000000010"
    spark.createDataFrame([(1,)], "seq long").coalesce(1).write.mode("overwrite").parquet(f"{path}/chunks/key={key}")
    after = archive.archive_ledger(whole, path, 10)
    assert [(r["first_seq"], r["last_seq"]) for r in after.orderBy("chunk").collect()] == [(1, 10), (11, 20), (21, 30), (31, 35)]
    assert all(r["sha256"] == before.get(r["key"], r["sha256"]) for r in after.collect())
    assert {r["key"] for r in archive.verify_archive(spark, path).where("reason IS NOT NULL").collect()} == {key, "chunk_000000000011_000000000020"}
    assert archive.archive_ledger(whole, path, 10).count() == 4  # nothing new


def test_a_chunk_whose_file_was_cut_is_not_listed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    describe = archive._describe_keys
    with monkeypatch.context() as m:
        m.setattr(archive, "_describe_keys", lambda rows: describe(rows.where("seq <> 15")))
        assert [r["first_seq"] for r in archive.archive_ledger(_ledger(spark, _rows(30)), path, 10).orderBy("chunk").collect()] == [1, 21]
    assert archive.archived_through(spark, path, 10) == 10
    assert archive.archive_ledger(_ledger(spark, _rows(30)), path, 10).count() == 3
    assert archive.verify_archive(spark, path).where("reason IS NOT NULL").count() == 0


@pytest.mark.parametrize("as_json", [True, False])
def test_a_bundle_is_verified_from_its_files(spark, tmp_path, as_json):
    path = str(tmp_path / "b")
    l = _ledger(spark, _rows(12))
    root = _root([_h(i) for i in range(9)])
    seals = spark.createDataFrame([("s1", root, 9, None, None, T0, None, True)], schemas.SEALS)
    empty = spark.createDataFrame([], schemas.TICKETS)
    archive.export_bundle({"ledger": l, "seals": seals, "tickets": empty}, path, as_json)
    checked = archive.verify_bundle(spark, path)
    assert checked.where("NOT ok").count() == 0
    assert {(r["part"], r["id"]) for r in checked.where("part <> 'file'").collect()} == {
        ("table", "ledger"), ("table", "seals"), ("table", "tickets"), ("chain", "ledger"), ("seal", "s1")}
    back = archive.rebuild_bundle(spark, path)
    assert sorted(map(str, back["ledger"].collect())) == sorted(map(str, l.collect())) and back["ledger"].schema == l.schema
    # one byte of one file
    files = [f for f in (tmp_path / "b" / "ledger").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    victim = files[0]
    if as_json:
        victim.write_bytes(victim.read_bytes().replace(b'"seq":1,', b'"seq":1 ,', 1) + b" ")
    else:
        victim.write_bytes(victim.read_bytes() + b"\0")
    (tmp_path / "b" / "ledger" / f".{victim.name}.crc").unlink(missing_ok=True)
    named = archive.verify_bundle_files(spark, path).where("detail IS NOT NULL").collect()
    assert [(r["id"], r["detail"]) for r in named] == [(f"ledger/{victim.name}", "file altered")]


def test_a_rewritten_bundle_does_not_verify(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = [list(r) for r in _rows(12)]
    archive.export_bundle({"ledger": _ledger(spark, rows)}, path)
    rows[6][2] = "0" * 64
    archive.export_tables({"ledger": _ledger(spark, rows)}, path, True)
    bad = {(r["part"], r["detail"]) for r in archive.verify_bundle(spark, path).where("NOT ok").collect()}
    assert {("table", "content mismatch"), ("chain", "broken after 7 entries")} <= bad
    assert {d for p, d in bad if p == "file"} <= {"file altered", "file missing", "file not listed"} and any(p == "file" for p, _ in bad)


def test_equal_keys_are_one_chain(spark):
    """Entries that creation time and source id do not tell apart, also at the end of a bucket."""
    at = datetime(2024, 1, 1)
    rows = [("x", '{"a": %d}' % (i % 7), at if i < 40 else datetime(2024, 1, 1, 0, 5), "same") for i in range(80)]
    chain = ledger.append(spark.createDataFrame(rows, "event_type string, payload string, created_at timestamp, source_id string").repartition(7))
    assert ledger.verify_chain(chain).first().asDict() == {"ok": True, "checked": 80}


def test_export_and_rebuild(spark, tmp_path):
    l = _ledger(spark, _rows(7))
    for as_json in (True, False):
        path = str(tmp_path / f"x{as_json}")
        archive.export_tables({"ledger": l}, path, as_json)
        back = archive.rebuild_tables(spark, path, {"ledger": schemas.LEDGER}, as_json)
        assert archive.compare_tables({"ledger": l}, back).first().asDict() == {
            "table": "ledger", "rows": 7, "rebuilt_rows": 7, "same_content": True}
    lost = {"ledger": back["ledger"].where("seq > 1")}
    assert archive.compare_tables({"ledger": l}, lost).first()["same_content"] is False


def test_what_cannot_be_appended_is_rejected(spark):
    at = datetime(2024, 1, 1)
    rows = [("x", '{"a": 1}', at, "good"), ("x", '{"a": 1}', None, "undated"), ("x", "{oops", at, "broken"),
            ("x", None, at, "empty"), ("x", '{"a": NaN}', at, "nan"), ("x", '{"a": 2}', at, "broken"), ("x", '{"a": 3}', at, "later")]
    batch = spark.createDataFrame(rows, "event_type string, payload string, created_at timestamp, source_id string")
    chain = ledger.append(batch)
    assert [r["seq"] for r in chain.orderBy("seq").collect()] == [1, 2, 3]
    assert sorted(r["source_id"] for r in chain.collect()) == ["broken", "good", "later"]
    assert ledger.verify_chain(chain).first()["ok"]
    assert sorted((r["source_id"], r["reason"]) for r in ledger.rejected(batch).collect()) == [
        ("broken", "invalid json"), ("empty", "missing payload"), ("nan", "non-finite number"), ("undated", "missing created_at")]
    assert chain.count() + ledger.rejected(batch).count() == len(rows)


def test_json_exports_are_compressed_and_read_back(spark, tmp_path):
    """F8: a bundle writes no plain JSON."""
    l = _ledger(spark, _rows(50))
    archive.export_tables({"ledger": l}, str(tmp_path), as_json=True)
    files = [f for f in (tmp_path / "ledger").iterdir() if f.name.startswith("part-")]
    assert files and all(f.read_bytes()[:2] == b"\x1f\x8b" for f in files)
    back = archive.rebuild_tables(spark, str(tmp_path), {"ledger": schemas.LEDGER}, as_json=True)["ledger"]
    assert sorted(back.collect()) == sorted(l.collect())


def test_roots_of_ledgers_that_fill_their_blocks(spark, monkeypatch):
    """a prefix that is one whole subtree, the ledger ending there or not; nothing, less and too much have no root."""
    monkeypatch.setattr(ledger, "BLOCK", 4)
    monkeypatch.setattr(ledger, "_HEIGHT", 2)
    for n in (1, 4, 16):
        asked = spark.createDataFrame([(c,) for c in (None, -3, 0, 1, 4, 16, 17)], "covers long")
        got = {r["covers"]: r["root"] for r in ledger.prefix_roots(_ledger(spark, _rows(n)), asked).collect()}
        assert got == {c: _root([_h(i) for i in range(c)]) if c and 0 < c <= n else None for c in (None, -3, 0, 1, 4, 16, 17)}


def test_a_gap_or_a_second_row_spoils_the_roots_behind_it(spark):
    rows = _rows(40)
    asked = spark.createDataFrame([(7,), (8,), (40,)], "covers long")
    for bad in (rows[:7] + rows[8:], rows[:8] + rows[7:]):
        got = {r["covers"]: r["root"] for r in ledger.prefix_roots(_ledger(spark, bad), asked).collect()}
        assert got == {7: _root([_h(i) for i in range(7)]), 8: None, 40: None}


def test_the_card_reads_the_ledger_and_the_seals_few_times(spark, tmp_path):
    """one pass for the seals, three for the chain; the roots come from stored nodes."""
    _ledger(spark, _rows(1500)).write.parquet(str(tmp_path / "ledger"))
    l = spark.read.parquet(str(tmp_path / "ledger"))
    covers = spark.createDataFrame([(700,), (1024,), (1500,)], "covers long")
    ledger.prefix_roots(l, covers).select(
        F.concat(F.lit("s"), F.col("covers")).alias("seal_id"), F.col("root").alias("root_hash"), F.col("covers").alias("covers_through_seq"),
        F.lit(True).alias("signature_ok"), F.lit(None).cast("binary").alias("countersign")).write.parquet(str(tmp_path / "seals"))
    card = ledger.integrity_card(l, spark.read.parquet(str(tmp_path / "seals")))
    plan = card._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [seq#") == 4 and plan.count("Relation [seal_id#") == 1
    assert card.first().asDict() == {"chain_ok": True, "entries": 1500, "seals": 3, "seals_valid": 3, "status": "pass"}


def test_a_bundle_makes_each_table_once(spark, tmp_path):
    """count and digest are taken while the rows are written; a table may be empty."""
    made = spark.sparkContext.accumulator(0)
    twice = F.udf(lambda i: made.add(1) or 2 * i, "long")
    tables = {"made": spark.range(300, numPartitions=3).select("id", twice("id").alias("v")), "none": spark.range(0).select("id", F.lit(b"x").alias("b")),
              "nulls": spark.createDataFrame([(None, None), (None, "a"), (None, "a")], "id long, t string"), "ledger": _ledger(spark, _rows(40))}
    for as_json in (True, False):
        path = str(tmp_path / str(as_json))
        made.value = 0
        archive.export_bundle(tables, path, as_json)
        assert made.value == 300
        checked = archive.verify_bundle(spark, path).collect()
        assert {(r["part"], r["id"]) for r in checked if r["part"] != "file"} == {("chain", "ledger"), *[("table", n) for n in tables]}
        assert all(r["ok"] for r in checked)
        listed = {r["table"]: r for r in spark.read.parquet(f"{path}/manifest/tables").collect()}
        assert {n: r["rows"] for n, r in listed.items()} == {"made": 300, "none": 0, "nulls": 3, "ledger": 40}
        assert listed["none"]["content"] is None
        assert listed["nulls"]["content"] == archive.content_hash(tables["nulls"]).first()["content"]


def test_the_chain_is_checked_with_one_exchange_of_its_hashes(spark):
    """the rows lie by range after their window and meet the tails of the ranges there."""
    import re
    breaks = ledger.chain_breaks(_ledger(spark, _rows(20)))
    plan = breaks._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\bprev_hash#", plan)) == 1


def test_a_chain_with_odd_hashes_and_numbers(spark, monkeypatch):
    """bytes in place of hash text keep every text apart, and rows without a number are still a range."""
    texts = [_h(1), _h(1).upper(), _h(1)[:63], "", "x", "é" * 32, "ab" * 16, "\0" * 33, "\0" * 65, None, " " + _h(1)[:63], _h(2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", ledger._packed(F.col("t")))
    got = df.withColumn("back", ledger._unpacked(F.col("p"))).orderBy("i").collect()
    assert [r["back"] for r in got] == texts and len({r["p"] and bytes(r["p"]) for r in got}) == len(texts)
    monkeypatch.setattr(ledger, "CHAIN_RANGE", 3)
    hashes = [_h(0), "x", _h(2), _h(2).upper(), _h(4), None, _h(6), _h(7)]
    rows = [(i + 1, "x", h, hashes[i - 1] if i else "GENESIS", bytearray(UNSIGNED_MARK), T0) for i, h in enumerate(hashes)]
    rows[6] = (7, "x", _h(6), "GENESIS", bytearray(UNSIGNED_MARK), T0)
    rows.append((None, "x", _h(9), "GENESIS", bytearray(UNSIGNED_MARK), T0))
    found = {(r["seq"], r["reason"]) for r in ledger.chain_breaks(_ledger(spark, rows)).collect()}
    # the row without a number comes first and has nothing before it, the first numbered one follows it
    assert found == {(1, "broken link"), (2, "malformed hash"), (4, "malformed hash"), (6, "malformed hash")}
