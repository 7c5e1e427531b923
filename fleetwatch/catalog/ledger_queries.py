"""E, F, the archive part of A and the reports that read the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A

from .. import schemas
from ..functions.hashing import payload_digest
from ..operators import archive, facts, ledger as led, privacy, reliability as rel
from ..operators.commits import TableLog
from ..plans import reports, views
from ..session import work_dir
from .base import cte, query
from .facts_queries import AS_OF_SQL


def _entries(spark, sf):
    """One payload per task event, keys deliberately unsorted and spaced."""
    t = A.task_events(spark, sf)
    payload = F.concat(F.lit('{"status": "'), F.col("status"), F.lit('", "retries": '),
                       F.col("retry_count").cast("string"), F.lit(', "event_id": "'), F.col("event_id"),
                       F.lit('", "agent_id": "'), F.col("agent_id"), F.lit('"}'))
    return t.select(F.when(F.col("status") == "ok", "task_recorded").otherwise("task_failed").alias("event_type"),
                    payload.alias("payload"), F.col("ts").alias("created_at"), F.col("event_id").alias("source_id"))


_STORED: dict[tuple[str, str], str] = {}


def ledger_of(spark, sf):
    """The ledger as a stored table: written once per application, then read."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        path = work_dir(spark, "ledger")
        led.append(_entries(spark, sf)).write.option("compression", "zstd").parquet(path)
        _STORED[at] = path
    return spark.read.parquet(_STORED[at])


cte("ledger", ["tasks"], """
  SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_type, payload_hash,
         coalesce(lag(payload_hash) OVER (ORDER BY ts, event_id), 'GENESIS') AS prev_hash, event_id AS source_id, n
  FROM (SELECT ts, event_id, n, CASE WHEN status = 'ok' THEN 'task_recorded' ELSE 'task_failed' END AS event_type,
               sha256('{"agent_id":"' || agent_id || '","event_id":"' || event_id || '","retries":'
                      || CAST(retry_count AS VARCHAR) || ',"status":"' || status || '"}') AS payload_hash FROM tasks)""")


@query("e1_payload_digest", """
SELECT doc_id, sha256('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}') AS digest
FROM documents""")
def e1(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", payload_digest(F.to_json(F.struct("text", "doc_id"))).alias("digest"))


@query("e2_payload_problems", """
SELECT event_id, CASE WHEN k % 10 = 3 THEN 'invalid json' WHEN k % 10 = 4 THEN 'non-finite number' ELSE 'missing payload' END AS reason
FROM tasks WHERE k % 10 IN (3, 4, 5)""", ["tasks"])
def e2(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    ev = A.table(spark, sf, "events").select(
        F.concat(F.lit("evt-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("event_id"),
        F.when(k % 10 == 3, F.concat(F.lit("{"), F.col("props")))
        .when(k % 10 == 4, F.lit('{"v": NaN}'))
        .when(k % 10 != 5, F.col("props")).alias("payload"))
    return led.payload_problems(ev).select("event_id", "reason")


@query("e3_ledger", "SELECT seq, event_type, payload_hash, prev_hash, source_id FROM ledger", ["ledger"])
def e3(spark, sf):
    return led.append(_entries(spark, sf)).select("seq", "event_type", "payload_hash", "prev_hash", "source_id")


@query("e3_rejects", """
SELECT event_id AS source_id, CASE k % 10 WHEN 0 THEN 'non-finite number' WHEN 1 THEN 'invalid json' WHEN 2 THEN 'missing payload'
       WHEN 3 THEN 'missing created_at' ELSE 'accepted' END AS outcome FROM tasks""", ["tasks"])
def e3_rejects(spark, sf):
    """Every entry of a batch is either in the ledger or named as rejected."""
    t = A.task_events(spark, sf).select("event_id", F.call_function("div", F.col("input_tokens") - 100, F.lit(10)).alias("k"))
    k = F.col("k") % 10
    batch = _entries(spark, sf).join(t, F.col("source_id") == F.col("event_id")).select(
        "event_type", F.when(k == 0, '{"v": NaN}').when(k == 1, "{oops").when(k != 2, F.col("payload")).alias("payload"),
        F.when(k != 3, F.col("created_at")).alias("created_at"), "source_id")
    return led.append(batch).select("source_id", F.lit("accepted").alias("outcome")).unionByName(
        led.rejected(batch).select("source_id", F.col("reason").alias("outcome")))


@query("e3_second_batch", """
SELECT seq, payload_hash, prev_hash FROM ledger WHERE seq > (SELECT count(*) FROM tasks WHERE ts < TIMESTAMP '2024-01-15')""",
       ["ledger"])
def e3_second(spark, sf):
    e = _entries(spark, sf)
    cut = F.col("created_at") < A.as_of("2024-01-15 00:00:00")
    return led.append(e.where(~cut), led.append(e.where(cut))).select("seq", "payload_hash", "prev_hash")


def _tampered(spark, sf):
    n = F.substring("source_id", 5, 12).cast("bigint")
    return ledger_of(spark, sf).withColumn(
        "prev_hash", F.when(n % 389 == 388, F.sha2("prev_hash", 256)).otherwise(F.col("prev_hash")))


@query("e4_verify_chain", "SELECT TRUE AS ok, count(*) AS checked FROM tasks", ["tasks"])
def e4(spark, sf):
    return led.verify_chain(ledger_of(spark, sf))


@query("e4_tampered_chain", "SELECT FALSE AS ok, min(seq) - 1 AS checked FROM ledger WHERE n % 389 = 388", ["ledger"])
def e4_bad(spark, sf):
    return led.verify_chain(_tampered(spark, sf))


@query("e4_chain_breaks", "SELECT seq, 'broken link' AS reason FROM ledger WHERE n % 389 = 388", ["ledger"])
def e4_breaks(spark, sf):
    return led.chain_breaks(_tampered(spark, sf))


cte("tree", ["ledger"], """
  SELECT seq - 1 AS pos, payload_hash AS h, (SELECT count(*) FROM ledger) AS cnt FROM ledger
  UNION ALL
  SELECT pos // 2, sha256(unhex(h) || unhex(coalesce(nxt, h))), (cnt + 1) // 2
  FROM (SELECT pos, h, cnt, lead(h) OVER (ORDER BY pos) AS nxt FROM tree WHERE cnt > 1) WHERE pos % 2 = 0""")
cte("covers", ["ledger"], "  SELECT seq AS covers FROM ledger WHERE n % 997 = 500")
cte("prefix_tree", ["covers"], """
  SELECT covers, seq - 1 AS pos, payload_hash AS h, covers AS cnt FROM ledger JOIN covers ON seq <= covers
  UNION ALL
  SELECT covers, pos // 2, sha256(unhex(h) || unhex(coalesce(nxt, h))), (cnt + 1) // 2
  FROM (SELECT covers, pos, h, cnt, lead(h) OVER (PARTITION BY covers ORDER BY pos) AS nxt FROM prefix_tree WHERE cnt > 1)
  WHERE pos % 2 = 0""")


@query("e5_merkle_root", "SELECT h AS root FROM tree WHERE cnt = 1", ["tree"])
def e5(spark, sf):
    return led.merkle_root(ledger_of(spark, sf))


@query("e6_seal", f"""
SELECT 'seal_' || lpad(CAST((SELECT count(*) FROM ledger) AS VARCHAR), 8, '0') || '_' || CAST(CAST(epoch({AS_OF_SQL}) AS BIGINT) AS VARCHAR) AS seal_id,
       h AS root_hash, (SELECT count(*) FROM ledger) AS covers_through_seq FROM tree WHERE cnt = 1""", ["tree"])
def e6(spark, sf):
    return led.seal(ledger_of(spark, sf), A.as_of()).select("seal_id", "root_hash", "covers_through_seq")


def _covers(spark, sf):
    n = F.substring("source_id", 5, 12).cast("bigint")
    return ledger_of(spark, sf).where(n % 997 == 500).select(F.col("seq").alias("covers"))


@query("e7_seal_roots", "SELECT covers, h AS root FROM prefix_tree WHERE cnt = 1", ["prefix_tree"])
def e7_roots(spark, sf):
    return led.prefix_roots(ledger_of(spark, sf), _covers(spark, sf))


def _node_log(spark, sf):
    """The node table of the ledger, stored in two runs as the ledger grew."""
    log = TableLog(spark, work_dir(spark, "merkle-nodes"))
    for rows in (ledger_of(spark, sf).where(F.col("created_at") < A.as_of("2024-01-15 00:00:00")), ledger_of(spark, sf)):
        led.extend_nodes(rows, log)
    return log


@query("e7_roots_from_nodes", "SELECT covers, h AS root FROM prefix_tree WHERE cnt = 1", ["prefix_tree"])
def e7_nodes(spark, sf):
    return led.prefix_roots(ledger_of(spark, sf), _covers(spark, sf), log=_node_log(spark, sf))


@query("e6_seal_from_nodes", """
SELECT h AS root_hash, (SELECT count(*) FROM ledger) AS covers_through_seq FROM tree WHERE cnt = 1""", ["tree"])
def e6_nodes(spark, sf):
    return led.seal(ledger_of(spark, sf), A.as_of(), log=_node_log(spark, sf)).select("root_hash", "covers_through_seq")


def seals_of(spark, sf):
    """Seals over several prefixes; by position some are altered, unsigned, badly
    countersigned or reach past the ledger."""
    roots = led.prefix_roots(ledger_of(spark, sf), _covers(spark, sf))
    c, root = F.col("covers"), F.col("root")
    imprint = F.unhex(F.sha2(led.seal_message(root, c), 256))
    return roots.select(
        F.concat(F.lit("seal-"), c.cast("string")).alias("seal_id"),
        F.when(c % 5 == 1, F.sha2(root, 256)).otherwise(root).alias("root_hash"),
        F.when(c % 5 == 2, c + 1_000_000_000).otherwise(c).alias("covers_through_seq"),
        (c % 7 != 3).alias("signature_ok"),
        F.when(c % 3 == 0, F.concat(F.lit("token").cast("binary"), imprint))
        .when(c % 3 == 1, F.lit("other").cast("binary")).alias("countersign"))


cte("seal_checks", ["covers"], """
  SELECT 'seal-' || CAST(covers AS VARCHAR) AS seal_id, covers % 3 <> 2 AS countersigned,
    CASE WHEN covers % 5 = 2 THEN 'covers seq beyond ledger'
         WHEN covers % 5 = 1 OR covers % 7 = 3 THEN 'root or signature mismatch'
         WHEN covers % 3 = 1 THEN 'countersign binding failed' ELSE '' END AS reason FROM covers""")


@query("e7_verify_seals", "SELECT seal_id, reason = '' AS ok, countersigned, reason FROM seal_checks", ["seal_checks"])
def e7(spark, sf):
    return led.verify_seals(ledger_of(spark, sf), seals_of(spark, sf)).select(
        "seal_id", "ok", "countersigned", F.coalesce("reason", F.lit("")).alias("reason"))


@query("e8_key_rotations", """
SELECT seq, sha256('{"new_public":"' || sha256(new) || '","old_public":"' || sha256(old) || '"}') AS payload_hash
FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS seq, c_name AS new, c_mktsegment AS old FROM customer)""")
def e8(spark, sf):
    c = A.table(spark, sf, "customer")
    rotations = c.select(
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("rotation_id"),
        F.unhex(F.sha2("c_mktsegment", 256)).alias("old_public"), F.unhex(F.sha2("c_name", 256)).alias("new_public"),
        A.as_of().alias("rotated_at"))
    by = F.call_function("div", F.col("source_id").cast("bigint"), F.lit(1000))
    return led.append(led.rotation_events(rotations), order=["source_id"], bucket=by).select("seq", "payload_hash")


@query("e9_countersign_binding", """
SELECT doc_id, doc_id % 3 <> 1 AS bound FROM documents""")
def e9(spark, sf):
    """Tokens that carry the imprint of the whole text, of nothing, or of another text."""
    d = A.table(spark, sf, "documents")
    good = F.concat(F.lit("head").cast("binary"), F.unhex(F.sha2("text", 256)), F.lit("tail").cast("binary"))
    token = F.when(F.col("doc_id") % 3 == 1, F.unhex(F.sha2(F.concat("text", F.lit("x")), 256))).otherwise(good)
    return d.select("doc_id", led.token_bound(token, F.col("text")).alias("bound"))


@query("e10_entries_by_type", "SELECT event_type, count(*) AS n FROM ledger GROUP BY 1", ["ledger"])
def e10(spark, sf):
    return led.entries_by_type(ledger_of(spark, sf))


@query("e10_latest_seal", """
SELECT 'seal-' || CAST(covers AS VARCHAR) AS seal_id,
       CASE WHEN covers % 5 = 2 THEN covers + 1000000000 ELSE covers END AS covers_through_seq
FROM covers ORDER BY 2 DESC LIMIT 1""", ["covers"])
def e10_seal(spark, sf):
    return led.latest_seal(seals_of(spark, sf)).select("seal_id", "covers_through_seq")


@query("g18_weekly_digest", f"""
SELECT 1 AS section, 0 AS rank, alarm_id || ' ' || agent_id AS subject, signal || ' ' || severity || ' ' || CAST(evidence_seq AS VARCHAR) AS detail
FROM alarms WHERE event_type = 'report_item' AND created_at >= {AS_OF_SQL} - INTERVAL 7 DAY
UNION ALL SELECT 2, row_number() OVER (ORDER BY CASE severity WHEN 'Emergency' THEN 0 WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END),
       severity, CAST(n AS VARCHAR) || ' ' || CAST(o AS VARCHAR) || ' ' || CAST(b AS VARCHAR)
FROM (SELECT severity, count(*) AS n, count(*) FILTER (status = 'open') AS o,
             count(*) FILTER (status = 'open' AND sla_deadline < {AS_OF_SQL}) AS b FROM alarms GROUP BY 1)
UNION ALL SELECT 3, row_number() OVER (ORDER BY created_at DESC, alarm_id), alarm_id,
       CAST(evidence_seq AS VARCHAR) || ' ' || coalesce(CAST(evidence_seq_resolved AS VARCHAR), '-') FROM anchors
UNION ALL SELECT 4, row_number() OVER (ORDER BY cost_usd DESC, agent_id), agent_id, format('{{:.2f}}', cost_usd) || ' ' || CAST(tasks AS VARCHAR) FROM cost_ranking
UNION ALL SELECT 5, 0, error_class, strftime(f, '%Y-%m-%d %H:%M')
FROM (SELECT error_class, min(ts) AS f FROM tasks WHERE error_class IS NOT NULL AND ts >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY 1)
UNION ALL SELECT 6, 1, 'ledger entries', CAST(count(*) AS VARCHAR) FROM ledger
UNION ALL SELECT 6, 2, 'latest seal seal-' || CAST(c AS VARCHAR), substr(CASE WHEN c % 5 = 1 THEN sha256(h) ELSE h END, 1, 16) || ' ' || CAST(k AS VARCHAR)
FROM (SELECT covers AS c, CASE WHEN covers % 5 = 2 THEN covers + 1000000000 ELSE covers END AS k, h
      FROM prefix_tree WHERE cnt = 1 ORDER BY k DESC LIMIT 1)""",
       ["alarms", "tasks", "anchors", "cost_ranking", "prefix_tree"])
def g18(spark, sf):
    return reports.weekly_digest(A.alarms(spark, sf), A.task_events(spark, sf), ledger_of(spark, sf),
                                 seals_of(spark, sf), A.as_of())


@query("g23_integrity_card", """
SELECT TRUE AS chain_ok, (SELECT count(*) FROM tasks) AS entries, count(*) AS seals,
       count(*) FILTER (reason = '') AS seals_valid, CASE WHEN bool_and(reason = '') THEN 'pass' ELSE 'fail' END AS status
FROM seal_checks""", ["seal_checks"])
def g23(spark, sf):
    return led.integrity_card(ledger_of(spark, sf), seals_of(spark, sf))


@query("g24_audit_trail", """
SELECT 'chain' AS part, 'ledger' AS id, TRUE AS ok, CAST(count(*) AS VARCHAR) || ' entries checked' AS detail FROM tasks
UNION ALL SELECT 'seal', seal_id, reason = '', reason FROM seal_checks""", ["seal_checks"])
def g24_audit(spark, sf):
    return led.audit_trail(ledger_of(spark, sf), seals_of(spark, sf))


CHUNK = 1000
cte("chunks", ["ledger"], f"""
  SELECT 'chunk_' || lpad(CAST(min(seq) AS VARCHAR), 12, '0') || '_' || lpad(CAST(max(seq) AS VARCHAR), 12, '0') AS key,
         (seq - 1) // {CHUNK} AS chunk, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS rows,
         sha256(string_agg(payload_hash, '' ORDER BY seq)) AS chain_digest FROM ledger GROUP BY (seq - 1) // {CHUNK}""")


@query("a19_archive_chunks", "SELECT * FROM chunks", ["chunks"])
def a19(spark, sf):
    return archive.chunks(ledger_of(spark, sf), CHUNK)


@query("a19_archived_twice", "SELECT key, first_seq, last_seq, rows, chain_digest FROM chunks", ["chunks"])
def a19_files(spark, sf):
    """Half of the ledger, then all of it: the grown chunk is stored anew, the rest skipped."""
    path = work_dir(spark, "archive")
    rows = ledger_of(spark, sf)
    archive.archive_ledger(rows.where(F.col("created_at") < A.as_of("2024-01-15 00:00:00")), path, CHUNK)
    return archive.archive_ledger(rows, path, CHUNK).select("key", "first_seq", "last_seq", "rows", "chain_digest")


@query("a19_delta_rows", f"""
SELECT n - first AS read, n AS rows, n - first AS due FROM (SELECT count(*) AS n,
  (SELECT count(*) // {CHUNK} * {CHUNK} FROM tasks WHERE ts < TIMESTAMP '2024-01-15') AS first FROM tasks)""", ["tasks"])
def a19_delta(spark, sf):
    """What the second run of an archive reads: the rows after its last whole chunk."""
    path = work_dir(spark, "archive")
    rows = ledger_of(spark, sf)
    archive.archive_ledger(rows.where(F.col("created_at") < A.as_of("2024-01-15 00:00:00")), path, CHUNK)
    start = archive.archived_through(spark, path, CHUNK)
    read = archive.pending_rows(rows, path, CHUNK).agg(F.count(F.lit(1)).alias("read"))
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(
        read.select("read").scalar().alias("read"), "rows", (F.col("rows") - start).alias("due"))


@query("a20_altered_files", """
SELECT key, CASE chunk % 5 WHEN 1 THEN 'chunk hash mismatch' WHEN 2 THEN 'chunk missing' WHEN 3 THEN 'chain digest mismatch'
                 WHEN 4 THEN 'chain break at seq ' || CAST(first_seq AS VARCHAR) ELSE '' END AS reason
FROM chunks""", ["chunks"])
def a20_files(spark, sf):
    """An archive whose files were tampered with, checked from the files alone: some chunks have
    another event type than the file that was listed, some are lost, in some a hash is changed and the
    listed file digest forged to fit, so that the chunk after them links no more."""
    honest, path = work_dir(spark, "archive"), work_dir(spark, "tampered")
    manifest = archive.archive_ledger(ledger_of(spark, sf), honest, CHUNK)
    rows = spark.read.parquet(f"{honest}/chunks").join(manifest.select("key", "chunk", "last_seq"), "key")
    kind = F.col("chunk") % 5
    changed = rows.where(kind != 2).select(
        "seq", F.when(kind == 1, F.concat("event_type", F.lit("?"))).otherwise(F.col("event_type")).alias("event_type"),
        F.when((kind == 3) & (F.col("seq") == F.col("last_seq")), F.sha2("payload_hash", 256)).otherwise(F.col("payload_hash")).alias("payload_hash"),
        "prev_hash", "signature", "created_at", "key")
    changed.repartition("key").sortWithinPartitions("key", "seq").write.partitionBy("key").parquet(f"{path}/chunks")
    now = archive.file_hashes(spark, path).withColumnRenamed("sha256", "now")
    forged = manifest.join(now, "key", "left").withColumn("sha256", F.when(kind == 1, F.col("sha256")).otherwise(F.coalesce("now", "sha256")))
    forged.select(manifest.columns).write.parquet(f"{path}/manifest")
    return archive.verify_archive(spark, path).select("key", F.coalesce("reason", F.lit("")).alias("reason"))


@query("a20_verify_archive", """
SELECT key, CASE WHEN chunk % 4 = 1 THEN 'chain digest mismatch' WHEN chunk % 4 = 2 THEN 'chunk missing'
                 WHEN chunk % 4 = 3 AND chunk > 0 THEN 'chain break at seq ' || CAST(first_seq AS VARCHAR) ELSE '' END AS reason
FROM chunks""", ["chunks"])
def a20(spark, sf):
    """Archived rows with a changed hash in some chunks and others lost. The chunk after a
    lost one no longer links; the one after a changed hash would not either."""
    manifest = archive.chunks(ledger_of(spark, sf), CHUNK)
    rows = ledger_of(spark, sf).withColumn("chunk", F.call_function("div", F.col("seq") - 1, F.lit(CHUNK)))
    first = F.col("seq") == F.col("chunk") * CHUNK + 1
    changed = rows.where(F.col("chunk") % 4 != 2).withColumn(
        "payload_hash", F.when((F.col("chunk") % 4 == 1) & first, F.sha2("payload_hash", 256))
        .otherwise(F.col("payload_hash")))
    stored = changed.join(manifest.select("chunk", "key"), "chunk")
    return archive.verify_chunks(manifest, stored).select("key", F.coalesce("reason", F.lit("")).alias("reason"))


@query("a21_export_rebuild", """
SELECT 'tasks' AS "table", (SELECT count(*) FROM tasks) AS rows, (SELECT count(*) FROM tasks) AS rebuilt_rows, TRUE AS same_content
UNION ALL SELECT 'guards', (SELECT count(*) FROM guards), (SELECT count(*) FROM guards), TRUE
UNION ALL SELECT 'ledger', (SELECT count(*) FROM tasks), (SELECT count(*) FROM tasks), TRUE""", ["tasks", "guards"])
def a21(spark, sf):
    path = work_dir(spark, "export")
    ddl = {"tasks": schemas.TASK_EVENTS, "guards": schemas.GUARD_EVENTS, "ledger": schemas.LEDGER}
    tables = {"tasks": A.task_events(spark, sf), "guards": A.guard_events(spark, sf),
              "ledger": ledger_of(spark, sf).drop("source_id")}
    archive.export_tables(tables, path, as_json=True)
    return archive.compare_tables(tables, archive.rebuild_tables(spark, path, ddl, as_json=True))


def _all_tables(spark, sf):
    """Every table of the data model."""
    from .alarm_queries import suggestions
    from .facts_queries import calibration
    t = A.task_events(spark, sf)
    seals = seals_of(spark, sf)
    subjects, keys = _registered(spark, sf)
    tenants = A.table(spark, sf, "nation").select(
        F.concat(F.lit("tenant-"), F.col("n_nationkey").cast("string")).alias("tenant_id"),
        F.col("n_name").alias("display_name"), F.lower("n_name").alias("sso_domain"))
    baselines = rel.baselines(t, A.guard_events(spark, sf), facts.daily_cost(t), calibration(spark, sf)).select(
        "agent_id", F.to_json("tool_mix").alias("tool_distribution"), "mean_cost_usd", "p95_latency_ms")
    return {"agents": A.agents(spark, sf), "tasks": t, "guards": A.guard_events(spark, sf), "tickets": A.tickets(spark, sf),
            "alarms": A.alarms(spark, sf), "calibration": calibration(spark, sf), "baselines": baselines,
            "suggestions": suggestions(spark, sf), "ledger": ledger_of(spark, sf).drop("source_id"), "seals": seals,
            "subjects": subjects, "subject_keys": keys, "tenants": tenants}


_BUNDLED = "['agents', 'tasks', 'guards', 'tickets', 'alarms', 'calibration', 'baselines', 'suggestions', 'ledger', 'seals', 'subjects', 'subject_keys', 'tenants']"


@query("a21_bundle", f"""
SELECT 'table' AS part, unnest({_BUNDLED}) AS id, TRUE AS ok, '' AS detail
UNION ALL SELECT 'chain', 'ledger', TRUE, ''
UNION ALL SELECT 'seal', seal_id, reason = '', reason FROM seal_checks""", ["seal_checks"])
def a21_bundle(spark, sf):
    """The exit drill: all tables exported, rebuilt from the files and verified there. Files are
    many and their names differ from run to run; they show up here only if something is wrong with one."""
    path = work_dir(spark, "bundle")
    archive.export_bundle(_all_tables(spark, sf), path)
    return _drilled(spark, path)


def _drilled(spark, path):
    return archive.verify_bundle(spark, path).where("part <> 'file' OR NOT ok").withColumn("detail", F.coalesce("detail", F.lit("")))


@query("a21_tampered_bundle", """
SELECT 'table' AS part, 'ledger' AS id, FALSE AS ok, 'content mismatch' AS detail
UNION ALL SELECT 'table', 'tickets', FALSE, 'row count mismatch'
UNION ALL SELECT 'table', unnest(['agents', 'guards', 'seals']), TRUE, ''
UNION ALL SELECT 'chain', 'ledger', FALSE, 'broken after ' || CAST((SELECT min(seq) FROM ledger WHERE n % 389 = 388) - 1 AS VARCHAR) || ' entries'
UNION ALL SELECT 'seal', seal_id, reason = '', reason FROM seal_checks
UNION ALL SELECT 'files', unnest(['ledger', 'tickets']), FALSE, 'file altered or missing'""", ["seal_checks", "ledger"])
def a21_tampered(spark, sf):
    """A bundle in which links of the ledger were changed and tickets taken out after the export."""
    path = work_dir(spark, "bundle")
    names = ("agents", "guards", "tickets", "ledger", "seals")
    every = _all_tables(spark, sf)
    archive.export_bundle({n: every[n] for n in names}, path)
    archive.export_tables({"ledger": _tampered(spark, sf).drop("source_id"),
                           "tickets": every["tickets"].where(F.xxhash64("escalation_id") % 3 != 0)}, path, True)
    out = _drilled(spark, path)
    files = (out.where("part = 'file' AND detail <> 'file not listed'").select(F.substring_index("id", "/", 1).alias("id")).distinct()
             .select(F.lit("files").alias("part"), "id", F.lit(False).alias("ok"), F.lit("file altered or missing").alias("detail")))
    return out.where("part <> 'file'").unionByName(files)


# --- privacy: every customer asks to be registered, some twice, some without a basis


def _master():
    return F.unhex(F.sha2(F.lit("catalog demo key"), 256))


def _requests(spark, sf):
    c = A.table(spark, sf, "customer")
    sid = F.concat(F.lit("subj-"), F.col("c_custkey").cast("string"))
    pii = F.concat(F.lit('{"balance":'), F.col("c_acctbal").cast("decimal(12,2)").cast("string"),
                   F.lit(',"segment":"'), F.col("c_mktsegment"), F.lit('"}'))
    return c.select(sid.alias("subject_id"), F.col("c_name").alias("display_name"), pii.alias("pii"),
                    F.lit("ops").alias("actor"),
                    F.when(F.col("c_custkey") % 10 == 0, " ").otherwise("contract").alias("lawful_basis"),
                    F.timestamp_micros(F.unix_micros(A.as_of("2024-01-01 00:00:00"))
                                       + F.col("c_custkey") * 1_000_000).alias("requested_at"))


def _erase_requests(spark, sf):
    c = A.table(spark, sf, "customer").where(F.col("c_custkey") % 7 == 3)
    sid = F.concat(F.lit("subj-"), F.col("c_custkey").cast("string"))
    days = F.col("c_custkey") % 60
    one = lambda who, lag: c.select(sid.alias("subject_id"), F.lit(who).alias("actor"), F.timestamp_micros(
        F.unix_micros(A.as_of("2024-01-01 00:00:00")) + F.col("c_custkey") * 1_000_000
        + (days + lag) * 86_400_000_000).alias("requested_at"))
    return one("dpo", 1).unionByName(one("late", 5))


cte("subjects", [], """
  SELECT 'subj-' || CAST(c_custkey AS VARCHAR) AS subject_id, c_custkey, c_name AS display_name,
         '{"balance":' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) || ',"segment":"' || c_mktsegment || '"}' AS pii,
         TIMESTAMP '2024-01-01' + to_seconds(c_custkey) AS registered_at,
         CASE WHEN c_custkey % 7 = 3 THEN TIMESTAMP '2024-01-01' + to_seconds(c_custkey) + to_days(CAST(c_custkey % 60 + 1 AS INT)) END AS erased_at
  FROM customer WHERE c_custkey % 10 <> 0""")


def _registered(spark, sf):
    return privacy.register(_requests(spark, sf), _master(), work_dir(spark, "subjects"))


def _erased(spark, sf):
    subjects, keys = _registered(spark, sf)
    return privacy.erase(subjects, keys, _erase_requests(spark, sf))


@query("f1_rejected_registrations", """
SELECT 'subj-' || CAST(c_custkey AS VARCHAR) AS subject_id, CASE WHEN c_custkey % 10 = 0 THEN 'lawful basis required' ELSE 'already registered' END AS reason
FROM customer WHERE c_custkey % 10 = 0 OR c_custkey < 100""")
def f1(spark, sf):
    known = A.table(spark, sf, "customer").where((F.col("c_custkey") < 100) & (F.col("c_custkey") % 10 != 0)) \
        .select(F.concat(F.lit("subj-"), F.col("c_custkey").cast("string")).alias("subject_id"))
    return privacy.rejected_registrations(_requests(spark, sf), known)


@query("f2_read_personal_data", "SELECT subject_id, pii FROM subjects", ["subjects"])
def f2(spark, sf):
    s, k = _registered(spark, sf)
    return privacy.read_personal_data(s, k, _master())


@query("f3_read_after_erasure", """
SELECT subject_id, CASE WHEN erased_at IS NULL THEN pii ELSE 'gone' END AS pii FROM subjects""", ["subjects"])
def f3(spark, sf):
    s, k, _ = _erased(spark, sf)
    return privacy.read_personal_data(s, k, _master()).withColumn("pii", F.coalesce("pii", F.lit("gone")))


@query("f3_files_after_erasure", """
SELECT subject_id, CASE WHEN erased_at IS NULL THEN pii ELSE 'gone' END AS pii FROM subjects""", ["subjects"])
def f3_files(spark, sf):
    """What the stored files still give away after the keys were destroyed there."""
    path = work_dir(spark, "shredded")
    s, k = privacy.register(_requests(spark, sf), _master(), path)
    privacy.shred(spark, path, privacy.erase(s, k, _erase_requests(spark, sf))[2].where("erased"))
    return privacy.read_personal_data(*privacy.registered(spark, path), _master()).withColumn("pii", F.coalesce("pii", F.lit("gone")))


@query("f3_erasure_results", """
SELECT 'subj-' || CAST(c_custkey AS VARCHAR) AS subject_id, c_custkey % 10 <> 0 AS erased,
       CASE WHEN c_custkey % 10 = 0 THEN 'unknown subject' ELSE '' END AS reason FROM customer WHERE c_custkey % 7 = 3""")
def f3_results(spark, sf):
    return _erased(spark, sf)[2].select("subject_id", "erased", F.coalesce("reason", F.lit("")).alias("reason"))


@query("f4_custody", """
SELECT subject_id, 1 AS key_version, 'created by ops; lawful basis: contract' || CASE WHEN erased_at IS NULL THEN '' ELSE ' | crypto-shredded by dpo' END AS note,
       erased_at IS NOT NULL AS revoked FROM subjects""", ["subjects"])
def f4(spark, sf):
    return privacy.custody(_erased(spark, sf)[1]).select(
        "subject_id", "key_version", "note", F.col("revoked_at").isNotNull().alias("revoked"))


@query("f5_display_form", """
SELECT subject_id, CASE WHEN erased_at IS NULL THEN display_name ELSE subject_id || ' [erased — crypto-shredded]' END AS display
FROM subjects""", ["subjects"])
def f5(spark, sf):
    return privacy.display_form(_erased(spark, sf)[0])


@query("f6_erasure_scope", """
SELECT event_id FROM subjects_bound JOIN subjects USING (subject_id) WHERE erased_at IS NOT NULL""",
       ["subjects_bound", "subjects"])
def f6(spark, sf):
    s = _erased(spark, sf)[0].where(F.col("erased_at").isNotNull())
    return privacy.erasure_scope(A.task_events(spark, sf), A.subject_events(spark, sf), s).select("event_id")


cte("bound_ledger", ["subjects_bound"], """
  SELECT row_number() OVER (ORDER BY ts, event_id) AS seq,
         sha256('{"event_id":"' || event_id || '","subject_id":"' || subject_id || '"}') AS payload_hash, event_id FROM subjects_bound""")


@query("a14_subject_bindings", "SELECT * FROM bound_ledger", ["bound_ledger"])
def a14(spark, sf):
    return led.append(privacy.binding_events(A.subject_events(spark, sf))).select(
        "seq", "payload_hash", F.col("source_id").alias("event_id"))


@query("g19_subject_register", """
SELECT subject_id, CASE WHEN erased_at IS NULL THEN display_name ELSE '[ERASED]' END AS display_name, registered_at,
       CASE WHEN erased_at IS NULL THEN 'active' ELSE 'erased' END AS state FROM subjects""", ["subjects"])
def g19(spark, sf):
    return reports.subject_register(_erased(spark, sf)[0]).select("subject_id", "display_name", "registered_at", "state")


@query("g20_erasure_breaches", """
SELECT subject_id, round((epoch(erased_at) - epoch(registered_at)) / 86400, 1) AS days FROM subjects
WHERE erased_at IS NOT NULL AND (epoch(erased_at) - epoch(registered_at)) / 86400 > 30""", ["subjects"])
def g20(spark, sf):
    return reports.erasure_breaches(_erased(spark, sf)[0])


@query("g21_erasure_anchors", """
SELECT (SELECT count(*) FROM subjects_bound) AS subject_event_bound, count(*) FILTER (erased_at IS NOT NULL) AS subject_erased,
       count(*) FILTER (erased_at IS NULL) AS live_keys FROM subjects""", ["subjects_bound", "subjects"])
def g21(spark, sf):
    s, _, results = _erased(spark, sf)
    entries = privacy.binding_events(A.subject_events(spark, sf)).unionByName(privacy.erasure_events(results))
    return reports.erasure_anchors(led.append(entries), s)


@query("g27_recent_subjects", """
SELECT subject_id, registered_at FROM subjects ORDER BY registered_at DESC, subject_id DESC LIMIT 12""", ["subjects"])
def g27_subjects(spark, sf):
    return views.newest_rows(_erased(spark, sf)[0], ["registered_at", "subject_id"]).select("subject_id", "registered_at")


@query("g27_recent_custody", """
SELECT subject_id, erased_at IS NOT NULL AS revoked FROM subjects ORDER BY registered_at DESC, subject_id DESC LIMIT 12""", ["subjects"])
def g27_custody(spark, sf):
    return views.newest_rows(_erased(spark, sf)[1], ["created_at", "subject_id"]).select(
        "subject_id", F.col("revoked_at").isNotNull().alias("revoked"))
