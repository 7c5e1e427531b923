"""Registration of queries and the SQL form of the domain tables for the SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ERROR_TEXTS
from ..rules import ERROR_FAMILIES, ERROR_RULES, PRESEEN_CLASSES, SIGNAL_RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SQL: dict[str, tuple[str, list[str]]] = {}


def query(name: str, sql: str | None = None, ctes: list[str] | None = None):
    """Registers a query; ``ctes`` name the domain tables its SQL reads."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (sql, ctes or [])
        return fn
    return add


def r6(col: str | Column, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6).alias(name or (col if isinstance(col, str) else "value"))


def _text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _rule(i: int) -> str:
    return f"({_list([r[i] for r in SIGNAL_RULES])})[CAST(k % 9 + 1 AS INT)]"


def classify_sql(raw: str, quarantined: str = "FALSE") -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({raw}), {_text(w)})" for w in words)
        + f" THEN {_text(name)}" for name, words in ERROR_RULES)
    return (f"CASE WHEN {quarantined} THEN 'loop' WHEN {raw} IS NULL THEN '' {arms}"
            " ELSE 'unknown' END")


PRESEEN_SQL = ", ".join(_text(c) for c in ["loop", *PRESEEN_CLASSES])

CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], """
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         'agent-' || CAST(user_id AS VARCHAR) AS agent_id,
         'task-' || CAST(user_id AS VARCHAR) || '-'
           || CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS VARCHAR) AS task_id
  FROM events"""),
    "tasks": (["ev"], f"""
  SELECT 'evt-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, agent_id, task_id,
         'sess-' || CAST(event_id // 4 AS VARCHAR) AS session_id,
         'model-' || CAST(k % 4 AS VARCHAR) AS model_name,
         k * 10 + 100 AS input_tokens, k * 3 + 50 AS output_tokens,
         CAST(value AS DECIMAL(12,6)) AS cost_usd, k * 100 + event_id % 97 AS latency_ms,
         CASE WHEN event_type = 'error' THEN ({_list(ERROR_TEXTS)})[CAST(k % 12 + 1 AS INT)] END AS error_class,
         CASE WHEN event_type <> 'error' THEN 'ok' WHEN k % 20 = 0 THEN 'quarantined' ELSE 'error' END AS status,
         user_id % 7 = 0 AS synthetic, ts, k % 5 AS retry_count,
         CAST(k % 40 AS DOUBLE) / 100.0 AS ttft_s,
         CASE WHEN k % 10 <> 9 THEN 'tmpl-' || CAST(k % 6 AS VARCHAR) END AS task_template,
         '{{"box":"' || event_type || '","count":' || CAST(k % 3 AS VARCHAR) || '}}' AS end_state,
         event_id AS n, k
  FROM ev"""),
    "guards": (["ev"], """
  SELECT 'grd-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, agent_id, task_id,
         CASE WHEN event_type IN ('signup', 'error') THEN 'permission_decision' ELSE 'tool_call' END AS event_type,
         CASE WHEN event_type = 'error' THEN 'deny' WHEN event_type = 'signup' THEN 'allow' END AS decision,
         event_type || '-' || CAST(k % 4 AS VARCHAR) AS tool_name,
         '{"a":[1,2],"q":' || CAST(k % 4 AS VARCHAR) || '}' AS args,
         user_id % 7 = 0 AS synthetic, ts
  FROM ev"""),
    "alarms": (["ev"], f"""
  SELECT 'alm-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS alarm_id, agent_id,
         {_rule(0)} AS signal, {_rule(1)} AS event_type, {_rule(2)} AS reason,
         {_rule(5)} AS severity, CAST({_rule(3)} AS DOUBLE) AS sla_hours,
         ts + to_seconds(k) + to_seconds(CAST({_rule(3)} * 3600 AS BIGINT)) AS sla_deadline,
         value AS trigger_value, {_rule(4)} AS protection,
         CASE WHEN k % 3 <> 0 THEN 'open' ELSE 'resolved' END AS status,
         ts + to_seconds(k) AS created_at,
         CASE WHEN k % 3 = 0 THEN ts + to_seconds(k) + to_hours(k % 12 + 1) END AS resolved_at,
         'tenant-' || CAST(user_id % 3 AS VARCHAR) AS tenant_id,
         event_id + 1 AS evidence_seq,
         CASE WHEN k % 3 = 0 THEN event_id + 2 END AS evidence_seq_resolved, event_id AS n, k
  FROM ev WHERE event_type = 'error'"""),
    "tickets": ([], """
  SELECT 'esc-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS escalation_id,
         'agent-' || CAST(o_custkey AS VARCHAR) AS agent_id,
         'task-' || CAST(o_orderkey AS VARCHAR) AS task_id, o_totalprice AS trigger_value,
         lower(o_orderpriority) AS reason,
         CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS status,
         TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INT)) + to_hours(o_custkey % 24)
           + to_milliseconds(o_orderkey) AS created_at
  FROM orders"""),
    "costs": ([], """
  SELECT 'supp-' || CAST(l_suppkey AS VARCHAR) AS agent_id, CAST(l_shipdate AS DATE) AS day,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost
  FROM lineitem GROUP BY ALL"""),
    "agents": ([], """
  SELECT 'agent-' || CAST(c_custkey AS VARCHAR) AS agent_id, lower(c_mktsegment) AS fleet_name,
         (['planner', 'worker', 'reviewer', 'executor'])[CAST(c_nationkey % 4 + 1 AS INT)] AS role,
         CASE WHEN c_acctbal < 0 THEN 'paused' ELSE 'active' END AS status,
         'tenant-' || CAST(c_custkey % 3 AS VARCHAR) AS tenant_id
  FROM customer"""),
    "subjects_bound": (["ev"], """
  SELECT 'subj-' || CAST(user_id % 50 AS VARCHAR) AS subject_id,
         'evt-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, ts
  FROM ev WHERE k % 8 = 0"""),
    "registrations": (["tasks", "guards"], """
  SELECT agent_id, min(ts) AS first_seen, arg_min(synthetic, ts) AS synthetic
  FROM (SELECT agent_id, ts, synthetic FROM tasks
        UNION ALL SELECT agent_id, ts, synthetic FROM guards) GROUP BY agent_id"""),
    "rules": ([], "  SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(_text(v) for v in r) + ")" for r in SIGNAL_RULES)
        + ") t(signal, event_type, reason, sla_hours, protection, severity, fires)"),
    "families": ([], "  SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(_text(v) for v in r) + ")" for r in ERROR_FAMILIES)
        + ") t(error_class, family, trigger_signal)"),
}


def oracles() -> dict[str, str]:
    return {name: with_ctes(sql, ctes) for name, (sql, ctes) in _SQL.items()}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(sql: str, names: list[str]) -> str:
    if not names:
        return sql
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    body = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {body}\n{sql.strip()}"
