"""Explicit schemas of the domain tables. Readers never infer."""

from __future__ import annotations

AGENTS = (
    "agent_id string, fleet_name string, role string, framework string,"
    " agent_version string, status string, created_at timestamp, tenant_id string")
TASK_EVENTS = (
    "event_id string, agent_id string, task_id string, session_id string,"
    " model_name string, input_tokens bigint, output_tokens bigint,"
    " cost_usd decimal(12,6), latency_ms bigint, error_class string, status string,"
    " synthetic boolean, ts timestamp, retry_count int, ttft_s double,"
    " task_template string, end_state_json string")
GUARD_EVENTS = (
    "event_id string, agent_id string, task_id string, event_type string,"
    " decision string, tool_name string, arguments_json string, synthetic boolean,"
    " ts timestamp")
TICKETS = (
    "escalation_id string, agent_id string, task_id string, trigger_metric string,"
    " trigger_value double, reason string, evidence_ref string, sla_deadline timestamp,"
    " status string, resolved_by string, resolved_at timestamp, created_at timestamp")
ALARMS = (
    "alarm_id string, agent_id string, task_id string, signal string,"
    " event_type string, reason string, severity string, sla_hours double,"
    " sla_deadline timestamp, trigger_value double, protection string, status string,"
    " created_at timestamp, resolved_by string, resolved_at timestamp,"
    " tenant_id string, evidence_seq bigint, evidence_seq_resolved bigint")
CALIBRATION = "agent_id string, calibration_until timestamp, closed boolean"
SUGGESTIONS = (
    "alarm_id string, suggested_agent_id string, suggested_step string,"
    " confidence double, method string, note string, confirmed boolean,"
    " confirmed_by string, confirmed_at timestamp")
LEDGER = (
    "seq bigint, event_type string, payload_hash string, prev_hash string,"
    " signature binary, created_at timestamp")
SEALS = (
    "seal_id string, root_hash string, covers_through_seq bigint, public_key binary,"
    " signature binary, sealed_at timestamp, countersign binary, signature_ok boolean")
SUBJECTS = (
    "subject_id string, display_name string, ciphertext binary, key_version int,"
    " registered_at timestamp, erased_at timestamp")
SUBJECT_KEYS = (
    "subject_id string, key_version int, wrapped_key binary, note string,"
    " created_at timestamp, revoked_at timestamp")
TENANTS = "tenant_id string, display_name string, sso_domain string"
ENVELOPES = (
    "envelope_id string, key_id string, ts_text string, nonce string,"
    " signature string, body string, received_at timestamp")
OBSERVATION = (
    "id string, traceId string, type string, name string, model string,"
    " providedModelName string, startTime string, endTime string, level string,"
    " statusMessage string, env string, cost double,"
    " usage struct<input: bigint, output: bigint, totalCost: double>")
