"""Thresholds, the signal rule table, error families, attribute types.

These must equal the monitored protocol for results to be right, so they are stated
plainly here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: statistics -----------------------------------------------------
EPS = 1e-6
EWMA_ALPHA = 0.15
EWMA_BETA = 0.10
EWMA_Z_LIMIT = 2.5
EWMA_WARMUP = 30
COST_MULTIPLE = 2.0
MAD_SCALE = 0.6745
MAD_Z_LIMIT = 3.0
JSD_WATCH = 0.20
JSD_ALARM = 0.40
PSI_LARGE = 0.25
CUSUM_DRIFT = 0.05
CUSUM_LIMIT = 5.0

# --- fixed values: facts and budgets ----------------------------------------------
ERROR_RATE_LIMIT = 0.20
ERROR_WINDOW_S = 24
DENY_RATIO_LIMIT = 0.20
DENY_WINDOW_S = 1
RETRY_LIMIT = 3
TICKET_AGE_LIMIT_H = 24.0
LOOP_RUN = 3
SHADOW_BUDGET = 0.01
FALSE_POSITIVE_BUDGET = 0.05
CALIBRATION_DAYS = 14
ERASE_SLA_DAYS = 30
REPLAY_WINDOW_S = 300
ARCHIVE_CHUNK_ROWS = 10_000
TRACE_SLOW_MS = 5000
TRACE_SAMPLE_PERCENT = 5

# --- fixed values: ledger ---------------------------------------------------------
GENESIS = "GENESIS"
UNSIGNED_MARK = b"F0-UNSIGNED-F2-PENDING"
SIGNATURE_BYTES = 64

# --- fixed values: signal rules ---------------------------------------------------
# signal, event_type, reason, sla_hours, protection, severity, fires_in_calibration
SIGNAL_RULES = [
    ("loop>=2", "escalation", "quality", 0.5,
     "task quarantine; loop breaker open", "Emergency", True),
    ("permission.deny>0.20", "escalation", "permission", 4.0,
     "external tool permissions frozen", "Critical", False),
    ("cost.daily>2x_ewma", "escalation", "budget", 24.0,
     "model downgrade proposal (operator-approved)", "Critical", False),
    ("error.new_class_seen", "escalation", "unknown", 24.0,
     "triage with new-error-pattern label", "Critical", True),
    ("error.rate>0.20", "escalation", "quality", 4.0,
     "responsible agent's tasks triaged (R15)", "Critical", False),
    ("latency.retry>=3", "escalation", "quality", 4.0,
     "task requeued; resource provider audited (R15)", "High", False),
    ("drift.tool_distribution>0.40", "report_item", "drift", 168.0,
     "weekly report behavior-deviation item", "Medium", False),
    ("drift.output_quality", "report_item", "drift", 168.0,
     "weekly report: end-state divergence on equivalent tasks", "Medium", False),
    ("escalation.age_max>24", "escalation", "system_health", 2.0,
     "self-escalation; PagerDuty/SMS (R14)", "Emergency", True),
]
SIGNALS = [r[0] for r in SIGNAL_RULES]
SIGNAL_RULES_SCHEMA = (
    "signal string, event_type string, reason string, sla_hours double,"
    " protection string, severity string, fires_in_calibration boolean")

# most urgent first
SEVERITIES = ["Emergency", "Critical", "High", "Medium", "Low", "Info"]

# --- fixed values: error classes --------------------------------------------------
# ordered: the first class with a matching text wins
ERROR_RULES = [
    ("schema_drift", ["schema drift", "schema_drift"]),
    ("partial_response", ["partial response", "truncated"]),
    ("timeout", ["timeout", "timed out"]),
    ("auth", ["auth", "401", "403", "permission"]),
    ("parse", ["parse", "json", "schema"]),
    ("tool_fail", ["tool", "api", "500", "429"]),
    ("verification_fail", ["verify", "validation", "expected"]),
    ("interagent_mismatch", ["mismatch", "protocol", "handoff"]),
    ("spec_ambiguity", ["ambiguous", "spec", "unclear"]),
]
PRESEEN_CLASSES = ["tool_fail", "parse", "timeout", "auth"]
# class, failure family, triggered signal
ERROR_FAMILIES = [
    ("spec_ambiguity", "Specification Issues", None),
    ("interagent_mismatch", "Inter-Agent Misalignment", None),
    ("verification_fail", "Task Verification", None),
    ("tool_fail", "(mechanical-operational)", None),
    ("parse", "(mechanical-operational)", None),
    ("timeout", "(mechanical-operational)", None),
    ("auth", "(mechanical-operational)", None),
    ("schema_drift", "(mechanical-operational; ReliabilityBench chaos class)", None),
    ("partial_response", "(mechanical-operational; ReliabilityBench chaos class)", None),
    ("loop", "Inter-Agent Misalignment (circulation)", "loop>=2"),
    ("unknown", "(sentinel)", "error.new_class_seen"),
]

# --- fixed values: masking --------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
EMAIL_MASK = "[REDACTED_EMAIL]"
CARD_MASK = "[REDACTED_CARD]"


def signal_rules(spark: SparkSession) -> DataFrame:
    """The nine signal rules, safe to broadcast."""
    return spark.createDataFrame(SIGNAL_RULES, SIGNAL_RULES_SCHEMA)


def error_families(spark: SparkSession) -> DataFrame:
    """Class, family and triggered signal, eleven rows."""
    return spark.createDataFrame(
        ERROR_FAMILIES, "error_class string, family string, trigger_signal string")


def severity_rank(col: str = "severity"):
    """0 for the most urgent severity, one past Low for anything else."""
    c = F.col(col)
    out = F.lit(5)
    for rank, name in reversed(list(enumerate(SEVERITIES[:5]))):
        out = F.when(c == name, rank).otherwise(out)
    return out
