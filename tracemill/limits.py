"""Fixed values of the trace format: limits, marks and alias lists."""

# They must be the same wherever traces are read.
DEFAULT_MAX_BYTES = 8_388_608
MAX_REDACTION_DEPTH = 64
DISPLAY_LIMIT = 128
REDACTED = "[redacted]"
DEPTH_LIMITED = "[depth-limited]"
SENSITIVE_KEY_FRAGMENTS = frozenset(
    ["apikey", "authorization", "cookie", "credential", "passwd", "password", "privatekey", "secret", "token"]
)
SESSION_KEYS = ("sessionId", "session_id", "id")
VERSION_KEYS = ("traceVersion", "trace_version", "schemaVersion", "schema_version", "version")
KIND_KEYS = ("kind", "type", "eventType", "event_type")
COLLECTIONS = {
    "events": (("events",), None),
    "findings": (("findings",), "finding"),
    "decisions": (("decisions", "policyDecisions", "policy_decisions"), "decision"),
}
BOM = "\ufeff"
