"""Operators over trace tables."""

from .collections import collection, counts, explode_collection, explode_redacted, redacted_collection, with_collections
from .fields import field, session_id, trace_version
from .redaction import redact_column, redact_json, redact_leaves, redact_typed

__all__ = [
    "collection", "counts", "explode_collection", "explode_redacted", "field", "redact_column", "redact_json", "redact_leaves",
    "redact_typed", "redacted_collection", "session_id", "trace_version", "with_collections",
]
