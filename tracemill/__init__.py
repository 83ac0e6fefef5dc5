"""Session traces as Spark tables: strict reading, extraction, redaction, summaries."""

from .document import Trace, TraceError, TraceFormatError, TraceSizeError, TraceSourceError
from .document import redact_value as redact
from .document import sensitive_key as is_sensitive_key
from .limits import DEFAULT_MAX_BYTES, DEPTH_LIMITED, MAX_REDACTION_DEPTH, REDACTED, SENSITIVE_KEY_FRAGMENTS

__version__ = "0.2.0"

# Fixed interface: the public names.
__all__ = [
    "DEFAULT_MAX_BYTES", "DEPTH_LIMITED", "MAX_REDACTION_DEPTH", "REDACTED", "SENSITIVE_KEY_FRAGMENTS", "Trace",
    "TraceError", "TraceFormatError", "TraceSizeError", "TraceSourceError", "__version__", "is_sensitive_key", "redact",
]
