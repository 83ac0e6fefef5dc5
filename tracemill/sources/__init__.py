"""Trace sources."""

from .files import classify, load_traces, scan_traces, traces_from_text

__all__ = ["classify", "load_traces", "scan_traces", "traces_from_text"]
