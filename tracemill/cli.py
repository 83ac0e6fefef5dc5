"""``python -m tracemill TRACE``: the summary of one trace. Exit 0; 1 on a refused trace; 2 on wrong usage."""

import argparse
import sys
from collections.abc import Sequence

from . import __version__
from .document import Trace, TraceError
from .limits import DEFAULT_MAX_BYTES


def main(argv: Sequence[str] | None = None) -> int:
    asks = argparse.ArgumentParser(prog="tracemill", description="Print a redacted summary of a session trace.")
    asks.add_argument("path", metavar="TRACE", help="a JSON trace file")
    asks.add_argument("--max-bytes", type=int, default=DEFAULT_MAX_BYTES, metavar="N", help="refuse larger files (default: %(default)s)")
    asks.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    told = asks.parse_args(argv)
    if told.max_bytes <= 0:
        asks.error("--max-bytes must be positive")
    try:
        print(Trace.load(told.path, max_bytes=told.max_bytes).summary())
    except TraceError as e:
        print(f"tracemill: {e}", file=sys.stderr)
        return 1
    return 0
