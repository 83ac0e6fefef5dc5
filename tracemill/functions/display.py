"""Text made safe for a terminal."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..limits import DISPLAY_LIMIT


def sanitise(text: Column, limit: int = DISPLAY_LIMIT) -> Column:
    """Each unprintable code point becomes ``?``; beyond ``limit`` code points the rest becomes ``...``."""
    clean = F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", "?")
    return F.when(F.char_length(clean) > limit, F.concat(F.left(clean, F.lit(limit)), F.lit("..."))).otherwise(clean)


def summary_text(session: Column, findings: Column, decisions: Column, title: str = "Session trace") -> Column:
    """The four summary lines. An empty or missing session prints as ``unknown``."""
    shown = F.when(F.coalesce(session, F.lit("")) == "", F.lit("unknown")).otherwise(sanitise(session))
    return F.concat_ws(
        "\n",
        F.lit(title),
        F.concat(F.lit("Session: "), shown),
        F.concat(F.lit("Findings: "), findings.cast("string")),
        F.concat(F.lit("Decisions: "), decisions.cast("string")),
    )
