"""Column functions: each takes and returns a Spark ``Column``."""

from .display import sanitise, summary_text
from .keys import is_sensitive, normalise
from .strict import strict_variant, strip_bom

__all__ = ["is_sensitive", "normalise", "sanitise", "strict_variant", "strip_bom", "summary_text"]
