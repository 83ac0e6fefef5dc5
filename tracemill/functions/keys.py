"""Key folding and the sensitive-key predicate, JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..limits import SENSITIVE_KEY_FRAGMENTS


def normalise(key: Column) -> Column:
    """Lower case, letters and digits of any script only; null stays null."""
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def is_sensitive(key: Column) -> Column:
    """Whether the folded key holds one of the fragments. One regex literal, so it stays in codegen."""
    return normalise(key).rlike("|".join(sorted(SENSITIVE_KEY_FRAGMENTS)))
