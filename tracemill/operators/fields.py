"""Scalar fields of a trace, through alias lists. Use them on rows that the strict parse admitted."""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..document import field_text
from ..limits import MAX_REDACTION_DEPTH, SESSION_KEYS, VERSION_KEYS
from .redaction import checked_depth


def _scalar(doc: Column, text: Column, path: str, integers: bool = True) -> Column:
    """Non-empty string, or an integer's exact digits (taken from the text: VARIANT rounds over 38 digits)."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    told = F.get_json_object(text, path)
    out = F.when((kind == "STRING") & (told != ""), told)
    if integers:
        digits = F.when(told == "-0", F.lit("0")).otherwise(told)
        out = out.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & told.rlike("^-?[0-9]+$"), digits)
    return out


def session_id(doc: Column, text: Column) -> Column:
    """First usable alias at the top, then under ``session``, where only strings count."""
    top = [_scalar(doc, text, f"$.{k}") for k in SESSION_KEYS]
    nested = [_scalar(doc, text, f"$.session.{k}", integers=False) for k in SESSION_KEYS]
    return F.coalesce(*top, *nested)


def trace_version(doc: Column, text: Column) -> Column:
    return F.coalesce(*[_scalar(doc, text, f"$.{k}") for k in VERSION_KEYS])


def field(text: Column, key: str, default: str | None = None, max_depth: int = MAX_REDACTION_DEPTH) -> Column:
    """A top-level field as redacted JSON text, keys in the document's order and integers with every digit; ``default`` (JSON text) when absent.

    A present null gives ``null``. Absence is tested before sensitivity. Null text, and text that is no strict JSON object, give null.
    """
    checked_depth(max_depth)

    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else field_text(t, key, default, max_depth) for t in texts.to_pylist()], pa.string())

    return cut(text)
