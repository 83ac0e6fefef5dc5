"""Key-based redaction, depth limited, for text, typed and VARIANT inputs.

* ``redact_column`` / ``redact_json``: JSON text, an Arrow UDF; exact, keeps key order and every digit.
* ``redact_typed``: typed columns, decided from the schema when the plan is built; masked columns are
  not read from Parquet at all. Absent and null are one thing here.
* ``redact_leaves``: VARIANT into rows ``(path, level, key, value)``; level by level DataFrame steps.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..document import redact_text, sensitive_key
from ..functions.keys import is_sensitive
from ..limits import DEPTH_LIMITED, MAX_REDACTION_DEPTH, REDACTED


def checked_depth(max_depth: int) -> int:
    if max_depth < 0:
        raise ValueError("max_depth has to be 0 or more")
    return max_depth


def _text_udf(max_depth: int) -> Callable[..., Column]:
    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redact_text(t, max_depth) for t in texts.to_pylist()], pa.string())

    return masked


def redact_column(text: Column, max_depth: int = MAX_REDACTION_DEPTH) -> Column:
    """JSON text to redacted JSON text; null, and text that is not strict JSON, give null."""
    return _text_udf(checked_depth(max_depth))(text)


def redact_json(df: DataFrame, column: str, out: str = "redacted", max_depth: int = MAX_REDACTION_DEPTH) -> DataFrame:
    return df.withColumn(out, redact_column(F.col(column), max_depth))


def _typed(value: Column, kind: T.DataType, depth: int) -> Column:
    if depth <= 0:
        return F.lit(DEPTH_LIMITED)
    if isinstance(kind, T.StructType):
        parts = [
            (F.lit(REDACTED) if sensitive_key(f.name) else _typed(value[f.name], f.dataType, depth - 1)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _typed(x, kind.elementType, depth - 1))
    if isinstance(kind, T.MapType):
        def entry(k: Column, v: Column) -> Column:
            inner = _typed(v, kind.valueType, depth - 1)
            text = inner if isinstance(kind.valueType, T.StringType) else F.to_json(inner) if isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)) else inner.cast("string")
            return F.when(is_sensitive(k), F.lit(REDACTED)).otherwise(text)
        return F.transform_values(value, entry)
    return value


def redact_typed(df: DataFrame, max_depth: int = MAX_REDACTION_DEPTH) -> DataFrame:
    """Redacts a table by its column names; map values become strings, since a mask is one."""
    if checked_depth(max_depth) == 0:
        raise ValueError("a table of rows needs a depth of 1 at least")
    return df.select(
        *[(F.lit(REDACTED) if sensitive_key(f.name) else _typed(df[f"`{f.name}`"], f.dataType, max_depth - 1)).alias(f.name) for f in df.schema]
    )


def redact_leaves(df: DataFrame, keep: list[str], doc: str = "doc", max_depth: int = MAX_REDACTION_DEPTH, levels: int | None = None) -> DataFrame:
    """One row for each leaf: ``path``, ``level``, ``key`` and ``value`` (JSON text, masked where it must be).

    Each level is one narrow explode of the open nodes, no shuffle; finished leaves pass through. ``levels``
    bounds how deep the plan goes when the documents' depth is known; a deeper document raises an error.
    """
    steps = min(checked_depth(max_depth), levels if levels is not None else max_depth)
    none = F.lit(None).cast("string")
    at = df.select(*keep, F.lit("$").alias("path"), F.lit(0).alias("level"), none.alias("key"), none.alias("value"), F.col(doc).alias("v"))
    for level in range(steps + 1):
        at = at.select(*keep, "path", "level", "key", _finished(level, max_depth, steps).alias("value"), "v")
        if level < steps:
            at = at.select(*keep, F.explode(_members(level + 1)).alias("m")).select(*keep, "m.path", "m.level", "m.key", "m.value", "m.v")
    return at.drop("v")


def _finished(level: int, max_depth: int, steps: int) -> Column:
    """The text of a leaf; null where the node is open. A sensitive key masks even at the depth limit; the limit comes next."""
    kind = F.schema_of_variant(F.col("v"))
    empty = kind.isin("OBJECT<>", "ARRAY<VOID>") & F.try_variant_get("v", "$[0]", "variant").isNull()
    text = F.when(~kind.rlike("^(OBJECT|ARRAY)<") | empty, F.to_json("v"))
    if level >= max_depth:
        text = F.lit(f'"{DEPTH_LIMITED}"')
    elif level == steps:
        text = F.coalesce(text, F.raise_error(F.lit("a document is deeper than the stated levels")).cast("string"))
    masked = F.when(F.coalesce(is_sensitive(F.col("key")), F.lit(False)), F.lit(f'"{REDACTED}"'))
    return F.when(F.col("value").isNotNull(), F.col("value")).when(masked.isNotNull(), masked).otherwise(text)


def _members(level: int) -> Column:
    """An open node's members, or a leaf as it is. The path quotes every key, so it names one place."""
    none = F.lit(None).cast("string")

    def row(key: Column, step: Column, v: Column) -> Column:
        return F.struct(F.concat("path", F.lit("["), step, F.lit("]")).alias("path"), F.lit(level).alias("level"), key.alias("key"), none.alias("value"), v.alias("v"))

    as_map = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: row(e["key"], F.to_json(e["key"].cast("variant")), e["value"]))
    as_list = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x, i: row(none, i.cast("string"), x))
    own = F.array(F.struct("path", "level", "key", "value", F.lit(None).cast("variant").alias("v")))
    return F.when(F.col("value").isNotNull(), own).otherwise(F.coalesce(as_map, as_list))
