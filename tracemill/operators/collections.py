"""Events, findings and decisions of a trace: alias lists, the event fallback, counts and rows."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..document import element_texts
from ..functions.keys import normalise
from ..limits import COLLECTIONS, KIND_KEYS, MAX_REDACTION_DEPTH
from .redaction import checked_depth


def _list(doc: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(doc, f"$.{k}", "array<variant>") for k in keys])


def kind_matches(event: Column, fragment: str) -> Column:
    """Whether any kind key of an event object is a string that holds the fragment once folded."""

    def one(key: str) -> Column:
        value = F.try_variant_get(event, f"$.{key}", "variant")
        told = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        return F.coalesce(F.contains(normalise(told), F.lit(fragment)), F.lit(False))

    return reduce(lambda a, b: a | b, map(one, KIND_KEYS))


def collection(doc: Column, name: str) -> Column:
    """``events``, ``findings`` or ``decisions`` as ARRAY<VARIANT>, order kept, never null for a document.

    The first alias that is a list wins, empty or not; otherwise the events of that kind.
    """
    keys, fragment = COLLECTIONS[name]
    events = _list(doc, COLLECTIONS["events"][0])
    none = F.array().cast("array<variant>")
    if fragment is None:
        return F.coalesce(events, none)
    return F.coalesce(_list(doc, keys), F.filter(events, lambda e: kind_matches(e, fragment)), none)


def counts(doc: Column) -> dict[str, Column]:
    return {f"{n[:-1]}_count": F.size(collection(doc, n)).cast("long") for n in COLLECTIONS}


def with_collections(traces: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds the three collections and their counts."""
    return traces.withColumns({n: collection(F.col(doc), n) for n in COLLECTIONS} | counts(F.col(doc)))


def explode_collection(traces: DataFrame, name: str, keep: list[str], doc: str = "doc") -> DataFrame:
    """A row for each element: the kept columns, ``pos`` from 0 and the raw ``value``."""
    return traces.select(*keep, F.posexplode(collection(F.col(doc), name)).alias("pos", "value"))


def redacted_collection(text: Column, name: str, max_depth: int = MAX_REDACTION_DEPTH) -> Column:
    """A collection's elements as redacted JSON texts, from the document's text: key order and digits are kept. Null for text that is no strict JSON object."""
    checked_depth(max_depth)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else element_texts(t, name, max_depth) for t in texts.to_pylist()], pa.list_(pa.string()))

    return cut(text)


def explode_redacted(traces: DataFrame, name: str, keep: list[str], text: str = "text", max_depth: int = MAX_REDACTION_DEPTH) -> DataFrame:
    """A row for each element: the kept columns, ``pos`` from 0 and ``value``, its redacted JSON text."""
    return traces.select(*keep, F.posexplode(redacted_collection(F.col(text), name, max_depth)).alias("pos", "value"))
