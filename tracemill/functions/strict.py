"""Strict JSON parsing into VARIANT with built-in functions only.

``try_parse_json`` already turns duplicate keys, ``NaN`` and ``Infinity`` and lax syntax into NULL; what
it lets through is text after the document. The document is therefore parsed twice, inside an array and
inside an object: a trailing text that closes one wrapper cannot close the other.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_bom(text: Column) -> Column:
    """Takes away one leading U+FEFF."""
    return F.regexp_replace(text, r"^\uFEFF", "")


def strict_variant(text: Column) -> Column:
    """The document as VARIANT, or NULL unless the text is exactly one JSON object without repeated keys.

    Nesting beyond 1,000 levels and integers beyond 1,000 digits count as rejected.
    """
    bare = strip_bom(text)
    in_array = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"d":'), bare, F.lit("}")))
    doc = F.try_variant_get(in_object, "$.d", "variant")
    alone = F.size(in_array.cast("array<variant>")) == 1
    is_object = F.try_variant_get(doc, "$", "map<string,variant>").isNotNull()
    return F.when(F.coalesce(alone & is_object, F.lit(False)), doc)
