"""Line dedup (8): lines that stand on many distinct sites are boilerplate and are taken out of documents.

Every distinct line of a document (spaces at its ends taken away, blank lines left alone) counts for the
document's source. HyperLogLog sketches of the sources, one for each line hash, merge in the aggregation's
partial and final steps. Lines whose estimate is within ``band`` of the threshold get an exact distinct
count; the rest are decided by their estimate, which is exact for small counts and errs by 1.6 % beyond.

A document of which no line would be left is a copy of other documents rather than a page with boilerplate;
it stays as it is, for the operators that compare whole documents.

The hashes of the lines to remove are counted: up to ``BROADCAST_ROWS`` go to all executors, and texts are
cleaned where they lie; beyond, the hits are joined by shuffle. Both give the same rows.

Defined results: null text stays null (no lines), a null source counts as one site, repeated rows are
treated alike, an empty table stays empty. Other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import BROADCAST_ROWS, discard, free, settle, sized

MIN_SITES = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """A hash for each line, null for blank ones."""
    return F.transform(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: F.when(x != "", F.xxhash64(x)))


def _hashed(docs: DataFrame) -> DataFrame:
    """``h, site``: the distinct non-blank lines of each document."""
    line = F.explode(F.array_distinct(F.transform(_lines(F.col("text").cast("string")), lambda x: F.trim(x))))
    return docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), line.alias("line")).where("line <> ''").select(F.xxhash64("line").alias("h"), "site")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = 0.1) -> DataFrame:
    """``h``: hashes of the lines on at least ``min_sites`` distinct sites."""
    lines = _hashed(docs)
    spread = lines.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", 12).alias("sketch")).where(F.col("n") >= min_sites)
    told = settle(spread.select("h", F.hll_sketch_estimate("sketch").alias("sites")))
    # Rounded estimates: a band of 1 at least, so that no estimate alone decides next to the threshold.
    margin = max(1.0, band * min_sites)
    sure = told.where(F.col("sites") > min_sites + margin).select("h")
    near = told.where(F.col("sites").between(min_sites - margin, min_sites + margin)).select("h")
    exact = lines.join(sized(near), "h", "left_semi").groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("sites"))
    return settle(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h")), told)


def _flags(bad: np.ndarray) -> Callable[[Column], Column]:
    """Line hashes to one flag a line: whether it is among the sorted ``bad``."""

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def gone(hashes: pa.Array) -> pa.Array:
        flat = hashes.flatten()
        h = flat.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(bad, h), max(len(bad) - 1, 0))
        hit = (bad[at] == h if len(bad) else np.zeros(len(h), bool)) & flat.is_valid().to_numpy(zero_copy_only=False)
        return _nested(hit, hashes)

    return gone


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _marked(positions: pa.Array, lines: pa.Array) -> pa.Array:
    """The places of lines to remove to one flag a line."""
    start = np.append(0, np.cumsum(lines.fill_null(0).to_numpy(zero_copy_only=False)))
    hit = np.zeros(start[-1], bool)
    places = positions.flatten().to_numpy(zero_copy_only=False)
    hit[np.repeat(start[:-1], positions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + places] = True
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(hit))


def _nested(flags: np.ndarray, like: pa.Array) -> pa.Array:
    size = like.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flags))


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All columns, the text without boilerplate lines, and ``n_lines`` and ``n_removed`` (long), with ``_`` at the end while such a name is taken.

    ``n_chars``, where there is one, follows the new text.
    """
    bad, text = boilerplate(docs, min_sites), F.col("text").cast("string")
    gone, n_lines, n_removed = free(docs, "gone", "n_lines", "n_removed")
    if bad.count() <= broadcast_rows:
        hashes = np.sort(np.array([r.h for r in bad.collect()], np.int64))
        discard(bad)
        marked = docs.withColumn(gone, _flags(hashes)(_hashes(text)))
    else:
        marked = _marked_by_join(docs, bad, gone)
    solid = F.size(F.filter(_lines(text), lambda x: F.trim(x) != ""))
    lost = F.size(F.filter(F.col(gone), lambda x: x))
    drop = (lost > 0) & (lost < solid)
    now = F.when(drop, F.array_join(F.filter(_lines(text), lambda x, i: ~F.get(F.col(gone), i)), "\n")).otherwise(text)
    put = {"text": now, "n_chars": F.char_length(now)}
    columns = [put[c].cast(docs.schema[c].dataType).alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*columns, F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long").alias(n_lines), F.when(drop, lost).otherwise(0).cast("long").alias(n_removed))


def _marked_by_join(docs: DataFrame, bad: DataFrame, gone: str) -> DataFrame:
    text = F.col("text").cast("string")
    ident, form, lost, own = free(docs, "ident", "form", "lost", "own")
    # Rows with the same id and text share their places.
    key = docs.select(F.col("doc_id").alias(ident), F.xxhash64(text).alias(form), F.posexplode(_hashes(text)).alias("pos", "h")).where("h IS NOT NULL")
    hits = key.join(bad, "h").groupBy(ident, form).agg(F.collect_set("pos").alias(lost))
    both = docs.withColumn(own, F.xxhash64(text)).join(hits, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(form)), "left")
    return both.withColumn(gone, _marked(F.coalesce(F.col(lost), F.array().cast("array<int>")), F.size(_lines(text))))


SQL = f"""WITH line AS (
    SELECT DISTINCT doc_id, trim(l) AS line, coalesce(source, '') AS site FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''),
  bad AS (SELECT line FROM line GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
  told AS (SELECT doc_id, pos, l, trim(l) IN (SELECT line FROM bad) AS gone FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
  doc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, count(*) FILTER (gone) < count(*) FILTER (trim(l) <> '') AS some_left,
    string_agg(l, chr(10) ORDER BY pos) AS whole, coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest FROM told GROUP BY doc_id)
SELECT doc_id, n_lines, CASE WHEN some_left THEN n_gone ELSE 0 END AS n_removed, sha256(CASE WHEN some_left THEN rest ELSE whole END) AS text_sha256 FROM doc"""
