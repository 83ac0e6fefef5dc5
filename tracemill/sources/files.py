"""Files and text columns to trace tables: ``source, size, status, error, text, doc``.

``status`` is ``ok``, ``source``, ``size`` or ``format``; the first check that fails decides. Bulk reads never
raise on a bad document. Spark parses a document again wherever ``doc`` is used in a filter and a projection,
so write the table (Parquet holds VARIANT) before asking it many things.
"""

import fnmatch
import os
import stat
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..document import TraceError, parse_problem, read_bounded
from ..functions.strict import strict_variant, strip_bom
from ..limits import DEFAULT_MAX_BYTES


@F.arrow_udf(T.StringType())
def _reason(texts: pa.Array) -> pa.Array:
    """Only refused rows carry a text here; what Python admits was beyond the native parser's limits."""
    told = [None if t is None else parse_problem(t) or "not JSON within the native parser's limits" for t in texts.to_pylist()]
    return pa.array(told, pa.string())


def _decoded(content: Column, encoding: str) -> Column:
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))

    @F.arrow_udf(T.StringType())
    def decode(parts: pa.Array) -> pa.Array:
        def one(data: bytes | None) -> str | None:
            try:
                return data.decode(encoding).encode().decode() if data is not None else None
            except (ValueError, LookupError):
                return None

        return pa.array([one(x) for x in parts.to_pylist()], pa.string())

    return decode(content)


def classify(raw: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES, encoding: str = "utf-8") -> DataFrame:
    """``source, size, content`` to the trace table. Null content within the size limit is a ``source`` error."""
    if max_bytes <= 0:
        raise ValueError("max_bytes has to be 1 or more")
    over = (F.col("size") > max_bytes) | (F.octet_length("content") > max_bytes)
    held = F.when(~over, F.col("content"))
    text = raw.select("source", "size", F.col("content").isNull().alias("gone"), over.alias("over"), _decoded(held, encoding).alias("text"))
    return _judged(text, encoding)


def _judged(text: DataFrame, encoding: str) -> DataFrame:
    doc = strict_variant(F.col("text"))
    parsed = text.withColumn("doc", doc)
    over = F.coalesce(F.col("over"), F.lit(False))
    status = F.when(over, "size").when(F.col("gone"), "source").when(F.col("doc").isNull(), "format").otherwise("ok")
    asked = F.when(~over & F.col("doc").isNull(), F.col("text"))
    error = (
        F.when(over, "more bytes than allowed")
        .when(F.col("gone"), "unreadable")
        .when(F.col("text").isNull(), f"no {encoding} text")
        .otherwise(_reason(asked))
    )
    return parsed.select("source", "size", status.alias("status"), error.alias("error"), strip_bom(F.col("text")).alias("text"), "doc")


def _refusal(files: DataFrame, status: str, error: str) -> DataFrame:
    return files.select("source", "size", F.lit(status).alias("status"), F.lit(error).alias("error"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("variant").alias("doc"))


def refused(files: DataFrame, max_bytes: int) -> DataFrame:
    """The oversize ones of ``source, size`` as rows of status ``size``."""
    return _refusal(files.where(F.col("size") > max_bytes), "size", "more bytes than allowed")


def scan_traces(spark: SparkSession, path: str | Sequence[str], max_bytes: int = DEFAULT_MAX_BYTES, encoding: str = "utf-8", glob: str | None = None) -> DataFrame:
    """All plain files under folders, any store. The size filter reaches the scan: oversize content is not read.

    Spark does not read names that begin with ``_`` or ``.`` (or lie in such a folder): these files are ``source`` rows.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(paths).select(F.col("path").alias("source"), F.col("length").alias("size"), "content")
    within = classify(files.where(F.col("size") <= max_bytes), max_bytes, encoding)
    hidden = spark.createDataFrame(_hidden(spark, paths, glob), "source string, size long")
    return within.unionByName(refused(files, max_bytes)).unionByName(_refusal(hidden, "source", "unreadable: a hidden name"))


def _hidden(spark: SparkSession, paths: list[str], glob: str | None) -> list[tuple[str, int]]:
    """Files below the paths that Spark's listing leaves out. Listed on the driver, as Spark lists what it reads."""
    out, hadoop = [], spark._jvm.org.apache.hadoop.fs
    for top in paths:
        at = hadoop.Path(top)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for root in store.globStatus(at) or ():
            depth = root.getPath().depth()
            listed = store.listFiles(root.getPath(), True) if root.isDirectory() else None
            while listed is not None and listed.hasNext():
                found = listed.next()
                names = found.getPath().toUri().getPath().rstrip("/").split("/")[depth + 1 :]
                if any(n[0] in "_." for n in names) and (not glob or fnmatch.fnmatchcase(names[-1], glob)):
                    out.append((found.getPath().toString(), found.getLen()))
    return out


def load_traces(spark: SparkSession, paths: Sequence[str | os.PathLike[str]], max_bytes: int = DEFAULT_MAX_BYTES, encoding: str = "utf-8") -> DataFrame:
    """A short list of named local files, one row each: missing files, folders and pipes become ``source`` rows.

    Spark skips names that begin with ``_`` or ``.``, so those few are read by the driver.
    """
    if max_bytes <= 0:
        raise ValueError("max_bytes has to be 1 or more")
    plain, rows = {}, []
    for path in map(os.fspath, paths):
        try:
            found = os.stat(path)
            if stat.S_ISREG(found.st_mode) and found.st_size <= max_bytes and os.path.basename(path)[0] not in "_.":
                plain[os.path.abspath(path)] = path
                continue
            rows.append((path, found.st_size, None, bytearray(read_bounded(path, max_bytes))))
        except TraceError as e:
            rows.append((path, None, f"{e.status}|{e}", None))
        except OSError as e:
            rows.append((path, None, f"source|{path}: unreadable ({e.strerror or e})", None))
    own = spark.createDataFrame(rows, "source string, size long, refusal string, content binary")
    refused = own.where("refusal IS NOT NULL").select("source", "size", F.split_part("refusal", F.lit("|"), F.lit(1)).alias("status"), F.expr("substr(refusal, instr(refusal, '|') + 1)").alias("error"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("variant").alias("doc"))
    out = refused.unionByName(classify(own.where("refusal IS NULL").select("source", "size", "content"), max_bytes, encoding))
    if not plain:
        return out
    given = F.create_map(*[F.lit(x) for path in plain for x in (path, plain[path])])  # the names as given, as in the other rows
    found = scan_traces(spark, list(plain), max_bytes, encoding)
    return out.unionByName(found.withColumn("source", F.element_at(given, F.regexp_replace("source", "^file:/+", "/"))))


def traces_from_text(df: DataFrame, text: str = "text", source: str | None = None) -> DataFrame:
    """A string column as traces; no size limit on this path. Null text is a ``source`` error."""
    return _judged(df.select((F.col(source).cast("string") if source else F.lit("<trace>")).alias("source"), F.octet_length(text).cast("long").alias("size"), F.col(text).isNull().alias("gone"), F.lit(False).alias("over"), F.col(text).alias("text")), "utf-8")
