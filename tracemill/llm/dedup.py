"""Exact dedup (5): a stateful stream whose keyed state never expires.

Documents arrive as files. For each digest (SHA-256 of the text) the state store, which keeps its data on
disk, retains how many rows had it, the identifier of the row that stays (the largest so far) and where
that row's content lies (file and id). Every micro-batch upserts the changed keys into a written table.
When the stream has caught up, every row that hit a known digest is checked byte by byte against the
content that the locator names; if any differs, the rows of that digest are grouped by their full text.
Only hits are moved for that, a large group in many parts, each with a copy of the content.

Defined results: null text counts as empty; a null id is smaller than any other; rows that share both text
and the largest id are all kept, as nothing tells them apart; very long texts are compared whole; an empty
table gives none; other columns play no part; a path that holds marks of a pattern is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import discard, settle, shared_folder, sized

_PROVIDER = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",  # else every partition of the state takes an eighth of 64 MB at once
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition of the state takes 4 MB or more at once
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _pattern(path: str) -> str:
    """The path as a pattern of one match: a stream takes a single file only so."""
    path = path.rstrip("/")
    if set(path) & set("*?[]{}\\^"):
        raise ValueError(f"a path with marks of a pattern can't be read as a stream: {path}")
    return f"{path[:-1]}[{path[-1]}]"


def run_stream(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, folder: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Brings the state up to all files of ``path``: ``digest, keep_id, locator, group_size``.

    Give the same ``folder`` again to go on with the state of earlier runs; only new files are read then.
    """
    folder = folder or shared_folder(spark)
    before = {k: spark.conf.get(k, None) for k in _PROVIDER}
    for k, v in _PROVIDER.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(spark.read.parquet(_pattern(path)).schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        stream = reader.parquet(_pattern(path)).select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"))
        state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file")).alias("locator"), F.count("*").alias("group_size"))

        def upsert(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={number}")  # again after a failure: the same rows

        query = state.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest binary, locator struct<doc_id: long, file: string>, group_size long"
    try:
        groups = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/groups")
    except Exception as e:  # no file ever came
        if "PATH_NOT_FOUND" not in str(e):
            raise
        groups = spark.createDataFrame([], schema)
    # Counts only grow, so the greatest is the last.
    last = groups.groupBy("digest").agg(F.max(F.struct("group_size", "locator")).alias("s"))
    return last.select("digest", F.col("s.locator.doc_id").alias("keep_id"), F.col("s.locator").alias("locator"), F.col("s.group_size").alias("group_size"))


def exact_duplicates(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, part: int = 1000) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of the table at ``path``. Groups are checked in parts of about ``part`` rows."""
    groups = settle(run_stream(spark, path, digest).where("group_size > 1"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = spark.read.parquet(_pattern(path)).select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), text.alias("text"))
    known = sized(groups)
    shown = [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), F.sha2("text", 256).alias("text_sha256")]
    alone = docs.join(known.select("digest"), "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), shown[3])
    parts = F.ceil(F.col("group_size") / part).cast("int")
    own = F.col("doc_id").eqNullSafe(F.col("locator.doc_id")) & (F.col("file") == F.col("locator.file"))
    hits = settle(docs.join(known, "digest").select("digest", "doc_id", "keep_id", "group_size", "text", own.alias("located"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part")))
    content = hits.where("located").groupBy("digest", "group_size").agg(F.min("text").alias("content")).select("digest", "content", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    told = settle(hits.join(content, ["digest", "part"]).select("digest", *shown, (F.col("text") == F.col("content")).alias("same")))
    odd = told.where("NOT same").select("digest").distinct()
    out = told.select("doc_id", "keep_id", "group_size", "text_sha256")
    if not odd.isEmpty():
        apart = hits.join(odd, "digest", "left_semi")
        texts = apart.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        redone = apart.select("doc_id", "text").join(texts, "text").select(*shown)
        out = told.join(odd, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(settle(redone))
    discard(hits)
    out = out.unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)"""
