"""Traces as they arrive: a stateless file stream, the same checks as in batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..limits import DEFAULT_MAX_BYTES
from ..sources.files import classify, refused

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_traces(spark: SparkSession, folder: str, max_bytes: int = DEFAULT_MAX_BYTES, encoding: str = "utf-8") -> DataFrame:
    """Each new file of a folder once. Oversize files are rows of status ``size``; a second stream over the folder lists them, so their content is never read."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder).select(F.col("path").alias("source"), F.col("length").alias("size"), "content")
    return classify(files.where(F.col("size") <= max_bytes), max_bytes, encoding).unionByName(refused(files, max_bytes))
