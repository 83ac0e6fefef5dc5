"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import fold_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``key, label, text`` of at most ``bound`` labelled ids outside fold 2, those with the least hash; a row for each id.

    Ids with null labels and null ids are left out; if an id has several labels, the largest holds, if it has
    several texts, the least. Other columns of either table play no part.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), (fold_of(F.col("doc_id")) != 2).alias("taught"), F.col(label).cast("int").alias("label"))
    ids = own.where("taught AND id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    some = F.broadcast(ids.orderBy(F.xxhash64("id"), "id").limit(bound))  # at most ``bound`` rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(some, "id").groupBy("id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("id").alias("key"), "label", "text")
