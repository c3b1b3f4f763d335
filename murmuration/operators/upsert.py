"""Keyed table updates as set operations, for tables without a merge statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in the order; ties need an order that tells rows apart."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Stored rows replaced or extended by incoming ones; of a key the latest version stays, incoming first on a tie."""
    both = stored.withColumn("__fresh", F.lit(0)).unionByName(incoming.withColumn("__fresh", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, keys, F.desc(version), F.desc("__fresh")).drop("__fresh")


def stub_authors(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Rows for authors that posts name and the author table lacks."""
    unknown = posts.select("author_id").where("author_id is not null").distinct().join(authors, "author_id", "left_anti")
    return unknown.withColumn("username", F.concat(F.lit("user_"), F.col("author_id").cast("string")))


def soft_delete(posts: DataFrame, removed: DataFrame, key: str, text: str, marker: str = "[deleted upstream]") -> DataFrame:
    """Rows whose key is in `removed` are marked deleted and lose their text."""
    ids = removed.select(F.col(key).alias("__gone")).distinct()
    hit = F.col("__gone").isNotNull()
    joined = posts.join(ids, F.col(key) == F.col("__gone"), "left")
    return joined.withColumn(text, F.when(hit, marker).otherwise(F.col(text))).withColumn("deleted", F.coalesce(F.col("deleted"), F.lit(False)) | hit).drop("__gone")


def removed_upstream(asked: DataFrame, present: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Ids that a source no longer returns: listed errors, and asked ids that are absent from the answer."""
    return asked.select(key).join(present.select(key), key, "left_anti").union(errors.select(key)).distinct()


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and the incoming ones whose key is new; of equal incoming keys one stays."""
    fresh = incoming.dropDuplicates(keys).join(stored, keys, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def annotation_upsert(stored: DataFrame, incoming: DataFrame, classified: DataFrame) -> DataFrame:
    """Annotations by (post, annotator), the latest stays; agreement with the model's label is null without one."""
    merged = upsert(stored, incoming, ["post_id", "annotator"], "at")
    model = classified.select("post_id", F.col("label").alias("model_label"))
    return merged.join(model, "post_id", "left").withColumn("agrees_with_model", F.col("model_label") == F.col("toxicity_label"))


def purge_older(rows: DataFrame, at: str, cutoff: Column) -> DataFrame:
    return rows.where(F.col(at) >= cutoff)
