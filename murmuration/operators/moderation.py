"""State of a moderation store as set operations: classifications with their hits and queue, skips, audits, rankings, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.operators.upsert import insert_absent, upsert


def flatten_result(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classification rows and target hits of nested results (post_id, at, label, toxicity, severity, needs_review, targets)."""
    flat = results.select("post_id", "at", "label", "toxicity", "severity", "needs_review", F.transform("targets", lambda t: F.concat_ws(":", t["category"], t["label"])).alias("target_labels"))
    hits = results.select("post_id", F.explode("targets").alias("t")).select("post_id", "t.category", "t.label", "t.confidence")
    return flat, hits.groupBy("post_id", "category", "label").agg(F.max("confidence").alias("confidence"))


def classification_upsert(stored: DataFrame, hits: DataFrame, queue: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classifications, hits, queue) after new results.

    A post's hits are those of its new result: wanted ones are set, others go; posts
    without a new result keep theirs.  A post that needs review enters the queue once.
    """
    flat, wanted = flatten_result(results)
    after = upsert(stored, flat, ["post_id"], "at")
    kept = hits.join(flat.select("post_id"), "post_id", "left_anti")
    asked = flat.where("needs_review").select("post_id", F.lit("pending").alias("status"), F.round(1 - 2 * F.abs(F.col("toxicity") - 0.5), 4).alias("priority"))
    return after, kept.unionByName(wanted), insert_absent(queue, asked, ["post_id"])


def skip(queue: DataFrame, asked: DataFrame, at: Column) -> DataFrame:
    """The queue after skips (post_id, reviewer): status, reviewer and time are set; ids that are not queued change nothing."""
    once = asked.groupBy("post_id").agg(F.min("reviewer").alias("__by"))
    joined = queue.join(once, "post_id", "left")
    hit = F.col("__by").isNotNull()
    return joined.select(
        *[c for c in queue.columns if c not in ("status", "reviewer", "resolved_at")],
        F.when(hit, "skipped").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("__by")).otherwise(F.col("reviewer") if "reviewer" in queue.columns else F.lit(None).cast("string")).alias("reviewer"),
        F.when(hit, at).otherwise(F.col("resolved_at") if "resolved_at" in queue.columns else F.lit(None).cast("timestamp_ntz")).alias("resolved_at"),
    )


def about(targets: Column, wanted: str) -> Column:
    """Whether a list of `category` or `category:label` holds the wanted target, or one below it."""
    return F.exists(targets, lambda t: (t == wanted) | t.startswith(wanted + ":"))


def account_ranking(scores: DataFrame, most: int, score: str = "score", key: str = "author_id") -> DataFrame:
    """The accounts of highest score; one without a score counts as 0, equal ones go by id."""
    return scores.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), key).limit(most)


def taxonomy(hits: DataFrame) -> DataFrame:
    """(category, labels): the distinct labels of each category, sorted."""
    once = hits.select("category", "label").distinct()
    return once.groupBy("category").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def summaries(posts: DataFrame, classified: DataFrame) -> DataFrame:
    """(post_id, author_id, engagement, classification): nested summaries; a post that is not classified has a null one."""
    model = classified.select("post_id", F.struct("label", "tox", "severity").alias("classification"))
    return posts.select("post_id", "author_id", F.struct("likes", "replies").alias("engagement")).join(model, "post_id", "left")


def append_audit(report: DataFrame, path: str, week: str) -> None:
    """A report as one JSON row a group, appended under its week; earlier weeks stay as they were."""
    report.select(F.lit(week).alias("week"), F.to_json(F.struct("*")).alias("report")).write.mode("append").partitionBy("week").json(path)


def event_list(events: DataFrame, day: str, until: Column, days: int) -> DataFrame:
    """The events from `days` before a day on, the newest first."""
    return events.where(F.col(day) >= F.date_sub(until, days)).orderBy(F.desc(day))
