"""Tables of a directory as domain views.

The views derive posts, authors, threads, reviews and annotations from generic
event, document and conversation tables by fixed formulas, so every analytical
query runs over any directory with those tables.  They are plain projections:
column pruning and filters reach the Parquet scan through them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
#: Real-world events, as a table of a fixed size.
WORLD_EVENTS = [(1, "2024-01-06", "summit"), (2, "2024-01-12", "election"), (3, "2024-01-19", "verdict"), (4, "2024-01-25", "derby")]


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores where a scan has fewer tasks, as of a file with one row group; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def toxicity_label(score: Column) -> Column:
    return F.when(score >= 0.9, "violent_extremism").when(score >= 0.6, "hate_speech").when(score >= 0.3, "offensive").otherwise("non_toxic")


def posts(spark: SparkSession, directory: str) -> DataFrame:
    """One row per event: scores, references to earlier posts, and moderation flags."""
    e = table(spark, directory, "events")
    i = F.col("event_id")
    tox = F.least(F.lit(1.0), F.col("value") / 100.0)
    back = lambda rest, by, step: F.when((i % by == rest) & (i >= step), i - step)
    return e.select(
        i.alias("post_id"),
        F.col("user_id").alias("author_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("target"),
        F.element_at(F.array(F.lit("ethnicity"), F.lit("religion"), F.lit("nationality")), (i % 3 + 1).cast("int")).alias("category"),
        tox.alias("tox"),
        (i % 5).cast("int").alias("severity"),
        toxicity_label(tox).alias("label"),
        F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (i % 4 + 1).cast("int")).alias("lang"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        back(0, 3, 7).alias("parent_id"),
        back(1, 3, 11).alias("quoted_id"),
        back(2, 5, 13).alias("retweeted_id"),
        (i % 17 == 0).alias("deleted"),
        (F.lit(0.5) + F.abs(tox - 0.5)).alias("confidence"),
    )


def authors(spark: SparkSession, directory: str) -> DataFrame:
    """One row per user, with profile fields derived from the id; some have no bot probability."""
    u = F.col("author_id")
    seen = table(spark, directory, "events").groupBy(F.col("user_id").alias("author_id")).agg(F.count(F.lit(1)).alias("n_posts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return seen.withColumns(
        {
            "username": F.concat(F.lit("user"), u.cast("string")),
            "bot_probability": F.when(u % 10 != 0, (u * 37 % 100) / 100.0),
            "followers": u * 13 % 500,
            "following": u * 7 % 300,
            "verified": u % 6 == 0,
            "default_avatar": u % 4 == 0,
            "location": F.when(u % 2 == 0, F.concat(F.lit("place"), (u % 9).cast("string"))),
        }
    )


def documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with their labels where there are any."""
    labels = table(spark, directory, "labels")
    return table(spark, directory, "documents").join(labels, "doc_id", "left")


def annotations(spark: SparkSession, directory: str) -> DataFrame:
    """Labels unpivoted to raters, with a third rater derived from the id."""
    l = table(spark, directory, "labels")
    rows = F.array(
        F.struct(F.lit("quality").alias("rater"), F.col("quality").cast("int").alias("label")),
        F.struct(F.lit("toxic").alias("rater"), F.col("toxic").cast("int").alias("label")),
        F.struct(F.lit("third").alias("rater"), (F.col("doc_id") % 2).cast("int").alias("label")),
    )
    return l.select("doc_id", F.inline(rows))


def review_queue(spark: SparkSession, directory: str) -> DataFrame:
    """Posts in the uncertainty band as queue rows."""
    p = posts(spark, directory).where(F.col("tox").between(0.3, 0.7))
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "done", "skipped")]), (F.col("post_id") % 3 + 1).cast("int"))
    return p.select("post_id", "created_at", "label", "tox", "severity", F.round(F.lit(1.0) - 2 * F.abs(F.col("tox") - 0.5), 4).alias("priority"), status.alias("status"))


def world_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORLD_EVENTS, "event_no int, day string, title string").withColumn("day", F.to_date("day"))


#: The same views in SQL, for the statement of each query's result.
SQL_VIEWS = {
    "posts": """posts AS (SELECT event_id AS post_id, user_id AS author_id, ts AS created_at, event_type AS target,
  CASE event_id % 3 WHEN 0 THEN 'ethnicity' WHEN 1 THEN 'religion' ELSE 'nationality' END AS category,
  least(1.0::DOUBLE, value / 100.0) AS tox, CAST(event_id % 5 AS INTEGER) AS severity,
  CASE WHEN least(1.0::DOUBLE, value / 100.0) >= 0.9 THEN 'violent_extremism' WHEN least(1.0::DOUBLE, value / 100.0) >= 0.6 THEN 'hate_speech'
       WHEN least(1.0::DOUBLE, value / 100.0) >= 0.3 THEN 'offensive' ELSE 'non_toxic' END AS label,
  CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_id % 3 = 0 AND event_id >= 7 THEN event_id - 7 END AS parent_id,
  CASE WHEN event_id % 3 = 1 AND event_id >= 11 THEN event_id - 11 END AS quoted_id,
  CASE WHEN event_id % 5 = 2 AND event_id >= 13 THEN event_id - 13 END AS retweeted_id,
  event_id % 17 = 0 AS deleted, 0.5::DOUBLE + abs(least(1.0::DOUBLE, value / 100.0) - 0.5::DOUBLE) AS confidence FROM events)""",
    "authors": """authors AS (SELECT user_id AS author_id, count(*) AS n_posts, min(ts) AS first_ts, max(ts) AS last_ts,
  'user' || CAST(user_id AS VARCHAR) AS username, CASE WHEN user_id % 10 <> 0 THEN (user_id * 37 % 100)::DOUBLE / 100.0 END AS bot_probability,
  user_id * 13 % 500 AS followers, user_id * 7 % 300 AS following, user_id % 6 = 0 AS verified, user_id % 4 = 0 AS default_avatar,
  CASE WHEN user_id % 2 = 0 THEN 'place' || CAST(user_id % 9 AS VARCHAR) END AS location FROM events GROUP BY user_id)""",
    "annotations": """annotations AS (SELECT doc_id, 'quality' AS rater, CAST(quality AS INTEGER) AS label FROM labels
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS INTEGER) FROM labels UNION ALL SELECT doc_id, 'third', CAST(doc_id % 2 AS INTEGER) FROM labels)""",
    "queue": """queue AS (SELECT post_id, created_at, label, tox, severity, round(1.0::DOUBLE - 2 * abs(tox - 0.5::DOUBLE), 4) AS priority,
  CASE post_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' ELSE 'skipped' END AS status FROM posts WHERE tox BETWEEN 0.3 AND 0.7)""",
    "world": """world AS (SELECT * FROM (VALUES (1, DATE '2024-01-06', 'summit'), (2, DATE '2024-01-12', 'election'), (3, DATE '2024-01-19', 'verdict'), (4, DATE '2024-01-25', 'derby')) AS w(event_no, dy, title))""",
}


def with_views(*names: str) -> str:
    """`WITH` and the named views, each after those it reads."""
    return "WITH " + ",\n".join(SQL_VIEWS[n] for n in names)
