"""Queries over the state of a moderation store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators import moderation as M
from murmuration.operators import trends
from murmuration.plans.registry import query
from murmuration.sources.tables import as_of, authors, posts, review_queue, with_views

P, PA, PQ = with_views("posts"), with_views("posts", "authors"), with_views("posts", "queue")

#: Stored hits of all posts, and new results of two of three posts, with other targets.
STATE = f"""{P}, old AS (SELECT post_id, category, target AS label, round(tox, 4) AS confidence FROM posts WHERE tox >= 0.3),
 new AS (SELECT post_id, category, 'group' || CAST(severity AS VARCHAR) AS label, round(tox / 2 + 1e-9::DOUBLE, 4) AS confidence FROM posts WHERE post_id % 3 <> 0 AND severity >= 1
 UNION ALL SELECT post_id, category, target, round(tox, 4) FROM posts WHERE post_id % 3 = 1)"""


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, hits, queue) after the new results."""
    p = posts(spark, d)
    stored = p.select("post_id", F.col("created_at").alias("at"), "label", F.col("tox").alias("toxicity"), "severity", F.lit(False).alias("needs_review"), F.array(F.concat_ws(":", "category", "target")).alias("target_labels"))
    hits = p.where("tox >= 0.3").select("post_id", "category", F.col("target").alias("label"), F.round("tox", 4).alias("confidence"))
    queued = p.where("post_id % 10 = 0").select("post_id", F.lit("done").alias("status"), F.lit(0.0).alias("priority"))
    group = F.when(F.col("severity") >= 1, F.struct("category", F.concat(F.lit("group"), F.col("severity").cast("string")).alias("label"), F.round(F.col("tox") / 2 + 1e-9, 4).alias("confidence")))
    own = F.when(F.col("post_id") % 3 == 1, F.struct("category", F.col("target").alias("label"), F.round("tox", 4).alias("confidence")))
    results = p.where("post_id % 3 <> 0").select(
        "post_id", as_of().alias("at"), F.lit("offensive").alias("label"), (F.col("tox") / 2).alias("toxicity"), "severity", F.col("tox").between(0.4, 0.6).alias("needs_review"),
        F.filter(F.array(group, own), lambda t: t.isNotNull()).alias("targets"),
    )
    return M.classification_upsert(stored, hits, queued, results)


@query(f"{STATE} SELECT post_id, category, label, confidence FROM old WHERE post_id % 3 = 0 UNION ALL SELECT post_id, category, label, max(confidence) FROM new GROUP BY post_id, category, label")
def hits_after_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)[1].select("post_id", "category", "label", "confidence")


@query(f"""{P} SELECT post_id, CASE WHEN post_id % 3 <> 0 THEN 'offensive' ELSE label END AS label, round(CASE WHEN post_id % 3 <> 0 THEN tox / 2 ELSE tox END + 1e-9::DOUBLE, 4) AS toxicity,
 CASE WHEN post_id % 3 = 0 THEN category || ':' || target ELSE concat_ws(';', CASE WHEN severity >= 1 THEN category || ':group' || CAST(severity AS VARCHAR) END, CASE WHEN post_id % 3 = 1 THEN category || ':' || target END) END AS targets FROM posts""")
def classifications_after_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)[0].select("post_id", "label", F.round(F.col("toxicity") + 1e-9, 4).alias("toxicity"), F.array_join("target_labels", ";").alias("targets"))


@query(f"{P} SELECT post_id, 'done' AS status, 0.0::DOUBLE AS priority FROM posts WHERE post_id % 10 = 0 UNION ALL SELECT post_id, 'pending', round(1 - 2 * abs(tox / 2 - 0.5::DOUBLE), 4) FROM posts WHERE post_id % 3 <> 0 AND tox BETWEEN 0.4 AND 0.6 AND post_id % 10 <> 0")
def queue_after_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)[2].select("post_id", "status", "priority")


@query(f"{PQ} SELECT post_id, CASE WHEN post_id % 4 = 1 THEN 'skipped' ELSE status END AS status, CASE WHEN post_id % 4 = 1 THEN 'reviewer' END AS reviewer, CASE WHEN post_id % 4 = 1 THEN '2024-01-31' END AS resolved FROM queue")
def queue_skip(spark: SparkSession, d: str) -> DataFrame:
    asked = posts(spark, d).where("post_id % 4 = 1").select("post_id", F.lit("reviewer").alias("reviewer"))
    return M.skip(review_queue(spark, d), asked, as_of()).select("post_id", "status", "reviewer", F.date_format("resolved_at", "yyyy-MM-dd").alias("resolved"))


@query(f"""{P}, t AS (SELECT post_id, list_filter([CASE WHEN tox >= 0.3 THEN category || ':' || target END, CASE WHEN tox >= 0.6 THEN category END], lambda x: x IS NOT NULL) AS targets FROM posts)
 SELECT post_id, len(targets) AS n_targets FROM t WHERE len(list_filter(targets, lambda x: x = 'religion' OR starts_with(x, 'religion:'))) > 0""")
def posts_about_target(spark: SparkSession, d: str) -> DataFrame:
    targets = F.filter(F.array(F.when(F.col("tox") >= 0.3, F.concat_ws(":", "category", "target")), F.when(F.col("tox") >= 0.6, F.col("category"))), lambda x: x.isNotNull())
    return posts(spark, d).select("post_id", targets.alias("t")).where(M.about(F.col("t"), "religion")).select("post_id", F.size("t").cast("long").alias("n_targets"))


@query(f"{PA} SELECT author_id, bot_probability FROM authors ORDER BY coalesce(bot_probability, 0) DESC, author_id LIMIT 200")
def account_ranking(spark: SparkSession, d: str) -> DataFrame:
    return M.account_ranking(authors(spark, d), 200, "bot_probability").select("author_id", "bot_probability")


@query(f"{P} SELECT category, string_agg(DISTINCT target, ',' ORDER BY target) AS labels FROM posts WHERE tox >= 0.3 GROUP BY category")
def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    hits = posts(spark, d).where("tox >= 0.3").select("category", F.col("target").alias("label"))
    return M.taxonomy(hits).select("category", F.array_join("labels", ",").alias("labels"))


@query(f"""{P}, daily AS (SELECT CAST(created_at AS DATE) AS dy, target, count(*) AS n, round(avg(tox), 4) AS mean_toxicity FROM posts WHERE tox >= 0.9 GROUP BY dy, target)
 SELECT strftime(dy, '%Y-%m-%d') AS on_day, target AS title, n, mean_toxicity FROM daily WHERE dy >= DATE '2024-01-31' - INTERVAL 20 DAY""")
def event_list(spark: SparkSession, d: str) -> DataFrame:
    """The events of the last 20 days, the newest first: outbursts of very toxic posts by day and target."""
    outbursts = posts(spark, d).where("tox >= 0.9").groupBy(F.to_date("created_at").alias("day"), F.col("target").alias("title")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("tox"), 4).alias("mean_toxicity"))
    return M.event_list(outbursts, "day", F.to_date(as_of()), 20).select(F.date_format("day", "yyyy-MM-dd").alias("on_day"), "title", "n", "mean_toxicity")


@query(f"{P} SELECT post_id, author_id, k AS likes, severity * 2 AS replies, label, CASE WHEN label IS NULL THEN NULL ELSE round(tox, 4) END AS toxicity FROM (SELECT post_id, author_id, k, severity, CASE WHEN post_id % 9 <> 0 THEN label END AS label, tox FROM posts) x")
def post_summary(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    made = M.summaries(p.withColumns({"likes": F.col("k"), "replies": F.col("severity") * 2}), p.where("post_id % 9 <> 0"))
    return made.select("post_id", "author_id", "engagement.likes", "engagement.replies", "classification.label", F.round("classification.tox", 4).alias("toxicity"))


@query(f"{P} SELECT post_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM posts WHERE NOT deleted ORDER BY created_at DESC, post_id LIMIT 100")
def posts_by_recency(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where(~F.col("deleted")).orderBy(F.desc("created_at"), "post_id").limit(100).select("post_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(f"{P}, hits AS (SELECT category, target, label, count(*) AS n FROM posts WHERE category = 'religion' GROUP BY category, target, label) SELECT target, label, n FROM hits ORDER BY n DESC, target, label LIMIT 30")
def heatmap_of_category(spark: SparkSession, d: str) -> DataFrame:
    cells = posts(spark, d).where("category = 'religion'").groupBy("target", "label").agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.desc("n"), "target", "label").limit(30)


@query(f"{P} SELECT severity, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER ()::DOUBLE, 2) AS percent FROM posts WHERE NOT deleted GROUP BY severity")
def severity_totals(spark: SparkSession, d: str) -> DataFrame:
    levels = posts(spark, d).where(~F.col("deleted")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    whole = levels.agg(F.sum("n").alias("all"))
    return levels.crossJoin(F.broadcast(whole)).select("severity", "n", F.round(100 * F.col("n") / F.col("all"), 2).alias("percent"))  # one row


@query(f"""{P}, s AS (SELECT date_trunc('hour', created_at) AS hr, count(*) AS n FROM posts GROUP BY hr), k AS (SELECT count(*) AS points FROM s)
 SELECT CASE WHEN points >= 400 THEN strftime(hr, '%Y-%m-%dT%H:%M:%S') ELSE strftime(hr, '%Y-%m-%d') END AS point, sum(n)::BIGINT AS n FROM s, k GROUP BY point""")
def series_points(spark: SparkSession, d: str) -> DataFrame:
    hourly = posts(spark, d).groupBy(F.date_trunc("hour", "created_at").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return trends.pointed(hourly, "at").groupBy("point").agg(F.sum("n").alias("n"))
