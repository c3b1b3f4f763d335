"""Overview, heatmap, browsing, queue and export queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmuration.operators import upsert
from murmuration.plans.registry import query
from murmuration.sources import exports
from murmuration.sources.tables import annotations, as_of, authors, posts, review_queue, table, with_views

P, PA, PQ = with_views("posts"), with_views("posts", "authors"), with_views("posts", "queue")


def _n() -> Column:
    return F.count(F.lit(1))


def _live(spark: SparkSession, d: str, days: int = 30) -> DataFrame:
    return posts(spark, d).where(~F.col("deleted") & (F.col("created_at") >= as_of() - F.expr(f"INTERVAL {days} DAYS")))


LIVE = "NOT deleted AND created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY"


def _kpis() -> list[Column]:
    toxic = F.col("tox") >= 0.5
    return [
        _n().alias("n_posts"),
        F.count_if(toxic).alias("n_toxic"),
        F.round(F.coalesce(F.try_divide(F.count_if(toxic), _n()), F.lit(0.0)), 4).alias("toxic_ratio"),
        F.round(F.avg(F.when(toxic, F.col("severity"))), 3).alias("avg_severity"),
        F.count_if(F.col("tox").between(0.4, 0.6)).alias("n_review"),
    ]


KPIS = """count(*) AS n_posts, count(*) FILTER (WHERE tox >= 0.5) AS n_toxic,
 round(coalesce(count(*) FILTER (WHERE tox >= 0.5) / nullif(count(*), 0)::DOUBLE, 0), 4) AS toxic_ratio,
 round(avg(severity) FILTER (WHERE tox >= 0.5), 3) AS avg_severity, count(*) FILTER (WHERE tox BETWEEN 0.4 AND 0.6) AS n_review"""


@query(f"{P} SELECT {KPIS} FROM posts WHERE {LIVE}")
def overview_kpis(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).agg(*_kpis())


@query(f"{P} SELECT label, severity, count(*) AS n FROM posts WHERE {LIVE} GROUP BY label, severity")
def counts_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).groupBy("label", "severity").agg(_n().alias("n"))


@query(f"{P} SELECT lang, count(*) AS n FROM posts WHERE {LIVE} GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
def top_languages(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).groupBy("lang").agg(_n().alias("n")).orderBy(F.desc("n"), "lang").limit(10)


@query(f"{P} SELECT count(DISTINCT author_id) AS n_authors FROM posts WHERE created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY")
def distinct_authors(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where(F.col("created_at") >= as_of() - F.expr("INTERVAL 30 DAYS")).agg(F.countDistinct("author_id").alias("n_authors"))


def _cells() -> list[Column]:
    return [
        _n().alias("n"),
        F.round(F.avg("tox"), 4).alias("avg_toxicity"),
        F.round(F.avg("severity"), 3).alias("avg_severity"),
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in range(5)],
        *[F.round(100.0 * F.count_if(F.col("severity") == s) / _n(), 2).alias(f"mix_{s}") for s in range(1, 5)],
    ]


CELLS = "count(*) AS n, round(avg(tox), 4) AS avg_toxicity, round(avg(severity), 3) AS avg_severity, " + ", ".join([f"count(*) FILTER (WHERE severity = {s}) AS severity_{s}" for s in range(5)] + [f"round(100.0::DOUBLE * count(*) FILTER (WHERE severity = {s}) / count(*), 2) AS mix_{s}" for s in range(1, 5)])


@query(f"{P} SELECT category, target, {CELLS} FROM posts WHERE {LIVE} AND tox >= 0.3 GROUP BY category, target")
def target_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).where("tox >= 0.3").groupBy("category", "target").agg(*_cells())


@query(f"{P} SELECT coalesce(category, 'all') AS category, coalesce(target, 'all') AS target, {CELLS} FROM posts WHERE {LIVE} AND tox >= 0.3 GROUP BY ROLLUP (category, target)")
def heatmap_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled = _live(spark, d).where("tox >= 0.3").rollup("category", "target").agg(*_cells())
    return rolled.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("category", "target")})


@query(
    f"{P}, levels AS (SELECT unnest(range(5))::INTEGER AS severity) SELECT l.severity, "
    + ", ".join(f"count(*) FILTER (WHERE label = '{x}') AS {x}" for x in ("non_toxic", "offensive", "hate_speech", "violent_extremism"))
    + f" FROM levels l LEFT JOIN (SELECT * FROM posts WHERE {LIVE}) p ON p.severity = l.severity GROUP BY l.severity"
)
def severity_label_matrix(spark: SparkSession, d: str) -> DataFrame:
    names = ["non_toxic", "offensive", "hate_speech", "violent_extremism"]
    counted = _live(spark, d).groupBy("severity").pivot("label", names).agg(_n())
    levels = spark.range(5).select(F.col("id").cast("int").alias("severity"))
    return levels.join(counted, "severity", "left").select("severity", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in names])


@query(f"{P} SELECT target, round(avg(severity), 3) AS avg_severity, count(*) AS n FROM posts WHERE tox >= 0.5 GROUP BY target HAVING count(*) >= 3 ORDER BY avg_severity DESC, target LIMIT 15")
def avg_severity_having(spark: SparkSession, d: str) -> DataFrame:
    grouped = posts(spark, d).where("tox >= 0.5").groupBy("target").agg(F.round(F.avg("severity"), 3).alias("avg_severity"), _n().alias("n"))
    return grouped.where("n >= 3").orderBy(F.desc("avg_severity"), "target").limit(15)


@query(f"""{PA} SELECT CASE WHEN bot_probability >= 0.8 THEN 'bot' ELSE 'human' END AS kind, count(*) AS n_posts, count(*) FILTER (WHERE tox >= 0.5) AS n_toxic,
 round(count(*) FILTER (WHERE tox >= 0.5) / count(*)::DOUBLE, 4) AS toxic_ratio, count(DISTINCT p.author_id) FILTER (WHERE bot_probability IS NOT NULL) AS n_scored
 FROM posts p JOIN authors a ON a.author_id = p.author_id GROUP BY kind""")
def bot_human_breakdown(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("bot_probability") >= 0.8, "bot").otherwise("human")
    joined = posts(spark, d).select("author_id", "tox").join(authors(spark, d).select("author_id", "bot_probability"), "author_id")
    toxic = F.count_if(F.col("tox") >= 0.5)
    return joined.groupBy(kind.alias("kind")).agg(
        _n().alias("n_posts"), toxic.alias("n_toxic"), F.round(toxic / _n(), 4).alias("toxic_ratio"), F.countDistinct(F.when(F.col("bot_probability").isNotNull(), F.col("author_id"))).alias("n_scored")
    )


@query(f"{PA} SELECT b.bin AS bin, count(a.author_id) AS n FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN authors a ON a.bot_probability IS NOT NULL AND least(9, floor(a.bot_probability * 10)) = b.bin GROUP BY b.bin")
def bot_histogram(spark: SparkSession, d: str) -> DataFrame:
    binned = authors(spark, d).where("bot_probability is not null").groupBy(F.least(F.lit(9), F.floor(F.col("bot_probability") * 10)).cast("long").alias("bin")).agg(_n().alias("n"))
    return spark.range(10).select(F.col("id").alias("bin")).join(binned, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{PQ} SELECT status, count(*) AS n, round(avg(CASE WHEN label = 'offensive' THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS agreement_rate, count(*) FILTER (WHERE severity >= 4) AS n_severe FROM queue GROUP BY status")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    q = review_queue(spark, d)
    return q.groupBy("status").agg(_n().alias("n"), F.round(F.avg((F.col("label") == "offensive").cast("double")), 4).alias("agreement_rate"), F.count_if(F.col("severity") >= 4).alias("n_severe"))


@query(f"{PA} SELECT {KPIS} FROM posts p JOIN authors a ON a.author_id = p.author_id WHERE {LIVE} AND (bot_probability IS NULL OR bot_probability < 0.8)")
def exclude_bots_overview(spark: SparkSession, d: str) -> DataFrame:
    people = authors(spark, d).where("bot_probability is null or bot_probability < 0.8").select("author_id")
    return _live(spark, d).join(people, "author_id", "left_semi").agg(*_kpis())


@query(f"""{PA} SELECT post_id, username, target, round(tox, 4) AS tox, severity, lang FROM posts p JOIN authors a ON a.author_id = p.author_id
 WHERE NOT deleted AND label = 'hate_speech' AND tox >= 0.6 AND tox <= 0.85 AND severity >= 2 AND lang = 'en' AND target ILIKE '%i%'""")
def post_browser(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d).where(~F.col("deleted") & (F.col("label") == "hate_speech") & F.col("tox").between(0.6, 0.85) & (F.col("severity") >= 2) & (F.col("lang") == "en") & F.col("target").ilike("%i%"))
    return p.join(authors(spark, d).select("author_id", "username"), "author_id").select("post_id", "username", "target", F.round("tox", 4).alias("tox"), "severity", "lang")


@query(f"{P} SELECT post_id, round(tox, 4) AS tox, severity FROM posts WHERE {LIVE} ORDER BY posts.tox DESC, created_at DESC, post_id LIMIT 100")
def posts_by_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return _live(spark, d).orderBy(F.desc("tox"), F.desc("created_at"), "post_id").limit(100).select("post_id", F.round("tox", 4).alias("tox"), "severity")


@query(f"{P} SELECT post_id, severity, (SELECT count(*) FROM posts WHERE {LIVE}) AS total, CAST(ceil((SELECT count(*) FROM posts WHERE {LIVE}) / 50.0) AS BIGINT) AS n_pages FROM posts WHERE {LIVE} ORDER BY severity DESC, tox DESC, post_id LIMIT 50 OFFSET 100")
def page_offset_limit(spark: SparkSession, d: str) -> DataFrame:
    live = _live(spark, d)
    total = live.agg(_n().alias("total"))
    page = live.orderBy(F.desc("severity"), F.desc("tox"), "post_id").offset(100).limit(50).select("post_id", "severity")
    return page.crossJoin(F.broadcast(total)).withColumn("n_pages", F.ceil(F.col("total") / 50.0))  # one row


@query(f"""{P}, best AS (SELECT target FROM posts WHERE tox >= 0.5 GROUP BY target ORDER BY count(*) DESC, target LIMIT 3)
 SELECT target, strftime(created_at, '%Y-%m-%d') AS on_day, count(*) AS n, count(*) FILTER (WHERE tox >= 0.5) AS n_toxic FROM posts WHERE {LIVE} AND target IN (SELECT target FROM best) GROUP BY target, on_day""")
def topn_target_series(spark: SparkSession, d: str) -> DataFrame:
    best = posts(spark, d).where("tox >= 0.5").groupBy("target").agg(_n().alias("n")).orderBy(F.desc("n"), "target").limit(3).select("target")
    kept = _live(spark, d).join(F.broadcast(best), "target", "left_semi")  # three rows
    return kept.groupBy("target", F.date_format("created_at", "yyyy-MM-dd").alias("on_day")).agg(_n().alias("n"), F.count_if(F.col("tox") >= 0.5).alias("n_toxic"))


@query(f"{PA} SELECT author_id, username, bot_probability FROM authors WHERE bot_probability IS NOT NULL ORDER BY bot_probability DESC, author_id LIMIT 20")
def top_bots(spark: SparkSession, d: str) -> DataFrame:
    return authors(spark, d).where("bot_probability is not null").orderBy(F.desc("bot_probability"), "author_id").limit(20).select("author_id", "username", "bot_probability")


@query(f"{PQ} SELECT post_id, priority, label FROM queue WHERE status = 'pending' ORDER BY priority DESC, created_at, post_id LIMIT 25")
def review_queue_next(spark: SparkSession, d: str) -> DataFrame:
    return review_queue(spark, d).where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "post_id").limit(25).select("post_id", "priority", "label")


@query(f"{P} SELECT author_id, post_id, rn FROM (SELECT author_id, post_id, row_number() OVER (PARTITION BY author_id ORDER BY created_at DESC, post_id DESC) AS rn FROM posts) x WHERE rn <= 20")
def recent_posts_per_author(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("created_at"), F.desc("post_id")))
    return posts(spark, d).select("author_id", "post_id", rank.cast("long").alias("rn")).where("rn <= 20")


@query(f"{P} SELECT post_id, author_id FROM posts WHERE author_id IN (SELECT author_id FROM posts WHERE target = 'error' AND tox >= 0.9)")
def semi_join_target(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    return p.select("post_id", "author_id").join(p.where("target = 'error' and tox >= 0.9").select("author_id"), "author_id", "left_semi").select("post_id", "author_id")


@query(f"{PA} SELECT author_id, username FROM authors a WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.author_id = a.author_id AND p.created_at >= TIMESTAMP '2024-01-30 00:00:00' AND p.tox >= 0.5)")
def anti_join_stale(spark: SparkSession, d: str) -> DataFrame:
    recent = posts(spark, d).where("created_at >= timestamp_ntz '2024-01-30 00:00:00' and tox >= 0.5").select("author_id")
    return authors(spark, d).join(recent, "author_id", "left_anti").select("author_id", "username")


@query(f"""{P} SELECT c.post_id, coalesce(c.parent_id, c.quoted_id, c.retweeted_id) AS ref_id, p.author_id AS ref_author, round(p.tox, 4) AS ref_tox
 FROM posts c LEFT JOIN posts p ON p.post_id = coalesce(c.parent_id, c.quoted_id, c.retweeted_id)""")
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    refs = p.select("post_id", F.coalesce("parent_id", "quoted_id", "retweeted_id").alias("ref_id"))
    return refs.join(p.select(F.col("post_id").alias("ref_id"), F.col("author_id").alias("ref_author"), F.round("tox", 4).alias("ref_tox")), "ref_id", "left").select("post_id", "ref_id", "ref_author", "ref_tox")


@query(f"""{P}, ranked AS (SELECT p.post_id AS root_id, c.post_id AS child_id, row_number() OVER (PARTITION BY p.post_id ORDER BY c.created_at, c.post_id) AS rn
 FROM posts p JOIN posts c ON c.parent_id = p.post_id OR c.quoted_id = p.post_id) SELECT root_id, child_id, rn FROM ranked WHERE rn <= 50""")
def thread_children(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    links = [p.select(F.col(c).alias("root_id"), F.col("post_id").alias("child_id"), "created_at").where("root_id is not null") for c in ("parent_id", "quoted_id")]
    both = links[0].union(links[1]).dropDuplicates(["root_id", "child_id"])
    known = both.join(p.select(F.col("post_id").alias("root_id")), "root_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("root_id").orderBy("created_at", "child_id"))
    return known.select("root_id", "child_id", rank.cast("long").alias("rn")).where("rn <= 50")


@query(with_views("posts", "annotations") + " SELECT a.doc_id, a.rater, a.label, p.label AS model_label, d.lang AS doc_lang FROM annotations a JOIN documents d ON d.doc_id = a.doc_id JOIN posts p ON p.post_id = a.doc_id")
def annotation_three_way(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("doc_lang"))
    model = posts(spark, d).select(F.col("post_id").alias("doc_id"), F.col("label").alias("model_label"))
    return annotations(spark, d).join(docs, "doc_id").join(model, "doc_id").select("doc_id", "rater", "label", "model_label", "doc_lang")


HITS = """hits AS (SELECT post_id, category, target AS label, tox, created_at FROM posts WHERE tox >= 0.3
 UNION ALL SELECT post_id, category, 'group' || CAST(severity AS VARCHAR), tox, created_at FROM posts WHERE tox >= 0.6)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Each post's target list as rows; a strong post has two targets of one category."""
    labels = F.filter(F.array(F.when(F.col("tox") >= 0.3, F.col("target")), F.when(F.col("tox") >= 0.6, F.concat(F.lit("group"), F.col("severity").cast("string")))), lambda x: x.isNotNull())
    return posts(spark, d).select("post_id", "category", "tox", "created_at", F.explode(labels).alias("label"))


@query(f"{P}, {HITS} SELECT strftime(created_at, '%Y-%m-%d') AS on_day, count(*) AS n FROM hits WHERE category = 'religion' GROUP BY on_day")
def target_series_fanout(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).where("category = 'religion'").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("on_day")).agg(_n().alias("n"))


@query(f"{P}, {HITS} SELECT post_id, category, label, round(tox, 4) AS confidence FROM hits")
def target_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("post_id", "category", "label", F.round("tox", 4).alias("confidence"))


@query(f"{P} SELECT post_id FROM posts WHERE tox BETWEEN 0.4 AND 0.6 UNION SELECT post_id FROM posts WHERE severity >= 4")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    return p.where("tox between 0.4 and 0.6").select("post_id").union(p.where("severity >= 4").select("post_id")).distinct()


@query(f"{P} SELECT DISTINCT quoted_id AS missing_id FROM posts WHERE quoted_id IS NOT NULL AND quoted_id NOT IN (SELECT post_id FROM posts WHERE NOT deleted)")
def missing_parents(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    wanted = p.where("quoted_id is not null").select(F.col("quoted_id").alias("missing_id")).distinct()
    return wanted.join(p.where(~F.col("deleted")).select(F.col("post_id").alias("missing_id")), "missing_id", "left_anti")


@query(with_views("annotations") + " SELECT doc_id FROM annotations WHERE rater = 'quality' AND label = 1 INTERSECT SELECT doc_id FROM annotations WHERE rater = 'third' AND label = 1")
def shared_items(spark: SparkSession, d: str) -> DataFrame:
    a = annotations(spark, d).where("label = 1")
    return a.where("rater = 'quality'").select("doc_id").intersect(a.where("rater = 'third'").select("doc_id"))


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE doc_id % 11 = 3)
 SELECT d.doc_id, CASE WHEN g.doc_id IS NOT NULL THEN '[deleted upstream]' ELSE d.text END AS text, g.doc_id IS NOT NULL AS deleted FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id""")
def soft_delete_apply(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("deleted", F.lit(False))
    removed = table(spark, d, "documents").where("doc_id % 11 = 3").select("doc_id")
    return upsert.soft_delete(docs, removed, "doc_id", "text").select("doc_id", "text", "deleted")


@query(f"""{PA} SELECT a.author_id, CASE WHEN r.author_id IS NULL THEN NULL ELSE a.username END AS username, CASE WHEN r.author_id IS NULL THEN NULL ELSE a.location END AS location,
 r.author_id IS NULL AND (a.username IS NOT NULL OR a.location IS NOT NULL) AS cleared
 FROM authors a LEFT JOIN (SELECT DISTINCT author_id FROM posts WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00') r ON r.author_id = a.author_id""")
def retention_anonymise(spark: SparkSession, d: str) -> DataFrame:
    recent = posts(spark, d).where("created_at >= timestamp_ntz '2024-01-30 00:00:00'").select("author_id", F.lit(True).alias("active")).distinct()
    a = authors(spark, d).select("author_id", "username", "location").join(recent, "author_id", "left")
    keep = lambda c: F.when(F.col("active"), F.col(c)).alias(c)
    return a.select("author_id", keep("username"), keep("location"), (F.col("active").isNull() & (F.col("username").isNotNull() | F.col("location").isNotNull())).alias("cleared"))


@query(f"""{PA} SELECT post_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created, p.author_id, username, lang, label, round(tox, 4) AS toxicity, severity, confidence >= 0.9 AS confident,
 CASE WHEN tox >= 0.6 THEN category || ':' || target || ';' || category || ':group' || CAST(severity AS VARCHAR) WHEN tox >= 0.3 THEN category || ':' || target ELSE '' END AS targets,
 coalesce(CAST(parent_id AS VARCHAR), '') AS parent, coalesce(CAST(quoted_id AS VARCHAR), '') AS quoted
 FROM posts p JOIN authors a ON a.author_id = p.author_id WHERE {LIVE}""")
def export_posts(spark: SparkSession, d: str) -> DataFrame:
    targets = F.concat_ws(";", F.when(F.col("tox") >= 0.3, F.concat_ws(":", "category", "target")), F.when(F.col("tox") >= 0.6, F.concat("category", F.lit(":group"), F.col("severity").cast("string"))))
    joined = _live(spark, d).join(authors(spark, d).select("author_id", "username"), "author_id")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return joined.select(
        "post_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), "author_id", "username", "lang", "label", F.round("tox", 4).alias("toxicity"), "severity",
        (F.col("confidence") >= 0.9).alias("confident"), targets.alias("targets"), text("parent_id").alias("parent"), text("quoted_id").alias("quoted"),
    )


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type, k")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type", parsed.alias("k")).agg(_n().alias("n"))


@query("""WITH p AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN substr(props, 1, len(props) - 1) ELSE props END AS payload FROM events), v AS MATERIALIZED (SELECT event_type, json_valid(payload) AS ok, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS j FROM p)
 SELECT event_type, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS n_malformed, CAST(sum(TRY_CAST(json_extract_string(j, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (WHERE json_exists(j, '$.none')) AS n_none FROM v GROUP BY event_type""")
def payload_paths(spark: SparkSession, d: str) -> DataFrame:
    """Payloads as VARIANT values read by path; some are cut short, and counted as malformed."""
    text = F.when(F.col("event_id") % 11 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    held = exports.parsed(table(spark, d, "events").select("event_type", text.alias("payload")))
    k = exports.payload_at(F.col("payload"), "$.k", "bigint")
    none = exports.payload_at(F.col("payload"), "$.none", "string")
    return held.groupBy("event_type").agg(_n().alias("n"), F.count("malformed").alias("n_malformed"), F.sum(k).alias("k"), F.count(none).alias("n_none"))
