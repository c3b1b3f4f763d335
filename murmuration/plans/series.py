"""Time-series, behaviour and windowed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators import behaviour, trends
from murmuration.plans.registry import query
from murmuration.sources.tables import as_of, authors, posts, table, with_views, world_events

P = with_views("posts")
DAILY = f"""{P}, daily AS (SELECT CAST(created_at AS DATE) AS dy, count(*) AS total, count(*) FILTER (WHERE tox >= 0.5) AS toxic, round(coalesce(avg(severity) FILTER (WHERE tox >= 0.5), 0), 4) AS avg_severity
 FROM posts WHERE NOT deleted AND target = 'error' GROUP BY CAST(created_at AS DATE))"""
FILLED = f"""{DAILY}, ends AS (SELECT min(dy) AS a, greatest(max(dy), DATE '2024-02-02') AS b FROM daily),
 filled AS (SELECT CAST(g.dy AS DATE) AS dy, coalesce(d.total, 0) AS total, coalesce(d.toxic, 0) AS toxic, coalesce(d.avg_severity, 0) AS avg_severity
 FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS dy FROM ends) g LEFT JOIN daily d ON d.dy = CAST(g.dy AS DATE))"""
ROBUST = f"""{FILLED}, past AS (SELECT dy, toxic, list_sort(list(toxic::DOUBLE) OVER (ORDER BY dy ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) AS h FROM filled),
 mid AS (SELECT *, h[len(h) // 2 + 1] AS m FROM past), dev AS (SELECT *, list_sort([abs(x - m) FOR x IN h]) AS d FROM mid),
 scaled AS (SELECT *, d[len(d) // 2 + 1] AS mad, list_sum([x * x FOR x IN d]) AS sq FROM dev),
 scored AS (SELECT dy, toxic, CASE WHEN h IS NULL OR len(h) < 3 THEN 0.0::DOUBLE ELSE (toxic - m) / CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad WHEN sq > 0 THEN sqrt(sq / len(h)) ELSE 1.0 END END AS z FROM scaled)"""
DAY = "strftime(dy, '%Y-%m-%d') AS on_day"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    live = posts(spark, d).where(~F.col("deleted") & (F.col("target") == "error"))
    toxic = F.col("tox") >= 0.5
    return live.groupBy(F.to_date("created_at").alias("at")).agg(F.count(F.lit(1)).alias("total"), F.count_if(toxic).alias("toxic"), F.round(F.coalesce(F.avg(F.when(toxic, F.col("severity"))), F.lit(0.0)), 4).alias("avg_severity"))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return trends.gap_filled(_daily(spark, d), "at", ["total", "toxic", "avg_severity"], F.lit("2024-02-02").cast("date"))


def _day():
    return F.date_format("at", "yyyy-MM-dd").alias("on_day")


@query(f"{DAILY} SELECT {DAY}, total, toxic, avg_severity FROM daily")
def daily_toxic_series(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d).select(_day(), "total", "toxic", "avg_severity")


@query(f"{FILLED} SELECT {DAY}, total, toxic, avg_severity::DOUBLE AS avg_severity FROM filled")
def gap_filled_series(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select(_day(), "total", "toxic", F.col("avg_severity").cast("double").alias("avg_severity"))


@query(f"{P} SELECT strftime(date_trunc('week', created_at) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end, count(*) AS total, count(*) FILTER (WHERE tox >= 0.5) AS toxic FROM posts WHERE NOT deleted GROUP BY week_end")
def weekly_series(spark: SparkSession, d: str) -> DataFrame:
    week_end = F.date_format(F.date_add(F.date_trunc("week", "created_at").cast("date"), 6), "yyyy-MM-dd")
    return posts(spark, d).where(~F.col("deleted")).groupBy(week_end.alias("week_end")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("tox") >= 0.5).alias("toxic"))


@query(f"{ROBUST} SELECT {DAY}, toxic, round(z, 3) AS z FROM scored")
def robust_zscore(spark: SparkSession, d: str) -> DataFrame:
    return trends.robust_z(_filled(spark, d), "at", "toxic").select(_day(), "toxic", F.round("z", 3).alias("z"))


@query(f"""{FILLED}, w AS (SELECT dy, toxic, count(toxic) OVER f AS n, avg(toxic) OVER f AS m, stddev_pop(toxic) OVER f AS s FROM filled WINDOW f AS (ORDER BY dy ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
 SELECT {DAY}, toxic, round(CASE WHEN n < 3 THEN 0.0 ELSE (toxic - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END END, 3)::DOUBLE AS z FROM w""")
def rolling_zscore(spark: SparkSession, d: str) -> DataFrame:
    return trends.rolling_z(_filled(spark, d), "at", "toxic").select(_day(), "toxic", F.round("z", 3).alias("z"))


@query(f"{ROBUST} SELECT {DAY}, toxic, round(z, 3) AS z, z >= 1.5 AND toxic >= 3 AS is_spike FROM scored")
def spike_detection(spark: SparkSession, d: str) -> DataFrame:
    scored = trends.robust_z(_filled(spark, d), "at", "toxic")
    return trends.spikes(scored, "toxic", least_z=1.5).select(_day(), "toxic", F.round("z", 3).alias("z"), "is_spike")


@query(f"""{DAILY}, final AS (SELECT total FROM daily ORDER BY dy DESC LIMIT 7), lvl AS (SELECT avg(total) AS m, stddev_pop(total) AS s FROM final)
 SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS step, round(m, 3) AS forecast, round(greatest(0, m - 1.28::DOUBLE * s), 3) AS low, round(m + 1.28::DOUBLE * s, 3) AS high FROM lvl""")
def naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return trends.naive_forecast(_daily(spark, d), "at", "total", 14)


@query()
def holt_winters_forecast(spark: SparkSession, d: str) -> DataFrame:
    counted = posts(spark, d).where(~F.col("deleted")).groupBy("target", F.to_date("created_at").alias("at")).agg(F.count(F.lit(1)).alias("total"))
    filled = trends.gap_filled(counted, "at", ["total"], F.lit("2024-01-30").cast("date"), ["target"])
    return trends.holt_winters(filled, "at", "total", ["target"], 14, search=200)


@query(
    DAILY.replace(P, with_views("posts", "world"))
    + """ SELECT event_no, title, round(coalesce(avg(total) FILTER (WHERE d.dy < w.dy), 0), 2) AS before, round(coalesce(avg(total) FILTER (WHERE d.dy >= w.dy), 0), 2) AS after,
 round(CASE WHEN coalesce(avg(total) FILTER (WHERE d.dy < w.dy), 0) > 0 THEN (coalesce(avg(total) FILTER (WHERE d.dy >= w.dy), 0) - avg(total) FILTER (WHERE d.dy < w.dy)) / avg(total) FILTER (WHERE d.dy < w.dy)
 ELSE coalesce(avg(total) FILTER (WHERE d.dy >= w.dy), 0) END, 3) AS lift FROM world w LEFT JOIN daily d ON d.dy >= w.dy - 3 AND d.dy < w.dy + 3 GROUP BY event_no, title"""
)
def event_impact(spark: SparkSession, d: str) -> DataFrame:
    events = world_events(spark).withColumnRenamed("day", "at")
    series = _daily(spark, d).withColumnRenamed("at", "day")
    return trends.event_lift(series, "day", "total", events).select("event_no", "title", "before", "after", "lift")


GAPS = f"""{P}, g AS (SELECT author_id, created_at, (epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY author_id ORDER BY created_at, post_id))) / 1e6::DOUBLE AS gap_s FROM posts),
 t AS (SELECT author_id, count(*) AS n, avg(gap_s) AS m, stddev_pop(gap_s) AS s, avg(CASE WHEN hour(created_at) BETWEEN 1 AND 4 THEN 1.0::DOUBLE ELSE 0 END) AS night, sum(gap_s) / 86400 AS span FROM g GROUP BY author_id),
 f AS (SELECT author_id, n, m, s, night, CASE WHEN n > 2 THEN greatest(0, 1 - least(CASE WHEN m > 0 THEN s / m ELSE 0 END, 1.5) / 1.5) ELSE 0 END::DOUBLE AS regularity,
 CASE WHEN n > 2 AND s + m > 0 THEN ((s - m) / (s + m) + 1) / 2 ELSE 0.5 END::DOUBLE AS burstiness, CASE WHEN n > 1 THEN n / greatest(1.0, span) ELSE n END::DOUBLE AS per_day FROM t)"""


@query(f"{GAPS} SELECT author_id, n, round(m, 3) AS mean_gap, round(s, 3) AS sd_gap FROM f")
def interarrival_stats(spark: SparkSession, d: str) -> DataFrame:
    t = behaviour.timing(posts(spark, d))
    return t.select("author_id", "n", F.round("mean_gap", 3).alias("mean_gap"), F.round("sd_gap", 3).alias("sd_gap"))


@query(f"{GAPS} SELECT author_id, n, round(regularity, 3) AS timing_regularity, round(burstiness, 3) AS burstiness, round(night, 3) AS night_activity_ratio, round(per_day, 3) AS posts_per_day FROM f")
def bot_features(spark: SparkSession, d: str) -> DataFrame:
    t = behaviour.timing(posts(spark, d))
    return t.select("author_id", "n", F.round("regularity", 3).alias("timing_regularity"), F.round("burstiness", 3).alias("burstiness"), F.round("night_share", 3).alias("night_activity_ratio"), F.round("posts_per_day", 3).alias("posts_per_day"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM o)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, no""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    grouped = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.date_format(F.col("w")["start"], "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS on_hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY on_hour, event_type")
def tumbling_hour(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.date_format(F.col("w")["start"], "yyyy-MM-dd HH:00").alias("on_hour"), "event_type", "n", "total")


def _account_rows(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).where(~F.col("deleted")).select("author_id", "post_id", "created_at", "tox", "severity", F.array("target").alias("targets"))


ACCOUNT = f"""{P}, aged AS (SELECT author_id, tox, severity, target, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(created_at)) / 86400e6::DOUBLE AS age FROM posts WHERE NOT deleted),
 w AS (SELECT *, pow(0.5::DOUBLE, age / 90) AS w FROM aged),
 c AS (SELECT author_id, count(*) AS n_posts, sum(w * severity) / sum(w) / 4 AS sev, sum(CASE WHEN tox >= 0.5 THEN w ELSE 0 END) / sum(w) AS ratio,
 least(1.0, count(DISTINCT target) FILTER (WHERE tox >= 0.5) / 6.0::DOUBLE)::DOUBLE AS div, coalesce(count(*) FILTER (WHERE tox >= 0.5 AND age <= 30) / nullif(count(*) FILTER (WHERE tox >= 0.5), 0)::DOUBLE, 0) AS rec FROM w GROUP BY author_id),
 s AS (SELECT *, 0.4::DOUBLE * sev + 0.3::DOUBLE * ratio + 0.2::DOUBLE * div + 0.1::DOUBLE * rec AS score FROM c)"""


@query(f"{ACCOUNT} SELECT author_id, n_posts, round(score, 4) AS score, round(sev * 4, 3) AS avg_severity, round(ratio, 4) AS toxic_ratio, round(div, 4) AS target_diversity, round(rec, 4) AS recency_weight, n_posts >= 50 AS reliable FROM s")
def account_score(spark: SparkSession, d: str) -> DataFrame:
    s = behaviour.account_scores(_account_rows(spark, d), as_of())
    return s.select(
        "author_id", "n_posts", F.round("score", 4).alias("score"), F.round(F.col("avg_severity") * 4, 3).alias("avg_severity"), F.round("toxic_ratio", 4).alias("toxic_ratio"),
        F.round("target_diversity", 4).alias("target_diversity"), F.round("recency", 4).alias("recency_weight"), (F.col("n_posts") >= 50).alias("reliable"),
    )


@query(f"""{ACCOUNT} SELECT author_id, n_posts, CASE WHEN n_posts < 50 THEN 'insufficient sample (< 50 posts)' WHEN 2 * 1.96::DOUBLE * sqrt(ratio * (1 - ratio) / n_posts) < 0.1 THEN 'high confidence'
 WHEN 2 * 1.96::DOUBLE * sqrt(ratio * (1 - ratio) / n_posts) < 0.2 THEN 'moderate confidence' ELSE 'low confidence' END AS confidence FROM s""")
def account_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = behaviour.account_scores(_account_rows(spark, d), as_of())
    half = 1.96 * F.sqrt(F.col("toxic_ratio") * (1 - F.col("toxic_ratio")) / F.col("n_posts"))
    return s.select("author_id", "n_posts", behaviour.confidence_label(F.col("n_posts"), F.col("toxic_ratio") - half, F.col("toxic_ratio") + half).alias("confidence"))


@query()
def account_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return behaviour.poisson_bootstrap(_account_rows(spark, d), as_of())


FEATURES = f"""{GAPS.replace(P, with_views("posts", "authors"))}, said AS (SELECT author_id, post_id, target || ' ' || category || ' ' || CAST(k % 40 AS VARCHAR) || ' ' || CAST(severity AS VARCHAR) AS t FROM posts),
 kinds AS (SELECT author_id, count(*) AS n, count(DISTINCT t) AS u FROM said GROUP BY author_id), firsts AS (SELECT author_id, row_number() OVER (PARTITION BY author_id ORDER BY post_id) AS i, list_distinct(string_split(t, ' ')) AS w FROM said QUALIFY i <= 40),
 alike AS (SELECT a.author_id, avg(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE) AS j FROM firsts a JOIN firsts b ON a.author_id = b.author_id AND a.i < b.i GROUP BY a.author_id),
 rep AS (SELECT k.author_id, CASE WHEN n > 1 THEN greatest(1 - u / n::DOUBLE, coalesce(j, 0)) ELSE 0 END::DOUBLE AS r FROM kinds k LEFT JOIN alike j ON j.author_id = k.author_id),
 sh AS (SELECT author_id, avg(CASE WHEN retweeted_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS rt, avg(CASE WHEN parent_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS re FROM posts GROUP BY author_id), x AS (SELECT a.author_id, greatest(1.0, 400 + a.author_id % 900)::DOUBLE AS age, greatest(f.per_day, (a.author_id * 211 % 5000) / greatest(1.0, 400 + a.author_id % 900)::DOUBLE) AS per_day, rep.r AS rep, sh.rt AS rt, sh.re AS re, (followers + 1) / (following + 1)::DOUBLE AS ff,
 (CAST(location IS NOT NULL AS INTEGER) + 1 + CAST(NOT default_avatar AS INTEGER) + CAST(verified AS INTEGER)) / 5.0::DOUBLE AS prof, f.regularity AS reg,
 len(regexp_replace(username, '[^0-9]', '', 'g')) / len(username)::DOUBLE AS digits, CASE WHEN default_avatar THEN 1.0::DOUBLE ELSE 0 END AS ava, f.night AS night, f.burstiness AS burst FROM authors a JOIN f ON f.author_id = a.author_id JOIN rep ON rep.author_id = a.author_id JOIN sh ON sh.author_id = a.author_id),
 terms AS (SELECT author_id, -1.4::DOUBLE * least(1.0, ln(1 + age) / ln(3651)) AS t_age, 1.6::DOUBLE * least(1.0, ln(1 + per_day) / ln(201)) AS t_day, -1.0::DOUBLE * least(1.0, ln(1 + ff) / ln(101)) AS t_ff, -1.3::DOUBLE * prof AS t_prof,
 2.2::DOUBLE * reg AS t_reg, 1.2::DOUBLE * least(1.0, 2 * digits) AS t_dig, 0.9::DOUBLE * ava AS t_ava, 0.6::DOUBLE * night AS t_night, 0.8::DOUBLE * burst AS t_burst, 2.4::DOUBLE * rep AS t_rep, 1.1::DOUBLE * rt AS t_rt, -0.3::DOUBLE * re AS t_re FROM x)"""


def bot_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Authors with their timing, and the bot model's features over those columns."""
    p = posts(spark, d)
    texts = p.select("author_id", "post_id", F.concat_ws(" ", "target", "category", (F.col("k") % 40).cast("string"), F.col("severity").cast("string")).alias("text"))
    joined = authors(spark, d).join(behaviour.timing(p).drop("n"), "author_id").join(behaviour.repetition(texts), "author_id").join(behaviour.post_shares(p), "author_id")
    age = F.greatest(F.lit(1.0), (400 + F.col("author_id") % 900).cast("double"))
    profile = F.col("location").isNotNull().cast("int") + 1 + (~F.col("default_avatar")).cast("int") + F.col("verified").cast("int")
    features = {
        "account_age_days": age,
        "posts_per_day": behaviour.rate(F.col("posts_per_day"), F.col("author_id") * 211 % 5000, age),
        "follower_following_ratio": (F.col("followers") + 1) / (F.col("following") + 1),
        "profile_completeness": profile / 5.0,
        "timing_regularity": F.col("regularity"),
        "content_repetitiveness": F.col("repetitiveness"),
        "retweet_ratio": F.col("retweet_share"),
        "reply_ratio": F.col("reply_share"),
        "username_digit_ratio": F.regexp_count("username", F.lit("[0-9]")) / F.length("username"),
        "default_avatar": F.col("default_avatar").cast("double"),
        "night_activity_ratio": F.col("night_share"),
        "burstiness": F.col("burstiness"),
    }
    return joined, features


@query(f"{FEATURES} SELECT author_id, round(1 / (1 + exp(-(-2.4::DOUBLE + t_age + t_day + t_ff + t_prof + t_reg + t_dig + t_ava + t_night + t_burst + t_rep + t_rt + t_re))), 4) AS bot_probability FROM terms")
def bot_logistic(spark: SparkSession, d: str) -> DataFrame:
    joined, features = bot_inputs(spark, d)
    return joined.select("author_id", F.round(behaviour.bot_probability(features), 4).alias("bot_probability"))


@query(f"""{FEATURES}, sig AS (SELECT author_id, unnest([{{'v': -t_age - 1.4::DOUBLE, 'k': 'account_age_days'}}, {{'v': t_day, 'k': 'posts_per_day'}}, {{'v': -t_ff - 1.0::DOUBLE, 'k': 'follower_following_ratio'}}, {{'v': -t_prof - 1.3::DOUBLE, 'k': 'profile_completeness'}},
 {{'v': t_reg, 'k': 'timing_regularity'}}, {{'v': t_dig, 'k': 'username_digit_ratio'}}, {{'v': t_ava, 'k': 'default_avatar'}}, {{'v': t_night, 'k': 'night_activity_ratio'}}, {{'v': t_burst, 'k': 'burstiness'}}, {{'v': t_rep, 'k': 'content_repetitiveness'}}, {{'v': t_rt, 'k': 'retweet_ratio'}}, {{'v': t_re, 'k': 'reply_ratio'}}]) AS s FROM terms),
 r AS (SELECT author_id, s.k AS k, row_number() OVER (PARTITION BY author_id ORDER BY round(s.v, 9) DESC, s.k) AS rn FROM sig WHERE round(s.v, 9) > 0.15)
 SELECT t.author_id, coalesce(string_agg(k, ',' ORDER BY rn), '') AS signals FROM terms t LEFT JOIN r ON r.author_id = t.author_id AND rn <= 3 GROUP BY t.author_id""")
def bot_top_signals(spark: SparkSession, d: str) -> DataFrame:
    joined, features = bot_inputs(spark, d)
    return joined.select("author_id", F.array_join(behaviour.top_signals(features), ",").alias("signals"))
