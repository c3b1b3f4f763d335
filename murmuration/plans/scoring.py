"""Scoring queries: the score inputs are fixed formulas of an event's numbers, so every branch occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions import scoring as S
from murmuration.plans.registry import query
from murmuration.sources.tables import posts, with_views

P = with_views("posts")
CATEGORIES = ["stereotype", "dehumanization", "harassment", "incitement", "offensive", "counterspeech"]

#: Category scores in steps of 0.01 from the post's numbers.
INPUTS = f"""{P}, x AS (SELECT post_id, author_id, created_at, target, severity, tox, lang, quoted_id IS NOT NULL AS is_quote, parent_id IS NOT NULL AS is_reply, parent_id,
 {", ".join(f"((post_id * {7 + 6 * i} + k * {3 + i}) % 101)::DOUBLE / 100 AS {c}" for i, c in enumerate(CATEGORIES))},
 post_id % 3 <> 0 AS has_target, post_id % 3 = 1 AS explicit_group, (k % 50)::DOUBLE / 100 AS obfuscation FROM posts)"""


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("post_id"), F.col("k")
    scores = [(((i * (7 + 6 * n) + k * (3 + n)) % 101) / 100.0).alias(c) for n, c in enumerate(CATEGORIES)]
    return posts(spark, d).select(
        "post_id", "author_id", "created_at", "target", "severity", "tox", "lang", F.col("quoted_id").isNotNull().alias("is_quote"), F.col("parent_id").isNotNull().alias("is_reply"), "parent_id",
        *scores, (i % 3 != 0).alias("has_target"), (i % 3 == 1).alias("explicit_group"), (k % 50 / 100.0).alias("obfuscation"),
    )


def _task_a() -> dict:
    return S.task_a(*[F.col(c) for c in CATEGORIES], F.col("has_target"), F.col("explicit_group"), F.col("obfuscation"))


TASK_A_STEPS = """h AS (SELECT *, greatest(harassment, dehumanization, 0.9::DOUBLE * stereotype) AS host FROM x),
 r AS (SELECT *, CASE WHEN explicit_group THEN host WHEN has_target THEN 0.75::DOUBLE * host ELSE 0.55::DOUBLE * host END * (1 - 0.75::DOUBLE * counterspeech) AS hate0,
 CASE WHEN explicit_group OR incitement >= 0.9 THEN incitement ELSE 0.6::DOUBLE * incitement END * (1 - 0.75::DOUBLE * counterspeech) AS ve0,
 CASE WHEN has_target THEN offensive ELSE greatest(offensive, 0.5::DOUBLE * host) END * (1 - 0.4::DOUBLE * counterspeech) AS off FROM h),
 b AS (SELECT *, CASE WHEN obfuscation > 0 AND (hate0 > 0.2 OR ve0 > 0.2) THEN least(1.0, hate0 * (1 + 0.15::DOUBLE * obfuscation)) ELSE hate0 END::DOUBLE AS hate,
 CASE WHEN obfuscation > 0 AND (hate0 > 0.2 OR ve0 > 0.2) THEN least(1.0, ve0 * (1 + 0.15::DOUBLE * obfuscation)) ELSE ve0 END::DOUBLE AS ve FROM r),
 m AS (SELECT *, 1 - greatest(ve, hate, off) AS m0, off * (1 - greatest(hate, ve)) AS m1, hate * (1 - 0.5::DOUBLE * ve) AS m2, ve AS m3 FROM b),
 a AS (SELECT *, m0 / (m0 + m1 + m2 + m3) AS non_toxic, m1 / (m0 + m1 + m2 + m3) AS offensive_p, m2 / (m0 + m1 + m2 + m3) AS hate_speech, m3 / (m0 + m1 + m2 + m3) AS violent_extremism FROM m)"""
TASK_A = f"{INPUTS}, {TASK_A_STEPS}"


@query(f"{TASK_A} SELECT post_id, round(non_toxic, 4) AS non_toxic, round(offensive_p, 4) AS offensive, round(hate_speech, 4) AS hate_speech, round(violent_extremism, 4) AS violent_extremism, round(1 - non_toxic, 4) AS toxicity_score FROM a")
def task_a_blend(spark: SparkSession, d: str) -> DataFrame:
    p = _task_a()
    return _inputs(spark, d).select("post_id", *[F.round(v, 4).alias(k) for k, v in p.items()], F.round(1 - p["non_toxic"], 4).alias("toxicity_score"))


@query(f"""{TASK_A} SELECT post_id, CASE WHEN non_toxic = greatest(non_toxic, offensive_p, hate_speech, violent_extremism) THEN 'non_toxic' WHEN offensive_p = greatest(non_toxic, offensive_p, hate_speech, violent_extremism) THEN 'offensive'
 WHEN hate_speech = greatest(non_toxic, offensive_p, hate_speech, violent_extremism) THEN 'hate_speech' ELSE 'violent_extremism' END AS label FROM a""")
def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    return _inputs(spark, d).select("post_id", S.argmax_label(_task_a()).alias("label"))


@query(f"{P} SELECT author_id, target, round(1 - product(1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, tox / 50))), 6) AS strength FROM posts GROUP BY author_id, target")
def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy("author_id", "target").agg(F.round(S.noisy_or_agg(F.col("tox") / 50), 6).alias("strength"))


SEVERITY_STEPS = """c AS (SELECT *, incitement * least(1.0, tox / 0.4) AS g4 FROM x), c3 AS (SELECT *, greatest(g4, harassment * least(1.0, tox / 0.4)) AS g3 FROM c), c2 AS (SELECT *, greatest(g3, dehumanization * least(1.0, tox / 0.4)) AS g2 FROM c3),
 c1 AS (SELECT *, greatest(g2, stereotype * least(1.0, tox / 0.4), CASE WHEN has_target THEN 0.5::DOUBLE * tox ELSE 0 END) AS g1 FROM c2)"""
LEVEL = "CASE WHEN g4 >= 0.5 THEN 4 WHEN g3 >= 0.5 THEN 3 WHEN g2 >= 0.5 THEN 2 WHEN g1 >= 0.5 THEN 1 ELSE 0 END"


@query(f"""{INPUTS}, {SEVERITY_STEPS}
 SELECT post_id, {LEVEL} AS level, round(((g1 - g2) + 2 * (g2 - g3) + 3 * (g3 - g4) + 4 * g4) / ((1 - g1) + (g1 - g2) + (g2 - g3) + (g3 - g4) + g4) + 1e-9::DOUBLE, 4) AS expected_level FROM c1""")
def severity_ordinal(spark: SparkSession, d: str) -> DataFrame:
    c = {n: F.col(n) for n in CATEGORIES}
    level, expected = S.severity(c["stereotype"], c["dehumanization"], c["harassment"], c["incitement"], F.col("tox"), F.col("has_target"))
    return _inputs(spark, d).select("post_id", level.alias("level"), F.round(expected + 1e-9, 4).alias("expected_level"))


#: Cue counts of a post, and its parent's score.
STANCE = f"""{INPUTS}, cue AS (SELECT x.*, x.post_id % 4 AS condemn, x.post_id % 3 AS deny, (x.post_id // 5) % 3 AS support, x.post_id % 7 = 0 AS query, x.post_id % 2 = 0 AS quoted, x.post_id % 11 = 0 AS sarcasm, x.post_id % 5 = 0 AS short, p.tox AS parent_tox
 FROM x LEFT JOIN posts p ON p.post_id = x.parent_id),
 s1 AS (SELECT *, least(1.0, 0.45::DOUBLE * condemn + 0.6::DOUBLE * counterspeech + CASE WHEN quoted THEN 0.15::DOUBLE ELSE 0 END) AS c0, least(1.0, 0.45::DOUBLE * deny + 0.2::DOUBLE * counterspeech)::DOUBLE AS s_deny,
 least(1.0, 0.4::DOUBLE * support) * CASE WHEN sarcasm THEN 0.3::DOUBLE ELSE 1 END AS p0, CASE WHEN query THEN 0.5::DOUBLE ELSE 0 END AS s_query FROM cue),
 s2 AS (SELECT *, CASE WHEN parent_tox >= 0.6 AND tox < 0.4 AND (condemn > 0 OR counterspeech > 0.3) THEN greatest(c0, 0.7) ELSE c0 END::DOUBLE AS s_condemn, CASE WHEN parent_tox >= 0.6 AND short AND support > 0 AND condemn = 0 THEN greatest(p0, 0.85) ELSE p0 END::DOUBLE AS s_support FROM s1),
 s3 AS (SELECT *, greatest(s_condemn, s_deny, s_support, s_query) AS best FROM s2),
 st AS (SELECT *, CASE WHEN best < 0.3 THEN 'neutral' WHEN s_condemn = best THEN 'condemn' WHEN s_deny = best THEN 'deny' WHEN s_support = best THEN 'support' ELSE 'query' END AS stance, CASE WHEN best < 0.3 THEN 1 - best ELSE best END AS conf FROM s3)"""


def _stances(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    x = _inputs(spark, d)
    parents = posts(spark, d).select(F.col("post_id").alias("parent_id"), F.col("tox").alias("parent_tox"))
    i = F.col("post_id")
    scores = S.stance_scores(i % 4, i % 3, F.floor(i / 5) % 3, i % 7 == 0, F.col("counterspeech"), i % 2 == 0, i % 11 == 0, i % 5 == 0, F.col("parent_tox"), F.col("tox"))
    return x.join(parents, "parent_id", "left"), scores


@query(f"{STANCE} SELECT post_id, round(s_condemn, 4) AS condemn, round(s_deny, 4) AS deny, round(s_support, 4) AS support, round(s_query, 4) AS query, stance, round(conf, 4) AS confidence FROM st")
def stance_scores(spark: SparkSession, d: str) -> DataFrame:
    joined, scores = _stances(spark, d)
    name, conf = S.stance(scores)
    return joined.select("post_id", *[F.round(v, 4).alias(k) for k, v in scores.items()], name.alias("stance"), F.round(conf, 4).alias("confidence"))


@query(f"""{STANCE} SELECT post_id, CASE WHEN stance IN ('condemn', 'deny') THEN 'criticism' WHEN stance = 'support' THEN 'amplification' ELSE 'neutral' END AS framing, round(CASE WHEN stance IN ('condemn', 'deny') THEN greatest(0.2, 1 - 0.8::DOUBLE
 * least(1.0, counterspeech + CASE WHEN is_quote OR is_reply THEN 0.5 ELSE 0 END + CASE WHEN quoted THEN 0.3 ELSE 0 END) * conf) ELSE 1 END::DOUBLE, 4) AS discount_factor FROM st""")
def counterspeech_discount(spark: SparkSession, d: str) -> DataFrame:
    joined, scores = _stances(spark, d)
    name, conf = S.stance(scores)
    factor = S.discount(name, conf, F.col("counterspeech"), F.col("is_quote") | F.col("is_reply"), F.col("post_id") % 2 == 0)
    return joined.select("post_id", S.framing(name).alias("framing"), F.round(factor, 4).alias("discount_factor"))


@query(f"""{INPUTS}, v AS (SELECT post_id, tox, CASE WHEN post_id % 4 <> 0 THEN greatest(offensive, incitement, 0.9::DOUBLE * CASE WHEN post_id % 9 = 1 THEN greatest(harassment, 0.7) ELSE harassment END)::DOUBLE END AS vis FROM x)
 SELECT post_id, round(vis, 4) AS visual_toxicity, round(CASE WHEN vis IS NULL THEN tox ELSE greatest(0.6::DOUBLE * tox + 0.4::DOUBLE * vis, CASE WHEN vis >= 0.8 THEN least(vis, 0.95) ELSE 0 END) END::DOUBLE, 4) AS ensemble FROM v""")
def visual_ensemble(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("post_id")
    shown = F.when(i % 4 != 0, S.visual_score(F.col("offensive"), F.col("incitement"), F.col("harassment"), i % 9 == 1))
    return _inputs(spark, d).select("post_id", F.round(shown, 4).alias("visual_toxicity"), F.round(S.visual_ensemble(F.col("tox"), shown), 4).alias("ensemble"))


@query(f"{P} SELECT post_id, round(tox, 4) BETWEEN 0.4 AND 0.6 OR (confidence BETWEEN 0.4 AND 0.6 AND round(tox, 4) >= 0.4) AS needs_review FROM posts")
def needs_review_flag(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", S.needs_review(S.final_score(F.col("tox"), F.lit(1.0)), F.col("confidence")).alias("needs_review"))


@query(f"{P} SELECT post_id, CASE WHEN severity >= 4 THEN 1.0 ELSE round(1 - 2 * abs(tox - 0.5::DOUBLE), 4) END::DOUBLE AS priority FROM posts")
def review_priority(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", S.review_priority(F.col("tox"), F.col("severity")).alias("priority"))


@query(f"""{P}, cand AS (SELECT post_id, 'uncertain' AS reason, round(1 - 2 * abs(tox - 0.5::DOUBLE), 4) AS priority FROM posts WHERE tox BETWEEN 0.4 AND 0.6 UNION ALL SELECT post_id, 'severe', 1.0 FROM posts WHERE severity >= 4),
 r AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY priority DESC, reason) AS rn FROM cand WHERE post_id % 10 <> 0) SELECT post_id, reason, priority::DOUBLE AS priority FROM r WHERE rn = 1""")
def enqueue_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    queued = p.where("post_id % 10 = 0").select("post_id")
    band = p.where("tox between 0.4 and 0.6").select("post_id", F.lit("uncertain").alias("reason"), F.round(1 - 2 * F.abs(F.col("tox") - 0.5), 4).alias("priority"))
    severe = p.where("severity >= 4").select("post_id", F.lit("severe").alias("reason"), F.lit(1.0).alias("priority"))
    from murmuration.operators.upsert import keep_latest

    return keep_latest(band.union(severe).join(queued, "post_id", "left_anti"), ["post_id"], F.desc("priority"), F.col("reason"))


@query(f"{P} SELECT post_id, lang, tox >= CASE lang WHEN 'en' THEN 0.7 WHEN 'fr' THEN 0.4 ELSE 0.5 END AS flagged FROM posts")
def calibrated_decision(spark: SparkSession, d: str) -> DataFrame:
    thresholds = F.broadcast(spark.createDataFrame([("en", 0.7), ("fr", 0.4)], "lang string, threshold double"))  # two rows
    return posts(spark, d).join(thresholds, "lang", "left").select("post_id", "lang", S.calibrated(F.col("tox"), F.col("threshold")).alias("flagged"))
