"""Fairness and agreement queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators import evaluation as E
from murmuration.operators.graph import saved
from murmuration.plans.classification import SCORED, scored_labels
from murmuration.plans.registry import query
from murmuration.sources.tables import annotations, table, with_views

def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores are saved: what follows reads them more than once, and texts should be matched once."""
    return saved(scored_labels(spark, d))


METRICS = """lang, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label <> 1) AS n_negative,
 round(coalesce(count(*) FILTER (WHERE label <> 1 AND score >= 0.5) / nullif(count(*) FILTER (WHERE label <> 1), 0)::DOUBLE, 0), 4) AS fpr,
 round(coalesce(count(*) FILTER (WHERE label = 1 AND score < 0.5) / nullif(count(*) FILTER (WHERE label = 1), 0)::DOUBLE, 0), 4) AS fnr,
 round(coalesce(count(*) FILTER (WHERE label = 1 AND score >= 0.5) / nullif(count(*) FILTER (WHERE label = 1), 0)::DOUBLE, 0), 4) AS tpr,
 round(coalesce(count(*) FILTER (WHERE label = 1 AND score >= 0.5) / nullif(count(*) FILTER (WHERE score >= 0.5), 0)::DOUBLE, 0), 4) AS precision,
 round(coalesce(avg(score) FILTER (WHERE label <> 1), 0), 4) AS mean_score_negative"""


@query(f"WITH {SCORED} SELECT {METRICS} FROM scored GROUP BY lang")
def fairness_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.group_metrics(_scored(spark, d), "lang")


@query(f"""WITH {SCORED}, by_lang AS (SELECT {METRICS} FROM scored GROUP BY lang) SELECT round(coalesce(max(fpr) FILTER (WHERE n_negative >= 5) - min(fpr) FILTER (WHERE n_negative >= 5), 0), 4) AS fpr_gap,
 round(coalesce(max(fnr) FILTER (WHERE n_positive >= 5) - min(fnr) FILTER (WHERE n_positive >= 5), 0), 4) AS fnr_gap, count(*) AS n_groups FROM by_lang""")
def fairness_gap(spark: SparkSession, d: str) -> DataFrame:
    return E.gaps(E.group_metrics(_scored(spark, d), "lang"))


@query(f"""WITH {SCORED}, neg AS (SELECT * FROM scored WHERE label <> 1), base AS (SELECT lang, count(*) AS n, avg(CASE WHEN score >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS fpr FROM neg GROUP BY lang),
 goal AS (SELECT coalesce(min(fpr) FILTER (WHERE n >= 5), 0.05::DOUBLE) AS goal FROM base), steps AS (SELECT unnest(range(51, 96)) AS t),
 ok AS (SELECT b.lang, min(s.t) FILTER (WHERE (SELECT count(*) FROM neg x WHERE x.lang = b.lang AND x.score >= s.t / 100.0::DOUBLE) / b.n::DOUBLE <= goal + 1e-9) AS t FROM base b, steps s, goal GROUP BY b.lang)
 SELECT b.lang, CASE WHEN b.n < 5 OR b.fpr <= goal + 1e-9 THEN 0.5 WHEN ok.t IS NULL THEN 0.95 ELSE ok.t / 100.0 END::DOUBLE AS threshold FROM base b JOIN ok ON ok.lang = b.lang, goal""")
def calibrate_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return E.calibrate(_scored(spark, d), "lang")


@query(f"""{with_views("annotations")}, {SCORED}, vote AS (SELECT doc_id, CAST(max(label) AS INTEGER) AS label FROM annotations WHERE rater <> 'quality' GROUP BY doc_id), j AS (SELECT s.lang, v.label, s.score FROM vote v JOIN scored s ON s.doc_id = v.doc_id)
 SELECT {METRICS} FROM j GROUP BY lang""")
def weekly_audit(spark: SparkSession, d: str) -> DataFrame:
    votes = annotations(spark, d).where("rater <> 'quality'").groupBy("doc_id").agg(F.max("label").alias("label"))
    return E.group_metrics(votes.join(_scored(spark, d).select("doc_id", "lang", "score"), "doc_id"), "lang")


PAIRS = f"""{with_views("annotations")}, p AS (SELECT a.rater AS rater_a, b.rater AS rater_b, a.label AS x, b.label AS y FROM annotations a JOIN annotations b ON a.doc_id = b.doc_id AND a.rater < b.rater),
 c AS (SELECT rater_a, rater_b, count(*) AS n, avg(CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0 END) AS po, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe FROM p GROUP BY rater_a, rater_b)"""


@query(f"{PAIRS} SELECT n, CASE WHEN pe >= 1 THEN 1.0 ELSE round((po - pe) / (1 - pe), 4) END::DOUBLE AS kappa FROM c WHERE rater_a = 'quality' AND rater_b = 'toxic'")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "labels").select(F.col("quality").cast("int").alias("a"), F.col("toxic").cast("int").alias("b"))
    return E.cohen_kappa(pairs, [])


@query(f"""{PAIRS}, k AS (SELECT rater_a, rater_b, n, CASE WHEN pe >= 1 THEN 1.0 ELSE round((po - pe) / (1 - pe), 4) END::DOUBLE AS kappa FROM c WHERE n >= 5)
 SELECT *, CASE WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS reading FROM k""")
def pairwise_kappa(spark: SparkSession, d: str) -> DataFrame:
    return E.pairwise(annotations(spark, d), "doc_id", "rater", "label").withColumn("reading", E.interpretation(F.col("kappa")))


@query(f"""{with_views("annotations")}, i AS (SELECT doc_id, sum(label) AS ones, count(*) AS m FROM annotations GROUP BY doc_id HAVING count(*) >= 2), p AS (SELECT count(*) AS n_items, max(m) AS n_raters, avg((ones * ones + (m - ones) * (m - ones) - m) / (m * (m - 1))::DOUBLE) AS p, sum(ones) / sum(m)::DOUBLE AS q FROM i)
 SELECT n_items, n_raters, round((p - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 4) AS kappa FROM p""")
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    return E.fleiss_kappa(annotations(spark, d), "doc_id", "rater", "label")


@query(f"""{with_views("annotations")}, c AS (SELECT doc_id, label, count(*) AS votes FROM annotations GROUP BY doc_id, label), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, label) AS rn FROM c)
 SELECT doc_id, label, votes, 3::BIGINT AS n FROM r WHERE rn = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return E.majority(annotations(spark, d), "doc_id", "label")
