"""Queries from whole texts to rule matches, labels, severity, targets and attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators import classify as C
from murmuration.plans.registry import query
from murmuration.plans.scoring import CATEGORIES, LEVEL, SEVERITY_STEPS, TASK_A_STEPS
from murmuration.sources.tables import spread, table

#: Group terms and slurs of these queries: made-up words of the documents stand for them.
TERMS = [
    C.Term("ouea", "ethnicity", "labela"), C.Term("thingon", "religion", "labelb"), C.Term("stin", "nationality", "labelc"), C.Term("therat", "ethnicity", "labeld"),
    C.Term("erheou", "ethnicity", "labela", 0.8), C.Term("thhaed", "religion", "labelb", 0.6, True), C.Term("anbleat", "nationality", "labelc", 0.4),
]


def lexicon() -> C.Lexicon:
    return C.Lexicon(C.bank(), TERMS)


def classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(C.matches(spread(table(spark, d, "documents").select("doc_id", "text")), lexicon()))


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, label, score): labelled documents and the toxicity that the rules give their whole texts."""
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("truth"))
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text").join(labels, "doc_id"))
    return C.backend("rules", lexicon())(docs).select("doc_id", "lang", F.col("truth").alias("label"), F.col("toxicity").alias("score"))


def _sql() -> str:
    """Every word of `t` stands between two spaces of its own; a rule's matches are counted, and so are the terms'."""
    group = "(?:" + lexicon().alternation() + ")"
    said = lambda p: p.replace("{G}", group).replace("~", "  ").replace("\\w+", "[\\pL\\pN]+")
    factors = {c: "1" for c in CATEGORIES}
    hostile, targeted = [], []
    for r in C.bank():
        n = f"len(regexp_extract_all(t, ' (?:{said(r.pattern)}) '))"
        factors[r.category] += f" * pow({1 - r.weight}::DOUBLE, {n})"
        hostile += [n] if r.category != "counterspeech" else []
        targeted += [n] if r.targeted else []
    held = lambda term: f"len(list_filter(g, lambda x: x = '{term}'))"
    slurs = [x for x in TERMS if x.slur]
    weight = lambda x: f"(CASE WHEN hostile > 0 THEN {x.weight} ELSE {x.weight} * 0.25 END)::DOUBLE" if x.ambiguous else f"{x.weight}::DOUBLE"
    slur_factor = " * ".join(f"pow(1 - {weight(x)}, {held(x.term)})" for x in slurs)
    named = " + ".join(held(x.term) for x in TERMS if not x.slur)
    strong = " + ".join(f"(CASE WHEN {weight(x)} >= 0.5 THEN {held(x.term)} ELSE 0 END)" for x in slurs)
    confidence = {}
    for x in TERMS:
        sure = f"least(0.99::DOUBLE, 0.5::DOUBLE + 0.5 * {weight(x)})" if x.slur else "least(0.97::DOUBLE, 0.45::DOUBLE + 0.5 * tox)"
        confidence.setdefault((x.category, x.label), []).append((x.term, f"pow(1 - {sure}, {held(x.term)})"))
    hits = " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS category, '{label}' AS label, round((1 - {' * '.join(v for _, v in parts)}) * (1 - 0.5::DOUBLE * counterspeech), 4) AS confidence FROM y WHERE tox >= 0.3 AND {' + '.join(held(t) for t, _ in parts)} > 0" for (c, label), parts in confidence.items()
    )
    scores = ", ".join(f"1 - {v}{' * ' + slur_factor if c == 'harassment' else ''} AS {c}" for c, v in factors.items())
    return f"""WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\\pL\\pN]+', '  ', 'g') || ' ' AS t FROM documents), e AS (SELECT *, regexp_extract_all(t, ' ({lexicon().alternation()}) ', 1) AS g, {' + '.join(hostile)} AS hostile, {' + '.join(targeted)} AS targeted FROM d),
 x AS (SELECT doc_id, g, hostile, {scores}, ({named}) > 0 OR len(g) > 0 OR targeted > 0 AS has_target, ({named}) > 0 OR ({strong}) > 0 AS explicit_group, 0.0::DOUBLE AS obfuscation FROM e), {TASK_A_STEPS},
 y AS (SELECT *, round(1 - non_toxic, 4) AS tox, CASE WHEN non_toxic = greatest(non_toxic, offensive_p, hate_speech, violent_extremism) THEN 'non_toxic' WHEN offensive_p = greatest(non_toxic, offensive_p, hate_speech, violent_extremism) THEN 'offensive'
 WHEN hate_speech = greatest(non_toxic, offensive_p, hate_speech, violent_extremism) THEN 'hate_speech' ELSE 'violent_extremism' END AS label FROM a),
 {SEVERITY_STEPS.replace("FROM x)", "FROM y)")}, hit AS ({hits})"""


#: The rows of :func:`scored_labels`, after the steps of the classification.
SCORED = f"{_sql().removeprefix('WITH ')}, scored AS (SELECT o.doc_id, o.lang, CAST(l.toxic AS INTEGER) AS label, y.tox AS score FROM documents o JOIN labels l ON l.doc_id = o.doc_id JOIN y ON y.doc_id = o.doc_id)"


@query(f"{_sql()} SELECT doc_id, {', '.join(f'round({c} + 1e-9::DOUBLE, 4) AS {c}' for c in CATEGORIES)}, label, tox AS toxicity, {LEVEL} AS severity FROM c1")
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("doc_id", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in CATEGORIES], "label", "toxicity", "severity")


@query(f"{_sql()} SELECT doc_id, category, label, confidence FROM hit WHERE confidence >= 0.3")
def document_targets(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("doc_id", F.explode("targets").alias("x")).select("doc_id", "x.category", "x.label", "x.confidence")


@query()
def token_attributions(spark: SparkSession, d: str) -> DataFrame:
    """The tokens that speak for or against each text, with their places; texts without any have no rows."""
    rows = C.attributions(classified(spark, d)).select("doc_id", F.explode(F.filter("attributions", lambda x: x["weight"] != 0)).alias("x"))
    return rows.select("doc_id", "x.token", "x.start", "x.end", "x.weight")
