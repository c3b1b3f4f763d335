"""Text queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions import language as L
from murmuration.functions import text as X
from murmuration.operators import behaviour, similarity
from murmuration.plans.registry import query
from murmuration.sources.tables import spread, table

#: Posts made from documents, so that every cleaning rule has something to do.
DIRTY = """dirty AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'RT @user' || CAST(doc_id AS VARCHAR) || ': ' || text WHEN 1 THEN 'see https://ex.org/' || CAST(doc_id AS VARCHAR) || ' &amp; ' || text
 WHEN 2 THEN text || ' @name_' || CAST(doc_id AS VARCHAR) || ' sooooo' ELSE text || ' v3ry b4dword www.ex.net' END AS t FROM documents)"""


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    i, t = F.col("doc_id").cast("string"), F.col("text")
    by = F.col("doc_id") % 4
    made = F.when(by == 0, F.concat(F.lit("RT @user"), i, F.lit(": "), t)).when(by == 1, F.concat(F.lit("see https://ex.org/"), i, F.lit(" &amp; "), t))
    made = made.when(by == 2, F.concat(t, F.lit(" @name_"), i, F.lit(" sooooo"))).otherwise(F.concat(t, F.lit(" v3ry b4dword www.ex.net")))
    return table(spark, d, "documents").select("doc_id", made.alias("t"))


@query()
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    clean = L.normalise(F.col("t"))
    return spread(_dirty(spark, d)).select("doc_id", clean.alias("clean")).select("doc_id", F.char_length("clean").alias("n_chars"), F.sha2("clean", 256).alias("clean_sha256"))


@query(f"""WITH {DIRTY} SELECT doc_id, len(regexp_extract_all(t, 'https?://\\S+|www\\.\\S+')) AS n_urls, sha256(regexp_replace(t, 'https?://\\S+|www\\.\\S+', ' ', 'g')) AS rest_sha256 FROM dirty""")
def url_strip(spark: SparkSession, d: str) -> DataFrame:
    dirty = _dirty(spark, d)
    return dirty.select("doc_id", X.url_count(F.col("t")).cast("long").alias("n_urls"), F.sha2(X.strip_urls(F.col("t")), 256).alias("rest_sha256"))


@query(f"WITH {DIRTY} SELECT doc_id, sha256(regexp_replace(t, '(^|[^\\pL\\pN_@])@[\\pL\\pN_]{{1,15}}($|[^\\pL\\pN_])', '\\1@user\\2', 'g')) AS anonymous_sha256 FROM dirty")
def mention_anonymise(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).select("doc_id", F.sha2(X.anonymise_mentions(F.col("t")), 256).alias("anonymous_sha256"))


@query(f"WITH {DIRTY} SELECT doc_id, regexp_matches(t, '(?i)^\\s*rt\\s+@[\\pL\\pN_]+:?\\s*') AS is_retweet, sha256(regexp_replace(t, '(?i)^\\s*rt\\s+@[\\pL\\pN_]+:?\\s*', '')) AS rest_sha256 FROM dirty")
def rt_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).select("doc_id", X.is_retweet(F.col("t")).alias("is_retweet"), F.sha2(X.strip_rt(F.col("t")), 256).alias("rest_sha256"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\pL\\pN_''’]+|[^\\s\\pL\\pN_''’]'))::BIGINT AS n_tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"""WITH {DIRTY}, c AS (SELECT doc_id, string_split(t, '') AS c FROM dirty)
 SELECT doc_id, sha256(array_to_string(list_filter(c, lambda x, i: NOT (i > 2 AND x = c[i - 1] AND x = c[i - 2] AND regexp_full_match(x, '[\\pL\\pN_]'))), '')) AS collapsed_sha256 FROM c""")
def collapse_repeats(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).select("doc_id", F.sha2(X.collapse_repeats(F.col("t")), 256).alias("collapsed_sha256"))


LEET_FROM, LEET_TO = "".join(X.LEET), "".join(X.LEET.values())
#: Of each run of word characters and signs the token that begins at a word with a letter and a digit or sign, without signs at its end.
LEET_STEPS = f"""runs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\\pL\\pN_@$!|+€£]+')) AS r FROM dirty),
 toks AS (SELECT doc_id, regexp_replace(regexp_extract(r, '(?:^|[@$!|+€£])((?:[\\pL\\pN_]*[A-Za-z][\\pL\\pN_]*[@$!|+€£0-9]|[\\pL\\pN_]*[0-9][\\pL\\pN_]*[A-Za-z])[\\pL\\pN_@$!|+€£]*)', 1), '[@$!|+€£]+$', '') AS w FROM runs),
 decs AS (SELECT doc_id, w, translate(lower(w), '{LEET_FROM}', '{LEET_TO}') AS x, len(regexp_replace(w, '\\pL', '', 'g')) AS signs FROM toks WHERE len(w) >= 3),
 good AS (SELECT doc_id, w, x FROM decs WHERE regexp_full_match(x, '\\pL+') AND len(x) >= 4 AND regexp_matches(x, '[aeiouy]') AND signs >= 1 AND signs * 2 <= len(w)
 AND NOT regexp_full_match(w, '(?i)(?:[a-z]{{1,3}}\\p{{Nd}}{{2,}}|\\p{{Nd}}+[a-z]{{1,2}}|[\\pL\\pN_]*\\p{{Nd}}{{4,}}[\\pL\\pN_]*|[a-z]+\\p{{Nd}}{{1,2}})'))"""


@query(f"WITH {DIRTY}, {LEET_STEPS} SELECT d.doc_id, count(g.x) AS n_decoded, coalesce(max(g.x), '') AS last_word FROM dirty d LEFT JOIN good g ON g.doc_id = d.doc_id GROUP BY d.doc_id")
def leet_decode(spark: SparkSession, d: str) -> DataFrame:
    changed = F.filter(F.transform(X.leet_tokens(F.col("t")), lambda w: F.struct(w.alias("w"), X.leet_word(w).alias("x"))), lambda s: s["w"] != s["x"])
    return _dirty(spark, d).select("doc_id", changed.alias("c")).select("doc_id", F.size("c").cast("long").alias("n_decoded"), F.coalesce(F.array_max(F.transform("c", lambda s: s["x"])), F.lit("")).alias("last_word"))


@query()
def obfuscation_score(spark: SparkSession, d: str) -> DataFrame:
    """The score of all five signals, each counted on the text that the repair before it leaves."""
    return X.obfuscation(spread(_dirty(spark, d)), "t").select("doc_id", "score")


LETTERS = "len(regexp_replace(text, '[^\\pL]', '', 'g'))"
LATIN = "len(regexp_replace(regexp_replace(text, '[^\\pL]', '', 'g'), '[^A-Za-zªµºÀ-ÖØ-öø-ɏ]', '', 'g'))"


@query(f"SELECT doc_id, CASE WHEN {LETTERS} = 0 THEN 'unknown' WHEN {LATIN} * 2 >= {LETTERS} THEN 'latin' ELSE 'other' END AS script, {LATIN}::BIGINT AS n_latin FROM documents")
def script_detect(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "documents").select("doc_id", X.script_counts(F.col("text")).alias("c"))
    return counted.select("doc_id", X.main_script(F.col("c")).alias("script"), F.col("c.latin").cast("long").alias("n_latin"))


def _profile_sql() -> str:
    parts = []
    for lang, known in X.PROFILES.items():
        words = ", ".join(f"'{w}'" for w in known.split())
        bonus = f" + CASE WHEN regexp_matches(array_to_string(w, ' '), '{X.DIACRITICS[lang][0]}') THEN 0.1::DOUBLE ELSE 0 END" if lang in X.DIACRITICS else ""
        parts.append(f"round(len(list_filter(w, lambda x: x IN ({words}))) / greatest(len(w), 1)::DOUBLE{bonus}, 4) AS {lang}_score")
    return f"WITH p AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zà-ÿ0-9'']+') AS w FROM documents) SELECT doc_id, {', '.join(parts)} FROM p"


@query(_profile_sql())
def language_profile(spark: SparkSession, d: str) -> DataFrame:
    scored = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.profile_scores(F.col("text")).alias("s"))
    return scored.select("doc_id", *[F.round(F.col("s")[k], 4).alias(f"{k}_score") for k in X.PROFILES])


def _verdict_sql() -> str:
    names = list(X.SCRIPTS)
    counts = ", ".join(f"len(regexp_replace(l, '[^{block}]', '', 'g')) AS n_{k}" for k, block in X.SCRIPTS.items())
    most = f"greatest({', '.join(f'n_{k}' for k in names)}, n_other)"
    script = "CASE WHEN len(l) = 0 THEN 'unknown' " + " ".join(f"WHEN n_{k} = {most} THEN '{k}'" for k in names) + " ELSE 'other' END"
    mixed = " + ".join(f"(n_{k} / greatest(len(l), 1)::DOUBLE > 0.15)::INT" for k in [*names, "other"])
    known = {k: v.split() for k, v in (X.PROFILES | L.ROMANISED).items()}
    bonus = {k: f" + CASE WHEN regexp_matches(j, '{v[0]}') THEN {v[1]}::DOUBLE ELSE 0 END" for k, v in X.DIACRITICS.items()}
    bonus["fr"] = " + CASE WHEN regexp_matches(j, '[éèêàçùœ]') AND contains(text, chr(39)) THEN 0.05::DOUBLE ELSE 0 END"
    d = L.DIGITS
    bonus["ar-latn"] = f" + 0.15::DOUBLE * len(regexp_extract_all(a, '[a-zA-Z]{d}[a-zA-Z]|\\b{d}[a-zA-Z]{{2,}}|[a-zA-Z]{{2,}}{d}\\b')) / n"
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    scores = ", ".join(f"{{'minus': -(len(list_filter(w, lambda x: x IN ({listed(v)}))) / n{bonus.get(k, '')}), 'i': {i}, 'lang': '{k}'}}" for i, (k, v) in enumerate(known.items()))
    of = lambda k: f"-list_filter(r, lambda x: x.lang = '{k}')[1].minus"
    fixed = lambda at: " ".join(f"WHEN '{k}' THEN {v[at]!r}" for k, v in L.SCRIPT_VERDICT.items())
    return f"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '[^\\pL]', '', 'g') AS l, regexp_extract_all(lower(text), '[a-zà-ÿ0-9'']+') AS w, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\pL\\pN]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS a FROM documents),
 c AS (SELECT *, {counts} FROM t), o AS (SELECT *, len(l) - ({' + '.join(f'n_{k}' for k in names)}) AS n_other, array_to_string(w, ' ') AS j, greatest(len(w), 1)::DOUBLE AS n FROM c),
 s AS (SELECT doc_id, {script} AS script, {mixed} > 1 AS mixed, list_sort([{scores}]) AS r FROM o),
 v AS (SELECT *, -r[1].minus AS best, r[1].lang AS top, script NOT IN ({listed(L.SCRIPT_VERDICT)}) AS latin, contains(r[1].lang, '-') AND r[1].minus < 0 AS roman FROM s)
 SELECT doc_id, CASE script {fixed(0)} ELSE CASE WHEN best = 0 THEN 'en' ELSE string_split(top, '-')[1] END END AS language,
 round(CASE script {fixed(1)} ELSE CASE WHEN best = 0 THEN 0.3::DOUBLE ELSE least(0.99::DOUBLE, 0.5::DOUBLE + best + (best + r[2].minus)) END END::DOUBLE, 4) AS confidence, script, latin AND roman AS romanised,
 mixed OR (latin AND ((roman AND {of('en')} > 0.08) OR (top = 'en' AND ({of('hi-latn')} > 0.08 OR {of('ar-latn')} > 0.08)))) AS code_switched FROM v"""


@query(_verdict_sql())
def language_verdict(spark: SparkSession, d: str) -> DataFrame:
    verdict = L.detect(F.col("text"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", verdict.alias("v")).select("doc_id", F.col("v.lang").alias("language"), "v.confidence", "v.script", "v.romanised", "v.code_switched")


def _dialect_sql() -> str:
    cue = lambda words: "len(regexp_extract_all(' ' || regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_'']', ' ', 'g'), ' ', '  ', 'g') || ' ', ' (" + "|".join(w.replace("'", "''").replace(" ", "  ") for w in words) + ") '))"
    counts = ", ".join(f"{cue(v)} AS {k}" for k, v in X.CUES.items())
    cases = " ".join(f"WHEN {k} = most THEN '{k}'" for k in X.CUES)
    return f"""WITH c AS (SELECT doc_id, text, greatest(1, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))) AS n, {counts} FROM documents), m AS (SELECT *, greatest({', '.join(X.CUES)}) AS most FROM c)
 SELECT doc_id, CASE WHEN most = 0 OR most / n::DOUBLE < 0.08 THEN CASE WHEN regexp_matches(lower(text), '[a-z]') THEN 'sae' ELSE 'other' END {cases} END AS dialect FROM m"""


@query(_dialect_sql())
def dialect_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.dialect(F.col("text")).alias("dialect"))


SHINGLES = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] ELSE w END) AS s FROM w)"""


@query(f"WITH {SHINGLES} SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(X.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@query()
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    """(band, doc_id, candidate): the documents of each band that two or more share, with the band's earliest.

    Two documents are candidates if they share a band, so all pairs follow from these
    rows, one a band of a document at most.  Bands follow from the threshold of 0.8.
    """
    count, width = similarity.banding(0.8)
    keyed = similarity.bands(similarity.signatures(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", hashes=count * width), "doc_id", count, width)
    heads = keyed.groupBy("band").agg(F.min("doc_id").alias("candidate"), F.max("doc_id").alias("last")).where("candidate < last")
    return keyed.join(heads.select("band", "candidate"), "band").select("band", "doc_id", "candidate").distinct()


@query(f"""WITH {SHINGLES}, e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS sim FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
 SELECT b AS doc_id, arg_max(a, sim * 1e9 - a / 1e6) AS duplicate_of, round(max(sim), 4) AS similarity FROM p WHERE sim >= 0.8 GROUP BY b""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.duplicates_of(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "duplicate_of", F.round("similarity", 4).alias("similarity"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents QUALIFY doc_id > first_id")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(first, "h").where("doc_id > first_id").select("doc_id", "first_id")


@query("""WITH n AS (SELECT source, trim(regexp_replace(lower(text), '[^\\pL\\pN_]+', ' ', 'g'), ' ') AS t FROM documents)
 SELECT source, count(*) AS n, round(1 - count(DISTINCT t) / count(*)::DOUBLE, 4) AS repetitiveness FROM n GROUP BY source""")
def content_repetitiveness(spark: SparkSession, d: str) -> DataFrame:
    t = F.xxhash64(behaviour.normalised(F.col("text")))
    grouped = table(spark, d, "documents").select("source", t.alias("t")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("u"))
    return grouped.select("source", "n", F.round(1 - F.col("u") / F.col("n"), 4).alias("repetitiveness"))


@query("""WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, list_distinct(string_split(trim(regexp_replace(lower(text), '[^\\pL\\pN_]+', ' ', 'g'), ' '), ' ')) AS w FROM documents), f AS (SELECT * FROM r WHERE i <= 40)
 SELECT a.source, count(*) AS n_pairs, round(avg(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE), 4) AS mean_jaccard FROM f a JOIN f b ON a.source = b.source AND a.i < b.i GROUP BY a.source""")
def mean_pairwise_jaccard(spark: SparkSession, d: str) -> DataFrame:
    found = behaviour.pairwise_jaccard(table(spark, d, "documents"), "source", "text", "doc_id")
    return found.where("n_pairs > 0").select("source", "n_pairs", F.round("mean_jaccard", 4).alias("mean_jaccard"))


#: Placeholder terms of the fuzzy lexicon.
TERMS = ["reation", "ertionen", "thaner", "stntre", "ouenth", "edwhren", "ingthandis", "idiott"]
TERM_ROWS = ", ".join(f"('{t}')" for t in TERMS)


#: DuckDB measures bytes, so letters beyond ASCII get a sign of one byte each that no lower-case word holds.
ONE_BYTE = f"translate(word, '{''.join(map(chr, range(0xDF, 0x100)))}œ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ01234567')"


@query(f"""WITH ws AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\pL+')) AS word FROM documents), lex AS (SELECT * FROM (VALUES {TERM_ROWS}) AS v(term)),
 c AS (SELECT word, term, damerau_levenshtein({ONE_BYTE}, term) AS dist FROM ws JOIN lex ON (substr(word, 1, 1) = substr(term, 1, 1) OR substr(word, 2, 1) = substr(term, 1, 1)) WHERE len(word) >= 5 AND word NOT IN (SELECT term FROM lex))
 SELECT word, arg_min(term, CAST(dist AS VARCHAR) || term) AS term, CAST(min(dist) AS INTEGER) AS distance FROM c WHERE dist <= CASE WHEN len(word) < 8 THEN 1 ELSE 2 END GROUP BY word""")
def fuzzy_lexicon_join(spark: SparkSession, d: str) -> DataFrame:
    """The nearest terms of words of all letters; swapped letters are one edit, and what stands between them one a letter."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return similarity.fuzzy_hits(words, _terms(spark), edits=X.damerau).select("word", "term", "distance")


def _terms(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(t,) for t in TERMS], "term string"))  # eight rows


@query()
def fuzzy_repair(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents with misspelt lexicon terms put right."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = similarity.fuzzy_repair(docs, _terms(spark), "doc_id", "text")
    return found.select("doc_id", "n_hits", F.round("score", 4).alias("score"), F.sha2("repaired", 256).alias("repaired_sha256"))
