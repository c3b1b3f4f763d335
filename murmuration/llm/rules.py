"""Quality rules under weak supervision, in DataFrame functions only.

Each rule looks at counts of one whole text and votes good (1), bad (-1) or
abstains (0).  Expectation-maximisation on the table of vote patterns estimates
how reliable each vote of each rule is, without labels; the posterior probability
of good quality decides, instead of a demand that all rules pass.

Counting needs no shuffle: a text's words, lines and three-word windows stay in
its row.  The patterns are pre-aggregated in the tasks; at most 3**rules of them
exist, whatever the input, and each EM step returns one row of sums.

Defined cases: a null text counts as empty; an empty text has zero counts and
fails the base rules; repeated rows are judged each; a table without rows gives
none; columns other than the given ones are not read, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.scratch import Scratch

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

# The most common function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with be by this at or from",
    "fr": "de la le les et des en un une du que qui dans pour par sur au pas est avec",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es",
    "es": "de la que el en y los del se las por un para con no una su al es lo",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the list."""

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["v"] == x["v"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        widths = lambda at: F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return let(let(ranked, twice), lambda at: F.aggregate(widths(at), F.lit(0), lambda a, x: a + x))

    windows = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The counts that the rules look at, one row for each document."""
    source = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    words = F.array_remove(F.split(t, SPACES + "+"), "")

    def of_words(w: Column) -> Column:
        known = F.array_distinct(F.flatten(F.array(*[F.lit(x.split()) for x in FUNCTION_WORDS.values()])))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), F.size(F.array_intersect(w, known)).alias("n_function_words"), F.size(F.array_distinct(w)).alias("n_distinct"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return source.select(
        key,
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        (F.char_length(t) - F.regexp_count(t, F.lit(SPACES))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"[!?]{2}")).alias("n_shouts"),
        F.regexp_count(t, F.lit(r"\p{Lu}{2}")).alias("n_upper_pairs"),
        F.regexp_count(t, F.lit(r"[.!?]" + SPACES)).alias("n_sentence_ends"),
    ).select(key, "w.*", "l.*", "word_chars", "n_symbols", "n_shouts", "n_upper_pairs", "n_sentence_ends")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote, over the columns of `counts`."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "length": _vote(F.col("n_words") < 20, F.col("n_words").between(100, 100_000)),
        "word_length": _vote((F.col("word_chars") / n < 2.5) | (F.col("word_chars") / n > 11), (F.col("word_chars") / n).between(3, 9)),
        "symbols": _vote(F.col("n_symbols") / n > 0.1, F.col("n_symbols") / n < 0.02),
        "repetition": _vote(F.col("n_repeat_words") / n > 0.3, F.col("n_repeat_words") / n < 0.15),
        "dup_lines": _vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3)),
        "shouting": _vote((F.col("n_shouts") / n > 0.1) | (F.col("n_upper_pairs") / n > 0.3), (F.col("n_shouts") / n < 0.02) & (F.col("n_upper_pairs") / n < 0.1)),
        "function_words": _vote((F.col("n_function_words") <= 2) & (F.col("n_words") >= 50), F.col("n_function_words") >= 6),
        "variety": _vote((F.col("n_distinct") / n < 0.2) & (F.col("n_words") < 1000), F.col("n_distinct") / n > 0.35),
        "sentences": _vote((F.col("n_sentence_ends") / n < 0.005) & (F.col("n_words") >= 100), (F.col("n_sentence_ends") / n).between(0.02, 0.4)),
    }


def estimate(patterns: DataFrame, names: list[str], steps: int = 25, tolerance: float = 1e-6) -> tuple[float, dict[tuple[str, int], float]]:
    """Log odds of good quality, and the log likelihood ratio of each (rule, vote).

    patterns: a column -1, 0 or 1 for each rule, and n.  The first posterior is
    high for patterns without a bad vote and low for others; counts are smoothed
    towards rules that are right more often than not, and no vote may speak
    against its own meaning, which also says which class is the good one.
    """
    p = F.when(sum((F.when(F.col(r) == -1, 1).otherwise(0) for r in names), F.lit(0)) == 0, 0.95).otherwise(0.2)
    before: dict[tuple[str, int], float] = {}
    odds, ratio = 0.0, before
    for _ in range(steps):
        row = patterns.withColumn("p", p).agg(
            F.sum(F.col("n") * F.col("p")).alias("good"),
            F.sum("n").alias("all"),
            *[F.sum(F.when(F.col(r) == v, F.col("n") * F.col("p"))).alias(f"g_{r}_{v}") for r in names for v in (-1, 1)],
            *[F.sum(F.when(F.col(r) == v, F.col("n"))).alias(f"n_{r}_{v}") for r in names for v in (-1, 1)],
        )
        s = {k: float(v or 0) for k, v in row.first().asDict().items()}
        good, bad = s["good"] + 1, s["all"] - s["good"] + 1
        odds = math.log(good / bad)
        ratio = {}
        for r in names:
            for v in (-1, 1):
                g, b = s[f"g_{r}_{v}"], s[f"n_{r}_{v}"] - s[f"g_{r}_{v}"]
                mine, other = (0.6, 0.4) if v == 1 else (0.4, 0.6)
                value = math.log((g + mine) / (good + 1)) - math.log((b + other) / (bad + 1))
                ratio[r, v] = round(max(0.0, min(6.0, value)) if v == 1 else min(0.0, max(-6.0, value)), 9)
        p = posterior(odds, ratio)
        if before and max(abs(ratio[k] - before[k]) for k in ratio) < tolerance:
            break
        before = ratio
    return round(odds, 9), ratio


def posterior(odds: float, ratio: dict[tuple[str, int], float]) -> Column:
    total = F.lit(odds)
    for (rule, vote), value in ratio.items():
        total = total + F.when(F.col(rule) == vote, F.lit(value)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """Counts, base_failed, the votes, quality (posterior) and kept, for each document."""
    rules = votes()
    scratch = Scratch(docs.sparkSession)
    seen = scratch.save(counts(docs, text, key).select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in rules.items()]))
    names = [f"vote_{k}" for k in rules]
    patterns = scratch.save(seen.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    odds, ratio = estimate(patterns, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seen.withColumn("base_failed", failed).withColumn("quality", F.round(posterior(odds, ratio), 6)).withColumn("kept", ~failed & (F.col("quality") >= least))
