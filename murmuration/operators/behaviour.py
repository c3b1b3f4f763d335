"""Behaviour of accounts: timing, repetition, bot scores and decay-weighted account scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The logistic bot model and the weights of the account score.
BOT_BIAS = -2.4
BOT_WEIGHTS = {
    "account_age_days": -1.4, "posts_per_day": 1.6, "follower_following_ratio": -1.0, "profile_completeness": -1.3, "timing_regularity": 2.2, "content_repetitiveness": 2.4,
    "username_digit_ratio": 1.2, "default_avatar": 0.9, "retweet_ratio": 1.1, "reply_ratio": -0.3, "night_activity_ratio": 0.6, "burstiness": 0.8,
}
ACCOUNT_WEIGHTS = {"severity": 0.4, "toxic_ratio": 0.3, "target_diversity": 0.2, "recency": 0.1}
CONFIDENT_POSTS = 50


def gaps(posts: DataFrame, author: str = "author_id", at: str = "created_at", tie: str = "post_id") -> DataFrame:
    """Each post with the seconds since the author's previous one, null for the first."""
    before = F.lag(at).over(Window.partitionBy(author).orderBy(at, tie))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")) / 1e6
    return posts.withColumn("gap_s", seconds(at) - seconds(before))


def timing(posts: DataFrame, author: str = "author_id", at: str = "created_at", tie: str = "post_id") -> DataFrame:
    """Per author: n, mean_gap, sd_gap, regularity, burstiness, night_share, posts_per_day over the observed span."""
    g = gaps(posts, author, at, tie)
    n = F.count(F.lit(1))
    hour = F.hour(F.col(at))
    stats = g.groupBy(author).agg(
        n.alias("n"), F.avg("gap_s").alias("mean_gap"), F.stddev_pop("gap_s").alias("sd_gap"), F.avg(hour.between(1, 4).cast("double")).alias("night_share"),
        (F.sum("gap_s") / 86400).alias("span"),
    )
    some = F.col("n") > 2
    cv = F.when(F.col("mean_gap") > 0, F.col("sd_gap") / F.col("mean_gap")).otherwise(0.0)
    total = F.col("sd_gap") + F.col("mean_gap")
    return stats.select(
        author, "n", "mean_gap", "sd_gap", "night_share",
        F.when(some, F.greatest(F.lit(0.0), 1 - F.least(cv, F.lit(1.5)) / 1.5)).otherwise(0.0).alias("regularity"),
        F.when(some & (total > 0), ((F.col("sd_gap") - F.col("mean_gap")) / total + 1) / 2).otherwise(0.5).alias("burstiness"),
        F.when(F.col("n") > 1, F.col("n") / F.greatest(F.lit(1.0), F.col("span"))).otherwise(F.col("n").cast("double")).alias("posts_per_day"),
    )


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def pairwise_jaccard(texts: DataFrame, key: str, text: str, order: str, most: int = 40) -> DataFrame:
    """(key, n_pairs, mean_jaccard) over all pairs of a key's first `most` texts, as the measure is defined."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    words = F.array_distinct(F.split(normalised(F.col(text)), " "))
    first = texts.select(key, words.alias("w"), rank.alias("i")).where(F.col("i") <= most)
    sets = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("s"))
    s = F.col("s")
    pairs = F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))))
    return sets.select(key, pairs.alias("p")).select(key, F.size("p").cast("long").alias("n_pairs"), F.coalesce(F.try_divide(F.aggregate("p", F.lit(0.0), lambda x, y: x + y), F.size("p")), F.lit(0.0)).alias("mean_jaccard"))


def repetition(posts: DataFrame, author: str = "author_id", text: str = "text", order: str = "post_id", most: int = 40) -> DataFrame:
    """(author, repetitiveness): the larger of the share of texts that repeat others and the mean similarity of the first `most` texts.

    Distinct texts are counted by their hashes, so no author's texts are gathered.
    """
    seen = posts.groupBy(author).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.xxhash64(normalised(F.col(text)))).alias("kinds"))
    alike = pairwise_jaccard(posts, author, text, order, most).select(author, "mean_jaccard")
    both = seen.join(alike, author, "left")
    return both.select(author, F.when(F.col("n") > 1, F.greatest(1 - F.col("kinds") / F.col("n"), F.coalesce("mean_jaccard", F.lit(0.0)))).otherwise(0.0).alias("repetitiveness"))


def post_shares(posts: DataFrame, author: str = "author_id") -> DataFrame:
    """(author, retweet_share, reply_share)."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    return posts.groupBy(author).agg(share("retweeted_id").alias("retweet_share"), share("parent_id").alias("reply_share"))


def rate(observed: Column, lifetime_posts: Column, age_days: Column) -> Column:
    """Posts a day: the observed rate, or that over the account's life if it is higher."""
    return F.greatest(observed, lifetime_posts / age_days)


def bot_terms(features: dict[str, Column]) -> dict[str, Column]:
    """Each feature scaled to about [0, 1] and weighted."""
    logs = {"account_age_days": 3650, "posts_per_day": 200, "follower_following_ratio": 100}
    scaled = {k: F.least(F.lit(1.0), F.log1p(v) / float(np.log1p(logs[k]))) if k in logs else F.least(F.lit(1.0), v * 2) if k == "username_digit_ratio" else v for k, v in features.items()}
    return {k: v * BOT_WEIGHTS[k] for k, v in scaled.items()}


def bot_probability(features: dict[str, Column]) -> Column:
    z = F.lit(BOT_BIAS)
    for term in bot_terms(features).values():
        z = z + term
    return 1 / (1 + F.exp(-z))


def top_signals(features: dict[str, Column], least: float = 0.15, most: int = 3) -> Column:
    """Names of the strongest contributions above `least`; a low age, profile or ratio counts as a signal."""
    terms = bot_terms(features)
    for k, shift in (("account_age_days", 1.4), ("profile_completeness", 1.3), ("follower_following_ratio", 1.0)):
        terms[k] = -terms[k] - shift
    ranked = F.array_sort(F.array(*[F.struct((-F.round(v, 9)).alias("minus"), F.lit(k).alias("name")) for k, v in terms.items()]))
    return F.slice(F.transform(F.filter(ranked, lambda x: -x["minus"] > least), lambda x: x["name"]), 1, most)


def account_scores(posts: DataFrame, as_of: Column, half_life: float = 90.0, author: str = "author_id") -> DataFrame:
    """Per author: decay-weighted severity and toxic ratio, target diversity, recency, and the composite score.

    posts: author, created_at, tox, severity, targets (an array).
    """
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86400e6
    weight = F.pow(F.lit(0.5), age / half_life) if half_life > 0 else F.lit(1.0)
    toxic = F.col("tox") >= 0.5
    aged = posts.select(author, "severity", toxic.alias("toxic"), weight.alias("w"), (age <= 30).alias("recent"), "targets")
    shown = F.explode_outer(F.when(F.col("toxic"), F.col("targets")))
    targets = aged.select(author, shown.alias("t")).groupBy(author).agg(F.countDistinct("t").alias("n_targets"))
    sums = aged.groupBy(author).agg(
        F.count(F.lit(1)).alias("n_posts"),
        (F.sum(F.col("w") * F.col("severity")) / F.sum("w") / 4).alias("avg_severity"),
        (F.sum(F.when(F.col("toxic"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("toxic_ratio"),
        F.coalesce(F.try_divide(F.count_if(F.col("toxic") & F.col("recent")), F.count_if("toxic")), F.lit(0.0)).alias("recency"),
    )
    both = sums.join(targets, author).withColumn("target_diversity", F.least(F.lit(1.0), F.col("n_targets") / 6.0))
    w = ACCOUNT_WEIGHTS
    score = w["severity"] * F.col("avg_severity") + w["toxic_ratio"] * F.col("toxic_ratio") + w["target_diversity"] * F.col("target_diversity") + w["recency"] * F.col("recency")
    return both.withColumn("score", score)


#: Posts up to which an author's are one stream of one task.
ONE_STREAM = 1_000_000


def _draws(rows: pd.DataFrame, half_life: float, resamples: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An author's five sums in each resample, and for each target in which of them it was drawn."""
    sums, drawn = np.zeros((5, resamples)), {}
    for at in range(0, len(rows), 1000):
        part = rows.iloc[at : at + 1000]
        seeds = part["post_id"].to_numpy(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(resamples, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            seeds = (seeds ^ (seeds >> np.uint64(shift))) * np.uint64(factor)
        uniform = (seeds >> np.uint64(11)).astype(np.float64) / (1 << 53)
        counts = np.searchsorted(np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)]), uniform).astype(np.float64)
        age = part["age"].to_numpy()
        w = 0.5 ** (age / half_life) if half_life > 0 else np.ones(len(part))
        toxic = part["tox"].to_numpy() >= 0.5
        sums += [counts.T @ x for x in (w, w * part["severity"].to_numpy(), w * toxic, toxic.astype(float), (toxic & (age <= 30)).astype(float))]
        for i, names in enumerate(part["targets"]):
            for t in names if toxic[i] else ():
                drawn[t] = drawn.get(t, np.zeros(resamples, bool)) | (counts[i] > 0)
    return sums, drawn


def poisson_bootstrap(posts: DataFrame, as_of: Column, half_life: float = 90.0, resamples: int = 300, author: str = "author_id", one_stream: int = ONE_STREAM) -> DataFrame:
    """(author, n_posts, ci_low, ci_high): a bootstrap interval of the account score.

    Each post has a Poisson(1) count in each resample, drawn from a hash of its id
    and the resample, so the result is the same on any cluster.  Posts move once, to
    their author's task, which streams them in batches and holds one author's sums; only
    the interval leaves it.  Of authors with more than `one_stream` posts the sums are
    taken in many tasks and merged.  Below two posts the interval is null.
    """
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86400e6
    known = posts.where(F.col(author).isNotNull())
    many = F.broadcast(known.groupBy(author).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > one_stream).select(author))  # few: each has so many posts

    def source(rows: DataFrame) -> DataFrame:
        each = rows.select(author, "post_id", "tox", "severity", age.alias("age"), F.explode_outer("targets").alias("target"))
        return each.groupBy(author, "post_id", "tox", "severity", "age").agg(F.array_sort(F.collect_set("target")).alias("targets"))

    low, high = int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples))
    w = ACCOUNT_WEIGHTS

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = lambda a, b: np.divide(a, b, out=np.zeros(resamples), where=b != 0)
        who, n, sums, drawn = None, 0, np.zeros((5, resamples)), {}

        def interval() -> tuple:
            t = np.sum([*drawn.values(), np.zeros(resamples)], axis=0)
            score = w["severity"] * part(sums[1], sums[0]) / 4 + w["toxic_ratio"] * part(sums[2], sums[0]) + w["target_diversity"] * np.minimum(1.0, t / 6.0) + w["recency"] * part(sums[4], sums[3])
            ordered = np.sort(score)
            return who, n, ordered[low], ordered[high]

        for frame in batches:
            done = []
            for key, rows in frame.groupby(author, sort=False):
                if key != who:
                    done += [interval()] if n else []
                    who, n, sums, drawn = key, 0, np.zeros((5, resamples)), {}
                more, hit = _draws(rows, half_life, resamples)
                n, sums = n + len(rows), sums + more
                drawn = {t: drawn.get(t, False) | hit.get(t, False) for t in drawn.keys() | hit.keys()}
            yield pd.DataFrame(done, columns=[author, "n_posts", "low", "high"])
        if n:
            yield pd.DataFrame([interval()], columns=[author, "n_posts", "low", "high"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [author, "resample", "target", "n", *[f"s{i}" for i in range(5)]]
        for frame in batches:
            out = []
            for key, rows in frame.groupby(author, sort=False):
                sums, drawn = _draws(rows, half_life, resamples)
                out.append(pd.DataFrame({author: key, "resample": np.arange(resamples), "target": None, "n": len(rows), **{f"s{i}": p for i, p in enumerate(sums)}}))
                out += [pd.DataFrame({author: key, "resample": np.flatnonzero(hit), "target": t, "n": 0, **{f"s{i}": 0.0 for i in range(5)}}) for t, hit in drawn.items()]
            yield pd.concat(out) if out else pd.DataFrame(columns=names)

    kind = dict(posts.dtypes)[author]
    dealt = source(known.join(many, author, "left_anti").repartition(author)).sortWithinPartitions(author)
    whole = dealt.mapInPandas(streamed, f"{author} {kind}, n_posts long, low double, high double")
    parts = source(known.join(many, author, "left_semi")).mapInPandas(partial, f"{author} {kind}, resample int, target string, n long, s0 double, s1 double, s2 double, s3 double, s4 double")
    merged = parts.groupBy(author, "resample").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)], F.countDistinct("target").alias("t"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    score = w["severity"] * share("s1", "s0") / 4 + w["toxic_ratio"] * share("s2", "s0") + w["target_diversity"] * F.least(F.lit(1.0), F.col("t") / 6.0) + w["recency"] * share("s4", "s3")
    ranked = merged.select(author, "n", score.alias("score")).groupBy(author).agg(F.max("n").alias("n_posts"), F.array_sort(F.collect_list("score")).alias("v"))
    every = whole.union(ranked.select(author, "n_posts", F.get("v", F.lit(low)).alias("low"), F.get("v", F.lit(high)).alias("high")))
    enough = F.col("n_posts") >= 2
    return every.select(author, "n_posts", F.when(enough, F.round("low", 4)).alias("ci_low"), F.when(enough, F.round("high", 4)).alias("ci_high"))


def confidence_label(n: Column, low: Column, high: Column, least: int = CONFIDENT_POSTS) -> Column:
    width = F.coalesce(high, F.lit(0.0)) - F.coalesce(low, F.lit(0.0))
    return F.when(n < least, f"insufficient sample (< {least} posts)").when(width < 0.1, "high confidence").when(width < 0.2, "moderate confidence").otherwise("low confidence")
