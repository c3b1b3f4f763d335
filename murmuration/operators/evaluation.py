"""Fairness of scores, agreement of raters, and retrain batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def group_metrics(scored: DataFrame, group: str, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """Per group: n, positives, negatives, error rates, precision and mean score of negatives; 0 on empty denominators."""
    said, true = F.col(score) >= threshold, F.col(label) == 1
    pos, neg = F.count_if(true), F.count_if(~true)
    tp, fp = F.count_if(said & true), F.count_if(said & ~true)
    return scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), pos.alias("n_positive"), neg.alias("n_negative"),
        F.round(_share(fp, neg), 4).alias("fpr"), F.round(_share(pos - tp, pos), 4).alias("fnr"), F.round(_share(tp, pos), 4).alias("tpr"), F.round(_share(tp, tp + fp), 4).alias("precision"),
        F.round(F.coalesce(F.avg(F.when(~true, F.col(score))), F.lit(0.0)), 4).alias("mean_score_negative"),
    )


def gaps(metrics: DataFrame, least: int = 5) -> DataFrame:
    """Largest differences of error rates between groups with at least `least` rows of the kind."""
    fpr, fnr = F.when(F.col("n_negative") >= least, F.col("fpr")), F.when(F.col("n_positive") >= least, F.col("fnr"))
    wide = lambda x: F.round(F.coalesce(F.max(x) - F.min(x), F.lit(0.0)), 4)
    return metrics.agg(wide(fpr).alias("fpr_gap"), wide(fnr).alias("fnr_gap"), F.count(F.lit(1)).alias("n_groups"))


def calibrate(scored: DataFrame, group: str, default: float = 0.5, target: float | None = None, reference: str | None = None, least: int = 5, score: str = "score", label: str = "label") -> DataFrame:
    """(group, threshold): the smallest threshold in hundredths with the target false-positive rate.

    Negatives are counted in hundredths once; no row is paired with thresholds.
    """
    negatives = scored.where(F.col(label) != 1)
    at = F.least(F.lit(100), F.floor(F.col(score) * 100 + 1e-9)).cast("int")
    hist = negatives.groupBy(group, at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    first = int(default * 100)
    # score >= t/100 for whole t is the same as at >= t
    above = F.sum("n").over(Window.partitionBy(group).orderBy(F.desc("at")))
    total = F.sum("n").over(Window.partitionBy(group))
    curve = hist.select(group, "at", above.alias("above"), total.alias("total"))
    base = negatives.groupBy(group).agg(F.count(F.lit(1)).alias("n_negative"), F.avg((F.col(score) >= default).cast("double")).alias("fpr"))
    if target is not None:
        goal = base.agg(F.lit(float(target)).alias("goal"))
    else:
        fit = F.when(F.col("n_negative") >= least, F.col("fpr"))
        chosen = F.coalesce(F.max(F.when(F.col(group) == reference, F.col("fpr"))) if reference else F.lit(None).cast("double"), F.min(fit), F.lit(0.05))
        goal = base.agg(chosen.alias("goal"))
    aimed = base.crossJoin(F.broadcast(goal))  # one row
    # the rate at t is that of the least bin >= t, so the smallest good t follows the largest bad bin
    bad = curve.join(aimed.select(group, "goal"), group).where(F.col("above") / F.col("total") > F.col("goal") + 1e-9).groupBy(group).agg(F.max("at").alias("bad"))
    joined = aimed.join(bad, group, "left")
    step = F.greatest(F.lit(first + 1), F.coalesce("bad", F.lit(-1)) + 1)
    value = F.when((F.col("n_negative") < least) | (F.col("fpr") <= F.col("goal") + 1e-9), default).when(step > 95, 0.95).otherwise(step / 100.0)
    return joined.select(group, value.alias("threshold"))


def cohen_kappa(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, kappa): chance-corrected agreement of two labels; equal constant labels give 1."""
    cells = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("c"))
    n = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col(a).alias("x")).agg(F.sum("c").alias("p"))
    right = cells.groupBy(*by, F.col(b).alias("x")).agg(F.sum("c").alias("q"))
    chance = left.join(right, [*by, "x"]).groupBy(*by).agg(F.sum(F.col("p") * F.col("q")).alias("pq")) if by else left.join(right, "x").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0)).alias("pq"))
    joined = n.join(chance, by, "left") if by else n.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.coalesce("pq", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(F.col("n") > 0, F.when(pe >= 1.0, 1.0).otherwise(F.round(F.try_divide(po - pe, 1 - pe), 4)))
    return joined.select(*by, "n", kappa.alias("kappa"))


def interpretation(kappa: Column) -> Column:
    return F.when(kappa.isNull(), "insufficient overlap").when(kappa < 0.2, "slight").when(kappa < 0.4, "fair").when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial").otherwise("almost perfect")


def pairwise(ratings: DataFrame, item: str, rater: str, label: str, least: int = 5) -> DataFrame:
    """(rater_a, rater_b, n, kappa) of all pairs of raters with at least `least` items in common."""
    a = ratings.select(item, F.col(rater).alias("rater_a"), F.col(label).alias("a"))
    b = ratings.select(item, F.col(rater).alias("rater_b"), F.col(label).alias("b"))
    return cohen_kappa(a.join(b, item).where("rater_a < rater_b"), ["rater_a", "rater_b"]).where(F.col("n") >= least)


def fleiss_kappa(ratings: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """One row (n_items, n_raters, kappa): items with two ratings or more, each cut to the least number of ratings."""
    several = ratings.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(item))).where("m >= 2")
    rank = F.row_number().over(Window.partitionBy(item).orderBy(rater))
    least = several.agg(F.min("m").alias("r"))
    cut = several.withColumn("i", rank).crossJoin(F.broadcast(least)).where("i <= r")  # one row
    cells = cut.groupBy(item, label, "r").agg(F.count(F.lit(1)).alias("c"))
    items = cells.groupBy(item, "r").agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    mean = items.agg(F.count(F.lit(1)).alias("n_items"), F.max("r").alias("n_raters"), F.avg((F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p"))
    shares = cells.groupBy(label).agg(F.sum("c").alias("c")).agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), F.lit(2))).alias("pe"))
    kappa = F.when(F.col("pe") >= 1.0, 1.0).otherwise(F.round(F.try_divide(F.col("p") - F.col("pe"), 1 - F.col("pe")), 4))
    return mean.crossJoin(shares).select("n_items", "n_raters", kappa.alias("kappa"))


def majority(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """(item, label, votes, n): the most frequent label of each item, the least of equals."""
    counts = ratings.groupBy(item, label).agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(item).agg(F.min_by(F.struct(label, "votes"), F.struct(-F.col("votes"), label)).alias("x"), F.sum("votes").alias("n"))
    return best.select(item, f"x.{label}", "x.votes", "n")


def retrain_batch(annotations: DataFrame, classified: DataFrame, least: int = 20) -> DataFrame:
    """(post_id, label, severity, targets, model_label, corrected, n_annotators) of unused annotations; empty below `least` of them.

    annotations: post_id, annotator, label, severity, targets, used.
    """
    fresh = annotations.where(~F.col("used"))
    enough = fresh.agg((F.count(F.lit(1)) >= least).alias("enough"))
    labels = majority(fresh, "post_id", "label")
    rest = fresh.groupBy("post_id").agg(F.bround(F.avg("severity"), 0).cast("int").alias("severity"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"))
    model = classified.select("post_id", F.col("label").alias("model_label"))
    joined = labels.join(rest, "post_id").join(model, "post_id").crossJoin(F.broadcast(enough)).where("enough")  # one row
    return joined.select("post_id", "label", "severity", "targets", "model_label", (F.col("label") != F.col("model_label")).alias("corrected"), F.col("n").alias("n_annotators"))
