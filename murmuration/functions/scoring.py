"""Scores as column arithmetic: noisy-or, toxicity blend, targets, severity, stance, discounts, review.

The constants are fixed values of the scoring model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ["non_toxic", "offensive", "hate_speech", "violent_extremism"]
STANCES = ["condemn", "deny", "support", "query"]


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def noisy_or(weights: Column) -> Column:
    """1 minus the product of 1 - w over an array; an empty array gives 0."""
    return 1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - clamp(w)))


def noisy_or_agg(weight: Column) -> Column:
    """The same as an aggregate over rows."""
    return 1 - F.product(1 - clamp(weight))


def slur_weight(weight: Column, ambiguous: Column, hostile: Column) -> Column:
    return F.when(ambiguous & ~hostile, weight * 0.25).otherwise(weight)


def task_a(stereotype: Column, dehumanization: Column, harassment: Column, incitement: Column, offensive: Column, counterspeech: Column, has_target: Column, explicit: Column, obfuscation: Column) -> dict[str, Column]:
    """Probabilities of the four labels, in declaration order."""
    hostility = F.greatest(harassment, dehumanization, 0.9 * stereotype)
    hate = F.when(explicit, hostility).when(has_target, 0.75 * hostility).otherwise(0.55 * hostility)
    violent = F.when(explicit | (incitement >= 0.9), incitement).otherwise(0.6 * incitement)
    rude = F.when(has_target, offensive).otherwise(F.greatest(offensive, 0.5 * hostility))
    hate, violent, rude = hate * (1 - 0.75 * counterspeech), violent * (1 - 0.75 * counterspeech), rude * (1 - 0.4 * counterspeech)
    evasive = (obfuscation > 0) & ((hate > 0.2) | (violent > 0.2))
    lift = 1 + 0.15 * obfuscation
    hate, violent = F.when(evasive, F.least(F.lit(1.0), hate * lift)).otherwise(hate), F.when(evasive, F.least(F.lit(1.0), violent * lift)).otherwise(violent)
    mass = [1 - F.greatest(violent, hate, rude), rude * (1 - F.greatest(hate, violent)), hate * (1 - 0.5 * violent), violent]
    total = reduce(lambda a, b: a + b, mass)
    total = F.when(total == 0, 1.0).otherwise(total)
    return {label: m / total for label, m in zip(LABELS, mass, strict=True)}


def argmax_label(scores: dict[str, Column]) -> Column:
    """The name with the highest score, the first of equals."""
    most = F.greatest(*scores.values())
    out = None
    for name, score in scores.items():
        out = F.when(score == most, name) if out is None else out.when(score == most, name)
    return out


def mention_confidence(toxicity: Column) -> Column:
    return F.least(F.lit(0.97), 0.45 + 0.5 * toxicity)


def slur_confidence(weight: Column) -> Column:
    return F.least(F.lit(0.99), 0.5 + 0.5 * weight)


def severity(stereotype: Column, dehumanization: Column, harassment: Column, incitement: Column, toxicity: Column, has_target: Column) -> tuple[Column, Column]:
    """(level, expected level) of the ordinal severity."""
    scale = F.least(F.lit(1.0), toxicity / 0.4)
    ge4 = incitement * scale
    ge3 = F.greatest(ge4, harassment * scale)
    ge2 = F.greatest(ge3, dehumanization * scale)
    ge1 = F.greatest(ge2, stereotype * scale, F.when(has_target, 0.5 * toxicity).otherwise(0.0))
    level = F.when(ge4 >= 0.5, 4).when(ge3 >= 0.5, 3).when(ge2 >= 0.5, 2).when(ge1 >= 0.5, 1).otherwise(0)
    masses = [F.greatest(F.lit(0.0), m) for m in (1 - ge1, ge1 - ge2, ge2 - ge3, ge3 - ge4, ge4)]
    total = reduce(lambda a, b: a + b, masses)
    expected = sum((k * m for k, m in enumerate(masses) if k), F.lit(0.0)) / total
    return level, expected


def stance_scores(condemn: Column, deny: Column, support: Column, query: Column, counterspeech: Column, quoted: Column, sarcasm: Column, short: Column, parent_toxicity: Column, own_toxicity: Column) -> dict[str, Column]:
    """Scores of the stances; a toxic parent makes short agreement amplification and named behaviour condemnation."""
    c = F.least(F.lit(1.0), 0.45 * condemn + 0.6 * counterspeech + 0.15 * quoted.cast("int"))
    d = F.least(F.lit(1.0), 0.45 * deny + 0.2 * counterspeech)
    s = F.least(F.lit(1.0), 0.4 * support) * F.when(sarcasm, 0.3).otherwise(1.0)
    toxic_parent = F.coalesce(parent_toxicity >= 0.6, F.lit(False))
    s = F.when(toxic_parent & short & (support > 0) & (condemn == 0), F.greatest(s, F.lit(0.85))).otherwise(s)
    c = F.when(toxic_parent & (own_toxicity < 0.4) & ((condemn > 0) | (counterspeech > 0.3)), F.greatest(c, F.lit(0.7))).otherwise(c)
    return {"condemn": c, "deny": d, "support": s, "query": F.when(query, 0.5).otherwise(0.0)}


def stance(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(stance, confidence); below 0.3 the stance is neutral and the confidence its complement."""
    best = F.greatest(*scores.values())
    return F.when(best < 0.3, "neutral").otherwise(argmax_label(scores)), F.when(best < 0.3, 1 - best).otherwise(best)


def discount(stance_: Column, confidence: Column, counterspeech: Column, refers: Column, quoted: Column, floor: float = 0.2) -> Column:
    attributable = F.least(F.lit(1.0), counterspeech + F.when(refers, 0.5).otherwise(0.0) + F.when(quoted, 0.3).otherwise(0.0))
    return F.when(stance_.isin("deny", "condemn"), F.greatest(F.lit(floor), 1 - (1 - floor) * attributable * confidence)).otherwise(1.0)


def framing(stance_: Column) -> Column:
    return F.when(stance_.isin("condemn", "deny"), "criticism").when(stance_ == "support", "amplification").otherwise("neutral")


def visual_score(vlm: Column, symbol: Column, ocr: Column, hate_code: Column) -> Column:
    text = F.when(hate_code, F.greatest(ocr, F.lit(0.7))).otherwise(ocr)
    return F.greatest(vlm, symbol, 0.9 * text)


def visual_ensemble(text: Column, visual: Column, weight: float = 0.4) -> Column:
    """Text and image scores; a null image score leaves the text's, a strong one is never diluted."""
    both = F.greatest((1 - weight) * text + weight * visual, F.when(visual >= 0.8, F.least(visual, F.lit(0.95))).otherwise(0.0))
    return F.when(visual.isNull(), text).otherwise(both)


def final_score(ensemble: Column, factor: Column) -> Column:
    return F.round(F.least(F.lit(1.0), ensemble * factor), 4)


def needs_review(final: Column, confidence: Column, low: float = 0.4, high: float = 0.6) -> Column:
    return final.between(low, high) | (confidence.between(low, high) & (final >= low))


def review_priority(final: Column, level: Column) -> Column:
    return F.when(level >= 4, 1.0).otherwise(F.round(1 - 2 * F.abs(final - 0.5), 4))


def calibrated(score: Column, threshold: Column, default: float = 0.5) -> Column:
    return score >= F.coalesce(threshold, F.lit(default))
