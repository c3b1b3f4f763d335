"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

A text is folded first: case, look-alike letters of other scripts, and digits and
signs used as letters; all that is no letter becomes a space.  The automaton finds
every lexicon term at a word's start and every exception phrase; a hit inside an
exception phrase is void.  A logistic model over the summed weights, with and
without division by length, gives the score.

The lexicon is a short fixed list and the terms (words or word stems) that mark
toxic documents in a bounded training sample: `SAMPLE` labelled rows, taken in
the order of a hash of the id.  Term counts come from Spark; only terms that pass
the frequency and odds tests reach the driver.  Scoring covers every whole text,
shuffles nothing and broadcasts only the fitted lexicon of `TERMS` terms at most.

Defined cases: null and empty texts have no hits and get the model's base score;
repeated rows get equal scores; extra columns are carried, but for those with the
name of an output, which are replaced; rows without an id are scored, and never
learned from; of equal hashes the smaller id enters the sample first; with no toxic
training rows the fixed list alone scores; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm import kernel

SAMPLE, TERMS = 12_000, 4_000
LEAST_ODDS, LEAST_ROWS, LEAST_SHARE = 3.5, 4, 0.004
STEM = range(4, 9)
MADE = ("score", "hits", "weight", "predicted")

# English insults, and phrases in which they are harmless.
INSULTS = """
idiot moron imbecile stupid dumbass loser scum scumbag trash worthless pathetic disgusting clown
vermin filthy bastard bitch asshole retard degenerate freak subhuman parasite
""".split()
EXCEPTIONS = ["trash can", "trash bag", "trash bin", "trash collection", "clown fish", "clownfish", "class clown", "loser bracket", "loser pays", "freak accident", "freak wave", "filthy rich", "worthless check", "parasite host"]

# Characters that stand for a Latin letter.
LOOKALIKES = {
    "a": "аαàáâäåãɑ@4ａ", "b": "вβЬ8ｂ", "c": "сϲçｃ", "d": "ԁɗｄ", "e": "еєéèêëɛ3ｅ", "f": "ｆƒ", "g": "ɡ9ｇ", "h": "һнｈ", "i": "іιíìîïı1|!ｉlｌӏ", "j": "јｊ", "k": "кκｋ",
    "m": "мｍ", "n": "ոηｎñ", "o": "оοóòôöõøօ0ｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕ5$ｓ", "t": "тτ7ｔ", "u": "υúùûüսｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγýÿｙ", "z": "ᴢｚ",
}
#: Signs that are letters only between letters; at a word's edge they end it.
SIGNS = "@$|!"
HIDDEN = "­​‌‍⁠﻿"


class _Fold(dict):
    """A table for str.translate, filled as characters are met."""

    def __init__(self) -> None:
        super().__init__({ord(x): letter for letter, odd in LOOKALIKES.items() for x in odd})
        self.update({ord(x): None for x in HIDDEN})

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        out = "".join(super(_Fold, self).get(ord(c)) or (c if c.isalpha() else " ") for c in char)
        self[code] = out
        return out


class Folder:
    def __init__(self) -> None:
        self.table = _Fold()
        for code in range(128):
            self.table[code] = self.table[code]
        self.edge = re.compile(rf"(?<![^\W_])[{re.escape(SIGNS)}]+|[{re.escape(SIGNS)}]+(?![^\W_])")

    def __call__(self, text: str) -> str:
        if any(sign in text for sign in SIGNS):
            text = self.edge.sub(" ", text)
        return text.translate(self.table)


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    bias: float = -3.0
    slopes: tuple[float, float] = (2.0, 1.0)


class Matcher:
    """Aho-Corasick over folded terms that begin at a word's start."""

    def __init__(self, model: Model):
        import ahocorasick

        self.fold, self.model = Folder(), model
        entries: dict[str, tuple[float, int]] = {}
        for term, weight in model.weights.items():
            entries[" " + self.fold(term).strip()] = (weight, 0)
        for phrase in model.exceptions:
            key = " " + self.fold(phrase).strip()
            entries[key] = (0.0, len(key))
        self.automaton = ahocorasick.Automaton()
        for key, (weight, void) in entries.items():
            self.automaton.add_word(key, (len(key), weight, void))
        self.automaton.make_automaton()

    def total(self, text: str) -> tuple[float, int, int]:
        """The summed weight of hits, the hits, and the words of a text."""
        folded = " " + self.fold(text)
        best: dict[int, float] = {}
        void: list[tuple[int, int]] = []
        for end, (size, weight, phrase) in self.automaton.iter(folded):
            begin = end - size + 1
            if phrase:
                void.append((begin, end))
            elif weight > best.get(begin, 0.0):  # of nested stems the heaviest counts, once
                best[begin] = weight
        hits = [w for at, w in best.items() if not any(a <= at <= b for a, b in void)] if void else list(best.values())
        return math.fsum(hits), len(hits), folded.count(" ") + 1

    def score(self, text: str) -> tuple[float, int, float]:
        total, hits, words = self.total(text)
        x = self.model.bias + sum(s * v for s, v in zip(self.model.slopes, features(total, words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), hits, total


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def _terms(fold: Folder, text: str) -> set[str]:
    words = set(fold(text).split())
    return {w for w in words if len(w) >= 4} | {w[:k] for w in words for k in STEM if len(w) > k}


def fit(training: DataFrame) -> Model:
    """A model from a bounded table of rows (text, toxic)."""
    rows = training.select("text", F.col("toxic").cast("int").alias("toxic")).repartition(12).persist()

    def count(wanted: frozenset[str] | None, label: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fold, counts = Folder(), Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    found = _terms(fold, text or "")
                    counts.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        return rows.where(F.col("toxic") == label).select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    n_toxic, n_clean = (rows.where(F.col("toxic") == y).count() for y in (1, 0))
    weights = dict.fromkeys(INSULTS, 2.0)
    if n_toxic:
        least = max(LEAST_ROWS, LEAST_SHARE * n_toxic)
        often = count(None, 1).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(10 * TERMS)
        toxic = {r.term: r.n for r in often.collect()}
        wanted = frozenset(toxic)
        clean = {r.term: r.n for r in count(wanted, 0).collect()}
        odds = {t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in toxic.items()}
        rare = {t: o for t, o in odds.items() if clean.get(t, 0) == 0 or o >= LEAST_ODDS}
        chosen: dict[str, float] = {}
        for t in sorted((t for t in rare if odds[t] >= min(LEAST_ODDS, math.log((n_clean + 1) / (n_toxic + 1)) + 1.5)), key=lambda t: (len(t), t)):
            stems = [t[:k] for k in range(4, len(t)) if t[:k] in chosen]
            if not stems:  # the shortest stem that tells as much stands for all its words
                chosen[t] = odds[t]
        for t in sorted(chosen, key=lambda t: (-chosen[t], t))[:TERMS]:
            weights[t] = min(4.0, max(1.0, chosen[t] / 2))
    model = Model(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            found = [matcher.total(t or "") for t in batch.column(0).to_pylist()]
            columns = list(zip(*[features(t, w) for t, _, w in found], strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns] + [batch.column(1).cast(pa.float64())], names=["a", "b", "y"])

    if n_toxic and n_clean:
        seen = rows.mapInArrow(measure, "a double, b double, y double").toPandas().to_numpy()
        model.bias, *slopes = _logistic(seen[:, :2], seen[:, 2])
        model.slopes = tuple(slopes)
    rows.unpersist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> list[float]:
    """Ridge logistic regression by Newton steps, classes weighted alike; slopes stay positive."""
    z = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = ridge * np.r_[0, w[1:]]
        slope = z.T @ (weight * (p - y)) + penalty
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(np.r_[1e-9, [ridge] * x.shape[1]])
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    if (w[1:] < 0).any():  # a feature that follows from the other one adds nothing
        keep = int(np.argmax(w[1:]))
        bias, slope = _logistic(x[:, [keep]], y, ridge, steps) if x.shape[1] > 1 else (w[0], max(w[1], 0.0))
        out = [bias, 0.0, 0.0]
        out[1 + keep] = slope
        return [float(v) for v in out]
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The given columns of every document but those with the name of an output, then score, hits, weight and predicted."""
    source = docs.select(*[F.col(f"`{c}`") for c in columns if c not in MADE], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string("score double, hits int, weight double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            for piece in kernel.slices(batch, "__text"):
                found = [matcher.score(t or "") for t in piece.column(piece.num_columns - 1).to_pylist()]
                made = [
                    pa.array([s for s, _, _ in found], pa.float64()),
                    pa.array([h for _, h, _ in found], pa.int32()),
                    pa.array([w for _, _, w in found], pa.float64()),
                    pa.array([int(s >= threshold) for s, _, _ in found], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(piece.num_columns - 1)] + made, names=schema.names)

    return source.mapInArrow(run, schema)


def held_out() -> F.Column:
    """The rows that no model learns from: crc32 of the id as text, modulo 3, is 1; a row without an id is not one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most `sample` labelled documents that are not held out, half for each label if there are enough.

    The sample is drawn from the labels alone, by a hash of the id, so only its own texts are moved.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    halves = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for y in (1, 0)]
    chosen = halves[0].unionByName(halves[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers at most
