"""A quality classifier: ordinal regression with cumulative links on hashed text.

A document's features are its words, pairs of adjacent words and word shapes,
hashed into one table of weights that all grades share; ordered thresholds cut
the score into grades: P(grade > k) = sigmoid(score - threshold_k).  The expected
grade and the tail probability P(grade >= `tail`) select documents.

Fitting uses a bounded sample, `SAMPLE` graded rows in the order of a hash of the
id, and runs in numpy on hashed features.  Scoring covers every whole text in
Arrow tasks, shuffles nothing and ships a table of fixed size to the tasks.

Defined cases: null and empty texts have no features and score 0, so they get the
prior's grade but are never kept; repeated rows get equal grades; extra columns
are carried, but for those with the name of an output, which are replaced; of equal
hashes the smaller id enters the sample first; grades with no rows keep their order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm import kernel

BITS, SAMPLE, STEPS = 18, 6_000, 120
MADE = ("expected_grade", "tail_prob", "kept")

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1  # upper case
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 8


def feature_hashes(batch: pa.RecordBatch, column: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table positions, the first of each document (n + 1), and words per document."""
    data, offsets = kernel.buffers(batch.column(column))
    words = kernel.Words(data, offsets)
    n_docs = len(offsets) - 1
    if not len(words):
        return np.empty(0, np.int64), np.zeros(n_docs + 1, np.int64), np.zeros(n_docs, np.int64)
    one = words.hashes()
    two, two_first = kernel.grams(one, words.first, 2)
    kinds = np.zeros(len(data) + 1, np.int64)
    kinds[:-1] = _CLASS[data]
    at = np.column_stack([words.start, words.end]).ravel()
    shape = np.bitwise_or.reduceat(kinds, at)[::2]
    length = np.minimum(words.end - words.start, 24)
    shape = kernel.mix((shape * 32 + length).astype(np.uint64) + np.uint64(1 << 40))
    value = np.concatenate([one, two, shape])
    doc = np.concatenate([words.doc(), np.repeat(np.arange(n_docs), np.diff(two_first)), words.doc()])
    order = np.argsort(doc, kind="stable")
    first = np.searchsorted(doc[order], np.arange(n_docs + 1))
    return (value[order] >> np.uint64(64 - bits)).astype(np.int64), first, np.diff(words.first)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def scores(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at) + 1)
        np.cumsum(self.weights[at], out=total[1:])
        return (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(1, np.diff(first)))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each document and each threshold."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: DataFrame, grades: int, bits: int = BITS, ridge: float = 2e-4) -> Model:
    """A model from a bounded table of rows (text, grade), grade from 0 to grades - 1."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                at, first, _ = feature_hashes(piece, "text", bits)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("grade"), lists], names=["grade", "at"])

    table = rows.select(F.col("grade").cast("int").alias("grade"), "text").mapInArrow(hashed, "grade int, at array<int>").toArrow().combine_chunks()
    grade = table["grade"].to_numpy()
    lists = table["at"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    return fit_arrays(np.asarray(lists.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), grade, grades, bits, ridge)


def fit_arrays(at: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int, bits: int, ridge: float) -> Model:
    """Adam on the likelihood of the grades; threshold gaps are exponentials, hence ordered."""
    n = len(grade)
    size = 1 << bits
    weights = np.zeros(size, np.float64)
    shares = [float(np.clip(((grade > k).sum() + 0.5) / (n + 1), 0.01, 0.99)) for k in range(grades - 1)]
    thresholds = np.array([-np.log(s / (1 - s)) for s in shares])
    thresholds = np.maximum.accumulate(thresholds + 1e-3 * np.arange(grades - 1))
    if not n or not len(at):
        return Model(weights, thresholds, bits)
    params = np.r_[thresholds[0], np.log(np.maximum(np.diff(thresholds), 1e-3))]
    counts = np.diff(first)
    scale = 1 / np.sqrt(np.maximum(1, counts))
    moments = [np.zeros(size), np.zeros(size), np.zeros(len(params)), np.zeros(len(params))]
    balance = np.array([n / (grades * max(1, (grade == g).sum())) for g in range(grades)])[grade] / n
    for step in range(1, STEPS + 1):
        cuts = np.cumsum(np.r_[params[0], np.exp(params[1:])])
        model = Model(weights, cuts, bits)
        score = model.scores(at, first)
        edge = np.r_[-30.0, cuts, 30.0]  # grade g lies between edge g and edge g + 1
        above, below = _sigmoid(score - edge[grade]), _sigmoid(score - edge[grade + 1])
        mass = np.maximum(above - below, 1e-9)
        d_above, d_below = above * (1 - above), below * (1 - below)
        d_score = -(d_above - d_below) / mass * balance
        d_cut = np.zeros(grades - 1)
        low, high = grade > 0, grade < grades - 1
        np.add.at(d_cut, grade[low] - 1, (d_above / mass * balance)[low])
        np.add.at(d_cut, grade[high], (-d_below / mass * balance)[high])
        later = np.cumsum(d_cut[::-1])[::-1]
        g_params = np.r_[later[0], later[1:] * np.exp(params[1:])]
        g_weights = np.bincount(at, np.repeat(d_score * scale, counts), size) + ridge * weights
        for value, slope, rate, (m, v) in ((weights, g_weights, 0.05, moments[:2]), (params, g_params, 0.05, moments[2:])):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights.astype(np.float32), np.cumsum(np.r_[params[0], np.exp(params[1:])]), bits)


def grade(docs: DataFrame, model: Model, columns: list[str], text: str = "text", tail: int = 1, least: float = 0.5) -> DataFrame:
    """The given columns but those with the name of an output, then expected_grade, tail_prob = P(grade >= tail), and kept = tail_prob >= least with a word in the text."""
    source = docs.select(*[F.col(f"`{c}`") for c in columns if c not in MADE], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string("expected_grade double, tail_prob double, kept boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "__text"):
                at, first, words = feature_hashes(piece, "__text", model.bits)
                tails = model.tails(model.scores(at, first))
                made = [pa.array(tails.sum(1)), pa.array(tails[:, tail - 1]), pa.array((tails[:, tail - 1] >= least) & (words > 0))]
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(piece.num_columns - 1)] + made, names=schema.names)

    return source.mapInArrow(run, schema)


def graded_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade) of at most `sample` rated documents, as many of each grade if there are enough.

    Grades come from two ratings: 0 poor quality, 1 good but toxic, 2 good and
    clean.  The sample is drawn from the ratings alone, by a hash of the id, so
    only its own texts are moved.
    """
    rated = labels.where("quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    grade_of = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    graded = rated.select("doc_id", grade_of.alias("grade"))
    parts = [graded.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, sample // 3)) for g in range(3)]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers at most
