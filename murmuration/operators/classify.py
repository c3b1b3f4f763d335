"""Rule-based classification of texts: rule bank, group terms, scores, targets, attribution, thread context.

The bank is made from frames and word lists of our own, the lexicon holds placeholder
terms; both are parameters, can be extended and are read from files by
:mod:`murmuration.sources.lexicons`.  Matching runs in Arrow batches through the
required-literal index of :mod:`murmuration.operators.literals`: a text is scanned once, and only
rules whose literals it holds run.  Everything after that is column arithmetic.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions import scoring as S
from murmuration.functions.text import let
from murmuration.operators.literals import Index, fold

MATCHES = "array<struct<category:string,weight:double,start:int,end:int,targeted:boolean,label:string,slur:boolean>>"


@dataclass
class Rule:
    category: str
    weight: float
    pattern: str
    targeted: bool = False
    plain: bool = False  # the pattern as it is: ~ stands for itself, and no edges are added


@dataclass
class Term:
    term: str
    category: str
    label: str
    weight: float = 0.0
    ambiguous: bool = False

    @property
    def slur(self) -> bool:
        return self.weight > 0


@dataclass
class Lexicon:
    """Rules may hold {G}, which stands for any group term or one of the patterns of `others`, and ~ for what is between two words."""

    rules: list[Rule] = field(default_factory=list)
    terms: list[Term] = field(default_factory=list)
    others: list[str] = field(default_factory=list)

    def extend(self, terms: list[Term]) -> Lexicon:
        """A lexicon with more terms; of equal terms the last holds."""
        known = {t.term: t for t in [*self.terms, *terms]}
        return Lexicon(self.rules, list(known.values()), self.others)

    def alternation(self) -> str:
        return "|".join([*(re.escape(t.term) for t in sorted(self.terms, key=lambda t: (-len(t.term), t.term))), *self.others])

    def index(self) -> Index:
        """What tasks need to match texts; of equal terms the last holds."""
        group = f"(?:{self.alternation()})" if self.terms or self.others else r"(?!x)x"
        rules = [(r.category, r.weight, r.pattern if r.plain else _edges(r.pattern.replace("~", r"[\W_]+")), r.targeted) for r in self.rules]
        return Index(rules, {fold(t.term): (t.category, t.label, t.weight, t.ambiguous, t.slur) for t in self.terms}, group, not self.others)


INSULTS = "idiot moron imbecile fool clown loser trash scum scumbag vermin filth".split()
ADJECTIVES = "stupid worthless pathetic disgusting useless dumb filthy".split()
CREATURES = "rats vermin insects parasites animals cockroaches dogs pigs".split()
HARMS = "attack destroy remove hurt crush expel deport".split()

#: (category, weight, targeted, frame, words of {w}): a frame makes one rule of each word.
FRAMES = [
    ("offensive", 0.4, False, "{w}s?", INSULTS),
    ("offensive", 0.35, False, "{w}", ADJECTIVES),
    ("harassment", 0.6, False, "you~(?:are~)?(?:an?~)?(?:such~)?(?:an?~)?{w}s?", INSULTS),
    ("harassment", 0.55, False, r"you~{w}~\w+", ADJECTIVES),
    ("harassment", 0.5, False, "{w}~(?:people|person|man|woman)", ADJECTIVES),
    ("harassment", 0.7, False, "(?:nobody|no~one)~{w}~you", "likes loves wants needs misses".split()),
    ("dehumanization", 0.7, True, "{G}~are~(?:just~|nothing~but~)?{w}", CREATURES),
    ("dehumanization", 0.6, True, "{w}~like~{G}", CREATURES),
    ("stereotype", 0.5, True, r"all~{G}~{w}~\w+", "are do want steal lie".split()),
    ("stereotype", 0.45, True, "{G}~(?:always|never|only)~{w}", "work lie steal cheat pay".split()),
    ("incitement", 0.9, True, "{w}~(?:all~)?(?:the~|those~)?{G}", HARMS),
    ("incitement", 0.8, True, "{G}~(?:must|should)~be~{w}(?:e?d|ed)?", HARMS),
    ("counterspeech", 0.6, False, "(?:stop|report|condemn|end)~(?:the~|this~)?{w}", "hate abuse racism violence bullying".split()),
    ("counterspeech", 0.4, False, "{w}~is~(?:wrong|not~ok|unacceptable)", "this hate that racism".split()),
]


def bank(frames: list[tuple] | None = None) -> list[Rule]:
    """A rule of each word of each frame."""
    return [Rule(category, weight, frame.replace("{w}", word), targeted) for category, weight, targeted, frame, words in frames or FRAMES for word in words]


def placeholder_lexicon() -> Lexicon:
    terms = [Term(f"group{x}", c, f"label{x}") for x, c in (("a", "ethnicity"), ("b", "religion"), ("c", "nationality"))]
    return Lexicon(bank(), [*terms, Term("slurx", "ethnicity", "labela", 0.8), Term("slury", "religion", "labelb", 0.8, True)])


def _edges(pattern: str) -> str:
    return rf"(?<![^\W_])(?:{pattern})(?![^\W_])"


#: Bytes of a lexicon that goes to every task.
MOST_BYTES = 64 << 20


def matches(texts: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """All columns, then `matches`: every non-empty rule match and every longest group term, with its place."""
    index = lexicon.index()
    if len(pickle.dumps(index)) > MOST_BYTES:
        raise ValueError(f"a lexicon holds at most {MOST_BYTES} bytes")
    shared = texts.sparkSession.sparkContext.broadcast(index)
    names = ("category", "weight", "start", "end", "targeted", "label", "slur")

    @F.pandas_udf(MATCHES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = shared.value.compiled()
        for batch in batches:
            yield batch.map(lambda t: [dict(zip(names, m, strict=True)) for m in scanner.find(t)] if t else [])

    return texts.withColumn("matches", find(F.col(text)))


def _weights(category: str) -> Column:
    m = F.filter("matches", lambda x: (x["label"].isNull() & (x["category"] == category)) | (x["slur"] & F.lit(category == "harassment")))
    return F.transform(m, lambda x: x["weight"])


def classify(matched: DataFrame, obfuscation: Column | None = None) -> DataFrame:
    """Adds the category scores, label probabilities, label, toxicity, severity and targets."""
    names = ["stereotype", "dehumanization", "harassment", "incitement", "offensive", "counterspeech"]
    scored = matched.withColumns({c: S.noisy_or(_weights(c)) for c in names})
    named = F.exists("matches", lambda x: x["label"].isNotNull() & ~x["slur"])
    slurs = F.filter("matches", lambda x: x["slur"])
    pattern = F.exists("matches", lambda x: x["targeted"] & x["label"].isNull() & (x["category"] != "counterspeech"))
    flagged = scored.withColumns({"has_target": named | (F.size(slurs) > 0) | pattern, "explicit": named | F.exists(slurs, lambda x: x["weight"] >= 0.5), "obfuscation": F.lit(0.0) if obfuscation is None else obfuscation})
    p = S.task_a(*[F.col(c) for c in names], F.col("has_target"), F.col("explicit"), F.col("obfuscation"))
    probable = flagged.withColumns({f"p_{k}": v for k, v in p.items()}).withColumn("label", S.argmax_label({k: F.col(f"p_{k}") for k in p})).withColumn("toxicity", F.round(1 - F.col("p_non_toxic"), 4))
    level, expected = S.severity(F.col("stereotype"), F.col("dehumanization"), F.col("harassment"), F.col("incitement"), F.col("toxicity"), F.col("has_target"))
    return probable.withColumn("severity", level).withColumn("expected_severity", F.round(expected, 4)).withColumn("targets", targets())


def targets() -> Column:
    """(category, label, confidence) of groups that a toxic text is about, the surest first."""
    hits = F.filter("matches", lambda x: x["label"].isNotNull())
    confidence = lambda x: F.when(x["slur"], S.slur_confidence(x["weight"])).otherwise(S.mention_confidence(F.col("toxicity")))
    keys = F.array_distinct(F.transform(hits, lambda x: F.struct(x["category"].alias("category"), x["label"].alias("label"))))

    def one(key: Column) -> Column:
        own = F.filter(hits, lambda x: (x["category"] == key["category"]) & (x["label"] == key["label"]))
        sure = F.round(S.noisy_or(F.transform(own, confidence)) * (1 - 0.5 * F.col("counterspeech")), 4)
        return F.struct((-sure).alias("minus"), key["category"].alias("category"), key["label"].alias("label"))

    ranked = F.filter(F.array_sort(F.transform(keys, one)), lambda x: -x["minus"] >= 0.3)
    out = F.transform(ranked, lambda x: F.struct(x["category"].alias("category"), x["label"].alias("label"), (-x["minus"]).alias("confidence")))
    return F.when(F.col("toxicity") < 0.3, F.slice(out, 1, 0)).otherwise(out)


def attributions(classified: DataFrame, text: str = "text") -> DataFrame:
    """Adds `attributions` (token, start, end, weight) and `top_positive`: each token has its strongest overlapping match's signed weight, scaled to [-1, 1]."""

    @F.arrow_udf("array<struct<token:string,start:int,end:int,weight:double>>")
    def weigh(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        token = re.compile(r"[\w'’]+|[^\w\s]")
        for columns in batches:
            for at in range(0, len(columns[0]), 256):  # few texts at a time are lists of tokens
                said, starts, ends, weights, first = [], [], [], [], [0]
                for text, marks, toxic in zip(*(c.slice(at, 256).to_pylist() for c in columns), strict=True):
                    for m in token.finditer(text or ""):
                        said.append(m[0])
                        starts.append(m.start())
                        ends.append(m.end())
                    weights += [0.0] * (len(said) - len(weights))
                    for m in marks:  # of equal strength the first mark stays
                        weight = signed(m, toxic)
                        for i in range(bisect_right(ends, m["start"], first[-1]), bisect_left(starts, m["end"], first[-1])):
                            if abs(weight) > abs(weights[i]):
                                weights[i] = weight
                    first.append(len(said))
                made = [pa.array(said, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(weights, pa.float64())]
                yield pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(made, ["token", "start", "end", "weight"]))

    def signed(m: dict, toxicity: float) -> float:
        if m["category"] == "counterspeech":
            return -m["weight"]
        if m["label"] is not None and not m["slur"]:
            return 0.2 * toxicity if toxicity >= 0.3 else 0.0
        return m["weight"]

    def scale(x: Column) -> Column:
        return F.transform(x["w"], lambda t: F.struct(t["token"].alias("token"), t["start"].alias("start"), t["end"].alias("end"), F.when(t["weight"] == 0, 0.0).otherwise(F.round(t["weight"] / x["most"], 4)).alias("weight")))

    # what tokens are weighed by is computed once a text, not once a token
    rows = classified.withColumn("__w", weigh(text, "matches", "toxicity"))
    most = F.greatest(F.coalesce(F.array_max(F.transform("__w", lambda x: F.abs(x["weight"]))), F.lit(0.0)), F.lit(1e-12))
    scaled = rows.withColumn("attributions", let(F.struct(F.col("__w").alias("w"), most.alias("most")), scale)).drop("__w")
    best = F.array_sort(F.transform(F.filter("attributions", lambda x: x["weight"] > 0), lambda x: F.struct((-x["weight"]).alias("minus"), x["start"].alias("start"), x["token"].alias("token"))))
    return scaled.withColumn("top_positive", F.slice(F.array_distinct(F.transform(best, lambda x: x["token"])), 1, 8))


def merge_attributions(a: Column, b: Column, same_text: Column, share: float = 0.6) -> Column:
    """Two attribution lists blended by place: `share` of a and the rest of b; a alone if they are of different texts."""
    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    other = F.map_from_entries(F.transform(b, lambda x: F.struct(place(x).alias("key"), x["weight"].alias("value"))))
    blend = lambda x: F.round(share * x["weight"] + (1 - share) * F.coalesce(F.try_element_at(other, place(x)), F.lit(0.0)), 4)
    both = F.transform(a, lambda x: F.struct(x["token"].alias("token"), x["start"].alias("start"), x["end"].alias("end"), blend(x).alias("weight")))
    return F.when(same_text, both).otherwise(a)


def scored_by(texts: DataFrame, scorer: Callable[[Column], Column], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds `score` and `flagged` of any scorer from a text column to numbers: a column expression or a pandas UDF."""
    return texts.withColumn("score", scorer(F.col(text)).cast("double")).withColumn("flagged", F.col("score") >= threshold)


def backend(name: str, lexicon: Lexicon | None = None, scorer: Callable[[Column], Column] | None = None, text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """The strategy that adds `toxicity`: `rules` classifies by a lexicon, `scorer` by a function of the text."""
    if name == "rules":
        return lambda texts: classify(matches(texts, lexicon or placeholder_lexicon(), text))
    if name == "scorer" and scorer is not None:
        return lambda texts: scored_by(texts, scorer, text).withColumnRenamed("score", "toxicity")
    raise ValueError(f"no backend {name}, or no scorer for it")


def with_parents(classified: DataFrame, key: str, parent: str) -> DataFrame:
    """Adds `parent_toxicity`: the parent's own score, by one join on numbers; texts are not read again."""
    side = classified.select(F.col(key).alias(parent), F.col("toxicity").alias("parent_toxicity"))
    return classified.join(side, parent, "left")
