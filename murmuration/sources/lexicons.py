"""Lexicons and rule banks from files.

Three files, JSON or YAML, hold what a classifier needs:

* targets: category -> label -> list of terms;
* slurs: term -> {category, label, weight, ambiguous};
* patterns: category -> list of {pattern, weight}; {G} in a pattern stands for any term.

They are dimension tables of some hundred entries.  Files are read by Spark, so any
store that the cluster reads will do, and validated before a job sees them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from murmuration.operators.classify import Lexicon, Rule, Term

#: What {G} matches besides terms.
GENERIC = ["them", "these people", "those people", "you people", "your kind", "your people", "immigrants?", "migrants?", "refugees?", "foreigners?", "minorit(?:y|ies)"]
#: What a slur without them has.
CATEGORY, LABEL, WEIGHT = "ethnicity", "unknown", 0.8


def _read(spark: SparkSession, path: str) -> dict:
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.rsplit(".", 1)[-1].lower() in ("yaml", "yml"):
        import yaml  # only needed for such files

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return found


def load(spark: SparkSession, targets: str, slurs: str | None = None, patterns: str | None = None, generic: list[str] | None = None) -> Lexicon:
    """The lexicon of the given files; of equal terms the last holds, slurs after targets."""
    terms = [Term(str(t).lower(), category, label) for category, labels in _read(spark, targets).items() for label, names in (labels or {}).items() for t in names or []]
    for term, about in (_read(spark, slurs) if slurs else {}).items():
        about = about or {}
        terms.append(Term(str(term).lower(), about.get("category", CATEGORY), about.get("label", LABEL), float(about.get("weight", WEIGHT)), bool(about.get("ambiguous", False))))
    rules = []
    for category, entries in (_read(spark, patterns) if patterns else {}).items():
        for entry in entries or []:
            pattern, weight = entry["pattern"], float(entry.get("weight", 0.5))
            if not 0 <= weight <= 1:
                raise ValueError(f"the weight {weight} of {pattern} is not in [0, 1]")
            re.compile(pattern.replace("{G}", "x"))
            rules.append(Rule(category, weight, pattern, "{G}" in pattern, plain=True))
    return Lexicon(rules, others=GENERIC if generic is None else generic).extend(terms)
