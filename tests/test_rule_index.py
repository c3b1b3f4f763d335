"""The required-literal index against running every rule, and lexicons from files."""

from __future__ import annotations

import json
import random
import re

import pytest

from murmuration.operators import classify as C
from murmuration.operators import literals as L
from murmuration.plans import classification
from murmuration.sources import lexicons

OWN = [
    r"\b(all|every single) {G}\b", r"{G} (are|r|is) (so )?\w+", r"they'?re all (good|bad) at", r"(?:stop|end)\s+hat(?:e|red)", r"a{2,}bc?d", r"[xy]{G}", r"(?:x|yy)+zz", r"\d+ \w",
    r"(?=look)l\w+", r"no(?!t) way", r"ſtrange|kelvin", r"(foo|)bar", r"caf[eé] {G}", r"(?i:Mixed)CASE", r"é{2}", r"", r"it{1}em", r"(?:a|b)(?:cc|dd)(?:e+f|gg)",
]


def lexicon(others: bool = False) -> C.Lexicon:
    rules = [C.Rule(c, 0.3, p, "{G}" in p, plain=True) for c, p in zip(["stereotype", "harassment", "counterspeech"] * 9, OWN, strict=False)]
    terms = [C.Term("groupa", "religion", "a"), C.Term("groupa men", "religion", "am"), C.Term("Ünder", "nationality", "u"), C.Term("ill", "ethnicity", "i", 0.9, True), C.Term("a.b", "ethnicity", "dot", 0.5)]
    return C.Lexicon([*rules, *C.bank()], terms, ["them", "immigrants?"] if others else [])


def naive(lex: C.Lexicon, text: str) -> list[tuple]:
    index = lex.index()
    out = [(c, w, m.start(), m.end(), t, None, False) for c, w, p, t in index.rules for m in re.finditer(p.replace("{G}", index.group), text, re.I) if m.end() > m.start()]
    hostile = any(m[0] != "counterspeech" for m in out)
    known = {t.term.lower(): t for t in lex.terms}
    group = "|".join(re.escape(t) for t in sorted(known, key=lambda t: (-len(t), t)))
    for m in re.finditer(C._edges(f"(?:{group})"), text, re.I):
        t = known[L.fold(m[0])]
        out.append((t.category, t.weight * (0.25 if t.ambiguous and not hostile else 1.0), m.start(), m.end(), True, t.label, t.slur))
    return out


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    pool = """all every single groupa groupa men are is so good they're theyre bad at stop end hate hatred aaabcd aabd xgroupa ygroupa xyyzz yyzz 12 a look looks no way not
    ſtrange STRANGE kelvin Kelvin bar foobar café cafe Ünder ünder MIXEDcase mixedCASE éé item acceef bddgg ill İll ıll a.b them immigrant immigrants idiot idiots you rats kill attack nobody likes worthless people""".split()
    return [r.choice(["", " "]).join(r.choice(pool) + r.choice(["", " ", " ", ", ", "_", "\n"]) for _ in range(r.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("others", [False, True])
def test_every_match_is_found(others):
    lex = lexicon(others)
    scanner = lex.index().compiled()
    for text in [*texts(1, 1_500), "", "groupa groupa men", "w " * 50_000 + " idiots"]:
        assert scanner.find(text) == naive(lex, text), text


def test_scan_without_the_automaton_library(monkeypatch):
    monkeypatch.setattr(L, "ahocorasick", None)
    scanner = lexicon().index().compiled()
    for text in texts(2, 200):
        assert scanner.find(text) == naive(lexicon(), text)


def test_required_literals():
    assert L.required("(?:stop|end) hate") == [frozenset({" hate"}), frozenset({"stop", "end"})]
    assert L.required(r"ab(?:c)?d+e\w") == [frozenset({"ab"})]
    assert L.required("x|[a-z]+") == [] and L.required("") == []
    assert L.required("kill all " + L.GROUP)[0] == frozenset({"kill all "})


def test_rules_run_only_where_their_literals_are():
    """A thousand rules cost a text no more runs than those it can match."""
    rules = [C.Rule("offensive", 0.2, f"word{i}~thing{i}s?") for i in range(1_000)]
    scanner = C.Lexicon(rules).index().compiled()
    assert scanner.candidates({p for _, p in scanner.scan("word7 thing7 word9 thing10")}) == [7]
    assert not scanner.always


def test_lexicon_files(spark, tmp_path):
    files = {"t.json": {"religion": {"a": ["groupa", "Groupb"]}, "ethnicity": {"b": ["groupb"], "none": None}}, "s.json": {"slurx": {"label": "a", "weight": 0.9, "ambiguous": True}, "slury": None}, "p.json": {"incitement": [{"pattern": r"remove\s+{G}", "weight": 0.8}, {"pattern": "go~away"}]}}
    for name, held in files.items():
        (tmp_path / name).write_text(json.dumps(held))
    (tmp_path / "p.yaml").write_text("incitement:\n  - { pattern: 'remove\\s+{G}', weight: 0.8 }\n  - { pattern: 'go~away' }\n")
    for patterns in ("p.json", "p.yaml"):
        lex = lexicons.load(spark, str(tmp_path / "t.json"), str(tmp_path / "s.json"), str(tmp_path / patterns))
        assert [(t.term, t.category, t.label, t.weight, t.ambiguous) for t in lex.terms] == [("groupa", "religion", "a", 0.0, False), ("groupb", "ethnicity", "b", 0.0, False), ("slurx", "ethnicity", "a", 0.9, True), ("slury", "ethnicity", "unknown", 0.8, False)]
        assert [(r.category, r.weight, r.targeted) for r in lex.rules] == [("incitement", 0.8, True), ("incitement", 0.5, False)]
        rows = spark.createDataFrame([(1, "remove them, go~away"), (2, "remove groupB"), (3, "SLURX"), (4, None)], "id long, text string")
        got = {r.id: [(m.category, m.start, m.end, m.label) for m in r.matches] for r in C.matches(rows, lex).collect()}
        assert got == {1: [("incitement", 0, 11, None), ("incitement", 13, 20, None)], 2: [("incitement", 0, 13, None), ("ethnicity", 7, 13, "b")], 3: [("ethnicity", 0, 5, "a")], 4: []}
    (tmp_path / "bad.json").write_text(json.dumps({"incitement": [{"pattern": "x", "weight": 2}]}))
    with pytest.raises(ValueError, match="weight"):
        lexicons.load(spark, str(tmp_path / "t.json"), patterns=str(tmp_path / "bad.json"))


def test_documents_get_the_same_rows_as_from_every_rule(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in C.matches(docs, classification.lexicon()).collect()}
    scanner = classification.lexicon()
    assert got == {r.doc_id: naive(scanner, r.text or "") for r in docs.collect()}
