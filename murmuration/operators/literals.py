"""A required-literal index over rules: one scan of a text says which patterns can match it.

Every match of a pattern holds certain pieces of plain text.  They are read from the
parsed pattern as a conjunction of choices: `(?:stop|end) hate` holds one of `stop`, `end`
and it holds ` hate`.  All pieces of all rules and all group terms go into one
automaton, so a text is scanned once whatever the number of rules; then only rules of
which every choice was met run their pattern.  A rule without pieces always runs, so nothing
is ever missed.

Pieces are ASCII, in lower case; texts are folded one character to one, so that
places in the folded text are places in the text, as patterns that ignore case match.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

try:  # a faster automaton where it is installed
    import ahocorasick
except ImportError:
    ahocorasick = None

_parser = re._parser  # the standard library's own pattern parser

#: Stands for any group term in a pattern that is parsed for its pieces.
GROUP = "\ue000"
#: Characters that match ASCII letters when case is ignored, but whose lower case is not one.
FOLDS = {0x130: "i", 0x131: "i", 0x17F: "s"}
SHORTEST, CHOICES = 2, 3


def fold(text: str) -> str:
    return text.translate(FOLDS).lower()


def required(pattern: str) -> list[frozenset[str]]:
    """Choices of pieces, the longest first: every match of the pattern holds one piece of each choice.

    `GROUP` in a pattern gives the choice {GROUP}.
    """
    return _best(_choices(_parser.parse(pattern, re.I)))


def _best(found: list[frozenset[str]]) -> list[frozenset[str]]:
    usable = {c for c in found if c and all(p == GROUP or len(p) >= SHORTEST for p in c)}
    length = lambda c: min(len(p) if p != GROUP else 4 for p in c)
    return sorted(usable, key=lambda c: (-length(c), len(c), sorted(c)))[:CHOICES]


def _flat(items) -> Iterator[tuple]:
    """The items of a sequence, with plain groups opened."""
    for op, value in items:
        name = str(op)
        if name == "SUBPATTERN":
            yield from _flat(value[3])
        elif name == "ATOMIC_GROUP":
            yield from _flat(value)
        elif name.endswith("REPEAT") and value[0] == value[1] == 1:
            yield from _flat(value[2])
        else:
            yield name, value


def _choices(items) -> list[frozenset[str]]:
    found: list[frozenset[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    for name, value in _flat(items):
        if name == "LITERAL" and value < 128:
            run += fold(chr(value))
            continue
        if name == "AT" or name == "ASSERT_NOT":
            continue  # takes no room
        if name == "ASSERT":
            found += _choices(value[1])
            continue
        close()
        if name == "LITERAL" and chr(value) == GROUP:
            found.append(frozenset([GROUP]))
        elif name == "BRANCH":
            each = [_best(_choices(way)) for way in value[1]]
            if all(each):
                found.append(frozenset().union(*(e[0] for e in each)))
        elif name.endswith("REPEAT") and value[0] > 0:
            found += _choices(value[2])
    close()
    return found


@dataclass
class Index:
    """What tasks need of a lexicon: plain data, compiled once in each worker.

    rules: (category, weight, pattern, targeted); {G} stands for any group term; terms: folded
    term -> (category, label, weight, ambiguous, slur); group: the pattern of any group term.
    """

    rules: list[tuple[str, float, str, bool]]
    terms: dict[str, tuple[str, str, float, bool, bool]]
    group: str
    named: bool = True  # whether group terms are all that {G} can match

    def compiled(self) -> Scanner:
        return Scanner(self)


class Scanner:
    def __init__(self, index: Index):
        self.index = index
        self.patterns: dict[int, re.Pattern] = {}
        pieces: dict[str, int] = {}
        self.first: dict[int, list[tuple[int, list[frozenset[int]]]]] = defaultdict(list)
        self.always: list[int] = []
        for term in index.terms:
            pieces.setdefault(term, len(pieces))
        self.term_ids = dict(enumerate(pieces))
        of_terms = frozenset(range(len(pieces)))
        for i, (_, _, pattern, _) in enumerate(index.rules):
            choices = required(pattern.replace("{G}", GROUP))
            if not index.named:  # {G} then has choices of its own
                choices = [c for c in choices if GROUP not in c]
            sets = []
            for choice in choices:
                ids = {pieces.setdefault(p, len(pieces)) for p in choice if p != GROUP}
                sets.append(frozenset(ids | of_terms if GROUP in choice else ids))
            if not sets:
                self.always.append(i)
                continue
            for piece in sets[0]:
                self.first[piece].append((i, sets[1:]))
        self.scan = _automaton(pieces)
        self.edge = re.compile(r"[^\W_]")

    def candidates(self, met: set[int]) -> list[int]:
        """The rules that can match a text which holds these pieces, in the order of the rules."""
        out = set(self.always)
        for piece in met:
            for rule, others in self.first.get(piece, ()):
                if rule not in out and not any(o.isdisjoint(met) for o in others):
                    out.add(rule)
        return sorted(out)

    def pattern(self, rule: int) -> re.Pattern:
        if rule not in self.patterns:
            self.patterns[rule] = re.compile(self.index.rules[rule][2].replace("{G}", self.index.group), re.I)
        return self.patterns[rule]

    def find(self, text: str) -> list[tuple]:
        """(category, weight, start, end, targeted, label, slur) of every match of a rule, then of every group term."""
        folded = fold(text)
        places = defaultdict(list)
        met: set[int] = set()
        for end, piece in self.scan(folded):
            met.add(piece)
            if piece in self.term_ids:
                places[end - len(self.term_ids[piece]) + 1].append(end + 1)
        out = []
        for rule in self.candidates(met):
            category, weight, _, targeted = self.index.rules[rule]
            out += [(category, weight, m.start(), m.end(), targeted, None, False) for m in self.pattern(rule).finditer(text) if m.end() > m.start()]
        hostile = any(m[0] != "counterspeech" for m in out)
        at = 0
        for start in sorted(places):
            if start < at or (start and self.edge.match(text[start - 1])):
                continue
            for end in sorted(places[start], reverse=True):
                if end == len(text) or not self.edge.match(text[end]):
                    category, label, weight, ambiguous, slur = self.index.terms[folded[start:end]]
                    out.append((category, weight * (0.25 if ambiguous and not hostile else 1.0), start, end, True, label, slur))
                    at = end
                    break
        return out


def _automaton(pieces: dict[str, int]):
    """A function that gives (last place, piece) of all pieces in a text."""
    if not pieces:
        return lambda text: ()
    if ahocorasick is not None:
        made = ahocorasick.Automaton()
        for piece, number in pieces.items():
            made.add_word(piece, number)
        made.make_automaton()
        return made.iter
    by_length = defaultdict(dict)
    for piece, number in pieces.items():
        by_length[len(piece)][piece] = number

    def scan(text: str) -> Iterator[tuple[int, int]]:
        for length, known in by_length.items():
            for i in range(len(text) - length + 1):
                number = known.get(text[i : i + length])
                if number is not None:
                    yield i + length - 1, number

    return scan
