"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is the list of its lines that hold a word, each hashed without its
outer white space.  Of every window of `run` lines the least hash is selected: it is
a fingerprint, a row of nothing but hash, document and position.  Two documents that
share `run` lines share a fingerprint at the same place of the shared run.

Fingerprints that stand at one place only are dropped.  The places of the others are
joined with the lines around them, and a match grows line by line, first to the
right and then to the left: places stay together while their next line is equal, and
a place that has none like it any more is dropped.  When a match has grown to `run`
lines, all its places but the earliest (smaller id, or same document and earlier
line) are later repeats.  Their lines are deleted; overlapping repeats join to runs.
So every run of `run` or more lines that appeared before is deleted, and its first
appearance stays.  With `words` a match of fewer lines, down to one, is as good as a
run if they hold more than so many words together; such windows have fingerprints too.

No pair of places is ever made: a place is compared with the earliest one of its
match, found by a pre-aggregated minimum, so a passage that a third of all documents
share costs no more than its rows.

Defined cases: a null text has no lines and stays null; blank lines are kept and
do not interrupt a run; lines are equal if two 64-bit hashes of them with different seeds
are, and so are matches; a row that is repeated, id included, is one document, and all
its copies are cut alike; different texts under one id are ordered by a hash; documents shorter than `run` lines keep all
unless `words` is given, and rows without an id keep all; other columns are carried
along, but for those with the name of an output, which are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.rules import WORD, let
from murmuration.llm.scratch import Scratch

RUN = 3
#: Fewer lines than a run go too if they hold more words than this.
WORDS = 50
#: Bytes up to which the runs to delete go to all tasks; beyond, documents are joined with them by a shuffle.
BROADCAST_BYTES = 16 << 20

#: A match is told by two hashes of its lines.
MATCH = ["c", "d"]

OUTER = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def hashed_lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, t, i, h, g, w): of each document the numbers, both hashes and word counts of its lines with a word."""
    value = F.col(f"`{text}`").cast("string")
    full = F.filter(_lines(value), lambda s: s["x"].rlike(WORD))

    def told(s: Column) -> Column:
        line = F.regexp_replace(s["x"], OUTER, "")
        words = F.regexp_count(s["x"], F.lit(f"{WORD}+"))
        return F.struct(s["i"].alias("i"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"), words.alias("w"))

    name = F.col(f"`{key}`")
    rows = docs.where(name.isNotNull()).select(name.alias("key"), F.xxhash64(value).alias("t"), F.transform(full, told).alias("s"))
    once = rows.where(F.size("s") > 0).groupBy("key", "t").agg(F.first("s").alias("s"))
    return once.select("key", "t", *(F.col("s")[c].alias(c) for c in "ihgw"))


def fingerprints(lined: DataFrame, run: int, words: int | None) -> DataFrame:
    """(key, t, at, c, d): the place and hashes of each line that a window selects; of equal least ones the first."""

    def selected(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("h") - size, F.lit(0)))
        if size < run:
            held = lambda i: reduce(lambda a, b: a + b, [F.get("w", i + j) for j in range(size)])
            starts = F.filter(starts, lambda i: held(i) > words)
        least = lambda part: F.array_position(part, F.array_min(part)).cast("int") - 1
        return F.when(F.size("h") >= size, F.transform(starts, lambda i: i + let(F.slice("h", i + 1, size), least)))

    sizes = [run] if words is None else range(1, run + 1)
    at = F.array_distinct(F.flatten(F.filter(F.array(*[selected(s) for s in sizes]), lambda x: x.isNotNull())))
    places = lined.select("key", "t", "h", "g", F.explode(at).alias("at"))
    return places.select("key", "t", "at", F.get("h", F.col("at")).alias("c"), F.get("g", F.col("at")).alias("d"))


def _several(places: DataFrame) -> DataFrame:
    """(c, d, first): the matches that stand at several places, with the earliest of these."""
    found = places.groupBy(MATCH).agg(F.min(F.struct("key", "t", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    return found.where("n > 1").drop("n")


def repeated_runs(docs: DataFrame, run: int = RUN, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """(key, t, runs): for each document with later repeats, the line intervals to delete."""
    scratch = Scratch(docs.sparkSession)
    lined = scratch.save(hashed_lines(docs, text, key))
    seeds = scratch.save(fingerprints(lined, run, words))

    def near(name: str) -> Column:
        """The values of the lines that a match around the fingerprint can reach."""
        at = F.col("at")
        return F.transform(F.sequence(F.lit(1 - run), F.lit(run - 1)), lambda j: F.when(at + j >= 0, F.get(name, at + j))).alias(name)

    held = "hg" if words is None else "hgw"
    around = seeds.join(_several(seeds), MATCH).join(lined, ["key", "t"]).select("key", "t", "at", *MATCH, "first", *map(near, held))
    matches = [scratch.save(around)]
    line = lambda name, j: F.get(name, F.lit(j + run - 1))

    def grown(places: DataFrame, j: int) -> DataFrame:
        longer = {"c": F.xxhash64("c", line("h", j)), "d": F.xxhash64("d", line("g", j))}
        further = places.where(line("h", j).isNotNull()).withColumns(longer).drop("first")
        matches.append(scratch.save(further.join(_several(further), MATCH)))
        return matches[-1]

    later: list[DataFrame] = []

    def note(places: DataFrame, left: int, right: int) -> None:
        """Notes the later places of a match of lines -left to right around the fingerprint, if it is long enough."""
        size = left + right + 1
        if size < run and words is None:
            return
        repeated = places.where(F.struct("key", "t", "at") > F.col("first"))
        if size < run:
            repeated = repeated.where(reduce(lambda a, b: a + b, [line("w", j) for j in range(-left, right + 1)]) > words)
        later.append(repeated.select("key", "t", (F.col("at") - left).alias("a"), (F.col("at") + right).alias("b")))

    match = matches[0]
    for right in range(run):
        match = grown(match, right) if right else match
        note(match, 0, right)
        wider = match
        for left in range(1, run - right):
            wider = grown(wider, -left)
            note(wider, left, right)
    widest = reduce(DataFrame.union, later).groupBy("key", "t", "a").agg(F.max("b").alias("b"))
    marks = widest.groupBy("key", "t").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("m"))
    # a match has `run` lines at most, so of the marks before only the last `run` can reach beyond this one
    r = F.col("r")
    reach = F.transform("m", lambda x, i: F.struct(x["a"].alias("a"), F.greatest(x["b"], *[F.get("m", i - j)["b"] for j in range(run)]).alias("b")))
    marks = marks.select("key", "t", reach.alias("r"))
    opens = F.filter(r, lambda x, i: F.coalesce(x["a"] > F.get(r, i - 1)["b"] + 1, F.lit(True)))
    ends = F.filter(r, lambda x, i: F.coalesce(F.get(r, i + 1)["a"] > x["b"] + 1, F.lit(True)))
    spans = marks.select("key", "t", F.zip_with(opens, ends, lambda a, b: F.struct(a["a"].alias("a"), b["b"].alias("b"))).alias("spans")).join(lined.select("key", "t", "i"), ["key", "t"])
    found = scratch.save(spans.select("key", "t", F.transform("spans", lambda s: F.struct(F.get("i", s["a"]).alias("first"), F.get("i", s["b"]).alias("last"))).alias("runs")))
    scratch.drop(lined, seeds, *matches)
    return found


def dedup(docs: DataFrame, run: int = RUN, text: str = "text", key: str = "doc_id", words: int | None = None) -> DataFrame:
    """All columns, the text without later repeated runs; then n_lines, n_removed_lines and n_runs."""
    runs = repeated_runs(docs, run, text, key, words).select(F.col("key").alias("__key"), F.col("t").alias("__t"), F.col("runs").alias("__runs"))
    held = runs.agg(F.coalesce(F.sum(F.size("__runs") * 16 + 48), F.lit(0))).first()[0]
    value = F.col(f"`{text}`").cast("string")
    joined = docs.join(F.broadcast(runs) if held <= BROADCAST_BYTES else runs.hint("shuffle_hash"), (F.col(f"`{key}`") == F.col("__key")) & (F.xxhash64(value) == F.col("__t")), "left")

    def cut(s: Column) -> Column:
        gone = lambda y: y["x"].rlike(WORD) & F.exists(F.col("__runs"), lambda r: y["i"].between(r["first"], r["last"]))
        kept = F.filter(s, lambda y: ~gone(y))
        return let(kept, lambda k: F.struct(F.array_join(F.transform(k, lambda y: y["x"]), "\n").alias("text"), (F.size(s) - F.size(k)).alias("removed")))

    done = F.when(F.col("__runs").isNotNull(), let(_lines(value), cut)).otherwise(F.struct(value.alias("text"), F.lit(0).alias("removed")))
    lined = F.coalesce(F.size(F.filter(F.split(value, "\n"), lambda x: x.rlike(WORD))), F.lit(0))
    out = joined.withColumn("__done", done).withColumn("__lines", lined)
    columns = [F.col("__done")["text"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed_lines", "n_runs")]
    return out.select(*columns, F.col("__lines").alias("n_lines"), F.col("__done")["removed"].alias("n_removed_lines"), F.coalesce(F.size("__runs"), F.lit(0)).alias("n_runs"))
