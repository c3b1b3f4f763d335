"""Quality rules, sharding and line dedup against brute force, and on awkward tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from murmuration.llm import lines, queries, rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule_counts(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    times = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if times[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    filled = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(filled) - len(set(filled)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rule_counts(spark, data, awkward):
    for docs in (queries.table(spark, data, "documents"), awkward):
        texts = Counter((r.doc_id, rule_counts(r.text)) for r in docs.collect())
        assert Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in rules.judge(docs).collect()) == texts


def test_rules_keep_good_documents_and_reject_junk(spark):
    """The method's verdict counts where the base rules, which reject every short text, leave one."""
    tables = "/root/testdata/sf0.01"  # 200 documents are too few to estimate nine rules from
    labels = {r.doc_id: r.quality for r in queries.table(spark, tables, "labels").collect()}
    judged = {r.doc_id: (r.base_failed, r.kept) for r in queries.op1_quality_rules(spark, tables).collect()}
    assert not any(failed and kept for failed, kept in judged.values())
    good = [judged[i][1] for i, q in labels.items() if q == 1 and not judged[i][0]]
    junk = [judged[i][1] for i, q in labels.items() if q == 0 and not judged[i][0]]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.4 * len(junk)


def test_rules_on_odd_tables(nothing, crowded):
    assert rules.judge(nothing).count() == 0
    assert rules.judge(crowded).count() == crowded.count()


def check_shards(rows, total, shards, slack):
    sizes, slots = Counter(), {}
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sum(sizes.values()) == total and set(sizes) <= set(range(shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert all(abs(sizes[i] - total / shards) <= slack for i in range(shards))


def test_shards_are_near_equal_and_keep_copies_together(spark, data):
    docs = queries.table(spark, data, "documents").select("doc_id", "text")
    rows = sharding.shard(docs, shards=6).collect()
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    check_shards(rows, total, 6, 0.05 * total / 6 + largest)
    assert len(rows) == docs.count()


def test_a_hot_text_is_cut_into_shards(spark):
    docs = spark.createDataFrame([(i, "hot" * 10 if i % 3 else f"own {i}") for i in range(3000)], "doc_id long, text string")
    for range_bytes in (1000, 80):  # the second has over a thousand sub-ranges
        rows = sharding.shard(docs, shards=8, range_bytes=range_bytes).collect()
        check_shards(rows, sum(r.size for r in rows), 8, 200)


def test_shards_of_odd_tables(awkward, nothing, crowded):
    rows = sharding.shard(awkward.select("doc_id", "text"), shards=3).collect()
    check_shards(rows, sum(r.size for r in rows), 3, 10**9)
    assert len(rows) == awkward.count() and sharding.shard(nothing).count() == 0
    made = sharding.shard(crowded)
    assert made.count() == crowded.count() and len(set(made.columns)) == len(made.columns)
    with pytest.raises(ValueError):
        sharding.shard(nothing, shards=0)


def brute_lines(rows, run):
    strip = " \t\n\x0b\x0c\r"
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").split("\n")
        filled = [i for i, x in enumerate(raw) if WORD.search(x)]
        gone = set()
        for k in range(len(filled) - run + 1):
            gram = tuple(raw[i].strip(strip) for i in filled[k : k + run])
            gone |= set(filled[k : k + run]) if gram in seen else set()
            seen.add(gram)
        out[key] = (None if text is None else "\n".join(x for i, x in enumerate(raw) if i not in gone), len(filled), len(gone))
    return out


@pytest.mark.parametrize("run", [2, 3])
def test_line_dedup(spark, data, awkward, run):
    for docs in (queries.table(spark, data, "documents"), awkward.dropDuplicates(["doc_id"]).where("doc_id is not null")):
        want = brute_lines([(r.doc_id, r.text) for r in docs.collect()], run)
        found = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in lines.dedup(docs.select("doc_id", "text"), run).collect()}
        assert found == want


def test_line_dedup_of_odd_tables(awkward, nothing, crowded):
    assert lines.dedup(nothing).count() == 0
    cut = lines.dedup(crowded)
    assert cut.count() == crowded.count() and len(set(cut.columns)) == len(cut.columns)
    assert cut.where("doc_id is null").first().n_removed_lines == 0


def brute_passages(rows, run, words):
    """As brute_lines, with windows of fewer lines that hold more than so many words."""
    strip = " \t\n\x0b\x0c\r"
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").split("\n")
        filled = [i for i, x in enumerate(raw) if WORD.search(x)]
        gone = set()
        for k in range(len(filled)):
            for part in (filled[k : k + n] for n in range(1, run + 1) if k + n <= len(filled)):
                gram = tuple(raw[i].strip(strip) for i in part)
                if len(part) == run or sum(len(WORD.findall(raw[i])) for i in part) > words:
                    gone |= set(part) if gram in seen else set()
                    seen.add(gram)
        runs = sum(a in gone and (not n or filled[n - 1] not in gone) for n, a in enumerate(filled))
        out[key] = (None if text is None else "\n".join(x for i, x in enumerate(raw) if i not in gone), len(filled), len(gone), runs)
    return out


def check_passages(docs, run, words):
    want = brute_passages([(r.doc_id, r.text) for r in docs.collect()], run, words)
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines, r.n_runs) for r in lines.dedup(docs.select("doc_id", "text"), run, words=words).collect()}
    assert found == want


@pytest.mark.parametrize("run, words", [(3, 50), (4, 7)])
def test_passages_of_few_lines(spark, data, awkward, run, words):
    for docs in (queries.table(spark, data, "documents"), awkward.dropDuplicates(["doc_id"]).where("doc_id is not null")):
        check_passages(docs, run, words)


def test_repeated_rows_are_one_document(spark):
    """All copies of a row are cut alike, and different texts under one id each by their own lines."""
    text = "\n".join(f"line {i} of the text" for i in range(6))
    rows = [(1, text), (1, text), (2, "own\n" + text), (2, "own\n" + text), (3, "a\nb\nc"), (3, "x\na\nb\nc")]
    kept = sorted((r.doc_id, r.text, r.n_removed_lines) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept[:4] == [(1, text, 0)] * 2 + [(2, "own", 6)] * 2
    assert sorted(n for _, _, n in kept[4:]) == [0, 3]


def test_matches_grow_from_one_line_that_stands_in_many_contexts(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(f"l{r.randrange(4)}" for _ in range(r.randrange(12)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for run in (1, 2, 3, 4):
        want = brute_lines(rows, run)
        assert {x.doc_id: (x.text, x.n_lines, x.n_removed_lines) for x in lines.dedup(docs, run).collect()} == want
    check_passages(docs, 4, 2)


def test_a_long_line_and_a_long_pair_go_from_short_documents(spark):
    line = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, line("a", 51)), (2, line("a", 51)), (3, line("b", 50)), (4, line("b", 50)), (5, line("c", 30) + "\n" + line("d", 21)), (6, "own\n" + line("c", 30) + "\n\n" + line("d", 21) + "\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_passages(docs, 3, 50)
    kept = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_lines(spark, docs.selectExpr("*", "'en' lang", "'s' source", "0L n_chars"), "").collect()}
    assert kept == {1: rows[0][1], 3: rows[2][1], 4: rows[3][1], 5: rows[4][1], 6: "own\n\nend"}
