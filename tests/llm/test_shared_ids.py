"""Texts that share an id, and words that a polynomial hash modulo 2**64 cannot tell apart."""

from __future__ import annotations


from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from murmuration.llm import decontam, kernel, lines, neardup, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(name: str, n: int = 60) -> str:
    return " ".join(f"{name}{i * 7919 % 1000}" for i in range(n))


def thue_morse(n: int) -> tuple[str, str]:
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def shared(spark):
    """Ids 2 and 4 stand for two texts each; one of them is a copy of another document's."""
    first, lone = prose("t"), prose("u")
    rows = [(1, first), (2, first), (2, lone), (3, prose("v")), (4, lone + " end"), (4, prose("w")), (5, None), (5, ""), (None, first), (3, prose("v"))]
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)


def test_suffix_dedup_loses_no_unique_text(shared):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in substrings.dedup(shared, ["doc_id"]).collect())
    first, lone, end = prose("t"), prose("u"), prose("u") + " end"
    n = lambda s: len(s.encode())
    want = Counter({(1, n(first), 0, first): 1, (2, n(first), n(first), ""): 1, (2, n(lone), 0, lone): 1, (3, n(prose("v")), 0, prose("v")): 2, (4, n(end), n(lone), " end"): 1, (4, n(prose("w")), 0, prose("w")): 1, (5, 0, 0, ""): 2, (None, n(first), 0, first): 1})
    assert got == want


def test_line_dedup_loses_no_unique_text(shared):
    assert {r.text for r in lines.dedup(shared.select("doc_id", "text"), words=lines.WORDS).collect()} >= {prose("u"), prose("v"), prose("w")}


def test_classes_of_texts_not_ids(shared):
    got = Counter((r.doc_id, r.component_id) for r in neardup.classes(shared, k=5).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (None, 1): 1, (2, 2): 1, (4, 2): 1, (4, 4): 1, (3, 3): 2, (5, 5): 2})


def test_pipeline_stages_keep_other_texts_of_an_id(spark, shared):
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_class(spark, shared, "").collect())
    assert kept == Counter({(1, prose("t")): 1, (2, prose("u")): 1, (3, prose("v")): 1, (4, prose("w")): 1, (5, None): 1, (5, ""): 1})
    items = spark.createDataFrame([(1, prose("w"))], "item_id long, text string")
    left = Counter((r.doc_id, r.text) for r in decontam.decontaminate(shared, items).collect())
    assert left == Counter((r.doc_id, r.text) for r in shared.collect() if r.text != prose("w"))


@pytest.mark.parametrize("n", [63, 64, 65, 1_024, 4_096])
def test_long_words_are_told_apart(n):
    words = kernel.Words(*kernel.buffers(pa.array([" ".join(thue_morse(n)), *thue_morse(n), "x" * n, "x" * (n + 1)])))
    h = words.hashes()
    assert h[0] == h[2] and h[1] == h[3] and len(np.unique(h)) == 4


def test_word_hash_of_any_place_and_fold():
    texts = pa.array(["Abc  abc\nABC", "", " abc", None, "z" * 100 + " " + "z" * 100])
    h = kernel.Words(*kernel.buffers(texts)).hashes(kernel.LOWER)
    assert h[0] == h[1] == h[2] == h[3] and h[4] == h[5] and h[0] != h[4]


def test_documents_of_complementary_words_are_not_linked(spark):
    a, b = thue_morse(1_024)
    docs = spark.createDataFrame([(1, f"{a} {a}"), (2, f"{b} {b}"), (3, f"{a} {a}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.classes(docs, k=2).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(1, " ".join([a] * 30))], "item_id long, text string")
    odd = spark.createDataFrame([(1, " ".join([b] * 30)), (2, " ".join([a] * 30))], "doc_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(odd, items).collect()} == {2}

