"""Toxicity, BPE, decontamination, licenses and the ordinal classifier."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from murmuration.llm import bpe, decontam, licenses, ordinal, queries, toxicity


def test_folding():
    fold = toxicity.Folder()
    same = [fold(x).strip() for x in ("idiot", "1D10T", "іdіоt", "id​iot", "IDIOT!!", "ｉｄｉｏｔ")]
    assert len(set(same)) == 1


def test_scores_normalise_and_heed_exceptions():
    matcher = toxicity.Matcher(toxicity.Model({"trash": 2.0, "idiot": 2.0}))
    assert matcher.total("put it in the trash can")[1] == 0
    assert matcher.total("you are trash, idiots")[1] == 2
    assert matcher.total("pretrash xidiot")[1] == 0
    short, long = matcher.score("idiot trash")[0], matcher.score("idiot trash " + "word " * 5000)[0]
    assert short > long > matcher.score("")[0] > 0


def test_toxicity_on_held_out_rows(spark, data):
    rows = queries.op2_toxicity(spark, data.replace("sf0.001", "sf0.01")).collect()
    labels = {r.doc_id: r.toxic for r in queries.table(spark, data.replace("sf0.001", "sf0.01"), "labels").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    clean = [p for y, p in held if y == 0]
    assert sum(clean) <= 0.03 * len(clean) and sum(p for y, p in held if y == 1) >= 0.6 * sum(y for y, _ in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_tables(spark, awkward, nothing, crowded):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.training_rows(awkward, labels))
    assert toxicity.score(nothing, model, ["doc_id"]).count() == 0
    found = toxicity.score(crowded, model, ["doc_id", "lang", "key", "score", "hits", "weight", "predicted"]).collect()
    assert len(found) == crowded.count() and {r.hits for r in found if r.doc_id == 16} == {2}
    base = {r.score for r in found if r.doc_id in (0, 1, 2)}
    assert len(base) == 1


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(queries.tokenizer_path())


def test_bpe_equals_the_library(coder, spark, data):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.tokenizer_path())
    r = random.Random(5)
    pool = "aaa bb'''s'll \n\t\r\x1c\x85\xa0　é漢字१२½ⅷ<|endoftext|>!?..,,  ́👍"
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(40))) + r.choice(["", "<|endoftext|>", "  "]) for _ in range(3000)]
    texts += [x.text for x in queries.table(spark, data, "documents").collect()] + ["a" * 3000, "ab" * 999, ""]
    ours = coder.encode(texts)
    theirs = known.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(o, "<u4").tolist() for o in ours] == [t.ids for t in theirs]
    assert [coder.decode(o) for o in ours] == [known.decode(t.ids, skip_special_tokens=False) for t in theirs]


def test_bpe_table(awkward, nothing, crowded):
    path = queries.tokenizer_path()
    for r in bpe.encode_decode(awkward, path, ["doc_id", "text"]).collect():
        assert r.decoded == (r.text or "")
    digest = bpe.encode_decode(crowded, path, ["doc_id", "text", "n", "n_tokens"], digest=True).collect()
    assert all(r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in digest)
    assert bpe.encode_decode(crowded, path, ["doc_id", "ids"]).count() == crowded.count()
    assert bpe.encode_decode(nothing, path, ["doc_id"]).count() == 0


def test_small_cache_gives_the_same_codes(coder, monkeypatch):
    texts = [f"word{i} and {i}" for i in range(300)]
    want = coder.encode(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    small = bpe.Coder(queries.tokenizer_path())
    assert [small.encode([t])[0] for t in texts] == want


def brute_tiles(item, text, least):
    """Greedy string tiling by comparing all places."""
    fi, ft, out = [True] * len(item), [True] * len(text), []
    while True:
        best = []
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and fi[p + n] and ft[t + n]:
                    n += 1
                if n >= least:
                    best.append((-n, p, t))
        if not best:
            return out
        longest = min(best)[0]
        for n, p, t in sorted(best):
            if n == longest and all(fi[p : p - n]) and all(ft[t : t - n]):
                fi[p : p - n] = [False] * -n
                ft[t : t - n] = [False] * -n
                out.append((p, t, -n))


@pytest.mark.parametrize("pairs", [decontam.PAIRS, 7])
def test_tiles_cover_as_brute_force_does(monkeypatch, pairs):
    monkeypatch.setattr(decontam, "PAIRS", pairs)
    r = random.Random(2)
    for _ in range(300):
        item = [r.randrange(3) for _ in range(r.randrange(3, 25))]
        text = [r.randrange(3) for _ in range(r.randrange(3, 40))]
        ours = decontam.tile(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        for p, t, n in ours:
            assert item[p : p + n] == text[t : t + n] and n >= 3
        covered = [i for p, _, n in ours for i in range(p, p + n)]
        assert len(set(covered)) == len(covered)
        theirs = brute_tiles(item, text, 3)
        assert sorted(n for *_, n in ours) == sorted(n for *_, n in theirs)


def test_contamination(spark, awkward, nothing, crowded, monkeypatch):
    r = random.Random(4)
    item = [f"b{r.randrange(999)}" for _ in range(40)]
    noise = lambda n: [f"z{r.randrange(9999)}" for _ in range(n)]
    docs = {
        1: noise(50) + item + noise(50),
        2: noise(20) + item[20:] + noise(30) + item[:20],
        3: item[:20] + noise(100),
        4: noise(200),
        5: [w.upper() + "," for w in item],
        6: noise(9000) + item + noise(9000),
    }
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    tests = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None), (3, "")], "item_id long, text string")
    found = {(x.doc_id, x.item_id): x for x in decontam.contaminated(table, tests).collect()}
    assert set(found) == {(1, 0), (2, 0), (5, 0), (6, 0)} and found[2, 0].n_tiles == 2 and found[1, 0].coverage == 1.0
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(table, tests).collect()} == set(found)
    assert {x.doc_id for x in decontam.decontaminate(table, tests).collect()} == {3, 4}
    assert decontam.contaminated(nothing, tests).count() == 0 == decontam.contaminated(awkward, tests.limit(0)).count()
    assert decontam.decontaminate(awkward, tests).count() == awkward.count()
    assert decontam.contaminated(crowded, tests).count() == 0 and decontam.decontaminate(crowded, tests).columns == crowded.columns


def brute_coverage(item: str, text: str, least: int) -> tuple[int, int]:
    tokens = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    tiles = brute_tiles(tokens(item), tokens(text), least)
    return len(tokens(item)), sum(n for *_, n in tiles)


def test_contamination_is_that_of_brute_force_tiling(spark):
    """Reordered, cut and repeated passages over few words, repeated rows and items, and a seed that all documents share."""
    r = random.Random(9)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(3, 30)))) for i in range(12)]
    rows = []
    for d in range(60):
        parts = ["w0 w1 w2 w3 w4"]
        for _ in range(r.randrange(3)):
            words = r.choice(items)[1].split()
            a = r.randrange(len(words))
            parts += [" ".join(words[a:]), "x" * r.randrange(1, 3), " ".join(words[:a])]
        r.shuffle(parts)
        rows.append((d, " ".join(parts)))
    rows, items = [*rows, rows[5]], [*items, items[3]]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, text in rows:
        for i, item in items:
            n, covered = brute_coverage(item, text, 5)
            if n and covered and covered >= 0.6 * n:
                want.append((d, i, n, covered))
    found = [(x.doc_id, x.item_id, x.n_tokens, x.n_covered) for x in decontam.contaminated(docs, tests).collect()]
    assert sorted(found) == sorted(want) and len(want) > 20


def test_tiling_a_long_text_of_few_words_is_quick():
    r = np.random.default_rng(3)
    item, text = r.integers(1, 4, 100).astype(np.uint64), r.integers(1, 4, 32_000).astype(np.uint64)
    assert sum(n for *_, n in decontam.tile(item, text)) > 60


def test_tiling_one_word_repeated_holds_few_pairs():
    """All windows are equal here: the tiles are whole, and memory follows the item and a block, not item times text."""
    item, text = np.full(200, 5, np.uint64), np.full(200_000, 5, np.uint64)
    tracemalloc.start()
    assert decontam.tile(item, text) == [(0, 0, 200)]
    ragged = np.where(np.arange(200_000) % 21 == 20, np.uint64(9), text)
    assert sum(n for *_, n in decontam.tile(item, ragged)) == 200
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20


def test_a_seed_alone_moves_no_text(spark, monkeypatch):
    """Rows that share one seed with a long item are met, but only texts with enough of its seeds reach the tiling."""

    def arrived(least, coverage):
        def run(batches):
            for batch in batches:
                one = pa.array(np.ones(batch.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item"), *[one] * 4], names=["key", "item", "n_tokens", "n_covered", "n_tiles", "longest"])

        return run

    monkeypatch.setattr(decontam, "_tiled", arrived)
    item = [f"b{i}" for i in range(50)]
    rows = [(1, item), (2, ["x", *item[:5], "y"]), (3, ["x", *item[10:45], "y"]), (4, ["x", *item[3:8], "y", *item[20:25]])]
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in rows], "doc_id long, text string")
    found = decontam.contaminated(docs, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert {x.doc_id for x in found.collect()} == {1, 3}


def test_planted_benchmark_passages(spark, data):
    docs, items = queries.table(spark, data, "documents").collect(), queries.table(spark, data, "benchmark").collect()
    whole = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    found = {(x.doc_id, x.item_id) for x in queries.op6_decontamination(spark, data).collect()}
    assert whole <= found and len(found) <= len(whole) + 1


def test_patience_alignment():
    a, b = [1, 2, 3, 4, 5, 6], [9, 1, 2, 8, 4, 5, 7, 6]
    pairs = licenses.align(a, b)
    assert [(a[i], b[j]) for i, j in pairs] == [(1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert licenses.align([], [1]) == [] and licenses.align([1, 1, 2], [1, 1, 3]) == [(0, 0), (1, 1)]


def brute_copies(template: list, tokens: list) -> int:
    """How many whole copies of a template stand in a text, back to back or apart."""
    n = at = 0
    while at + len(template) <= len(tokens):
        whole = tokens[at : at + len(template)] == template
        n, at = n + whole, at + (len(template) if whole else 1)
    return n


@pytest.mark.parametrize("name", ["Apache-2.0", "Apache-2.0-header", "MIT-text", "BSD", "MIT", "Zlib"])
def test_copies_of_a_license_are_told_apart(name):
    words = re.findall(r"[^\W_]+", licenses.TEMPLATES[name].lower())
    code = {w: i + 1 for i, w in enumerate(sorted(set(words)))}
    template, r = [code[w] for w in words], random.Random(3)
    needed = max(1, len(set(template)) - int(0.2 * len(template) + 1e-9))
    for copies in (0, 1, 2, 3, 6):
        for gap in (0, 1, len(template) // 4, len(template), 3 * len(template)):
            text = []
            for _ in range(copies):
                text += [r.choice([1, 2, 999]) if gap < 9 else 999 for _ in range(gap)] + template
            found = licenses._places(template, np.array(text, np.uint64), needed, 0.8)
            assert len(found) == copies == brute_copies(template, text)
    changed = list(template)
    changed[len(changed) // 2] = 999
    found = licenses._places(template, np.array(changed * 4, np.uint64), needed, 0.8)
    assert [n for n, _, _ in found] == [len(template) - 1] * 4


def test_bank_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("you may use this thing as you like but never sell it to anybody else")
    bank = licenses.read_bank(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "x y You may use this thing, as you like; but never sell it to anybody else! z")], "doc_id long, text string")
    assert list(bank) == ["Own-1.0"] and [r.license for r in licenses.scan(docs, bank).collect()] == ["Own-1.0"]
    with pytest.raises(ValueError):
        licenses.read_bank(spark, str(tmp_path), most_bytes=3)


def test_license_scan(spark, awkward, nothing, crowded):
    gone = "noise " * 50
    texts = {
        1: licenses.TEMPLATES["MIT-text"],
        2: gone + licenses.TEMPLATES["BSD"].replace("source", "original").upper() + gone,
        3: "Released under the MIT License.\nReleased under the MIT License.",
        4: gone,
        5: "license mit the under released words in the wrong order are none",
    }
    found = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {(1, "MIT-text"), (2, "BSD"), (3, "MIT")} <= set(found) and found[3, "MIT"].n_places == 2
    assert {d for d, _ in found} == {1, 2, 3} and 0.8 <= found[2, "BSD"].coverage < 1
    assert licenses.scan(crowded).count() == licenses.scan(awkward).count()
    assert licenses.scan(nothing).count() == 0 and {r.doc_id for r in licenses.scan(awkward).collect()} == {15}


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(1)
    grade = r.integers(0, 3, 600)
    lists = [np.r_[r.integers(0, 900, 20), 900 + 10 * g + r.integers(0, 10, 6)] for g in grade]
    first = np.cumsum([0, *map(len, lists)])
    model = ordinal.fit_arrays(np.concatenate(lists), first, grade, 3, 10, 1e-4)
    assert (np.diff(model.thresholds) > 0).all()
    expected = model.tails(model.scores(np.concatenate(lists), first)).sum(1)
    means = [expected[grade == g].mean() for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.6 < means[2]


def test_quality_on_rows_outside_the_sample(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    docs, labels = queries.table(spark, big, "documents"), queries.table(spark, big, "labels")
    fit = ordinal.fit(ordinal.graded_rows(docs, labels.where("doc_id % 2 = 0")), grades=3)
    graded = {r.doc_id: r.kept for r in ordinal.grade(docs, fit, ["doc_id"]).collect()}
    rest = [(r.quality, graded[r.doc_id]) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in graded]
    good, junk = [k for q, k in rest if q == 1], [k for q, k in rest if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(junk) <= 0.35 * len(junk)


def test_quality_of_odd_tables(spark, awkward, nothing, crowded):
    labels = spark.createDataFrame([(9, 1, 0), (12, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = ordinal.fit(ordinal.graded_rows(awkward, labels), grades=3)
    rows = ordinal.grade(crowded, model, ["doc_id", "n", "kept", "tail_prob"]).collect()
    assert len(rows) == crowded.count() and not any(r.kept for r in rows if r.doc_id in (0, 1, 2))
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert ordinal.grade(nothing, model, ["doc_id"]).count() == 0
    none = ordinal.fit(ordinal.graded_rows(awkward, labels.limit(0)), grades=3)
    assert ordinal.grade(awkward, none, ["doc_id"]).count() == awkward.count()
