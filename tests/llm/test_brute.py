"""Operators and stages that SQL cannot state, held against plain Python over whole small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline as pipeline
from murmuration.llm import decontam, neardup, ordinal, queries, rules, sharding, toxicity
from tests.llm.test_dedup import brute_classes
from tests.llm.test_native import brute_passages, rule_counts
from tests.llm.test_text_operators import brute_tiles


@pytest.fixture(scope="module")
def documents(spark, data):
    return queries.table(spark, data, "documents")


def naive_hits(matcher, text):
    """Each lexicon term and exception phrase looked for at every word's start, one by one."""
    folded = " " + matcher.fold(text)
    best, void = {}, []
    for phrase in matcher.model.exceptions:
        key = " " + matcher.fold(phrase).strip()
        void += [(m.start(), m.start() + len(key) - 1) for m in re.finditer(f"(?={re.escape(key)})", folded)]
    for term, weight in matcher.model.weights.items():
        key = " " + matcher.fold(term).strip()
        if key in {" " + matcher.fold(p).strip() for p in matcher.model.exceptions}:
            continue
        for m in re.finditer(f"(?={re.escape(key)})", folded):
            best[m.start()] = max(weight, best.get(m.start(), 0.0))
    hits = [w for at, w in best.items() if not any(a <= at <= b for a, b in void)]
    return math.fsum(hits), len(hits), folded.count(" ") + 1


def test_toxicity_of_every_document(spark, data, documents):
    model = toxicity.fit(toxicity.training_rows(documents, queries.table(spark, data, "labels")))
    matcher = toxicity.Matcher(model)
    want = {}
    for r in documents.collect():
        total, hits, words = naive_hits(matcher, r.text or "")
        x = model.bias + model.slopes[0] * math.log1p(total) + model.slopes[1] * math.log1p(100 * total / (words + 20))
        want[r.doc_id] = (1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), hits, total)
    scored = {r.doc_id: r for r in toxicity.score(documents, model, ["doc_id"]).collect()}
    assert {i: r.hits for i, r in scored.items()} == {i: h for i, (_, h, _) in want.items()} and any(h for _, h, _ in want.values())
    assert all(abs(r.score - want[i][0]) < 1e-9 and r.predicted == int(want[i][0] >= 0.7) for i, r in scored.items())


def test_held_out_is_never_null(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    want = {None: False, 1: zlib.crc32(b"1") % 3 == 1, 2: zlib.crc32(b"2") % 3 == 1}
    assert {r.doc_id: r.h for r in rows.select("doc_id", toxicity.held_out().alias("h")).collect()} == want


def test_shards_follow_a_full_sort(spark, data, documents):
    """Shards and slots are the order of all rows by checksum and a hash of the id, cut where bytes are near equal."""
    rows = sharding.shard(documents.select("doc_id", "text"), shards=5).collect()
    place = lambda r: (zlib.crc32((r.text or "").encode()) << 31) | (xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), 42) & ((1 << 31) - 1))
    in_order = sorted(rows, key=lambda r: (place(r), r.doc_id))
    assert [(r.shard, r.slot) for r in in_order] == sorted((r.shard, r.slot) for r in rows)
    below, fair = 0, sum(r.size for r in rows) / 5
    for r in in_order:
        assert (r.shard - 0.05) * fair - max(x.size for x in rows) <= below <= (r.shard + 1.05) * fair + max(x.size for x in rows)
        below += r.size


def test_quality_votes_and_estimation(documents):
    """Expectation-maximisation over all documents, one by one, gives the same posteriors."""
    judged = rules.judge(documents).collect()
    names = [c for c in judged[0].asDict() if c.startswith("vote_")]
    votes = [[getattr(r, c) for c in names] for r in judged]
    p = [0.95 if -1 not in v else 0.2 for v in votes]
    before = None
    for _ in range(25):
        good, bad = sum(p) + 1, len(p) - sum(p) + 1
        ratio = {}
        for k in range(len(names)):
            for side in (-1, 1):
                g = sum(q for q, v in zip(p, votes, strict=True) if v[k] == side)
                b = sum(1 - q for q, v in zip(p, votes, strict=True) if v[k] == side)
                mine, other = (0.6, 0.4) if side == 1 else (0.4, 0.6)
                x = math.log((g + mine) / (good + 1)) - math.log((b + other) / (bad + 1))
                ratio[k, side] = max(0.0, min(6.0, x)) if side == 1 else min(0.0, max(-6.0, x))
        odds = math.log(good / bad)
        p = [1 / (1 + math.exp(-(odds + sum(ratio[k, s] for k, s in enumerate(v) if s)))) for v in votes]
        if before and max(abs(ratio[k] - before[k]) for k in ratio) < 1e-6:
            break
        before = ratio
    for r, q in zip(judged, p, strict=True):
        assert abs(r.quality - q) < 2e-5 and r.kept == (not r.base_failed and r.quality >= 0.5)
    assert {r.doc_id: r.base_failed for r in judged} == {r.doc_id: rule_counts(r.text)[5] for r in documents.collect()}


def test_grades_are_those_of_the_cumulative_links(spark, data, documents):
    """Grades from the model's weights by plain sums; the sample's mean grades are in order."""
    graded = ordinal.graded_rows(documents, queries.table(spark, data, "labels"))
    model = ordinal.fit(graded, grades=3)
    import pyarrow as pa

    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    found = {r.doc_id: r for r in ordinal.grade(documents, model, ["doc_id"]).collect()}
    for i, text in texts.items():
        at, _, words = ordinal.feature_hashes(pa.record_batch([pa.array([text])], names=["text"]), "text", model.bits)
        score = math.fsum(float(model.weights[k]) for k in at) / math.sqrt(max(1, len(at)))
        tails = [1 / (1 + math.exp(-(score - c))) for c in model.thresholds]
        assert abs(found[i].expected_grade - sum(tails)) < 1e-4 and abs(found[i].tail_prob - tails[0]) < 1e-4
        assert found[i].kept == (found[i].tail_prob >= 0.5 and words[0] > 0)
    rows = [(r.grade, found[r.doc_id].expected_grade) for r in graded.collect()]
    means = [np.mean([e for g, e in rows if g == k]) for k in range(3) if any(g == k for g, _ in rows)]
    assert means == sorted(means)


@pytest.fixture(scope="module")
def stages(spark, data, documents, tmp_path_factory):
    out = [documents]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("brute") / str(i))
        stage(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [{r[0]: r for r in t.collect()} for t in out]


def test_toxic_stage(spark, data, documents, stages):
    matcher = toxicity.Matcher(toxicity.fit(toxicity.training_rows(documents, queries.table(spark, data, "labels"))))
    assert set(stages[1]) == {i for i, r in stages[0].items() if matcher.score(r.text or "")[0] < 0.7}


def test_line_stage(stages):
    cut = brute_passages([(i, r.text) for i, r in stages[1].items()], 3, 50)
    want = {i: text for i, (text, lines, gone, _) in cut.items() if gone == 0 or gone < lines}
    assert {i: r.text for i, r in stages[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in stages[2].values() if r.text is not None)


def test_near_duplicate_stage(stages):
    classes = brute_classes([(i, r.text) for i, r in stages[2].items()], 5, 80)
    assert set(stages[3]) == {i for i, (_, component) in classes.items() if component == i}


def test_benchmark_stage(spark, data, stages):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [tokens(r.text) for r in queries.table(spark, data, "benchmark").collect()]
    grams = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    seeds = [grams(x) for x in items]
    gone = set()
    for i, r in stages[3].items():
        own = tokens(r.text)
        mine = grams(own)
        for item, seed in zip(items, seeds, strict=True):
            near = {k + j for k in range(len(own) - 4) if tuple(own[k : k + 5]) in seed for j in range(5)}
            if not mine & seed or len(near) < 0.6 * len(item):
                continue
            text = [x if k in near else f"#{k}" for k, x in enumerate(own) if k in near or k - 1 in near]
            if sum(n for *_, n in brute_tiles(item, text, 5)) >= 0.6 * len(item):
                gone.add(i)
    assert set(stages[4]) == set(stages[3]) - gone and gone


def test_token_stage(stages):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.tokenizer_path())
    assert set(stages[5]) == set(stages[4])
    for i, r in stages[5].items():
        ids = known.encode(stages[4][i].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_with_empty_labels_and_benchmark(spark, data, awkward, tmp_path):
    for name in ("labels", "benchmark"):
        queries.table(spark, data, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = awkward
    for _, stage in pipeline.STAGES[:2] + pipeline.STAGES[3:]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() > 10


def test_a_hot_group_is_searched_in_parts(spark, monkeypatch):
    """Thousands of near copies in two components, some far from both hubs, against brute force by shared shingles."""
    import random

    r = random.Random(2)
    rows = []
    for base in range(2):
        words = [f"b{base}w{k}" for k in range(60)]
        for i in range(400):
            t = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                t[r.randrange(60)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.classes(docs, 2, 80).collect()}
    assert found == brute_classes(rows, 2, 80)


def test_coverage_needs_the_asked_share(spark):
    docs = spark.createDataFrame([(1, "a b c d e f x y"), (2, "a b c d e x f g h i j")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    assert [(x.doc_id, x.n_covered, x.n_tiles) for x in decontam.contaminated(docs, items).collect()] == [(1, 6, 1), (2, 10, 2)]
    assert [x.doc_id for x in decontam.contaminated(docs, items, coverage=0.7).collect()] == [2]
