"""Near duplicates and repeated substrings against brute force, with small limits so that every path runs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string

import numpy as np
import pytest

from murmuration.llm import neardup, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_classes(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        p, q = sets[a], sets[b]
        if p and q and 100 * len(p & q) >= percent * len(p | q):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def check_classes(docs, k, percent=80):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs, k, percent).collect()}
    assert found == brute_classes([(r.doc_id, r.text) for r in docs.collect()], k, percent)


@pytest.mark.parametrize("k", [2, 5])
def test_classes(spark, data, k):
    check_classes(queries.table(spark, data, "documents"), k)


@pytest.mark.parametrize("common, broadcast", [(400, 2_000_000), (5, 1)])
def test_long_lists(spark, monkeypatch, common, broadcast):
    for name, value in (("LONG", 4), ("SEEN", 3), ("COMMON", common), ("BROADCAST_IDS", broadcast)):
        monkeypatch.setattr(neardup, name, value)
    r = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):  # copies of one text, each changed a little; some are linked only through others
        t = list(base)
        for _ in range(r.randrange(0, 6)):
            t[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(30)) + " the same old tail") for i in range(20)]
    check_classes(spark.createDataFrame(rows, "doc_id long, text string"), 2)


@pytest.mark.parametrize("long_", [1, 3, 64])
def test_groups_of_near_copies_that_are_not_all_linked(spark, monkeypatch, long_):
    """Members far from the hub find their partners by the deviations that they share."""
    monkeypatch.setattr(neardup, "LONG", long_)
    monkeypatch.setattr(neardup, "COMMON", 20)
    r = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows, parents = [], [base]
    for i in range(150):  # each a changed copy of the base or of an earlier copy, so that links come in chains and islands
        t = list(r.choice(parents[-6:] if i % 3 else parents[:1]))
        for _ in range(r.choice([0, 1, 2, 4, 7, 9])):
            at = r.randrange(len(t))
            t[at : at + r.randrange(3)] = [f"x{r.randrange(40)}"] * r.randrange(3)
        parents.append(t)
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base[:12] + [f"u{r.randrange(10**6)}" for _ in range(r.randrange(70))])) for i in range(40)]
    check_classes(spark.createDataFrame(rows, "doc_id long, text string"), 2)


def test_classes_of_odd_tables(awkward, nothing, crowded):
    clean = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_classes(clean, 2)
    assert neardup.classes(nothing).count() == 0
    assert neardup.classes(crowded).count() == crowded.count()


def test_sketch_size_is_safe():
    for n in (1, 2, 5, 20, 100, 1000, 50_000):
        for rare in {0, 1, n // 3, n // 2, n}:
            k, least = neardup.sketch_size(n, rare)
            assert 1 <= least <= k <= n - -(-4 * n // 5) + 1


def brute_cut(rows, length):
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        spans = []
        for i in range(len(raw) - length + 1):
            gram = raw[i : i + length]
            if gram in seen:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
            seen.add(gram)
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        out[key] = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def check_cut(docs, length=100, gram=32):
    rows = substrings.dedup(docs, ["doc_id"], length, gram, digest=True).collect()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert found == brute_cut([(r.doc_id, r.text) for r in docs.collect()], length)


def test_cuts(spark, data):
    check_cut(queries.table(spark, data, "documents"))


@pytest.mark.parametrize("group, broadcast, bits, memory", [(50_000, 2_000_000, 28, 32 << 20), (2, 1, 12, 1000)])
def test_cuts_by_every_path(spark, monkeypatch, group, broadcast, bits, memory):
    for name, value in (("GROUP", group), ("BROADCAST_ROWS", broadcast), ("FILTER_BITS", bits), ("MEMORY", memory), ("SHARD_BYTES", 5000)):
        monkeypatch.setattr(substrings, name, value)
    r = random.Random(8)
    passage = "".join(r.choice("abc é") for _ in range(60))
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randrange(40))) + passage * r.randrange(3) + "z" * r.randrange(60)) for i in range(60)]
    check_cut(spark.createDataFrame(rows, "doc_id long, text string"), 20, 7)


def test_cuts_of_odd_tables(awkward, nothing, crowded):
    check_cut(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert substrings.dedup(nothing, ["doc_id"]).count() == 0
    rows = substrings.dedup(crowded, ["doc_id", "key", "n_bytes", "n_removed", "kept"]).collect()
    assert len(rows) == crowded.count() and [r.n_removed for r in rows if r.doc_id is None] == [0]


def test_suffix_order():
    r = random.Random(3)
    for _ in range(200):
        symbols = r.choice([1, 2, 3, 26])
        t = [r.randrange(1, symbols + 1) for _ in range(r.randrange(1, 200))] + [0]
        order = substrings.Sorter(np.array(t, np.int16), 1000, r.choice([0, 100, 1 << 20])).order()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_cuts_leave_a_repeated_row_whole(awkward):
    docs = awkward.where("doc_id is not null")
    rows = substrings.dedup(docs, ["doc_id"], digest=True).collect()
    want = brute_cut({(r.doc_id, r.text) for r in docs.collect()}, 100)
    assert sorted(tuple(r) for r in rows) == sorted((r.doc_id, *want[r.doc_id]) for r in docs.collect())
