"""The Merkle manifest, the mix of sources and the prefix trie against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from murmuration.llm import merkle, mixing, queries, ranks, trie
from murmuration.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_running_totals_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 10)
    r = random.Random(3)
    rows = [("a" if r.random() < 0.6 else r.choice("bcd"), r.choice([None, 1, 2, 2, 2]), r.randrange(9)) for _ in range(600)]
    scratch = Scratch(spark)
    got = ranks.running(scratch.save(spark.createDataFrame(rows, "g string, o int, v long")), ["g"], ["o"], ["v"], scratch).collect()
    assert Counter((x.g, x.o, x.v) for x in got) == Counter(rows)
    for g in "abcd":
        held = sorted((x for x in got if x.g == g), key=lambda x: x.before)
        assert [x.before for x in held] == list(range(len(held)))
        assert [x.before_v for x in held] == [sum(y.v for y in held[:i]) for i in range(len(held))]
        assert [x.o is not None and x.o for x in held] == sorted(x.o is not None and x.o for x in held)


def lower(t: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def tree(level: list[str]) -> tuple[str, list[list[list[str]]]]:
    """The top, and all levels as runs."""
    levels = []
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        levels.append(runs)
        level = [sha(*run) for run in runs]
    return level[0], levels


def manifest(rows: list) -> Counter:
    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    first = lambda v: (v is not None, v if v is not None else 0)
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(((first(r.doc_id), leaf(r, r.text)), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda x: x[0])
    tops = {lang: tree([x[0][1] for x in groups[lang]]) for lang in langs}
    root, upper = tree([tops[lang][0] for lang in langs])
    out = Counter()
    for i, lang in enumerate(langs):
        top, lower_levels = tops[lang]
        for j, ((_, h), r) in enumerate(groups[lang]):
            hit = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            now, told = leaf(r, lower(r.text)) if hit else h, []
            for levels, at in ((lower_levels, j), (upper, i)):
                for runs in levels:
                    run, k = list(runs[at // 8]), at % 8
                    told += run[:k] + run[k + 1 :]
                    run[k] = now
                    now, at = sha(*run), at // 8
            out[r.doc_id, h, top, root, sha(*told), now, now == root] += 1
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.fixture
def as_tables(spark, tmp_path):
    def write(name, df):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_manifest_is_brute_force(spark, data, awkward, as_tables):
    for place, docs in ((data, queries.table(spark, data, "documents")), (as_tables("documents", awkward), awkward)):
        got = queries.op12_merkle_manifest(spark, place)
        assert Counter(tuple(r[c] for c in MANIFEST) for r in got.collect()) == manifest(docs.collect())


@pytest.mark.parametrize("sizes", [[1], [9], [1] * 70, [513, 64, 8, 2, 1]])
def test_manifest_of_all_shapes(spark, as_tables, sizes):
    rows = [(i * 1000 + j, f"T{j}", None if i == 3 else f"l{i}", "s", 2) for i, n in enumerate(sizes) for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = queries.op12_merkle_manifest(spark, as_tables("documents", docs)).collect()
    assert Counter(tuple(r[c] for c in MANIFEST) for r in got) == manifest(docs.collect())
    assert all(r.verified for r in got if zlib.crc32(str(r.doc_id).encode()) % 3)


def test_manifest_of_no_rows(spark, nothing, as_tables):
    assert queries.op12_merkle_manifest(spark, as_tables("documents", nothing)).count() == 0


def highest(weights: list[float], caps: list[int], seats: int) -> list[int]:
    won, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while seats:
        _, i = heapq.heappop(heap)
        if won[i] == caps[i]:
            continue
        won[i] += 1
        seats -= 1
        heapq.heappush(heap, (-weights[i] / (2 * won[i] + 1), i))
    return won


def test_apportion_takes_the_highest_quotients(spark):
    r = random.Random(5)
    rows, seats, caps = [], {}, {}
    for g in range(12):
        n = r.choice([1, 2, 5, 30])
        for c in range(n):
            w = r.choice([1.0, 2.0, 2.0, r.random() * 50])
            rows.append((f"g{g}", c, w, int(w * 2) + r.choice([0, 1, 3])))
        seats[f"g{g}"] = min(sum(x[3] for x in rows if x[0] == f"g{g}"), int(sum(x[2] for x in rows if x[0] == f"g{g}") * r.choice([0, 0.3, 1, 2])))
    scratch = Scratch(spark)
    cells = scratch.save(spark.createDataFrame(rows, "g string, c long, weight double, cap long"))
    asked = scratch.save(spark.createDataFrame(list(seats.items()), "g string, seats long"))
    got = {(x.g, x.c): x.quota for x in mixing.apportion(cells, asked, ["g"], "c", scratch).collect()}
    for g in seats:
        held = [x for x in rows if x[0] == g]
        assert [got[g, x[1]] for x in held] == highest([x[2] for x in held], [x[3] for x in held], seats[g]), g


def filled(sizes: list[int], weights: list[float], share: float) -> list[float]:
    """Targets by sharing the excess again and again."""
    target, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > 2 * sizes[i] * (1 + 1e-12)}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


def mixed(spark, docs, block, shard):
    rows = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", F.lit(7)).alias("at")).collect()
    sizes = [len(WORD.findall(r.text or "")) for r in rows]
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for r, n in zip(rows, sizes, strict=True) if r.source == s) for s in names}
    goal = dict(zip(names, filled([total[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5), strict=True))
    n_blocks = {s: -(-total[s] // block) for s in names}
    some = [s for s in names if total[s]]
    share = [goal[s] * n_blocks[s] / total[s] for s in some]
    by_source = dict(zip(some, highest(share, [2 * n_blocks[s] for s in some], int(sum(share) + 1e-6)), strict=True))
    copies = {}
    for s in some:
        lengths = [min(shard, n_blocks[s] - k) for k in range(0, n_blocks[s], shard)]
        starts = spark.createDataFrame([("1" if s is None else "0" + s, k) for k in range(len(lengths))], "s string, k long").select("k", F.xxhash64("s", "k", F.lit(7)).alias("h"))
        start = {x.k: x.h % lengths[x.k] for x in starts.collect()}
        got = []
        for k, (n, q) in enumerate(zip(lengths, highest(lengths, [2 * x for x in lengths], by_source[s]), strict=True)):
            got += [q // n + ((b * (q % n) + start[k]) % n >= n - q % n) for b in range(n)]
        assert sum(got) == by_source[s] and set(got) <= {0, 1, 2}
        copies[s] = got
    out = Counter()
    for s in names:
        at = 0
        for _, i in sorted((((r.at, r.doc_id is not None, r.doc_id or 0, n), i) for i, (r, n) in enumerate(zip(rows, sizes, strict=True)) if r.source == s), key=lambda x: x[0]):
            out[rows[i].doc_id, sizes[i], total[s], round(goal[s], 6), sum(copies[s][w // block] for w in range(at, at + sizes[i]))] += 1
            at += sizes[i]
    return out, goal


@pytest.mark.parametrize(("block", "shard"), [(32, 1 << 15), (8, 20)])
def test_mix_is_brute_force(spark, data, awkward, block, shard):
    for docs in (queries.table(spark, data, "documents"), awkward):
        want, goal = mixed(spark, docs, block, shard)
        got = mixing.mix(docs, block=block, shard=shard).collect()
        assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r.size
        assert all(abs(taken[s] - goal[s]) <= 3 * block for s in goal)


def test_mix_gives_the_words_it_counts(spark, data):
    docs = queries.table(spark, data, "documents").where("doc_id < 60")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block=16, shard=30).collect()}
    texts = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    got = Counter()
    for r in mixing.blocks(docs, block=16, shard=30).collect():
        words = r.words.split(" ")
        assert texts[r.doc_id][r.first : r.first + len(words)] == words
        got[r.doc_id] += r.copies * len(words)
    assert {i: got[i] for i in taken} == taken


def test_mix_on_odd_tables(spark, nothing, crowded):
    assert mixing.mix(nothing).count() == 0
    first, again = (Counter(map(tuple, mixing.mix(d).select("doc_id", "taken").collect())) for d in (crowded, crowded.repartition(7)))
    assert first == again
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(empty).collect()} == {(0, 0.0, 0)}


def brute_trie(rows: list, rebuilt: bool = True) -> list[tuple]:
    convs = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            name = hashlib.sha256(f"{len((r.role or '').encode())}:{r.role or ''}{r.text or ''}".encode()).digest()
            convs[r.conv_id].append(((r.turn is not None, r.turn or 0, name), (r.role or "", r.text or "")))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - int(c - c // 20 * 20), [])[: h[c]] + t[h[c] :] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children, below = Counter(p[:-1] for p in members if p), defaultdict(lambda: [0, 0])
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]][0] += not children[p]
            below[p[:d]][1] += (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], *below[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()
    )


def nodes_of(df) -> list[tuple]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.select(*names).collect())


CONV = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talk(spark):
    """Shared starts of many lengths, copies, a very long conversation, repeated and null turns, and columns with clashing names."""
    r = random.Random(11)
    start = [("user", f"w{i} a b") for i in range(40)]
    rows = []
    for c in range(240):
        kind = c % 6
        body = {0: start[: r.randrange(1, 41)], 1: start[:12], 2: [("system", "be good"), *start[:3], ("user", f"x{r.randrange(4)}")], 3: [("user", r.choice("abc")) for _ in range(r.randrange(6))], 4: start[: r.randrange(3)] + [("user", f"own {c}")] * r.randrange(4), 5: start[:30] + [("assistant", f"e{r.randrange(3)}")]}[kind]
        rows += [(c * 3, i, role, text) for i, (role, text) in enumerate(body)]
    rows += [(9_000_000_001, i, "user", f"long {i % 7}") for i in range(250)]
    rows += [(5, None, None, None), (5, 0, "user", None), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (None, 0, "user", "lost"), (7, 0, "", " \t\n"), (8, 3, "user", "É " * 50_000)]
    return spark.createDataFrame(rows, CONV).withColumn("seq", F.lit(1)).withColumn("key", F.lit("k"))


def test_trie_is_brute_force(spark, data, talk):
    """Small buckets, so that many rounds run, over rebuilt conversations, and production buckets over both forms."""
    assert nodes_of(trie.rebuilt_trie(talk, 30)) == brute_trie(talk.collect())
    given = queries.table(spark, data, "conversations")
    assert nodes_of(trie.rebuilt_trie(given)) == brute_trie(given.collect())
    assert nodes_of(trie.trie(given)) == brute_trie(given.collect(), rebuilt=False)


def test_trie_on_odd_tables(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], CONV)).count() == 0
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    turnless = spark.createDataFrame([(alone, 0, "user", "a"), (alone, 1, "user", "b")], CONV)
    assert nodes_of(trie.rebuilt_trie(turnless)) == [(alone, 0, -1, 1, 0, 1, 0, sha(str(alone)))]
    copies = spark.createDataFrame([(c * 20, t, "user", f"same {t}") for c in range(300) for t in range(9)], CONV)
    assert nodes_of(trie.rebuilt_trie(copies)) == brute_trie(copies.collect())


@pytest.mark.parametrize("name", ["op5_line_dedup", "op11_prefix_trie", "op12_merkle_manifest"])
def test_statements_give_the_same_rows(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, data).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
