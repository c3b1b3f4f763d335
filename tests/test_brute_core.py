"""Queries that SQL cannot state, held against plain Python over the whole tables."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.functions import text as X
from murmuration.operators import behaviour, graph, modularity, similarity, trends
from murmuration.plans import graph as graph_plans
from murmuration.plans import text as text_plans


def brute_forecast(y, horizon, grid, width=1.28):
    n, seasonal = len(y), len(y) >= 21
    tail = y[-7:]
    mean = sum(tail) / len(tail)
    if n < 7 or not any(y):
        sd = (sum((x - mean) ** 2 for x in tail) / len(tail)) ** 0.5
        return [(max(0.0, mean), max(0.0, mean - width * sd), mean + width * sd)] * horizon
    best = None
    for a, b, c in grid:
        base = sum(y[:7]) / len(y[:7])
        level, trend, season, sse = base, 0.0, [x - base for x in y[:7]] if seasonal else [0.0] * 7, 0.0
        for t, x in enumerate(y):
            error = x - (level + trend + (season[t % 7] if seasonal else 0.0))
            level, trend = level + trend + a * error, trend + a * b * error
            season[t % 7] += c * (1 - a) * error if seasonal else 0.0
            sse += error * error
        if best is None or sse < best[0]:
            best = sse, level, trend, season
    sse, level, trend, season = best
    out = []
    for h in range(1, horizon + 1):
        centre = level + trend * h + (season[(n + h - 1) % 7] if seasonal else 0.0)
        band = width * (sse / n) ** 0.5 * h**0.5
        out.append((max(0.0, centre), max(0.0, centre - band), centre + band))
    return out


def test_forecast_by_the_best_weights(spark):
    r = np.random.default_rng(5)
    series = {"season": [float(10 + 5 * (i % 7 == 2) + r.integers(0, 3)) for i in range(60)], "trend": [float(i) for i in range(15)], "short": [3.0, 4.0], "zero": [0.0] * 30, "jump": [1.0] * 30 + [9.0] * 10}
    rows = [(k, i, v) for k, y in series.items() for i, v in enumerate(y)]
    found = defaultdict(list)
    for x in trends.holt_winters(spark.createDataFrame(rows, "k string, day int, v double"), "day", "v", ["k"], 5).orderBy("k", "step").collect():
        found[x.k].append((x.forecast, x.low, x.high))
    for k, y in series.items():
        assert np.allclose(found[k], brute_forecast(y, 5, trends.GRID), atol=6e-4), k


def test_searched_weights_are_never_worse_than_the_grid(spark):
    r = np.random.default_rng(5)
    series = {f"s{i}": [float(max(0, 20 + 0.3 * t + 6 * (t % 7 in (1, 2)) + r.normal(0, 1 + i))) for t in range(21 + 9 * i)] for i in range(5)} | {"short": [1.0, 2.0], "flat": [4.0] * 25, "zero": [0.0] * 25}
    better = 0
    for y in series.values():
        if len(y) < 7:
            continue
        start = min(trends.GRID, key=lambda w: trends.one_step_error(y, *w))
        found = trends.simplex(y, start, 200)
        assert all(trends.LOWEST <= v <= trends.HIGHEST for v in found)
        dense = min(trends.one_step_error(y, a, b, c) for a in np.linspace(0.01, 0.99, 12) for b in np.linspace(0.01, 0.99, 12) for c in np.linspace(0.01, 0.99, 12))
        grid, now = trends.one_step_error(y, *start), trends.one_step_error(y, *found)
        assert now <= grid + 1e-9 and now <= dense * 1.02 + 1e-9
        better += now < grid - 1e-6
    assert better >= 4
    rows = spark.createDataFrame([(k, i, v) for k, y in series.items() for i, v in enumerate(y)], "k string, day int, v double")
    found = defaultdict(list)
    for x in trends.holt_winters(rows, "day", "v", ["k"], 5, search=200).orderBy("k", "step").collect():
        found[x.k].append((x.forecast, x.low, x.high))
    for k, y in series.items():
        start = min(trends.GRID, key=lambda w: trends.one_step_error(y, *w))
        own = trends.simplex(y, start, 200) if len(y) >= 7 else start
        assert np.allclose(found[k], brute_forecast(y, 5, [start, own]), atol=6e-4), k


def test_betweenness_of_all_sources(spark, data):
    """Brandes' algorithm on the query's own edges, where all vertices are sources."""
    edges = {(r.src, r.dst) for r in graph_plans._edges(spark, data).select("src", "dst").collect()}
    out, ids = defaultdict(list), sorted({v for e in edges for v in e})
    for a, b in edges:
        out[a].append(b)
    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        depth, paths, order, before = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        part = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                score[w] += part[w]
    n = len(ids)
    assert n <= 200
    found = {r.id: r.betweenness for r in graph_plans.sampled_betweenness(spark, data).collect()}
    assert found == pytest.approx({v: x / ((n - 1) * (n - 2)) for v, x in score.items()}, abs=1e-9)


def test_label_propagation_step_by_step(spark, data):
    edges = [(r.src, r.dst, r.weight) for r in graph_plans._edges(spark, data).select("src", "dst", "weight").collect()]
    weight = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        weight[a][b] += w
        weight[b][a] += w
    ids = sorted(weight)
    turn = {r.id: r.t for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("t")).collect()}
    label = {i: i for i in ids}
    for step in range(12):
        fresh, moved = {}, False
        for i in ids:
            sums = defaultdict(float, {label[i]: 0.5})
            for j, w in weight[i].items():
                sums[label[j]] += w
            best = min(sums, key=lambda x: (-sums[x], x))
            fresh[i] = best if turn[i] == step % 2 else label[i]
            moved |= fresh[i] != label[i]
        label = fresh
        if step % 2 and not moved:
            break
    assert {r.id: r.community for r in graph.communities(graph.saved(graph_plans._edges(spark, data))).collect()} == label


def brute_clean(t):
    t = unicodedata.normalize("NFKC", t)
    t = "".join(c for c in t if unicodedata.category(c)[0] != "C" or c in "\n\t")
    for name in X.ENTITIES:
        t = t.replace(name, html.unescape(name) if name != "&nbsp;" else " ")
    t = re.sub(r"^\s*rt\s+@\w+:?\s*", "", t, flags=re.I)
    t = re.sub(r"(?:https?://\S+|www\.\S+|(?<![\w@.])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|io|co|ly|gov|edu|info)(?:/\S*)?(?!\w))", " ", t, flags=re.I)
    t = re.sub(r"(?<![\w@])@\w{1,15}(?!\w)", "@user", t)
    t = re.sub(r"#(\w+)", r" \1 ", t).replace("_", " ")
    t = re.sub(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", " ", t)
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").lower()


def test_normalised_texts_of_all_documents(spark, data):
    texts = {r.doc_id: r.t for r in text_plans._dirty(spark, data).collect()}
    found = {r.doc_id: (r.n_chars, r.clean_sha256) for r in text_plans.normalize_text(spark, data).collect()}
    want = {i: brute_clean(t) for i, t in texts.items() if t is not None}
    assert {i: found[i] for i in want} == {i: (len(c), hashlib.sha256(c.encode()).hexdigest()) for i, c in want.items()}


def test_bootstrap_draws_one_by_one(spark):
    posts = [(1 + i % 2, i, (i * 37 % 100) / 100, i % 5, f"t{i % 4}", i * 3.0) for i in range(40)]
    rows = spark.createDataFrame(posts, "author_id long, post_id long, tox double, severity int, t string, age double")
    rows = rows.select("author_id", "post_id", "tox", "severity", F.array("t").alias("targets"), (F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(secs=F.col("age") * 86400)).alias("created_at"))
    found = {r.author_id: (r.n_posts, r.ci_low, r.ci_high) for r in behaviour.poisson_bootstrap(rows.repartition(3), F.lit("2024-01-31").cast("timestamp"), resamples=60).collect()}
    mask, steps = (1 << 64) - 1, np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)])

    def draw(post, sample):
        x = (post * 0x9E3779B97F4A7C15 + sample * 0xBF58476D1CE4E5B9) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & mask
        return int(np.searchsorted(steps, (x >> 11) / (1 << 53)))

    for who in (1, 2):
        mine, scores = [p for p in posts if p[0] == who], []
        for sample in range(60):
            w = sev = tox = n_tox = recent = 0.0
            targets = set()
            for _, post, t, severity, target, age in mine:
                k, decay = draw(post, sample), 0.5 ** (age / 90)
                w, sev = w + k * decay, sev + k * decay * severity
                if t >= 0.5:
                    tox, n_tox, recent = tox + k * decay, n_tox + k, recent + k * (age <= 30)
                    targets |= {target} if k else set()
            of = lambda a, b: a / b if b else 0.0
            scores.append(0.4 * of(sev, w) / 4 + 0.3 * of(tox, w) + 0.2 * min(1.0, len(targets) / 6) + 0.1 * of(recent, n_tox))
        scores.sort()
        assert found[who] == pytest.approx((len(mine), scores[int(0.025 * 60)], scores[int(0.975 * 60)]), abs=6e-5)


def test_bootstrap_moves_posts_once_and_streams_agree_with_parts(spark):
    from pyspark.sql import functions as F

    posts = spark.range(3000).selectExpr("id AS post_id", "id % 7 AS author_id", "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 29 AS int)) AS created_at", "id % 11 / 10.0D AS tox", "cast(id % 5 AS int) AS severity", "array('a', substr('bcd', cast(id % 3 + 1 AS int), 1)) AS targets").repartition(5).localCheckpoint()
    now = F.lit("2024-01-31").cast("timestamp")
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved() -> int:
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    whole = sorted(map(tuple, behaviour.poisson_bootstrap(posts, now).collect()))
    assert moved() - before < 1.2 * 3000 and len(whole) == 7
    parts = sorted(map(tuple, behaviour.poisson_bootstrap(posts, now, one_stream=100).collect()))
    assert [w[:2] for w in whole] == [p[:2] for p in parts]
    assert all(abs(a - b) < 2e-4 for w, p in zip(whole, parts) for a, b in zip(w[2:], p[2:]))


def shuffled_bytes(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_duplicates_move_a_shingle_once(spark, tmp_path):
    """all rows as compared one by one, and little more shuffled than each shingle's hash with its set's id."""
    r = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 3000, r.integers(1, 300))) for _ in range(300)]
    for i in range(0, 60, 2):
        words = texts[i].split()
        words[:: max(60, len(words))] = ["changed"]
        texts += [" ".join(words), texts[i + 1].upper()]
    texts += ["common words " * n for n in range(1, 40)]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 3 else set(w))
    want = {}
    for j, b in enumerate(sets):
        near = [(len(a & b) / len(a | b), -i) for i, a in enumerate(sets[:j]) if len(a & b) >= 0.8 * len(a | b)]
        if near:
            want[j] = (-max(near)[1], round(max(near)[0], 6))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    before, setting = shuffled_bytes(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "-1")  # as of large tables
    try:
        found = {x.doc_id: (x.duplicate_of, round(x.similarity, 6)) for x in similarity.duplicates_of(spark.read.parquet(str(tmp_path / "t")), "doc_id", "text").collect()}
    finally:
        spark.conf.unset(setting)
    assert found == want and len(want) > 60
    moved = (shuffled_bytes(spark) - before) / sum(map(len, sets))
    assert moved < 45


def test_betweenness_of_a_long_walk_does_not_move_what_is_behind(spark):
    """F8: on a chain that is longer than what may be broadcast, rows shuffled are in proportion to those found."""
    n = 28
    edges = graph.saved(spark.createDataFrame([(i, i + 1, 1) for i in range(n - 1)], "src long, dst long, weight long").coalesce(1))
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    count = lambda s: sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()))
    before, setting = count(stages()), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "6000")
    try:
        found = {r.id: r.betweenness for r in graph.betweenness(edges).collect()}
    finally:
        spark.conf.unset(setting)
    assert found == pytest.approx({i: i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)}, abs=1e-9)
    moved = count(stages()) - before
    assert moved < 8 * n * (n + 1) // 2


def test_only_the_links_of_a_turn_are_dealt(spark):
    """a turn deals the links of its movers alone, and modularity is that of all links."""
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 30, 1 + i % 3) for i in range(30) if i != (i * 7 + 3) % 30], "src long, dst long, weight long")
    links = graph.saved(modularity.undirected(edges))
    members = graph.saved(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).select("id", (F.col("id") % 5).alias("community"), "k"))
    m2 = links.agg(F.sum("w")).first()[0]
    assert modularity._modularity(links, members, m2, 1.0) == pytest.approx(modularity.modularity(links, members), abs=1e-12)
    moved = modularity._move(links, members, m2, 1.0, 1, 3)
    assert "pmod(xxhash64(a#" in moved._jdf.queryExecution().optimizedPlan().toString()
    mine = {r.id for r in members.where(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(3)) == 1).collect()}
    was, now = ({r.id: r.community for r in t.collect()} for t in (members, moved))
    assert was.keys() == now.keys() and {i for i in was if was[i] != now[i]} <= mine
