"""Operators on small literal frames: series, behaviour, agreement, graphs, updates, scores."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from murmuration.functions import scoring as S
from murmuration.operators import behaviour, evaluation, graph, learning, trends, upsert

DAY = dt.date(2024, 1, 1)


def series(spark, values):
    return spark.createDataFrame([(DAY + dt.timedelta(i), v) for i, v in enumerate(values)], "d date, v long")


def test_robust_z_of_a_jump(spark):
    z = [r.z for r in trends.robust_z(series(spark, [5] * 20 + [40]), "d", "v").orderBy("d").collect()]
    assert z[:3] == [0.0, 0.0, 0.0] and z[-1] == 35.0


def test_gap_fill_and_empty(spark):
    rows = spark.createDataFrame([(DAY, 2), (DAY + dt.timedelta(3), 1)], "d date, v long")
    filled = trends.gap_filled(rows, "d", ["v"], F.lit("2024-01-06").cast("date")).orderBy("d").collect()
    assert [r.v for r in filled] == [2, 0, 0, 1, 0, 0]
    assert trends.gap_filled(rows.limit(0), "d", ["v"], F.lit("2024-01-06").cast("date")).count() == 0
    assert trends.empty_series(3, F.lit("2024-01-06").cast("date"), "d", ["v"], spark).count() == 3


def test_forecasts(spark):
    flat = trends.naive_forecast(series(spark, [10 + i % 7 for i in range(60)]), "d", "v", 3).collect()
    assert len(flat) == 3 and {r.forecast for r in flat} == {13.0} and all(r.low <= r.forecast <= r.high for r in flat)
    keyed = series(spark, [10 + i % 7 for i in range(60)]).withColumn("k", F.lit(1))
    waves = trends.holt_winters(keyed, "d", "v", ["k"], 7).orderBy("step").collect()
    assert max(abs(r.forecast - (10 + (60 + i) % 7)) for i, r in enumerate(waves)) < 1.5
    short = trends.holt_winters(keyed.limit(3), "d", "v", ["k"], 2).collect()
    assert len(short) == 2 and short[0].forecast == short[1].forecast


def test_event_lift(spark):
    rows = series(spark, [1, 1, 1, 4, 4, 4])
    events = spark.createDataFrame([(DAY + dt.timedelta(3), "x"), (DAY + dt.timedelta(90), "y")], "at date, title string")
    found = {r.title: r.lift for r in trends.event_lift(rows, "d", "v", events).collect()}
    assert found == {"x": 3.0, "y": 0.0}


def posts(spark, rows):
    return spark.createDataFrame(rows, "author_id long, post_id long, created_at timestamp_ntz, tox double, severity int, targets array<string>")


def test_timing_of_a_metronome(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(hours=4 * i), 0.9, 4, ["a"]) for i in range(30)] + [(2, 100, start, 0.1, 0, [])]
    found = {r.author_id: r for r in behaviour.timing(posts(spark, rows)).collect()}
    assert found[1].regularity == 1.0 and found[1].burstiness == 0.0
    assert (found[2].regularity, found[2].burstiness, found[2].posts_per_day) == (0.0, 0.5, 1.0)


def test_account_score_and_interval(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    rows = [(1, i, dt.datetime(2024, 1, 31), 1.0, 4, ["a", "b"]) for i in range(60)] + [(2, 99, dt.datetime(2024, 1, 31), 0.0, 0, [])]
    p = posts(spark, rows)
    found = {r.author_id: r for r in behaviour.account_scores(p, now).collect()}
    assert found[1].score == pytest.approx(0.4 + 0.3 + 0.2 * 2 / 6 + 0.1)
    assert found[2].score == 0.0
    ci = {r.author_id: r for r in behaviour.poisson_bootstrap(p, now).collect()}
    assert ci[1].ci_low == pytest.approx(found[1].score, abs=1e-4) and ci[1].ci_high == pytest.approx(found[1].score, abs=1e-4)
    assert ci[2].ci_low is None and ci[1].n_posts == 60


def test_pairwise_jaccard_keeps_the_first_forty(spark):
    rows = [(1, i, "same words") for i in range(41)] + [(2, 0, "lone")]
    found = {r.k: r for r in behaviour.pairwise_jaccard(spark.createDataFrame(rows, "k long, i long, t string"), "k", "t", "i").collect()}
    assert (found[1].n_pairs, found[1].mean_jaccard) == (780, 1.0) and (found[2].n_pairs, found[2].mean_jaccard) == (0, 0.0)


def test_kappa(spark):
    same = spark.createDataFrame([(i % 2, i % 2) for i in range(10)], "a int, b int")
    assert evaluation.cohen_kappa(same, []).first().kappa == 1.0
    cross = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert evaluation.cohen_kappa(cross, []).first().kappa == 0.0
    constant = spark.createDataFrame([(1, 1)], "a int, b int")
    assert evaluation.cohen_kappa(constant, []).first().kappa == 1.0
    ratings = spark.createDataFrame([(i, r, i % 2) for i in range(4) for r in "abc"], "item int, rater string, label int")
    assert evaluation.fleiss_kappa(ratings, "item", "rater", "label").first().kappa == 1.0


def test_calibration_is_the_smallest_good_threshold(spark):
    rows = [("a", s / 100, 0) for s in (10, 20, 30, 40, 60, 61, 62, 90)] + [("b", 0.1, 0)] * 6 + [("c", 0.9, 0)]
    found = {r.g: r.threshold for r in evaluation.calibrate(spark.createDataFrame(rows, "g string, score double, label int"), "g", target=0.25).collect()}
    assert found == {"a": 0.62, "b": 0.5, "c": 0.5}


def test_majority_breaks_ties_by_label(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (2, "b"), (2, "a")], "i int, l string")
    assert {r.i: r.l for r in evaluation.majority(rows, "i", "l").collect()} == {1: "a", 2: "b"}


def test_retrain_batch(spark):
    schema = "post_id long, annotator string, label string, severity int, targets array<string>, used boolean"
    rows = [(i // 2, "ab"[i % 2], "x", i % 3, ["t"], False) for i in range(20)]
    model = spark.createDataFrame([(i, "y" if i else "x") for i in range(10)], "post_id long, label string")
    batch = evaluation.retrain_batch(spark.createDataFrame(rows, schema), model)
    assert batch.count() == 10 and batch.where("corrected").count() == 9
    assert evaluation.retrain_batch(spark.createDataFrame(rows[:19], schema), model).count() == 0


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight long")


def test_pagerank_sums_to_one_with_dangling_ends(spark):
    rank = {r.id: r.rank for r in graph.pagerank(edges(spark, [(1, 2, 1), (2, 3, 2), (1, 3, 1)])).collect()}
    assert sum(rank.values()) == pytest.approx(1.0) and max(rank, key=rank.get) == 3


def test_communities_of_two_cliques(spark):
    rows = [(a, b, 5) for base in (0, 10) for a in range(base, base + 4) for b in range(base, base + 4) if a < b] + [(0, 10, 1)]
    found = {r.id: r.community for r in graph.communities(edges(spark, rows)).collect()}
    assert len({found[i] for i in range(4)}) == 1 and len({found[i] for i in range(10, 14)}) == 1 and found[0] != found[10]


def test_betweenness_of_a_path(spark):
    found = {r.id: r.betweenness for r in graph.betweenness(edges(spark, [(1, 2, 1), (2, 3, 1)])).collect()}
    assert found == {1: 0.0, 2: 0.5, 3: 0.0}


def test_thread_depth_of_a_chain(spark):
    rows = [(i, i - 1 if i else None) for i in range(60)] + [(100, 99)]
    found = {r.k: (r.root, r.depth) for r in graph.thread_depth(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    assert found[3] == (0, 3) and found[45] == (0, 45) and found[59][1] == 50 and found[100] == (100, 0)


def test_upsert_keeps_the_latest(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 5, "kept")], "id int, at int, v string")
    b = spark.createDataFrame([(1, 2, "new"), (2, 5, "tie"), (3, 1, "added")], "id int, at int, v string")
    assert {r.id: r.v for r in upsert.upsert(a, b, ["id"], "at").collect()} == {1: "new", 2: "tie", 3: "added"}


def test_updates(spark):
    p = spark.createDataFrame([(1, "a", False), (2, "b", False)], "id int, text string, deleted boolean")
    gone = upsert.removed_upstream(p, p.where("id = 1"), spark.createDataFrame([(9,)], "id int"), "id")
    assert {r.id for r in gone.collect()} == {2, 9}
    assert {r.id: (r.text, r.deleted) for r in upsert.soft_delete(p, gone, "id", "text").collect()} == {1: ("a", False), 2: ("[deleted upstream]", True)}
    known = spark.createDataFrame([("x", 1)], "author_id string, n int")
    named = spark.createDataFrame([("x",), ("y",), (None,)], "author_id string")
    assert [r.username for r in upsert.stub_authors(named, known).collect()] == ["user_y"]
    assert upsert.insert_absent(known, spark.createDataFrame([("x", 2), ("z", 1), ("z", 1)], "author_id string, n int"), ["author_id"]).count() == 2


def test_scores(spark):
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    lit = F.lit
    p = S.task_a(lit(0.0), lit(0.9), lit(0.2), lit(0.1), lit(0.0), lit(0.0), lit(True), lit(True), lit(0.0))
    found = row(**p, label=S.argmax_label(p))
    assert sum(found[k] for k in S.LABELS) == pytest.approx(1.0) and found.label == "hate_speech"
    assert row(x=S.argmax_label({"a": lit(0.5), "b": lit(0.5)})).x == "a"
    level, expected = S.severity(lit(0.0), lit(0.0), lit(0.8), lit(0.0), lit(0.9), lit(True))
    got = row(level=level, expected=expected)
    assert got.level == 3 and 2 < got.expected < 3
    assert row(x=S.noisy_or(F.array(lit(0.5), lit(0.5), lit(2.0)))).x == 1.0 and row(x=S.noisy_or(F.array().cast("array<double>"))).x == 0.0
    assert row(x=S.visual_ensemble(lit(0.3), lit(None).cast("double"))).x == 0.3 and row(x=S.visual_ensemble(lit(0.0), lit(0.99))).x == 0.95
    assert math.isclose(row(x=S.discount(lit("condemn"), lit(1.0), lit(1.0), lit(True), lit(True))).x, 0.2)
    assert row(x=S.review_priority(lit(0.5), lit(1)), y=S.review_priority(lit(0.1), lit(4))) == (1.0, 1.0)
    assert row(x=S.calibrated(lit(0.6), lit(None).cast("double"))).x is True


def test_forest(spark):
    rows = spark.createDataFrame([(str(i), i % 2, float(i % 2 * 5 + i % 3)) for i in range(200)], "id string, label int, f double")
    model, area = learning.train_accounts(rows, ["f"], trees=5)
    assert area == 1.0 and learning.score_accounts(model, rows).where("label = 1").agg(F.min("bot_probability")).first()[0] > 0.5


def brute_betweenness(rows):
    """With every vertex as a source."""
    near, ids = {}, sorted({v for a, b, _ in rows for v in (a, b)})
    for a, b, _ in rows:
        near.setdefault(a, set()).add(b)
    total = dict.fromkeys(ids, 0.0)
    for s in ids:
        depth, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near.get(v, ()):
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    order.append(w)
                paths[w] += paths[v] if depth[w] == depth[v] + 1 else 0
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if w in near.get(v, ()) and depth[w] == depth[v] + 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            total[w] += share[w] if w != s else 0
    return {v: x / ((len(ids) - 1) * (len(ids) - 2)) for v, x in total.items()}


def test_betweenness_stays_in_tables(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.randrange(25), r.randrange(25), 1) for _ in range(60)] + [(100 + i, 101 + i, 1) for i in range(6)]
    made = edges(spark, rows)

    def no_copy(self):
        raise AssertionError("the edges went through the driver")

    monkeypatch.setattr(type(made), "toPandas", no_copy)
    found = {r.id: r.betweenness for r in graph.betweenness(made).collect()}
    assert found == pytest.approx(brute_betweenness(rows))


def test_long_threads_keep_rows_and_depth(spark, tmp_path):
    from murmuration.plans import graph as plans

    turns = [(c, t) for c, n in ((1, 300), (2, 66), (3, 1)) for t in range(n)] + [(4, 1), (4, 2)]  # the last has no first turn
    spark.createDataFrame(turns, "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    found = [(r.conv_id, r.turn, r.depth) for r in plans.thread_depth(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted((c, t, t) for c, t in turns if c < 4)
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 1), (6, None)], "k long, p long")
    assert {r.k: r.depth for r in graph.thread_depth(circle, "k", "p").collect()}[6] == 0
