"""Streams with keyed state against their batch twins, over restarts and any order of arrival."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmuration.operators import similarity, trends
from murmuration.streaming import ingest, state

DAY = datetime(2024, 1, 1)


@pytest.fixture
def stream_of(spark, tmp_path):
    """Writes row lists as one file each and runs a stream over them, in as many restarts as there are parts."""
    state.use_state_store(spark)

    def run(parts, schema, make):
        for n, part in enumerate(parts):
            for i, rows in enumerate(part):
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}-{i}")
                spark.sparkContext._jvm.Thread.sleep(20)  # files are read by age
            stream = ingest.read_rows(spark, f"{tmp_path}/in/*", schema, files=1)
            writer = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
            ingest.run_available(writer)
        return spark.read.parquet(f"{tmp_path}/out")

    return run


def test_near_duplicates_of_a_stream_are_those_of_all_batches(spark, data, stream_of):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("length(text) < 3000 and doc_id < 110")
    rows = [(r.doc_id, r.text, DAY + timedelta(minutes=r.doc_id)) for r in docs.collect()]
    rows += [(10_000 + i, rows[3][1], DAY) for i in range(5)] + [(-1, rows[3][1], DAY + timedelta(hours=1)), (20_000, None, DAY), (20_001, "", DAY)]
    random.Random(4).shuffle(rows)
    n = len(rows) // 3
    schema = "doc_id long, text string, at timestamp"
    pairs = stream_of([[rows[:n]], [rows[n : 2 * n], rows[2 * n :]]], schema, lambda s: state.near_duplicate_pairs(s, "doc_id", "text", "at", late="30 days"))
    got = {r.doc_id: (r.duplicate_of, round(r.similarity, 6)) for r in state.verdicts(pairs, "doc_id").collect()}
    want = similarity.duplicates_of(spark.createDataFrame(rows, schema), "doc_id", "text").collect()
    assert got == {r.doc_id: (r.duplicate_of, round(r.similarity, 6)) for r in want} and len(got) > 5


def test_near_duplicate_state_ends(spark, stream_of):
    text = " ".join(f"w{i}" for i in range(30))
    days = [(1, 0), (2, 1), (9, 30), (3, 31), (4, 60)]
    parts = [[[(i, text if i != 9 else "other words that are here alone", DAY + timedelta(days=d))]] for i, d in days]
    pairs = stream_of(parts, "doc_id long, text string, at timestamp", lambda s: state.near_duplicate_pairs(s, "doc_id", "text", "at", keep="5 days", late="0 seconds"))
    assert {(r.x, r.y) for r in pairs.collect()} == {(1, 2)}  # 3 and 4 came when 1 was no longer held


def test_rolling_spikes_are_those_of_the_closed_series(spark, stream_of):
    r = random.Random(9)
    rows = [("a", DAY + timedelta(days=r.randrange(30), hours=r.randrange(24)), float(r.random() < 0.7)) for _ in range(160)]
    rows += [("a", DAY + timedelta(days=22, minutes=i), 1.0) for i in range(40)] + [("b", DAY + timedelta(days=d), 1.0) for d in (3, 4, 17)]
    rows.sort(key=lambda x: x[1] + timedelta(hours=r.randrange(20)))  # up to 20 hours out of order
    too_late = [("a", DAY, 100.0)]
    parts = [[rows[:60], rows[60:120]], [rows[120:], too_late, [("c", DAY + timedelta(days=40), 1.0)]], [[("c", DAY + timedelta(days=41), 1.0)]]]
    got = stream_of(parts, "key string, at timestamp, value double", lambda s: state.rolling_spikes(s, "key", "at", "value", late="1 day"))
    got = {(x.key, x.start.date()): (x.total, round(x.z, 9), x.is_spike) for x in got.collect()}
    daily = spark.createDataFrame(rows, "key string, at timestamp, value double").groupBy("key", F.to_date("at").alias("day")).agg(F.sum("value").alias("v"))
    last = max(d for k, d in got if k == "a")
    filled = trends.gap_filled(daily, "day", ["v"], F.lit(last), ["key"])
    want = trends.spikes(trends.robust_z(filled, "day", "v", ["key"]), "v")
    assert last >= (DAY + timedelta(days=38)).date()
    assert {k: v for k, v in got.items() if k[0] != "c"} == {(x.key, x.day): (x.v, round(x.z, 9), x.is_spike) for x in want.collect()}
    assert sum(v[2] for v in got.values()) >= 1


@pytest.mark.parametrize("seed", [1, 2])
def test_late_parents_come_to_the_batch_join(spark, stream_of, seed):
    r = random.Random(seed)
    posts = [(i, r.choice([None, r.randrange(40), 999]), r.random(), DAY + timedelta(minutes=i)) for i in range(40)]
    r.shuffle(posts)
    schema = "post_id long, parent_id long, toxicity double, at timestamp"
    updates = stream_of([[posts[:13], posts[13:20]], [posts[20:], posts[5:9]]], schema, lambda s: state.late_parents(s, late="2 days"))
    scores = {p[0]: p[2] for p in posts}
    got = {x.post_id: (x.parent_id, x.parent_toxicity) for x in state.settled(updates).collect()}
    assert got == {i: (p, scores.get(p)) for i, p, _, _ in posts if p is not None}
    assert updates.where("not settled").count() > 0


def test_waiting_children_end(spark, stream_of):
    parts = [[[(1, 7, 0.1, DAY)]], [[(50, None, 0.5, DAY + timedelta(days=9))]], [[(51, None, 0.5, DAY + timedelta(days=10))]], [[(7, None, 0.9, DAY + timedelta(days=11))]]]
    updates = stream_of(parts, "post_id long, parent_id long, toxicity double, at timestamp", lambda s: state.late_parents(s, keep="1 day", late="0 seconds"))
    assert [(x.post_id, x.parent_toxicity) for x in state.settled(updates).collect()] == [(1, None)]
