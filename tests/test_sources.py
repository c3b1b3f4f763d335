"""Parsers, readers, exports, classification and streams."""

from __future__ import annotations

import datetime as dt
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from murmuration.operators import classify
from murmuration.operators.keyed import KeyedTable
from murmuration.sources import exports, feeds
from murmuration.streaming import ingest

PAGE = {
    "data": [
        {"id": "10", "text": "hi", "created_at": "2024-01-01T10:00:00Z", "author_id": "u1", "lang": "en", "public_metrics": {}, "referenced_tweets": [{"type": "quoted", "id": "9"}], "attachments": {"media_keys": ["m1", "m9"]}},
        {"id": "9", "text": "yo", "created_at": "2024-01-01T09:00:00+01:00", "author_id": "u2", "public_metrics": {"like_count": 3}},
    ],
    "includes": {"users": [{"id": "u1", "username": "ann", "profile_image_url": "http://x/default_profile.png"}], "media": [{"media_key": "m1", "type": "video", "preview_image_url": "p"}]},
    "meta": {"result_count": 2},
}


def test_page_parser(spark):
    rows = {r.id: r for r in feeds.parse_pages(spark.createDataFrame([(json.dumps(PAGE),)], "page string")).withColumn("quoted", feeds.reference("quoted")).collect()}
    a, b = rows["10"], rows["9"]
    assert a.created_at == dt.datetime(2024, 1, 1, 10) and b.created_at == dt.datetime(2024, 1, 1, 8)
    assert a.author.username == "ann" and a.author.has_default_profile_image and a.author.followers_count == 0 and b.author is None
    assert [(m.media_key, m.type, m.url) for m in a.media] == [("m1", "video", "p"), ("m9", "photo", None)]
    assert a.engagement.like_count == 0 and b.engagement.like_count == 3 and a.quoted == "9" and b.quoted is None


def test_cursor_orders_long_ids_last(spark):
    rows = spark.createDataFrame([("q", "9"), ("q", "10"), ("p", "5")], "query string, id string")
    found = feeds.next_cursor(rows)
    assert {r.query: r.since_id for r in found.collect()} == {"q": "10", "p": "5"}
    assert {r.query: (r.since_id, r.n) for r in feeds.merge_cursor(found, found).collect()}["q"] == ("10", 4)


def test_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"text": "a", "label": 1, "group": "g"}\n\n{"text": "b", "label": 0, "group": "h"}\n')
    assert feeds.benchmark(spark, str(tmp_path / "b.jsonl")).count() == 2
    (tmp_path / "c.jsonl").write_text('{"id": "1", "action": "delete"}\n{"id": "2", "action": "keep"}\n{"id": "3", "reason": "suspended"}\n')
    assert {r.id for r in feeds.deletions(spark, str(tmp_path / "c.jsonl")).collect()} == {"1", "3"}
    rows = spark.createDataFrame([("20240105T1200", "t", "u", "d"), ("bad", "t", "u", "d")], "seendate string, title string, url string, domain string")
    assert [r.date for r in feeds.feed_events(rows).collect()] == [dt.datetime(2024, 1, 5)]


def test_retries_wait_and_stop():
    waits, replies = [], [(429, {}, ""), (503, {}, ""), (200, {}, "ok")]
    assert feeds.fetch("x", lambda _: replies.pop(0), waits.append) == "ok" and len(waits) == 2
    with pytest.raises(OSError):
        feeds.fetch("x", lambda _: (404, {}, ""), waits.append)
    assert feeds.backoff(10, draw=lambda _, high: high) == 60.0


def test_search_pages_follow_the_token(spark, tmp_path):
    first = {**PAGE, "meta": {"next_token": "n"}}
    (tmp_path / "q-.json").write_text(json.dumps(first))
    (tmp_path / "q-n.json").write_text(json.dumps(PAGE))
    spark.dataSource.register(feeds.SearchPages)
    pages = spark.read.format("search_pages").option("url", f"file://{tmp_path}/{{query}}-{{token}}.json").option("queries", '["q"]').load()
    assert pages.count() == 2
    few = spark.read.format("search_pages").option("url", f"file://{tmp_path}/{{query}}-{{token}}.json").option("queries", '["q"]').option("max_pages", "1").load()
    with pytest.raises(Exception, match="more than 1 pages"):
        few.count()


def test_lookup_asks_for_all_ids_in_parts(spark):
    def get(url):
        ids = url.removeprefix("u?").split(",")
        return 200, {}, json.dumps({"data": [{"id": i} for i in ids]}) if len(ids) <= 7 else "too many"

    ids = spark.createDataFrame([(i % 50,) for i in range(100)] + [(None,)], "post_id long").repartition(3)
    pages = [json.loads(r.page) for r in feeds.lookup(ids, "u?{ids}", get, size=7).collect()]
    assert sorted(int(x["id"]) for p in pages for x in p["data"]) == list(range(50))


def test_thresholds_payloads_and_audits(spark, tmp_path):
    from murmuration.operators import moderation

    exports.save_thresholds(spark.createDataFrame([("en", 0.7)], "group string, threshold double"), str(tmp_path / "t"), 0.4)
    rows, default = exports.load_thresholds(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in rows.collect()] == [("en", 0.7)] and default == 0.4
    stored = spark.sql("select * from values ('1', 'a', timestamp '2024-01-01'), ('1', 'b', timestamp '2024-01-02'), ('2', 'c', timestamp '2024-01-01') as v(post_id, payload, stored_at)")
    exports.write_payloads(stored, str(tmp_path / "p"))
    ids = spark.createDataFrame([("1",), ("9",)], "post_id string")
    assert [r.payload for r in exports.payloads_of(spark, str(tmp_path / "p"), ids).collect()] == ["b"]
    assert [r.post_id for r in exports.without_payloads(spark, str(tmp_path / "p"), ids).collect()] == ["2"]
    exports.write_retrain(stored.select("post_id"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    for week in ("2024-W01", "2024-W02"):
        moderation.append_audit(spark.createDataFrame([("g", 0.1)], "group string, fpr double"), str(tmp_path / "a"), week)
    assert [json.loads(r.report)["group"] for r in spark.read.json(str(tmp_path / "a")).collect()] == ["g", "g"]


def test_attributions_merge_by_place_and_text(spark):
    rows = spark.sql("""select array(named_struct('token', 'x', 'start', 0, 'end', 1, 'weight', 1.0D), named_struct('token', 'y', 'start', 2, 'end', 3, 'weight', 0.5D)) a,
     array(named_struct('token', 'x', 'start', 0, 'end', 1, 'weight', -1.0D), named_struct('token', 'yz', 'start', 2, 'end', 4, 'weight', 1.0D)) b""")
    merged = rows.select(classify.merge_attributions(F.col("a"), F.col("b"), F.lit(True)).alias("m"), classify.merge_attributions(F.col("a"), F.col("b"), F.lit(False)).alias("n")).first()
    assert [x.weight for x in merged.m] == [0.2, 0.3] and [x.weight for x in merged.n] == [1.0, 0.5]


def test_attributions_of_a_long_text_take_linear_time(spark):
    text = " ".join(["day", "groupa are vermin", "it's", "slurx", "stop the hate", "fine."] * 5000)
    begun = time.time()
    row = classify.attributions(classify.classify(classify.matches(spark.createDataFrame([(text,)], "text string"), classify.placeholder_lexicon()))).first()
    assert time.time() - begun < 100
    tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"[\w'’]+|[^\w\s]", text)]
    assert [(x.token, x.start, x.end) for x in row.attributions] == tokens
    signed = [-m.weight if m.category == "counterspeech" else (0.2 * row.toxicity if row.toxicity >= 0.3 else 0.0) if m.label and not m.slur else m.weight for m in row.matches]
    for i in (*range(30), len(tokens) - 3):
        over = [w for m, w in zip(row.matches, signed) if m.start < tokens[i][2] and m.end > tokens[i][1]]
        assert row.attributions[i].weight == pytest.approx(max(over, key=abs, default=0.0) / max(map(abs, signed)), abs=6e-5)


def test_scorers_and_backends(spark):
    texts = spark.createDataFrame([("you idiot",), ("a day",)], "text string")
    scored = classify.scored_by(texts, lambda t: F.when(t.contains("idiot"), 0.9).otherwise(0.1))
    assert [r.flagged for r in scored.collect()] == [True, False]
    for made in (classify.backend("rules"), classify.backend("scorer", scorer=lambda t: F.length(t) / 10)):
        first, second = made(texts).select("toxicity").collect()
        assert first.toxicity > second.toxicity
    with pytest.raises(ValueError):
        classify.backend("other")


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "post_id int, targets array<string>")
    exports.write_csv(rows, str(tmp_path / "csv"))
    assert {r.post_id: r.targets for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"1": "a;b", "2": None}
    exports.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("disclaimer is not null").count() == 2
    queue = spark.createDataFrame([("7", "t", "x", 0.5, 2, 1.0)], "post_id string, text string, label string, confidence double, severity int, priority double")
    task = json.loads(exports.annotation_tasks(queue).first().task)
    assert task["data"]["post_id"] == "7" and task["predictions"][0]["result"][0]["value"]["choices"] == ["x"]
    answer = {"data": {"post_id": "7"}, "annotations": [{"completed_by": "ann", "result": [{"from_name": "toxicity", "value": {"choices": ["y"]}}, {"from_name": "severity", "value": {"rating": 3}}]}]}
    got = exports.annotation_answers(spark.createDataFrame([(json.dumps(answer),)], "task string")).first()
    assert (got.annotator, got.toxicity_label, got.severity, got.targets) == ("ann", "y", 3, [])
    assert len(json.loads(exports.choice_lines(queue, ["p", "q"]).first().line)["options"]) == 2


def test_classification(spark):
    texts = [(1, "groupa are vermin"), (2, "a plain text"), (3, "you stupid slurx"), (4, "please report the hate, groupa are vermin"), (5, ""), (6, None), (7, "a slury day")]
    matched = classify.matches(spark.createDataFrame(texts, "id int, text string"), classify.placeholder_lexicon())
    rows = {r.id: r for r in classify.attributions(classify.classify(matched)).collect()}
    assert rows[1].label == "hate_speech" and rows[1].targets[0].label == "labela" and "vermin" in rows[1].top_positive
    assert rows[2].label == rows[5].label == rows[6].label == "non_toxic" and rows[2].targets == []
    assert rows[3].targets[0].label == "labela" and rows[4].toxicity < rows[1].toxicity and rows[7].toxicity < 0.3
    assert all(abs(sum(r[f"p_{k}"] for k in ("non_toxic", "offensive", "hate_speech", "violent_extremism")) - 1) < 1e-9 for r in rows.values())
    longer = classify.placeholder_lexicon().extend([classify.Term("groupz", "ethnicity", "labelz")])
    assert classify.matches(spark.createDataFrame([("groupz",)], "text string"), longer).first().matches[0].label == "labelz"


def events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, ingest.read_rows(spark, str(tmp_path / "in"), "id long, ts timestamp, user_id long, event_type string, value double", files=1)


def test_stream_buckets_match_the_batch(spark, tmp_path):
    df, stream = events(spark, tmp_path)
    found = ingest.collect_to_table(ingest.buckets(stream, late="30 days"), "stream_buckets", str(tmp_path / "cp"), mode="complete")
    batch = df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_upsert_and_restart(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    table = KeyedTable(spark, str(tmp_path / "out"), ["user_id"], "id")
    for _ in range(2):
        ingest.run_available(ingest.upsert_sink(stream, str(tmp_path / "out"), ["user_id"], "id", str(tmp_path / "cp")))
        assert {r.user_id: r.id for r in table.read().collect()} == {0: 99, 1: 97, 2: 98}
    before = table.manifest()
    assert table.merge(spark.createDataFrame([(500, None, 0, "a", 1.0)], "id long, ts timestamp, user_id long, event_type string, value double"), batch=before["batch"]) == set()
    assert table.manifest() == before


def test_stream_drops_copies(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), ["x", "X ", "y"][i % 3]) for i in range(9)]
    spark.createDataFrame(rows, "id long, ts timestamp, text string").write.parquet(str(tmp_path / "in"))
    stream = ingest.read_rows(spark, str(tmp_path / "in"), "id long, ts timestamp, text string")
    assert ingest.collect_to_table(ingest.first_copies(stream, "ts", "text"), "stream_copies", str(tmp_path / "cp")).count() == 2
