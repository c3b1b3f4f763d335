"""What runs hold on disk: shuffles go with the write that made them, whole texts are not moved to drop some."""

from __future__ import annotations

import time

import pytest

from murmuration.llm import decontam, neardup, ranks
from murmuration.llm.scratch import CLEANUP_SETTING, Scratch
from tests.llm.conftest import words


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffles_go_with_their_write(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP_SETTING, None)
    saved = Scratch(spark).save(spark.range(20_000).selectExpr("id % 100 as k").groupBy("k").count())
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert saved.count() == 100 and spark.conf.get(CLEANUP_SETTING, None) == setting


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("most", [ranks.BROADCAST_IDS, 0])
@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("stage", ["near", "benchmark"])
def test_texts_are_not_sorted_to_drop_documents(spark, monkeypatch, most, shared, stage):
    """With many ids to drop, as tables of several GB have; 0: too many for every task."""
    monkeypatch.setattr(ranks, "BROADCAST_IDS", most)
    rows = [(i, words(i // 3 if i < 60 else i, 40)) for i in range(200)] + ([(0, words(900, 40))] if shared else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark takes for small by itself is left out
    try:
        if stage == "near":
            kept = neardup.one_of_each_class(docs)
            want = [i for i, _ in rows if i >= 60 or i % 3 == 0]
        else:
            items = spark.createDataFrame([(i, words(i, 40)) for i in range(10)], "item_id long, text string")
            kept = decontam.decontaminate(docs, items)
            want = [i for i, t in rows if t not in {words(i, 40) for i in range(10)}]
        plan = final_plan(kept)
        found = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == sorted(want)
    assert "SortMergeJoin" not in plan
    assert most == 0 or "Exchange hashpartitioning" not in plan
