"""Sinks: delimited and JSON exports, annotation tasks, raw payloads, retrain batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DISCLAIMER = "Model-estimated probability, not a definitive human judgement."


def write_csv(rows: DataFrame, path: str) -> None:
    """Arrays are joined with semicolons; the header is written even for an empty table."""
    flat = rows.select(*[F.concat_ws(";", c).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
    flat.write.option("header", True).mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.withColumn("disclaimer", F.lit(DISCLAIMER)).write.mode("overwrite").json(path)


def annotation_tasks(queue: DataFrame) -> DataFrame:
    """One JSON task per row of (post_id, text, label, confidence, severity)."""
    data = F.struct("post_id", "text", "label", F.round("confidence", 4).alias("confidence"), "severity")
    choice = F.struct(F.lit("toxicity").alias("from_name"), F.lit("text").alias("to_name"), F.lit("choices").alias("type"), F.struct(F.array("label").alias("choices")).alias("value"))
    return queue.select(F.to_json(F.struct(data.alias("data"), F.array(F.struct(F.array(choice).alias("result"))).alias("predictions"))).alias("task"))


ANSWERS = """data STRUCT<post_id: STRING>, annotations ARRAY<STRUCT<completed_by: STRING, result: ARRAY<STRUCT<from_name: STRING, value: STRUCT<choices: ARRAY<STRING>, rating: INT, text: ARRAY<STRING>>>>>>"""


def annotation_answers(tasks: DataFrame, column: str = "task") -> DataFrame:
    """(post_id, annotator, toxicity_label, severity, targets, notes) of answered tasks, a row per annotation."""
    parsed = tasks.select(F.from_json(column, ANSWERS).alias("t")).select(F.col("t.data.post_id").alias("post_id"), F.explode("t.annotations").alias("a"))
    of = lambda name: F.get(F.filter("a.result", lambda r: r["from_name"] == name), F.lit(0))["value"]
    return parsed.select(
        "post_id", F.col("a.completed_by").alias("annotator"), F.get(of("toxicity")["choices"], F.lit(0)).alias("toxicity_label"), of("severity")["rating"].alias("severity"),
        F.coalesce(of("targets")["choices"], F.array().cast("array<string>")).alias("targets"), F.get(of("notes")["text"], F.lit(0)).alias("notes"),
    ).where("toxicity_label is not null")


def choice_lines(queue: DataFrame, labels: list[str]) -> DataFrame:
    """One JSON line {text, meta, options} per row, for choice interfaces."""
    options = F.array(*[F.struct(F.lit(x).alias("id"), F.lit(x).alias("text")) for x in labels])
    return queue.select(F.to_json(F.struct("text", F.struct("post_id", "label", "priority").alias("meta"), options.alias("options"))).alias("line"))


def write_payloads(rows: DataFrame, path: str) -> None:
    """(post_id, payload, stored_at), partitioned by day so that old days are dropped as folders."""
    rows.withColumn("stored_date", F.to_date("stored_at")).write.partitionBy("stored_date").mode("append").parquet(path)


def report_counts(posts: DataFrame) -> DataFrame:
    """(kind, name, n): the label, severity and target counts of a report, deleted posts included, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name")) for k, c in (("label", "label"), ("severity", "severity"), ("target", "target"))])
    return posts.select(F.inline(pairs)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def save_thresholds(thresholds: DataFrame, path: str, default: float = 0.5) -> None:
    """A decision threshold a group and the default, as one JSON folder; the default's group is null."""
    rows = thresholds.select(F.col("group").cast("string").alias("group"), F.col("threshold").cast("double").alias("threshold"))
    rows.union(thresholds.sparkSession.createDataFrame([(None, default)], rows.schema)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_thresholds(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """(thresholds, default) as `save_thresholds` wrote them; without a default it is 0.5."""
    rows = spark.read.schema("group string, threshold double").json(path)
    default = rows.where("group is null").first()
    return rows.where("group is not null"), 0.5 if default is None else default["threshold"]


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The rows with the JSON text as a VARIANT; text that is not JSON stays in `malformed`, with no value."""
    value = F.try_parse_json(F.col(column))
    return payloads.withColumn("malformed", F.when(value.isNull() & F.col(column).isNotNull(), F.col(column))).withColumn(column, value)


def store_payloads(payloads: DataFrame, path: str, at: str = "stored_at") -> None:
    """Appends (post_id, payload, at), payloads parsed once and kept by day."""
    parsed(payloads).withColumn("stored_date", F.to_date(at)).write.mode("append").partitionBy("stored_date").parquet(path)


def payload_at(payload: Column, path: str, kind: str) -> Column:
    """What a payload holds at a path such as `$.user.id`, as a type; null if it is not there or not of that type."""
    return F.try_variant_get(payload, path, kind)


def purge_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """Drops the days of a payload store before a date, whole folders at a time; gives the days."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    days = sorted(s.getPath().getName().split("=")[1] for s in files.listStatus(root) if s.getPath().getName().startswith("stored_date="))
    gone = [d for d in days if d[:4].isdigit() and d < before]
    for d in gone:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/stored_date={d}"), True)
    return gone


def payloads_of(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The latest stored payload of each id."""
    held = spark.read.parquet(path).join(ids.select("post_id").distinct(), "post_id", "left_semi")
    latest = held.groupBy("post_id").agg(F.max_by(F.struct("payload"), "stored_at").alias("p"), F.max("stored_at").alias("stored_at"))
    return latest.select("post_id", "p.payload", "stored_at")


def without_payloads(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The stored payloads but those of the ids, for a store written anew."""
    return spark.read.parquet(path).join(ids.select("post_id").distinct(), "post_id", "left_anti")


def write_retrain(batch: DataFrame, path: str) -> None:
    """A retraining batch as JSON lines; an empty one writes no rows."""
    batch.write.mode("overwrite").json(path)
