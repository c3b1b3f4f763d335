"""A table by key whose updates rewrite only what they touch.

Rows are dealt to buckets by a hash of their key.  An update merges its rows with those of
the buckets that they fall in, writes these buckets as a new generation and then puts
a manifest in place, which names the generation of every bucket.  The manifest's rename is the
only commit: before it readers see the old table, after it the new one, and a job that dies
between leaves files that nobody reads, which :meth:`KeyedTable.clean` removes.  Two writers
cannot both put the same manifest number in place; the second fails and may try again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.operators.upsert import upsert

BUCKET = "__bucket"


class KeyedTable:
    """buckets: fixed with the first update; one bucket is read and written by one task, so take one per some 100 MB."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], version: str, buckets: int = 64):
        self.spark, self.folder, self.keys, self.version, self.buckets = spark, folder.rstrip("/"), keys, version, buckets
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _numbers(self) -> list[int]:
        place = self._path("_manifest")
        if not self.files.exists(place):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(place)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, number: int | None = None) -> dict | None:
        """{number, generations, schema, batch, buckets} of the newest manifest, or of a given one."""
        numbers = self._numbers()
        if not numbers:
            return None
        text = self.spark.read.text(str(self._path(f"_manifest/{numbers[-1] if number is None else number}")), wholetext=True).first()[0]
        return json.loads(text)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder}/g={g}/{BUCKET}={b}" for b, g in manifest["generations"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame | None:
        """The table, as of its newest manifest or a given one; None before the first update."""
        manifest = self.manifest(number)
        return None if manifest is None else self._rows(manifest)

    def _write(self, rows: DataFrame, generation: int, buckets: int) -> None:
        rows.withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/g={generation}")

    def _swap(self, manifest: dict) -> None:
        self.files.mkdirs(self._path("_manifest"))
        text, name = json.dumps(manifest), f"_manifest/.{manifest['number']}.new"
        out = self.files.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"_manifest/{manifest['number']}")
        if self.files.exists(target) or not self.files.rename(self._path(name), target):
            raise RuntimeError(f"another writer has put manifest {manifest['number']} of {self.folder} in place")

    def merge(self, incoming: DataFrame, batch: int | None = None) -> set[int]:
        """The buckets that were rewritten; of a key the latest version stays, incoming first on a tie.

        A stream's batch that was merged before is not merged again.
        """
        before = self.manifest() or {"number": 0, "generations": {}, "schema": None, "batch": -1, "buckets": self.buckets}
        if batch is not None and batch <= before["batch"]:
            return set()
        buckets, number = before["buckets"], before["number"] + 1
        touched = {r[0] for r in incoming.select(self._bucket(buckets)).distinct().collect()}  # at most `buckets` numbers
        generations = dict(before["generations"])
        schema = before["schema"]
        if touched:
            stored = self._rows(before, touched) if schema is not None else self.spark.createDataFrame([], incoming.schema)
            merged = upsert(stored, incoming, self.keys, self.version)
            self._write(merged, number, buckets)
            schema = json.loads(merged.schema.json())
            generations |= {str(b): number for b in touched}
        self._swap({"number": number, "generations": generations, "schema": schema or json.loads(incoming.schema.json()), "batch": before["batch"] if batch is None else batch, "buckets": buckets})
        return touched

    def clean(self, keep: int = 1) -> int:
        """Deletes what none of the newest `keep` manifests names; gives the number of folders deleted.  No other writer may be at work."""
        numbers = self._numbers()
        named = {(str(g), str(b)) for n in numbers[-keep:] for b, g in self.manifest(n)["generations"].items()}
        gone = 0
        for generation in self.files.listStatus(self._path("")):
            name = generation.getPath().getName()
            if not name.startswith("g="):
                continue
            for part in self.files.listStatus(generation.getPath()):
                at = part.getPath().getName()
                if at.startswith(f"{BUCKET}=") and (name[2:], at.split("=")[1]) not in named:
                    self.files.delete(part.getPath(), True)
                    gone += 1
            if not any(p.getPath().getName().startswith(f"{BUCKET}=") for p in self.files.listStatus(generation.getPath())):
                self.files.delete(generation.getPath(), True)
        for n in numbers[:-keep]:
            self.files.delete(self._path(f"_manifest/{n}"), True)
        return gone
