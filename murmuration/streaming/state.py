"""Keyed state over streams: near duplicates, rolling spikes, parents that come late.

Each operator keeps what it needs under one key in the state store and lets event-time
timers end it, so state is bounded by the watermark and a restart goes on from the
checkpoint.  Each has a batch twin that gives the same rows over the union of all batches.

Sessions need the RocksDB state store; :func:`use_state_store` sets it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmuration.operators import similarity
from murmuration.operators.graph import saved, thread_depth

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ms(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


class _NearCopies(StatefulProcessor):
    """Under a band: one member of each different set, the one with the least id, until `keep` ms after its last copy."""

    def __init__(self, threshold: float, keep: int):
        self.threshold, self.keep = threshold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sets = handle.getMapState("sets", "name string", "id long, at long, hashes binary, bands binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        band, out = key[0], []
        held = {name[0]: (v[0], v[1], np.frombuffer(v[2], np.int64), np.frombuffer(v[3], np.int64)) for name, v in self.sets.iterator()}
        changed = set()
        for batch in rows:
            for x in batch.itertuples():
                own, bands = np.asarray(x.hashes, np.int64), np.asarray(x.bands, np.int64)
                name, at = hashlib.sha256(own.tobytes()).hexdigest(), _ms(x.at)
                known = held.get(name)
                if known is not None and abs(at - known[1]) > self.keep:
                    known = None if at > known[1] else known  # outlived; the watermark has not ended it yet
                if known is not None and (bands == band).argmax() == 0:  # copies share all bands; the first tells
                    if x.id != known[0] and abs(at - known[1]) <= self.keep:
                        out.append((min(x.id, known[0]), max(x.id, known[0]), 1.0))
                if known is None or x.id < known[0]:
                    for other, (i, then, theirs, b) in held.items():
                        same = bands == b
                        if other != name and abs(at - then) <= self.keep and bands[same.argmax()] == band and same.any() and i != x.id:
                            shared = len(np.intersect1d(own, theirs, assume_unique=True))
                            similarity_ = shared / (len(own) + len(theirs) - shared)
                            if similarity_ >= self.threshold:
                                out.append((min(i, x.id), max(i, x.id), similarity_))
                held[name] = (min(x.id, known[0]), max(at, known[1]), own, bands) if known else (x.id, at, own, bands)
                changed.add(name)
        for name in changed:
            i, at, own, bands = held[name]
            self.sets.updateValue((name,), (int(i), int(at), own.tobytes(), bands.tobytes()))
            self.handle.registerTimer(int(at) + self.keep)
        yield pd.DataFrame(out, columns=["x", "y", "similarity"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for name in [n for n, v in self.sets.iterator() if v[1] + self.keep <= now]:
            self.sets.removeKey(name)
        return iter(())

    def close(self) -> None:
        pass


def near_duplicate_pairs(stream: DataFrame, key: str, text: str, at: str, threshold: float = 0.8, keep: str = "7 days", late: str = "1 hour", k: int = 3) -> DataFrame:
    """(x, y, similarity), x < y: links of texts that arrive within `keep` of each other, each verified on the full sets.

    Bands follow from the threshold, so that a linked pair shares none with a chance
    below one in a million.  A band's task compares a new set with the different sets
    that it holds, so copies make one link each; a pair is told by its first shared band.
    """
    count, rows = similarity.banding(threshold)
    signed = similarity.signatures(stream, key, text, k, count * rows, keep=[at, "s"])
    each = similarity.band_names(F.col("m"), count, rows)
    told = signed.select(F.col(key).cast("long").alias("id"), F.col(at).alias("at"), F.array_sort("s").alias("hashes"), each.alias("bands")).withWatermark("at", late)
    dealt = told.select("id", "at", "hashes", "bands", F.explode("bands").alias("band"))
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    return dealt.groupBy("band").transformWithStateInPandas(_NearCopies(threshold, span), "x long, y long, similarity double", "Append", "EventTime")


def verdicts(pairs: DataFrame, key: str) -> DataFrame:
    """(key, duplicate_of, similarity) of all links so far: the most similar earlier text, the least id of equals.

    A copy was linked to the member that its set had then, so copies follow their links to the least.
    """
    best = pairs.groupBy("y").agg(F.max_by(F.struct(F.col("x").alias("duplicate_of"), "similarity"), F.struct("similarity", -F.col("x"))).alias("v"))
    found = saved(best.select(F.col("y").alias(key), "v.duplicate_of", "v.similarity"))
    copies = found.where("similarity = 1").select(F.col(key).alias("__k"), F.col("duplicate_of").alias("__up"))
    tops = copies.select(F.col("__up").alias("__k"), F.lit(None).cast("long").alias("__up")).distinct().join(copies.select("__k"), "__k", "left_anti")
    roots = thread_depth(copies.unionByName(tops), "__k", "__up", most=None).select(F.col("__k").alias(key), "root")
    return found.join(roots, key, "left").select(key, F.when(F.col("similarity") == 1, F.col("root")).otherwise(F.col("duplicate_of")).alias("duplicate_of"), "similarity")


class _Rolling(StatefulProcessor):
    """Under a key: totals of open buckets, the next bucket to close, and the last `history` closed totals."""

    def __init__(self, width: int, history: int, least_z: float, least: float):
        self.width, self.history, self.least_z, self.least = width, history, least_z, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "total double")
        self.next = handle.getValueState("next", "start long")
        self.past = handle.getListState("past", "total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        totals: dict[int, float] = {}
        for batch in rows:
            starts = batch["at"].map(_ms) // self.width * self.width
            for start, total in batch["value"].astype(float).groupby(starts).sum().items():
                totals[int(start)] = totals.get(int(start), 0.0) + float(total)
        next_ = self.next.get()[0] if self.next.exists() else None
        closed = any(True for _ in self.past.get()) if self.past.exists() else False
        for start, total in totals.items():
            if closed and start < next_:
                continue  # later than the watermark
            held = self.open.getValue((start,))[0] if self.open.containsKey((start,)) else 0.0
            self.open.updateValue((start,), (held + total,))
            if next_ is None or (not closed and start < next_):
                next_ = start
        if next_ is not None:
            self.next.update((next_,))
            self.handle.registerTimer(next_ + self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, next_, out = timerValues.getCurrentWatermarkInMs(), self.next.get()[0], []
        past = [x[0] for x in self.past.get()] if self.past.exists() else []
        while next_ + self.width <= now:
            total = 0.0
            if self.open.containsKey((next_,)):
                total = self.open.getValue((next_,))[0]
                self.open.removeKey((next_,))
            z = robust_z_of(past, total)
            out.append((key[0], pd.Timestamp(next_, unit="ms"), total, z, bool(z >= self.least_z and total >= self.least)))
            past = [*past, total][-self.history :]
            next_ += self.width
        if out:
            self.past.put([(x,) for x in past])
            self.next.update((next_,))
        self.handle.registerTimer(next_ + self.width)
        yield pd.DataFrame(out, columns=["key", "start", "total", "z", "is_spike"])

    def close(self) -> None:
        pass


def robust_z_of(past: list[float], value: float) -> float:
    """The score of :func:`murmuration.operators.trends.robust_z` for one value and the values before it."""
    n = len(past)
    if n < 3:
        return 0.0
    median = sorted(past)[n // 2]
    apart = sorted(abs(x - median) for x in past)
    scale = 1.4826 * apart[n // 2] or float(np.sqrt(sum(a * a for a in apart) / n)) or 1.0
    return (value - median) / scale


def rolling_spikes(stream: DataFrame, key: str, at: str, value: str, width: str = "1 day", late: str = "6 hours", history: int = 14, least_z: float = 2.5, least: float = 3) -> DataFrame:
    """(key, start, total, z, is_spike) of each bucket as the watermark closes it, buckets without rows included.

    A key's buckets begin with its first row and go on as long as the watermark moves.
    """
    kind = next(f.dataType.simpleString() for f in stream.schema.fields if f.name == key)
    told = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.coalesce(F.col(value), F.lit(0)).cast("double").alias("value")).withWatermark("at", late)
    processor = _Rolling(int(pd.Timedelta(width).total_seconds() * 1000), history, least_z, least)
    return told.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, start timestamp, total double, z double, is_spike boolean", "Append", "EventTime")


class _Parents(StatefulProcessor):
    """Under a post's id: its score once it is known, and the children that wait for it."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.score = handle.getValueState("score", "toxicity double, at long")
        self.waiting = handle.getMapState("waiting", "id long", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.score.get()[:2] if self.score.exists() else None
        came, out = {}, []
        for batch in rows:
            for x in batch.itertuples():
                at = _ms(x.at)
                if x.child < 0 or pd.isna(x.child):
                    known = (None if pd.isna(x.toxicity) else float(x.toxicity), max(at, known[1] if known else at))
                else:
                    came[int(x.child)] = at
        if known is not None:
            self.score.update((known[0], known[1]))
            self.handle.registerTimer(known[1] + self.keep)
            late = [c[0] for c in self.waiting.keys()]
            out = [(c, key[0], known[0], True) for c in dict.fromkeys([*late, *came])]
            self.waiting.clear()
        else:
            for child, at in came.items():
                self.waiting.updateValue((child,), (at,))
                self.handle.registerTimer(at + self.keep)
                out.append((child, key[0], None, False))
        yield pd.DataFrame(out, columns=["post_id", "parent_id", "parent_toxicity", "settled"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.score.exists() and self.score.get()[1] + self.keep <= now:
            self.score.clear()
        for child in [c for c, at in self.waiting.iterator() if at[0] + self.keep <= now]:
            self.waiting.removeKey(child)
        return iter(())

    def close(self) -> None:
        pass


def late_parents(stream: DataFrame, keep: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(post_id, parent_id, parent_toxicity, settled) of a stream of (post_id, parent_id, toxicity, at).

    A post whose parent is not there yet is given at once, not settled, and again when the
    parent comes within `keep`; :func:`settled` takes the last word on each.  Ids are
    0 or more; a post without a parent is settled at once.
    """
    role = F.array(F.struct(F.col("post_id").alias("k"), F.lit(-1).cast("long").alias("child"), "toxicity"), F.struct(F.col("parent_id").alias("k"), F.col("post_id").alias("child"), F.lit(None).cast("double").alias("toxicity")))
    rows = stream.select(F.col("post_id").cast("long").alias("post_id"), F.col("parent_id").cast("long").alias("parent_id"), F.col("toxicity").cast("double").alias("toxicity"), "at").withWatermark("at", late)
    each = rows.select("at", F.explode(role).alias("r")).select("at", "r.k", "r.child", "r.toxicity").where("k is not null")
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    return each.groupBy("k").transformWithStateInPandas(_Parents(span), "post_id long, parent_id long, parent_toxicity double, settled boolean", "Append", "EventTime")


def settled(updates: DataFrame) -> DataFrame:
    """(post_id, parent_id, parent_toxicity): the last word on each post that has a parent."""
    best = updates.groupBy("post_id").agg(F.max_by(F.struct("parent_id", "parent_toxicity"), "settled").alias("v"))
    return best.select("post_id", "v.parent_id", "v.parent_toxicity")
