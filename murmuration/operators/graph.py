"""Interaction graphs: edges, PageRank, degrees, communities, betweenness, thread depth.

Iterative operators keep vertices and edges as tables and write each step's small
vertex table to the shared checkpoint folder, so lineage stays short and an
executor can be lost at any time.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def saved(df: DataFrame) -> DataFrame:
    """The table, written to the folder of `spark.checkpoint.dir` and read again."""
    spark: SparkSession = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="murmuration-graph-"))
            atexit.register(shutil.rmtree, _local[0].removeprefix("file://"), ignore_errors=True)
        place = _local[0]
    path = f"{place.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def interactions(posts: DataFrame, least: float = 0.0) -> DataFrame:
    """(src, dst, weight, toxicity, n_quote, n_reply, n_retweet): authors and those whose posts they refer to.

    A quote or retweet has the toxicity of the referenced post, a reply its own;
    references to unknown posts and to oneself do not count.
    """
    refs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("ref")) for kind, c in (("reply", "parent_id"), ("quote", "quoted_id"), ("retweet", "retweeted_id"))])
    links = posts.select(F.col("author_id").alias("src"), F.col("tox").alias("own"), F.explode(refs).alias("r")).select("src", "own", "r.*").where("ref is not null")
    known = posts.select(F.col("post_id").alias("ref"), F.col("author_id").alias("dst"), F.col("tox").alias("theirs"))
    met = links.join(known, "ref").where("src <> dst").withColumn("toxicity", F.when(F.col("kind") == "reply", F.col("own")).otherwise(F.col("theirs")))
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("quote", "reply", "retweet")]
    return met.where(F.col("toxicity") >= least).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.max("toxicity").alias("toxicity"), *kinds)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, steps: int = 20, save_every: int = 5) -> DataFrame:
    """(id, rank): weighted PageRank by a fixed number of steps; the mass of vertices without out-edges is spread evenly."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = saved(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    ids = saved(vertices(edges).join(out.select(F.col("src").alias("id"), F.lit(1).alias("linked")), "id", "left"))
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("rank"))
    rank = ids.select("id", "linked", F.lit(1.0 / n).alias("rank"))
    for step in range(1, steps + 1):
        given = share.join(rank, share.src == rank.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("linked").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        value = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        rank = ids.join(given, "id", "left").crossJoin(F.broadcast(loose)).select("id", "linked", value.alias("rank"))  # one row
        if step % save_every == 0:
            rank = saved(rank)
    return rank.select("id", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_weight, out_weight)."""
    both = edges.select(F.col("dst").alias("id"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")).union(edges.select(F.col("src").alias("id"), F.lit(0).cast("long"), F.col("weight")))
    return both.groupBy("id").agg(F.sum("i").alias("in_weight"), F.sum("o").alias("out_weight"))


def communities(edges: DataFrame, steps: int = 12) -> DataFrame:
    """(id, community): label propagation on the undirected graph.

    A vertex takes the label with the most weight among its neighbours and itself,
    the least of equals; even and odd vertices take turns, so labels settle.
    """
    flat = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    flat = saved(flat)
    labels = saved(vertices(edges).select("id", F.col("id").alias("label")))
    for step in range(steps):
        near = flat.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        own = labels.select(F.col("id").alias("src"), "label", F.lit(0.5).alias("w"))
        best = near.union(own).groupBy("src", "label").agg(F.sum("w").alias("w")).groupBy("src").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("best"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == step % 2
        moved = labels.join(best, labels.id == best.src).select("id", F.when(turn, F.col("best")).otherwise(F.col("label")).alias("label"), (turn & (F.col("best") != F.col("label"))).alias("moved"))
        fresh = saved(moved)
        done = step % 2 == 1 and not fresh.where("moved").limit(1).count()
        labels = fresh.select("id", "label")
        if done:
            break
    return labels.withColumnRenamed("label", "community")


def community_stats(members: DataFrame, rank: DataFrame, toxicity: DataFrame, most: int = 5) -> DataFrame:
    """(community, size, mean_toxicity, top): the members of highest rank first.

    The top members of each part are merged, so no community is gathered whole.
    """
    joined = members.join(rank, "id").join(toxicity, "id", "left")
    sizes = joined.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("toxicity"), 4).alias("mean_toxicity"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("rank"), "id"))
    top = joined.select("community", "id", place.alias("place")).where(F.col("place") <= most).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("top"))
    return sizes.join(top, "community")


def intra_ratio(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the share of edges whose ends are in one community."""
    side = lambda c, name: members.select(F.col("id").alias(c), F.col("community").alias(name))
    both = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return both.agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 4).alias("intra_ratio"))


def top_subgraph(edges: DataFrame, rank: DataFrame, most: int) -> DataFrame:
    """The edges among the `most` vertices of highest rank."""
    top = rank.orderBy(F.desc("rank"), "id").limit(most).select("id")
    return edges.join(top.withColumnRenamed("id", "src"), "src", "left_semi").join(top.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


class Layers:
    """Rows that come in many small tables: as soon as `fan` tables of one tier are there they become one of the next, so each row is written again a logarithm of times."""

    def __init__(self, merge: Callable[[DataFrame], DataFrame] = lambda df: df, fan: int = 8):
        self.merge, self.fan, self.tiers = merge, fan, [[]]

    def add(self, table: DataFrame) -> None:
        self.tiers[0].append(table)
        for i, tier in enumerate(self.tiers):
            if len(tier) < self.fan:
                break
            joined = saved(self.merge(reduce(DataFrame.union, tier)).coalesce(table.sparkSession.sparkContext.defaultParallelism))
            tier.clear()
            if i + 1 == len(self.tiers):
                self.tiers.append([])
            self.tiers[i + 1].append(joined)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, [t for tier in self.tiers for t in tier])


def betweenness(edges: DataFrame, sources: int = 200) -> DataFrame:
    """(id, betweenness): unweighted shortest-path counts from a fixed number of sampled sources.

    All sources walk at once: a level is a table of (source, id, depth, paths), grown
    by joining the one before it with the edges; dependencies go back the same way.
    Each level is saved, so the work is joins and sums over `sources` rows a vertex.
    What was seen is read at each level, but only what a level meets again leaves it, so
    a long walk does not shuffle all that is behind it.
    """
    plain = saved(edges.select("src", "dst").distinct())
    ids = saved(vertices(plain))
    n = ids.count()
    if n <= 2:
        return ids.select("id", F.lit(0.0).alias("betweenness"))
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(sources)
    levels = [saved(chosen.select(F.col("id").alias("source"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))]
    seen = Layers()
    seen.add(levels[0].select("source", "id"))
    while True:
        ahead = saved(levels[-1].join(plain, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")))
        again = seen.rows().join(ahead.select("source", "id"), ["source", "id"], "left_semi")
        level = saved(ahead.join(again, ["source", "id"], "left_anti").select("source", "id", F.lit(len(levels)).alias("depth"), "paths"))
        if level.isEmpty():
            break
        levels.append(level)
        seen.add(level.select("source", "id"))
    summed = lambda df: df.groupBy("id").agg(F.sum("part").alias("part"))
    total = Layers(summed)
    total.add(ids.select("id", F.lit(0.0).alias("part")))
    below = levels[-1].select("source", "id", "paths", F.lit(0.0).alias("part"))
    for level in reversed(levels[:-1]):
        total.add(below.select("id", "part"))
        back = below.select("source", F.col("id").alias("dst"), ((1 + F.col("part")) / F.col("paths")).alias("given"))
        got = back.join(plain, "dst").groupBy("source", F.col("src").alias("id")).agg(F.sum("given").alias("given"))
        found = level.join(got, ["source", "id"], "left")
        below = saved(found.select("source", "id", "paths", (F.col("paths") * F.coalesce("given", F.lit(0.0))).alias("part")))
    scale = n / min(sources, n) / ((n - 1) * (n - 2))
    return summed(total.rows()).select("id", (F.col("part") * scale).alias("betweenness"))


def thread_depth(posts: DataFrame, key: str, parent: str, most: int | None = 50) -> DataFrame:
    """(key, root, depth): how far a post is below its thread's first known post; `most` only clips the depth.

    Jumps double in length until no post moves, so a thread of depth d takes log2(d)
    steps.  Jumps as long as the table are enough for any thread without a circle.
    """
    known = posts.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    known = known.join(known.select(F.col("k").alias("p"), F.lit(1).alias("there")), "p", "left").select("k", F.when(F.col("there").isNotNull(), F.col("p")).alias("up"))
    state = saved(known.select("k", F.coalesce("up", "k").alias("up"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth")))
    reach, rows, moving = 1, state.count(), True
    while moving and reach < rows:
        above = state.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        moved = state.join(above, "up").select("k", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("up2") != F.col("up")).alias("moved"))
        fresh = saved(moved)
        moving = bool(fresh.where("moved").limit(1).count())
        state = fresh.select("k", "up", "depth")
        reach *= 2
    depth = F.col("depth") if most is None else F.least(F.lit(most), F.col("depth")).cast("int")
    return state.select(F.col("k").alias(key), F.col("up").alias("root"), depth.alias("depth"))
