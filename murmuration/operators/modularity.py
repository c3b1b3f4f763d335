"""Communities by modularity: local moving in tables, refinement by connectivity, graph coarsening.

As in the Leiden method, vertices move to the neighbouring community that gains most; then
communities that fell apart are split into their connected parts; then each part
becomes a vertex of a smaller graph and the same goes on, until nothing gains.  Every
step is a join of edges with vertex states, so no community and no neighbourhood is
gathered.  Vertices move in turns by a hash of their id, in each turn one of `TURNS`
shares, since neighbours that move at once can undo each other's gain; a round that does
not raise modularity is not taken.  Ties go to the least community, so runs agree.

The result is never below that of the start: singletons, or given communities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators.graph import saved, vertices

TURNS, ROUNDS, LEVELS = 3, 8, 12
#: The least gain of modularity for which another round is run.
GAIN = 1e-5


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w): both directions of every link, weights of equal links added; a loop has one row with twice its weight."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("w"))
    return both.union(both.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(links: DataFrame, members: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of communities (id, community) on links of :func:`undirected`."""
    side = lambda c, name: members.select(F.col("id").alias(c), F.col("community").alias(name))
    inside = links.join(side("a", "ca"), "a").join(side("b", "cb"), "b")
    flows = inside.groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("d"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("i"))
    r = flows.agg(F.sum("d").alias("m2"), F.sum("i").alias("i"), F.sum(F.col("d") * F.col("d")).alias("dd")).first()
    return 0.0 if not r["m2"] else r["i"] / r["m2"] - resolution * r["dd"] / r["m2"] ** 2


def _modularity(links: DataFrame, members: DataFrame, m2: float, resolution: float) -> float:
    """As :func:`modularity`, of members with their weight `k`, so links are only summed, not dealt by community."""
    side = lambda c, name: members.select(F.col("id").alias(c), F.col("community").alias(name))
    inside = links.join(side("a", "ca"), "a").join(side("b", "cb"), "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("i"))
    squares = members.groupBy("community").agg(F.sum("k").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    r = inside.crossJoin(squares).first()  # one row each
    return r["i"] / m2 - resolution * r["dd"] / m2**2


def _move(links: DataFrame, members: DataFrame, m2: float, resolution: float, turn: int, turns: int) -> DataFrame:
    """Communities (id, community, k) after the vertices of a turn took their best neighbouring one; only their links take part."""
    totals = members.groupBy("community").agg(F.sum("k").alias("total"))
    mine = lambda c: F.pmod(F.xxhash64(c, F.lit(turn // turns)), F.lit(turns)) == turn % turns
    movers = members.where(mine("id")).select(F.col("id").alias("a"), F.col("community").alias("own"), "k")
    met = links.where((F.col("a") != F.col("b")) & mine("a")).join(movers, "a").join(members.select(F.col("id").alias("b"), "community"), "b")
    stay = movers.select("a", F.col("own").alias("community"), F.lit(0.0).alias("w"), "own", "k")
    both = met.select("a", "community", "w", "own", "k").union(stay).groupBy("a", "community").agg(F.sum("w").alias("w"), F.first("own").alias("own"), F.first("k").alias("k"))
    others = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.col("w") - resolution * F.col("k") * others / m2
    ranked = both.join(totals, "community").select("a", "community", "own", gain.alias("gain"))
    best = ranked.groupBy("a").agg(
        F.min_by(F.struct("community", "gain"), F.struct(-F.col("gain"), "community")).alias("best"),
        F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("now"),
    )
    moved = best.where(F.col("best.gain") > F.col("now") + 1e-12).select(F.col("a").alias("id"), F.col("best.community").alias("to"))
    return members.join(moved, "id", "left").select("id", F.coalesce("to", "community").alias("community"), "k")


def _connected(links: DataFrame, members: DataFrame) -> DataFrame:
    """Communities split into their connected parts, each named by its least vertex; labels jump, so long chains take few steps."""
    side = lambda c, name: members.select(F.col("id").alias(c), F.col("community").alias(name))
    inside = saved(links.where("a <> b").join(side("a", "ca"), "a").join(side("b", "cb"), "b").where("ca = cb").select("a", "b"))
    labels = saved(members.select("id", F.col("id").alias("label")))
    while True:
        told = inside.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        near = labels.join(told, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        fresh = saved(near.join(jump, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("label"), F.col("label").alias("old")))
        labels = fresh.select("id", "label")
        if not fresh.where("label <> old").limit(1).count():
            return labels.select("id", F.col("label").alias("community"))


def _settle(links: DataFrame, members: DataFrame, m2: float, resolution: float, turns: int, rounds: int) -> tuple[DataFrame, float]:
    """Communities after rounds of local moving, and their modularity."""
    best = _modularity(links, members, m2, resolution)
    for n in range(rounds):
        state = members
        for turn in range(turns):
            state = saved(_move(links, state, m2, resolution, n * turns + turn, turns))
        now = _modularity(links, state, m2, resolution)
        if now <= best + GAIN:
            break
        members, best = state, now
    return members, best


def communities(edges: DataFrame, resolution: float = 1.0, start: DataFrame | None = None, turns: int = TURNS, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """(id, community) of all vertices of (src, dst, weight), a community named by its least vertex.

    start: communities to go on from, as of label propagation.
    """
    links = saved(undirected(edges))
    m2 = links.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    ids = vertices(edges)
    whole = saved(ids.select("id", F.col("id").alias("community")) if start is None else ids.join(start.select("id", "community"), "id", "left").select("id", F.coalesce("community", "id").alias("community")))
    if not m2:
        return whole
    first, best = links, modularity(links, whole, resolution)
    members, place = whole, saved(ids.select("id", F.col("id").alias("node")))  # node: the vertex of the current level that stands for id
    result = whole
    for level in range(levels):
        degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
        weighed = saved(members.select("id", "community").join(degree, "id", "left").select("id", "community", F.coalesce("k", F.lit(0.0)).alias("k")))
        members, _ = _settle(links, weighed, m2, resolution, turns, rounds)
        parts = saved(_connected(links, members))
        found = saved(place.join(parts.select(F.col("id").alias("node"), "community"), "node").select("id", "community"))
        now = modularity(first, found, resolution)
        if now <= best + GAIN and level:
            break
        if now >= best:
            best, result = now, found
        count, before = parts.select("community").distinct().count(), parts.count()
        if count == before:
            break
        side = lambda c, name: parts.select(F.col("id").alias(c), F.col("community").alias(name))  # noqa: B023, E731
        links = saved(links.join(side("a", "ca"), "a").join(side("b", "cb"), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        place = saved(place.join(parts.select(F.col("id").alias("node"), "community"), "node").select("id", F.col("community").alias("node")))
        # connected parts of one community begin the next level together, as refinement asks
        joined = members.join(parts.select("id", F.col("community").alias("part")), "id").groupBy("part").agg(F.min("community").alias("old"))
        named = joined.groupBy("old").agg(F.min("part").alias("community"))
        members = saved(joined.join(named, "old").select(F.col("part").alias("id"), "community"))
    least = result.groupBy("community").agg(F.min("id").alias("least"))
    return result.join(least, "community").select("id", F.col("least").alias("community"))
