"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

A source's documents, in the order of a seeded hash, are laid end to end; every
`block` words of that row are a block, the last one may be shorter.  Targets fill up:
sources share by weight, a source stops at `most` times its size, and what it
leaves is shared by weight among the others.  Blocks go to the sources by the highest
quotients target / (2 n - 1), and a source's blocks in the same way to its shards, which
are runs of `SHARD` blocks.  So every shard of a source has an integer quota.

A shard's quota takes each of its blocks as often as it goes evenly, and the rest are
blocks in even steps from a seeded start.  The number taken before any block is then
a closed form, so what is taken of a document follows from its first and last word
alone: no block is ever a row, and very long documents cost no more than short ones.

Nothing is collected: sources, shards and quotas are tables, running totals come from
:mod:`murmuration.llm.ranks`, so neither a hot source nor a hot id is one task's work.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, the last; rows that are repeated are documents of their own; ties of
quotients go to the smaller source and shard; an empty table gives no rows; other
columns are carried if asked for, but for those with the name of an output, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.ranks import running, sized
from murmuration.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and blocks of a shard.
BLOCK, SHARD = 32, 1 << 15
#: Doublings of the margin within which the highest quotients are looked for.
MARGINS = 40
MADE = ("size", "source_size", "target", "taken")


def targets(sources: DataFrame, weights: list[float], share: float, most: float, scratch: Scratch) -> DataFrame:
    """The saved sources (source, source_size) with `target`, filled up by weight to `most` times the size."""
    ranked = running(sources, [], ["source"], [], scratch)
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    capped = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    capped = scratch.save(capped.withColumn("level", F.col("cap") / F.col("weight")))
    filled = scratch.save(running(capped, [], ["level", "source"], ["weight", "cap"], scratch))
    whole = filled.agg(F.sum("weight").alias("all_weight"), (F.sum("source_size") * share).alias("all"))
    level = (F.col("all") - F.col("before_cap")) / (F.col("all_weight") - F.col("before_weight"))
    reached = filled.crossJoin(F.broadcast(whole)).withColumn("reached", level).where("reached <= level")  # one row on that side
    final = reached.agg(F.min_by("reached", "before").alias("reached"))
    return filled.crossJoin(F.broadcast(final)).select("source", "source_size", F.least("cap", F.coalesce(F.col("reached") * F.col("weight"), F.col("cap"))).alias("target"))


def apportion(cells: DataFrame, seats: DataFrame, groups: list[str], cell: str, scratch: Scratch) -> DataFrame:
    """The saved cells (groups, cell, weight, cap) with `quota`, by the highest quotients weight / (2 n - 1) in each group.

    seats: (groups, seats).  No cell gets more than its cap, and seats must not exceed the caps.
    With W, S and M for weights, cells and seats of a group, weights times
    (M - S) / W round to M at most, so those need no comparison; the rest is
    taken from quotients that weights times (M + margin) / W reach, with the
    smallest margin of S, 2 S, 4 S ... that reaches M: without caps S does, so
    some 3 S quotients are compared.
    """
    stats = cells.groupBy(*groups).agg(F.sum("weight").alias("W"), F.count(F.lit(1)).alias("S")) if groups else cells.agg(F.sum("weight").alias("W"), F.count(F.lit(1)).alias("S"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, groups) if groups else a.crossJoin(F.broadcast(b))  # without groups one row

    of = joined(stats, seats)
    known = joined(cells, of)
    reach = lambda margin: F.least(F.col("cap"), F.greatest(F.lit(0), F.floor(F.col("weight") * (F.col("seats") + margin) / F.col("W") + 0.5)).cast("long"))
    margins = [F.col("S").cast("double") * float(1 << e) for e in range(MARGINS)]
    by_margin = known.groupBy(*groups, "seats") if groups else known.groupBy("seats")
    reached = by_margin.agg(F.array(*[F.struct(F.sum(reach(m)).alias("n"), F.max(m).alias("margin")) for m in margins]).alias("r"), F.sum(reach(-F.col("S"))).alias("sure"))
    margin = F.coalesce(F.get(F.filter("r", lambda x: x["n"] >= F.col("seats")), F.lit(0))["margin"], F.lit(float(1 << 60)))
    left = scratch.save(reached.select(*groups, (F.col("seats") - F.col("sure")).alias("open"), margin.alias("margin")))
    known = scratch.save(joined(known, left).select(*groups, cell, "weight", reach(-F.col("S")).alias("base"), reach(F.col("margin")).alias("top"), "open"))
    asked = known.where("top > base").select(*groups, cell, "weight", "open", F.explode(F.expr("sequence(base + 1, top)")).alias("n"))
    asked = scratch.save(asked.select(*groups, cell, "open", "n", (-F.col("weight") / (2 * F.col("n") - 1)).alias("quotient")))
    won = running(asked, groups, ["quotient", cell, "n"], [], scratch).where("before < open").groupBy(*groups, cell).agg(F.count(F.lit(1)).alias("won"))
    return known.join(won, [*groups, cell], "left").select(*groups, cell, (F.col("base") + F.coalesce("won", F.lit(0))).alias("quota"))


def quotas(wanted: DataFrame, most: int, block: int, shard: int, seed: int, scratch: Scratch) -> DataFrame:
    """(source, shard, blocks, quota, start, words_before) of the saved sources (source, source_size, target).

    start: where the even steps begin; words_before: what the source's earlier shards take.
    """
    held = scratch.save(wanted.where("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")))
    weight = F.col("target") * F.col("blocks") / F.col("source_size")
    cells = scratch.save(held.select("source", weight.alias("weight"), (most * F.col("blocks")).alias("cap"), "blocks"))
    seats = cells.agg(F.coalesce(F.floor(F.sum("weight") + 1e-6), F.lit(0)).cast("long").alias("seats"))
    by_source = scratch.save(apportion(cells, seats, [], "source", scratch).withColumnRenamed("quota", "seats"))
    shards = cells.select("source", "blocks", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {shard})")).alias("shard"))
    shards = shards.select("source", "shard", F.least(F.lit(shard).cast("long"), F.col("blocks") - F.col("shard") * shard).alias("blocks"))
    shards = scratch.save(shards.withColumns({"weight": F.col("blocks").cast("double"), "cap": most * F.col("blocks")}))
    dealt = scratch.save(apportion(shards, by_source, ["source"], "shard", scratch).join(shards, ["source", "shard"]).select("source", "shard", "blocks", "quota"))
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.col("blocks"))
    return running(dealt, ["source"], ["shard"], ["quota"], scratch).select("source", "shard", "blocks", "quota", start.alias("start"), (F.col("before_quota") * block).alias("words_before"))


def _taken_before(at: Column, cell: Column, block: int, shard: int) -> Column:
    """Words taken of a source's first `at` words; the word before `at`, or at it, lies in the cell."""
    inside = at - cell["shard"] * (block * shard)
    b, more = F.floor(inside / block).cast("long"), inside % block
    each, rest = F.floor(cell["quota"] / cell["blocks"]).cast("long"), cell["quota"] % cell["blocks"]
    step = b * rest + cell["start"]
    whole = b * each + F.floor(step / cell["blocks"]).cast("long")
    copies = each + (step % cell["blocks"] >= cell["blocks"] - rest).cast("long")
    return cell["words_before"] + whole * block + more * copies


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, block: int = BLOCK, shard: int = SHARD, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", columns: list[str] | None = None) -> DataFrame:
    """The columns asked for, all but the text if none are, then size, source_size, target and taken.

    weights go to the sources in ascending order, null last, and repeat.
    """
    if most != int(most) or not 0 <= share <= most or block < 1 or not 1 <= shard <= 1 << 30:
        raise ValueError("most is a whole number, share is at most that, and shards hold 1 to 2**30 blocks")
    scratch = Scratch(docs.sparkSession)
    wanted = [c for c in docs.columns if c != text] if columns is None else columns
    return _mix(docs, wanted, weights, share, most, block, shard, seed, key, text, source, scratch)[0]


def _mix(docs, columns, weights, share, most, block, shard, seed, key, text, source, scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept = [c for c in columns if c not in MADE]
    name = F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`").cast("string")), F.lit("1"))
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    carried = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None)
    rows = scratch.save(docs.select(carried.alias("carried"), F.xxhash64(F.col(f"`{key}`"), F.lit(seed)).alias("at"), F.col(f"`{key}`").alias("key"), name.alias("source"), words.alias("size")))
    sources = scratch.save(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    wanted = scratch.save(targets(sources, list(weights), share, most, scratch))
    cells = scratch.save(quotas(wanted, int(most), block, shard, seed, scratch).select("source", F.col("shard"), F.struct("shard", "blocks", "quota", "start", "words_before").alias("cell")))
    n_cells, n_sources = cells.count(), wanted.count()
    laid = scratch.save(running(rows, ["source"], ["at", "key", "size"], ["size"], scratch).withColumnRenamed("before_size", "first"))
    known = laid.join(sized(wanted, n_sources), "source")
    wide = block * shard
    some = known.where("size > 0").withColumns({"from": F.floor(F.col("first") / wide).cast("long"), "to": F.floor((F.col("first") + F.col("size") - 1) / wide).cast("long")})
    for side in ("from", "to"):
        some = some.join(sized(cells.select("source", F.col("shard").alias(side), F.col("cell").alias(f"cell_{side}")), n_cells), ["source", side])
    taken = _taken_before(F.col("first") + F.col("size"), F.col("cell_to"), block, shard) - _taken_before(F.col("first"), F.col("cell_from"), block, shard)
    out = lambda rows, taken: rows.select("carried.*", "size", "source_size", "target", taken.alias("taken"))
    return out(some, taken).unionByName(out(known.where("size = 0"), F.lit(0).cast("long"))), laid, cells


def blocks(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, block: int = BLOCK, shard: int = SHARD, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, shard, first, copies, words): what is taken, as the words of each document that lie in taken blocks.

    first: place of the first word in the document, from 0; words: the words themselves, spaces between them.
    """
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{source}`").alias("source"))
    _, laid, cells = _mix(whole, ["doc", "text"], weights, share, most, block, shard, seed, "doc", "text", "source", scratch)
    some = laid.where("size > 0").select("source", "carried", "first", "size", F.expr(f"explode(sequence(first div {block}, (first + size - 1) div {block}))").alias("b"))
    some = some.withColumns({"shard": F.floor(F.col("b") / shard).cast("long"), "in": F.col("b") % shard}).join(sized(cells, cells.count()), ["source", "shard"])
    cell = F.col("cell")
    step = F.col("in") * (cell["quota"] % cell["blocks"]) + cell["start"]
    copies = F.floor(cell["quota"] / cell["blocks"]).cast("long") + (step % cell["blocks"] >= cell["blocks"] - cell["quota"] % cell["blocks"]).cast("long")
    begin = F.greatest(F.col("b") * block, F.col("first")) - F.col("first")
    end = F.least((F.col("b") + 1) * block, F.col("first") + F.col("size")) - F.col("first")
    found = some.select(F.col("carried.doc").alias(key), "shard", begin.alias("first"), copies.alias("copies"), "carried.text", (end - begin).cast("int").alias("n")).where("copies > 0")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.col("first").cast("int") + 1, F.col("n")), " ")
    return found.select(key, "shard", "first", "copies", words.alias("words"))
