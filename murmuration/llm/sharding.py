"""Histogram sort: equal shards of a table by one exchange, in DataFrame functions only.

A row's position key is 63 bits: the CRC-32 of its text, then 31 bits of a hash
of its id, so equal texts are neighbours and a hot text can still be cut.  Bytes
below candidate boundaries are counted exactly, for all rows, with 12 more bits
of the key in each round; only the bins that hold a boundary are refined, until
every splitter meets its tolerance.  Then rows go to their sub-ranges in one
exchange.  Row counts below each sub-range come from the same counts, so slots
need no second pass and no task ever sorts a whole shard.

The law held is `bytes`: shard sizes are near equal.  A splitter keeps a group of
equal texts whole if that costs at most `tolerance` of a shard; else it cuts it.

What reaches the driver is a histogram of bounded size: 4,096 bins (262,144 where
there are over 1,024 sub-ranges; there are 65,536 at most), and then 4,096 for each
splitter that is not settled: the shards' own, and those inside hot texts.

Defined cases: a null text has no bytes and size 8, like an empty one, with the
CRC-32 of no bytes; rows that are repeated, id included, share a key and stay
together; an empty table gives no rows; other columns are carried along, but for
those with the name of an output, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.scratch import Scratch

KEY_BITS, ROUND_BITS, TEXT_SHIFT, MOST_RANGES = 63, 12, 31, 1 << 16


def position(text: Column, key: Column) -> Column:
    low = F.xxhash64(key).bitwiseAND(F.lit((1 << TEXT_SHIFT) - 1))
    return F.shiftleft(F.crc32(text.cast("binary")), TEXT_SHIFT).bitwiseOR(low)


def splitters(keys: DataFrame, targets: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """For each (bytes below, tolerance), in ascending order: a key, and the bytes and rows below it.

    keys: rows (position, size).
    """
    found: dict[int, tuple[int, int, int]] = {}
    open_bins: dict[int, tuple[int, int]] = {0: (0, 0)}  # bins that hold a boundary, with bytes and rows below
    waiting = {i: 0 for i in range(len(targets))}
    shift = KEY_BITS
    while waiting:
        wide = shift == KEY_BITS and len(targets) > 1024
        above, shift = shift, max(0, shift - (18 if wide else ROUND_BITS))
        if above > TEXT_SHIFT > shift:  # one round ends where texts end, so that groups can stay whole
            shift = TEXT_SHIFT
        wanted = sorted(set(waiting.values()))
        inside = keys if above == KEY_BITS else keys.where(F.shiftright("position", above).isin(wanted))
        rows = inside.groupBy(F.shiftright("position", shift).alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        held: dict[int, list[tuple[int, int, int]]] = {}
        for r in sorted(rows, key=lambda r: r["bin"]):
            held.setdefault(r["bin"] >> (above - shift), []).append((r["bin"], r["bytes"], r["rows"]))
        runs = {}
        for parent in wanted:
            below, count = open_bins[parent]
            edges = []
            for at, size, n in held[parent]:
                edges.append((at, below, count))
                below, count = below + size, count + n
            runs[parent] = edges, [e[1] for e in edges], (below, count)
        fresh: dict[int, tuple[int, int]] = {}
        for i, parent in list(waiting.items()):
            goal, tolerance = targets[i]
            edges, starts, end = runs[parent]
            k = max(0, bisect_right(starts, goal) - 1)
            at, below, count = edges[k]
            upper = edges[k + 1] if k + 1 < len(edges) else (edges[k][0] + 1, *end)
            best = min(((at, below, count), upper), key=lambda e: abs(e[1] - goal))
            if abs(best[1] - goal) <= tolerance or shift == 0:
                found[i] = (best[0] << shift, best[1], best[2])
                del waiting[i]
            else:
                waiting[i] = at
                fresh[at] = (below, count)
        open_bins = fresh
    return [found[i] for i in range(len(targets))]


def _below(boundaries: list[int], position: Column) -> Column:
    """How many ascending boundaries are at most the position: a table by leading bits, then a short scan."""
    bits = max(0, min(16, len(boundaries).bit_length() + 1))
    starts, at = [], 0
    for lead in range((1 << bits) + 1):
        while at < len(boundaries) and boundaries[at] < lead << (KEY_BITS - bits):
            at += 1
        starts.append(at)
    lead = F.shiftright(position, KEY_BITS - bits).cast("int")
    low, high = F.get(F.lit(starts), lead), F.get(F.lit(starts), lead + 1)
    near = F.slice(F.lit(boundaries).cast("array<bigint>"), low + 1, high - low)
    return (low + F.size(F.filter(near, lambda b: b <= position))).cast("int")


def shard(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", tolerance: float = 0.02, range_bytes: int = 64 << 20) -> DataFrame:
    """All columns, then size, text_crc32, shard and slot; slots are gapless from 0 in each shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    made = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in docs.columns if c not in made]
    sized = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.octet_length(value) + 8).cast("long").alias("__size"),
        F.crc32(value.cast("binary")).alias("__crc"),
        position(value, F.col(f"`{key}`")).alias("__position"),
    )
    scratch = Scratch(docs.sparkSession)
    keys = scratch.save(sized.select(F.col("__position").alias("position"), F.col("__size").alias("size")))
    total, n_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(4, min(-(-total // (shards * range_bytes)), MOST_RANGES // shards))
    if n_rows == 0:
        return sized.select(*[F.col(f"`{c}`") for c in kept], F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = shards * ranges
    fair = total / shards
    targets = [(round(total * i / parts), int(fair * tolerance) if i % ranges == 0 else int(fair / ranges * 0.25)) for i in range(1, parts)]
    cuts = splitters(keys, targets)
    scratch.drop(keys)
    for i in range(1, len(cuts)):  # a sub-range cut must not pass the shard cut beside it
        if cuts[i] < cuts[i - 1]:
            if (i + 1) % ranges == 0:
                j = i - 1
                while j >= 0 and cuts[j] > cuts[i]:
                    cuts[j] = cuts[i]
                    j -= 1
            else:
                cuts[i] = cuts[i - 1]
    boundaries = [c[0] for c in cuts]
    rows_below = [0, *[c[2] for c in cuts]]
    bases = [rows_below[i] - rows_below[i // ranges * ranges] for i in range(parts)]
    dealt = sized.withColumn("__range", _below(boundaries, F.col("__position")))
    order = Window.partitionBy("__range").orderBy("__position", F.col(f"`{key}`"))
    return dealt.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.floor(F.col("__range") / ranges).cast("int").alias("shard"),
        (F.row_number().over(order) - 1 + F.get(F.lit(bases).cast("array<bigint>"), F.col("__range"))).cast("long").alias("slot"),
    )
