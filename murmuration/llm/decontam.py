"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item become a pair if they share seeds, that is
`LEAST` consecutive tokens (letters and digits, lower case).  Each pair is tiled:
running Karp-Rabin hashes find the longest matches of tokens that are not yet
covered, these are marked, longest first and without overlap, and the search
goes on with shorter ones down to `LEAST` tokens.  The share of the item's tokens
under tiles is its coverage; tiles may come in any order, so passages that were
cut up and reordered are found too.

Documents are scanned once.  A table of bits of a fixed size, merged in the tasks,
says which seeds the benchmark has; documents with none of them go no further.
The others are written with their seeds and joined with the items' seeds.  Tiles
that cover enough of an item hold so many of its seeds that one is among its rarest,
so items are joined by these alone, and a seed that very many documents share is
left out.  Of each pair so met all shared seeds are counted by their hashes, and only
the texts of pairs with as many as such tiles hold are moved.  The benchmark is a table throughout: only its bits reach the driver, and
its texts are broadcast only if they were measured and are small.

Defined cases: null and empty texts and items of fewer than `LEAST` tokens match
nothing; repeated rows and repeated items give a row each; all tokens of a long
text count; a row without an id is found but never removed; extra columns are
ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm import kernel
from murmuration.llm.ranks import built, numbered, shares_ids, without
from murmuration.llm.scratch import Scratch

LEAST, COVERAGE = 5, 0.6
#: Bytes of item texts up to which they go to all tasks; beyond, a shuffle join is used.
BROADCAST_BYTES = 8 << 20
#: Bits of the table of the benchmark's seeds: 2 MB, whatever its size.
FILTER_BITS = 24
#: Pairs of equal windows that tiling holds at a time.
PAIRS = 1 << 18


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = kernel.Words(*kernel.buffers(texts), space=kernel.NO_LETTER)
    if not len(words):
        return np.empty(0, np.uint64), words.first
    return words.hashes(kernel.LOWER), words.first


class _Rolling:
    """Karp-Rabin hashes of all windows of one sequence, for any window length."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = kernel.powers(len(tokens) + 1)
        self.total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[:-1], out=self.total[1:])

    def of(self, length: int, at: np.ndarray) -> np.ndarray:
        return (self.total[at + length] - self.total[at]) * self.down[at]


def _open_windows(free: np.ndarray, length: int) -> np.ndarray:
    """Where windows begin that hold only free tokens."""
    below = np.zeros(len(free) + 1, np.int64)
    np.cumsum(free, out=below[1:])
    return np.flatnonzero(below[length:] - below[:-length] == length) if len(free) >= length else np.empty(0, np.int64)


def _blocks(count: np.ndarray) -> Iterator[slice]:
    """Slices of places whose pairs are `PAIRS` at most together, or one place."""
    total = np.cumsum(count)
    start = 0
    while start < len(count):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        yield slice(start, end)
        start = end


def _grown(
    item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, p: np.ndarray, t: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of windows with equal hashes those with equal tokens, and how long they match."""
    same = np.ones(len(p), bool)
    for k in range(length):  # equal hashes are not yet equal tokens
        same &= item[p + k] == text[t + k]
    p, t = p[same], t[same]
    n = np.full(len(p), length)
    grows = np.arange(len(p))
    while len(grows):
        a, b = p[grows] + n[grows], t[grows] + n[grows]
        inside = (a < len(item)) & (b < len(text))
        grows, a, b = grows[inside], a[inside], b[inside]
        grows = grows[free_item[a] & free_text[b] & (item[a] == text[b])]
        n[grows] += 1
    return p, t, n


def _matches(
    item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, rolls: tuple[_Rolling, _Rolling], length: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in both, by item and text, of the longest free matches, and their length; none below `length` tokens.

    The text is met in blocks, so memory follows the item: of the longest matches at
    one place of the item the first 2 * len(item) + 1 are kept.  Tiles of one length are
    len(item) / length at most and each bars fewer than 2 * length places of the text,
    so the place that greedy tiling takes is always among them.
    """
    at_item, at_text = _open_windows(free_item, length), _open_windows(free_text, length)
    hashes = rolls[0].of(length, at_item)
    order = np.argsort(hashes, kind="stable")
    windows = rolls[1].of(length, at_text)
    low, high = np.searchsorted(hashes[order], windows), np.searchsorted(hashes[order], windows, "right")
    met = np.flatnonzero(high > low)
    low, count = low[met], (high - low)[met]
    held = np.zeros(len(item), np.int64)
    best, places, others = length, [], []
    for block in _blocks(count):
        many = count[block]
        t = np.repeat(at_text[met[block]], many)
        within = np.arange(len(t)) - np.repeat(np.cumsum(many) - many, many)
        p, t, n = _grown(item, text, free_item, free_text, at_item[order[np.repeat(low[block], many) + within]], t, length)
        if not len(p) or n.max() < best:
            continue
        if n.max() > best:
            best, places, others = int(n.max()), [], []
            held[:] = 0
        p, t = p[n == best], t[n == best]
        by_item = np.lexsort((t, p))
        p, t = p[by_item], t[by_item]
        rank = np.arange(len(p)) - np.searchsorted(p, p) + held[p]
        p, t = p[rank <= 2 * len(item)], t[rank <= 2 * len(item)]
        held += np.bincount(p, minlength=len(item))
        places.append(p)
        others.append(t)
    p, t = (np.concatenate([np.empty(0, np.int64), *x]) for x in (places, others))
    by_item = np.lexsort((t, p))
    return p[by_item], t[by_item], best


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length) of greedy string tiling."""
    if len(item) < least or len(text) < least:
        return []
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    rolls = _Rolling(item), _Rolling(text)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(item), len(text))
    while True:
        p, t, size = _matches(item, text, free_item, free_text, rolls, length)
        while len(p):
            free_item[p[0] : p[0] + size] = free_text[t[0] : t[0] + size] = False
            tiles.append((int(p[0]), int(t[0]), size))
            taken_item, taken_text = np.r_[0, np.cumsum(~free_item)], np.r_[0, np.cumsum(~free_text)]
            open_ = (taken_item[p + size] == taken_item[p]) & (taken_text[t + size] == taken_text[t])
            p, t = p[open_], t[open_]
            if not len(p):  # shorter matches may have been cut by the tiles of this length
                p, t, size = _matches(item, text, free_item, free_text, rolls, length)
        if length == least:
            return tiles
        length = max(least, length * 3 // 4)


def _seeds(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all texts, n + 1 offsets, and the tokens of each text."""
    tokens, first = _tokens(texts)
    seeds, at = kernel.grams(tokens, first, least)
    return seeds, at, np.diff(first)


def _item_seeds(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                seeds, at, tokens = _seeds(piece.column("text"), least)
                owner = np.repeat(np.arange(piece.num_rows), np.diff(at))
                b = piece.column("b").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(b[owner], pa.int64()), pa.array(tokens[owner], pa.int64()), pa.array(seeds.astype(np.int64))], names=["b", "n_tokens", "h"])

    return run


def _seeded_docs(least: int, table):
    """The rows that hold seeds of the benchmark, with these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table.value
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                seeds, at, _ = _seeds(piece.column("text"), least)
                owner = np.repeat(np.arange(piece.num_rows), np.diff(at))
                known = kernel.has_bit(words, seeds)
                seeds, owner = seeds[known], owner[known]
                order = np.lexsort((seeds, owner))
                seeds, owner = seeds[order], owner[order]
                new = np.ones(len(seeds), bool)
                new[1:] = (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])
                seeds, owner = seeds[new], owner[new]
                rows, first = np.unique(owner, return_index=True)
                kept = piece.take(pa.array(rows, pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(seeds)), pa.int32()), pa.array(seeds.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("text"), lists], names=["key", "text", "seeds"])

    return run


def _tiled(least: int, coverage: float):
    """Pairs with both texts in, the covered ones out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text", kernel.SLICE_BYTES, "item_text"):
                own, first = _tokens(piece.column("text"))
                items, item_first = _tokens(piece.column("item_text"))
                rows = []
                for r in range(piece.num_rows):
                    text, item = own[first[r] : first[r + 1]], items[item_first[r] : item_first[r + 1]]
                    ends = np.array([0, len(text)]), np.array([0, len(item)])
                    grams = kernel.grams(text, ends[0], least)[0]
                    shared = np.isin(grams, kernel.grams(item, ends[1], least)[0])
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, np.flatnonzero(shared), 1)
                    np.add.at(edge, np.flatnonzero(shared) + least, -1)
                    near = np.cumsum(edge[:-1]) > 0  # tokens under no seed can be in no tile
                    kept = np.where(near, text, np.uint64(0))
                    # runs of tokens outside all seeds shrink to one, which ends every match
                    tiles = tile(item, kept[near | np.r_[True, near[:-1]]], least)
                    covered = sum(n for _, _, n in tiles)
                    if tiles and covered >= coverage * len(item):
                        rows.append((piece.column("key")[r].as_py(), piece.column("item")[r].as_py(), len(item), covered, len(tiles), max(n for _, _, n in tiles)))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "item", "n_tokens", "n_covered", "n_tiles", "longest"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, n_tokens, n_covered, n_tiles, longest, coverage) of all pairs with at least that coverage."""
    scratch = Scratch(docs.sparkSession)
    tests = scratch.save(benchmark.select(F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").withColumn("b", F.monotonically_increasing_id()))
    held = tests.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    item_seeds = scratch.save(tests.select("b", "text").mapInArrow(_item_seeds(least), "b long, n_tokens long, h long"))
    table = docs.sparkSession.sparkContext.broadcast(kernel.bit_table(item_seeds.select("h"), FILTER_BITS))
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    # each seeded row has a name of its own, which the written table fixes
    seeded = scratch.save(source.mapInArrow(_seeded_docs(least, table), "key long, text string, seeds array<long>").withColumn("r", F.monotonically_increasing_id()))
    places = seeded.select("r", F.explode("seeds").alias("h"))
    often = places.groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    # tiles over c tokens hold c / least seeds of the item or more; so many of its seeds a partner shares
    asked = F.ceil(F.ceil(F.col("n_tokens") * coverage - 1e-9) / least)
    ranked = item_seeds.join(often, "h", "left").withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.coalesce("times", F.lit(0)), "h")))
    probes = ranked.where(F.col("times").isNotNull() & (F.col("place") <= F.col("n_tokens") - least + 1 - asked + 1)).select("b", "h").distinct()
    met = scratch.save(places.join(probes, "h").select("r", "b").distinct())
    # an item's seeds may repeat, a row's do not: of different seeds fewer need be shared
    repeats = item_seeds.groupBy("b", "h").agg(F.count(F.lit(1)).alias("m"), F.first("n_tokens").alias("n_tokens"))
    lists = repeats.groupBy("b").agg(F.collect_list("h").alias("hs"), F.ceil(F.first(asked) / F.max("m")).alias("asked"))
    counted = built(met).join(seeded.select("r", "seeds"), "r").join(F.broadcast(lists) if held <= BROADCAST_BYTES else lists, "b")
    pairs = scratch.save(counted.where(F.size(F.array_intersect("seeds", "hs")) >= F.col("asked")).select("r", "b"))
    items = tests.select("b", "item", F.col("text").alias("item_text"))
    texts = built(pairs).join(seeded.select("r", "key", "text"), "r").join(F.broadcast(items) if held <= BROADCAST_BYTES else items, "b")
    found = texts.select("key", "text", "item", "item_text").mapInArrow(_tiled(least, coverage), "key long, item long, n_tokens long, n_covered long, n_tiles long, longest long")
    found = scratch.save(found)  # in batches of few whole texts; what is saved is a few numbers a pair
    scratch.drop(seeded, met, pairs, item_seeds, tests)
    return found.withColumn("coverage", F.col("n_covered") / F.col("n_tokens")).withColumnsRenamed({"key": key, "item": item})


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no benchmark item, all columns as they were."""
    if key != "__row" and shares_ids(docs, key):  # another text under a contaminated id stays
        return decontaminate(numbered(docs, Scratch(docs.sparkSession)), benchmark, "__row", **options).drop("__row")
    return without(docs, key, contaminated(docs, benchmark, key=key, **options).select(key), Scratch(docs.sparkSession))
