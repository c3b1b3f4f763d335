"""Repeated byte strings: an external induced suffix sort, dealt out by anchors.

A byte is deleted if a string of `length` bytes that covers it also starts earlier
(smaller id, or same document and earlier byte).  Such strings are suffixes with a
common prefix of `length` bytes, neighbours in the order of all suffixes.

To sort suffixes in shards that know nothing of each other, each string is given
to its anchor: the least hash among its `GRAM`-byte grams.  Equal strings have
equal anchors at equal offsets.  The strings of one anchor occurrence start next
to each other; together they are a piece of text.  Anchors that occur once are
dropped by a bit table of fixed size.  Equal pieces of an anchor are named once, as equal substrings are in
induced sorting: all but the earliest are repeats as a whole.  Where an anchor has
several different pieces, the earliest of each go to a suffix sort:

:class:`Sorter` sorts the suffixes of a shard by recursive induction.  Suffixes of
type L and S are induced from the sorted S* suffixes through a priority queue
whose keys are monotone (first byte, then time of insertion); it is a row of
append-only lists, one for each byte, which go to disk beyond `MEMORY` bytes.
Each queue tuple carries the suffix; lengths of common prefixes up to `length`
follow from the sorted order.  S* substrings are named and sorted by recursion.

Before all this, documents with equal texts, named by SHA-256 and size, count as one:
every string of a later copy starts earlier in the first.  Passages that very many documents share are
pre-aggregated to their distinct pieces.  Anchors are dealt to shards by hash; the
strings of an anchor with more than `GROUP` distinct pieces, too many for a shard,
are told apart one by one: their 128-bit hashes are grouped with partial minima.

Defined cases: null and empty texts and texts shorter than `length` keep all;
repeated rows are copies of each other, and the one met as smallest is kept whole;
several texts under one id are texts of their own, in the order of their SHA-256;
rows without an id keep all; very long texts are cut at no place; extra columns are carried, but
for those with the name of an output, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm import kernel
from murmuration.llm.ranks import running
from murmuration.llm.scratch import Scratch

LENGTH, GRAM = 100, 32
SHARD_BYTES, MEMORY = 2 << 20, 32 << 20
#: Entries (about 24 bytes each) up to which a table goes to all tasks; beyond, a shuffle join is used.
BROADCAST_ROWS, GROUP = 2_000_000, 50_000
#: Bits of the filter of anchors that occur again: 32 MB at most, whatever the input.
FILTER_BITS = 28


class Queue:
    """A priority queue with monotone keys: a first-in-first-out list for each symbol, on disk beyond `memory` bytes."""

    def __init__(self, memory: int = MEMORY):
        self.lists: dict[int, list] = defaultdict(list)
        self.memory, self.held, self.file = memory, 0, None

    def put(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[order], suffixes[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(symbols)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            self._add(int(symbols[a]), suffixes[a:b])

    def _add(self, symbol: int, part: np.ndarray) -> None:
        if self.held + part.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            part.tofile(self.file)
            self.lists[symbol].append((at, len(part), part.dtype))
        else:
            self.held += part.nbytes
            self.lists[symbol].append(part)

    def take(self, symbol: int, index: int) -> np.ndarray | None:
        held = self.lists.get(symbol, ())
        if index >= len(held):
            return None
        if isinstance(held[index], tuple):
            at, count, kind = held[index]
            self.file.seek(at)
            return np.fromfile(self.file, kind, count)
        return held[index]

    def all(self, symbol: int) -> list[np.ndarray]:
        return [self.take(symbol, i) for i in range(len(self.lists.get(symbol, ())))]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.lists.clear()


class Sorter:
    """The suffixes of a sequence of small numbers in order, right to `depth` symbols.

    The sequence must end in 0, which occurs there only.
    """

    def __init__(self, text: np.ndarray, depth: int, memory: int = MEMORY):
        self.text, self.depth, self.memory = text, depth, memory
        n = len(text)
        rise = np.zeros(n, np.int8)
        rise[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
        rise[-1] = 1
        at = np.where(rise != 0, np.arange(n, dtype=np.int32), n)
        at = np.minimum.accumulate(at[::-1])[::-1]  # of equal neighbours the next change decides
        self.small = rise[at] > 0
        star = np.zeros(n, bool)
        star[1:] = self.small[1:] & ~self.small[:-1]
        self.star = np.flatnonzero(star).astype(np.int32)

    def order(self) -> np.ndarray:
        return self._induce(self._sorted_star())

    def _names(self) -> np.ndarray:
        """Ranks of the substrings from each S* suffix to the next, ends included; equal substrings share one."""
        star, n = self.star, len(self.text)
        end = np.append(star[1:], n - 1)
        size = end - star + 1
        typed = np.zeros(n + 6, np.uint64)
        typed[:n] = (self.text.astype(np.uint64) << np.uint64(1)) + self.small + np.uint64(1)
        rank = np.zeros(len(star), np.int64)
        active, offset = np.arange(len(star)), 0
        while len(active):
            key = np.zeros(len(active), np.uint64)
            for j in range(6):
                key <<= np.uint64(10)
                inside = size[active] > offset + j
                key[inside] |= typed[star[active[inside]] + offset + j]
            order = np.lexsort((key, rank[active]))
            who, key = active[order], key[order]
            old = rank[who]
            fresh = np.ones(len(who), bool)
            fresh[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
            group = np.ones(len(who), bool)
            group[1:] = old[1:] != old[:-1]
            at = np.arange(len(who))
            # a rank is the number of smaller substrings: the group's, and the smaller ones in the group
            rank[who] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            offset += 6
            twin = np.zeros(len(who), bool)
            twin[1:] |= ~fresh[1:]
            twin[:-1] |= ~fresh[1:]
            active = who[twin & (size[who] > offset)]
        return rank

    def _sorted_star(self) -> np.ndarray:
        """S* suffixes in order: ranks of names are doubled until they tell `depth` symbols apart."""
        rank = self._names()
        m, span = len(rank), 1
        active = np.arange(m)
        order = np.argsort(rank, kind="stable")
        while span * 2 < 2 * self.depth:  # each name stands for two symbols at least
            sorted_rank = rank[order]
            same = np.zeros(m, bool)
            equal = sorted_rank[1:] == sorted_rank[:-1]
            same[1:] |= equal
            same[:-1] |= equal
            active = order[same]
            if not len(active):
                break
            ahead = np.where(active + span < m, rank[np.minimum(active + span, m - 1)] + 1, 0)
            part = np.lexsort((ahead, rank[active]))
            who, ahead = active[part], ahead[part]
            old = rank[who]
            at = np.arange(len(who))
            fresh = np.ones(len(who), bool)
            fresh[1:] = (old[1:] != old[:-1]) | (ahead[1:] != ahead[:-1])
            group = np.ones(len(who), bool)
            group[1:] = old[1:] != old[:-1]
            rank[who] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            order[np.flatnonzero(same)] = who  # groups keep their places
            span *= 2
        return self.star[order]

    def _induce(self, sorted_star: np.ndarray) -> np.ndarray:
        text, small = self.text, self.small
        top = int(text.max()) + 1
        cuts = np.searchsorted(text[sorted_star], np.arange(top + 1))
        large, low = Queue(self.memory), Queue(self.memory)

        def before(part: np.ndarray, kind: bool, queue: Queue) -> None:
            prior = part[part > 0] - 1
            prior = prior[small[prior] == kind]
            if len(prior):
                queue.put(text[prior], prior)

        for c in range(top):
            k = 0
            while (part := large.take(c, k)) is not None:
                before(part, False, large)
                k += 1
            if cuts[c + 1] > cuts[c]:
                before(sorted_star[cuts[c] : cuts[c + 1]], False, large)
        for c in range(top - 1, -1, -1):
            k = 0
            while (part := low.take(c, k)) is not None:
                before(part, True, low)
                k += 1
            for part in reversed(large.all(c)):
                before(part[::-1], True, low)
        out = [np.array([len(text) - 1], np.int32)]
        for c in range(top):
            out += large.all(c)
            out += [p[::-1] for p in reversed(low.all(c))]
        large.close()
        low.close()
        return np.concatenate(out)


def repeats(pieces: list[np.ndarray], windows: np.ndarray, length: int, memory: int = MEMORY) -> np.ndarray:
    """For pieces in the order of their places: a flag for each string of `length` bytes that has an equal one before it.

    windows: how many strings start in each piece, at its first bytes; the flags are in the order of the pieces.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(sizes + 1, out=starts[1:])
    raw = np.zeros(int(starts[-1]) + 1 + 8, np.uint8)
    text = np.ones(int(starts[-1]) + 1, np.int16)  # 1 ends a piece, 0 the sequence
    text[-1] = 0
    for p, s in zip(pieces, starts.tolist(), strict=False):
        raw[s : s + len(p)] = p
        text[s : s + len(p)] = p.astype(np.int16) + 2
    wanted = np.zeros(len(text), bool)
    first = np.repeat(starts[:-1], windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    wanted[first] = True
    order = Sorter(text, length, memory).order()
    order = order[wanted[order]]
    words = np.zeros(len(text), np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | raw[j : j + len(text)]
    same = np.ones(max(0, len(order) - 1), bool)
    for j in [*range(0, length - 7, 8), length - 8]:  # common prefixes of neighbours, up to `length`
        same &= words[order[1:] + j] == words[order[:-1] + j]
    opens = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.empty(0, np.int64)
    flags = np.zeros(len(text), bool)
    if len(order):
        earliest = np.repeat(np.minimum.reduceat(order, opens), np.diff(np.r_[opens, len(order)]))
        flags[order] = order != earliest
    return flags[first]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchor occurrences: hash, document, first and last string, and a hash of the piece."""
    w = length - gram + 1
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, np.uint64), empty, empty, empty, np.empty(0, np.uint64)
    up, down = kernel.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    n = len(data) - gram + 1
    h = kernel.mix((total[gram:] - total[:-gram]) * down[:n])
    bits = np.uint64(max(1, int(n).bit_length()))
    place = np.arange(n, dtype=np.uint64)
    least = (h >> bits << bits) | place  # ties go to the left
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.ones(len(at), bool)
    for end in offsets[1:-1].tolist():  # strings do not reach into the next document
        valid[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return np.empty(0, np.uint64), empty, empty, empty, np.empty(0, np.uint64)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    low, high, anchor = starts[first], starts[np.r_[first[1:], len(at)] - 1], at[first]
    piece = kernel.mix((total[high + length] - total[low]) * down[low]) ^ kernel.mix(((high - low) << 20 | anchor - low).astype(np.uint64))
    return h[anchor], np.searchsorted(offsets, low, "right") - 1, low, high, kernel.mix(piece)


def _anchor_hashes(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                h = anchors(*kernel.buffers(piece.column("text")), length, gram)[0]
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"])

    return run


def _places(length: int, gram: int, known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                data, offsets = kernel.buffers(piece.column("text"))
                h, doc, low, high, p = anchors(data, offsets, length, gram)
                keep = kernel.has_bit(known, h)
                h, doc, low, high, p = h[keep], doc[keep], low[keep], high[keep], p[keep]
                keys = piece.column("key").to_numpy(zero_copy_only=False)[doc]
                columns = [h.astype(np.int64), p.astype(np.int64), keys.astype(np.int64), low - offsets[doc], high - low + 1]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "p", "key", "low", "n"])

    return run


def _cut_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                data, offsets = kernel.buffers(piece.column("text"))
                lists = piece.column("places")
                flat = lists.flatten()
                h, low, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                doc = np.repeat(np.arange(piece.num_rows), np.diff(np.asarray(lists.offsets)))
                begin = offsets[doc] + low
                raw = data.tobytes()
                keys = piece.column("key").to_numpy(zero_copy_only=False)[doc]
                cut = pa.array([raw[b : b + k + length - 1] for b, k in zip(begin.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(keys, pa.int64()), pa.array(low, pa.int64()), pa.array(n, pa.int64()), cut], names=["h", "key", "low", "n", "piece"])

    return run


def _sort_shard(length: int):
    """A shard's pieces in, (key, low, n) of repeated strings out; rows of one anchor are all in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        keys, low, n = (rows.column(c).to_numpy() for c in ("key", "low", "n"))
        order = np.lexsort((low, keys))
        keys, low, n = keys[order], low[order], n[order]
        data, offsets = kernel.buffers(rows.column("piece").take(pa.array(order)).combine_chunks().cast(pa.large_binary()))
        del rows, batches
        flags = repeats([data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], n, length)
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        owner, place = owner[flags], place[flags]
        if not len(owner):
            return
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(owner)])
        yield pa.RecordBatch.from_arrays([pa.array(keys[owner[first]]), pa.array(low[owner[first]] + place[first]), pa.array(count, pa.int64())], names=["key", "low", "n"])

    return run


def _sized(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def repeated_runs(firsts: DataFrame, scratch: Scratch, length: int, gram: int) -> DataFrame:
    """(key, runs): per document the intervals [first, last] of strings that start earlier too; firsts: rows (key, text), no text twice."""
    once = firsts.mapInArrow(_anchor_hashes(length, gram), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    again = scratch.save(once)
    shared = firsts.sparkSession.sparkContext.broadcast(kernel.bit_table(again, FILTER_BITS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _places(length, gram, shared.value)(batches)

    found = firsts.mapInArrow(places, "h long, p long, key long, low long, n long")
    places_ = scratch.save(found)
    scratch.drop(again)
    place = F.struct("key", "low")
    pieces = scratch.save(places_.groupBy("h", "p").agg(F.min(F.struct("key", "low", "n")).alias("origin"), F.count(F.lit(1)).alias("times")))
    several = pieces.where("times > 1").select("h", "p", F.struct(F.col("origin")["key"].alias("key"), F.col("origin")["low"].alias("low")).alias("o"))
    whole = scratch.save(places_.join(several, ["h", "p"]).where(place > F.col("o")).select("key", "low", "n"))
    unlike = pieces.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h", (F.col("kinds") > GROUP).alias("hot"))
    chosen = pieces.join(unlike, "h").select("h", "origin.*", "hot")
    wanted = scratch.save(chosen.groupBy("key").agg(F.collect_list(F.struct("h", "low", "n", "hot")).alias("places"), F.max("hot").alias("hot")))
    n_pieces, n_bytes = wanted.select(F.explode("places").alias("x")).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("x")["n"] + length), F.lit(0))).first()
    scratch.drop(places_, pieces)
    shards = max(1, -(-n_bytes // SHARD_BYTES))
    cut = firsts.join(_sized(wanted, n_pieces), "key").select("key", "text", F.filter("places", lambda x: ~x["hot"]).alias("places")).mapInArrow(_cut_pieces(length), "h long, key long, low long, n long, piece binary")
    partly = cut.repartition(shards, "h").mapInArrow(_sort_shard(length), "key long, low long, n long")
    marks = whole.union(partly).union(_hot_repeats(firsts, wanted, n_pieces, scratch, length)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("low", "n"))).alias("m"))
    m = F.col("m")
    gap = lambda x, y: x["low"] + x["n"] < y["low"]
    opens = F.filter(m, lambda x, i: F.coalesce(gap(F.get(m, i - 1), x), F.lit(True)))
    ends = F.filter(m, lambda x, i: F.coalesce(gap(x, F.get(m, i + 1)), F.lit(True)))
    return scratch.save(marks.select("key", F.zip_with(opens, ends, lambda a, b: F.struct(a["low"].alias("first"), (b["low"] + b["n"] - 1).alias("last"))).alias("runs")))


def _hot_repeats(firsts: DataFrame, wanted: DataFrame, n_pieces: int, scratch: Scratch, length: int) -> DataFrame:
    """(key, low, n) of repeated strings among the pieces of anchors with very many of them."""
    hot = wanted.where("hot").select("key", F.filter("places", lambda x: x["hot"]).alias("places"))
    if not hot.limit(1).count():
        return firsts.sparkSession.createDataFrame([], "key long, low long, n long")
    strings = firsts.join(_sized(hot, n_pieces), "key").select("key", "text", "places").mapInArrow(_strings(length), "a long, b long, key long, low long")
    strings = scratch.save(strings)
    place = F.struct("key", "low")
    earliest = strings.groupBy("a", "b").agg(F.min(place).alias("o"), F.count(F.lit(1)).alias("times")).where("times > 1").select("a", "b", "o")
    return strings.join(earliest, ["a", "b"]).where(place > F.col("o")).select("key", "low", F.lit(1).cast("long").alias("n"))


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "text"):
                data, offsets = kernel.buffers(piece.column("text"))
                flat = piece.column("places").flatten()
                low, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                doc = np.repeat(np.arange(piece.num_rows), np.diff(np.asarray(piece.column("places").offsets)))
                owner = np.repeat(np.arange(len(n)), n)
                start = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                up, down = kernel.powers(len(data) + 1)
                at = offsets[doc[owner]] + start
                hashes = []
                for salt in (1, 3):
                    total = np.zeros(len(data) + 1, np.uint64)
                    np.cumsum((kernel.mix(data.astype(np.uint64) * np.uint64(salt) + np.uint64(salt))) * up[:-1], out=total[1:])
                    hashes.append(kernel.mix((total[at + length] - total[at]) * down[at]).astype(np.int64))
                keys = piece.column("key").to_numpy(zero_copy_only=False)[doc[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*hashes, keys, start)], names=["a", "b", "key", "low"])

    return run


def _cut_texts(length: int, digest: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kernel.slices(batch, "__text", 1 << 20):
                data, offsets = kernel.buffers(piece.column("__text"))
                copies = piece.column("__copy").to_pylist()
                rows = []
                for d, runs in enumerate(piece.column("__runs").to_pylist()):
                    text = data[offsets[d] : offsets[d + 1]].tobytes()
                    spans = [[0, len(text)]] if copies[d] and len(text) >= length else []
                    for r in () if copies[d] else runs or ():
                        begin, end = r["first"], r["last"] + length
                        if spans and begin <= spans[-1][1]:
                            spans[-1][1] = max(end, spans[-1][1])
                        else:
                            spans.append([begin, end])
                    kept, at = [], 0
                    for begin, end in spans:
                        kept.append(text[at:begin])
                        at = end
                    left = b"".join([*kept, text[at:]])
                    rows.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest() if digest else left))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
                made = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(piece.num_columns - 3)] + made, names=names)

    return run


def dedup(docs: DataFrame, columns: list[str], length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """The given columns, then n_bytes, n_removed, n_spans and the kept bytes, or with `digest` their SHA-256."""
    scratch = Scratch(docs.sparkSession)
    columns = [c for c in columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), value.alias("text"))
    named = source.select("key", F.unhex(F.sha2("text", 256)).alias("name"), F.octet_length("text").alias("size"))
    prints = scratch.save(named)
    if prints.where("key is not null").groupBy("key").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").limit(1).count():
        # several texts under one id: rows are numbered in the order of id and name, and the numbers are the keys
        numbers = running(scratch.save(prints.where("key is not null").select("key", "name").distinct()), [], ["key", "name"], [], scratch)
        numbers = numbers.select(F.col("key").alias("__id"), F.col("name").alias("__name"), F.col("before").alias("__row"))
        told = docs.withColumn("__id", F.col(f"`{key}`").cast("long")).withColumn("__name", F.unhex(F.sha2(value, 256)))
        rows = told.join(numbers, ["__id", "__name"], "left")
        return dedup(rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text])], "__row"), columns, length, gram, "__row", text, digest)
    least = prints.groupBy("name", "size").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = scratch.save(prints.join(least, ["name", "size"]).where("key > first").select("key").distinct())
    n_copies = copies.count()
    twice = prints.join(least, ["name", "size"]).where((F.col("key") == F.col("first")) & (F.col("size") >= length))
    rows_again = scratch.save(twice.groupBy("key", "name", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key").distinct())
    n_again = rows_again.count()
    scratch.drop(prints)
    firsts = source.where(F.col("key").isNotNull() & (F.octet_length("text") >= length)).join(_sized(copies, n_copies), "key", "left_anti")
    if n_again:  # a row and its repeats are one text
        again = firsts.join(_sized(rows_again, n_again), "key", "left_semi").dropDuplicates(["key", "text"])
        firsts = firsts.join(_sized(rows_again, n_again), "key", "left_anti").union(again)
    runs = repeated_runs(firsts, scratch, length, gram)
    n_runs = runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    picked = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{key}`").cast("long").alias("__key"), value.alias("__text"))
    flagged = picked.join(_sized(copies.select(F.col("key").alias("__key"), F.lit(True).alias("__copy")), n_copies), "__key", "left")
    flagged = flagged.join(_sized(runs.select(F.col("key").alias("__key"), F.col("runs").alias("__runs")), n_runs), "__key", "left")
    source_ = flagged.select(*[F.col(f"`{c}`") for c in columns], "__text", F.coalesce("__copy", F.lit(False)).alias("__copy"), "__runs")
    last = "kept_sha256 string" if digest else "kept binary"
    schema = T.StructType([*source_.schema.fields[:-3], *T._parse_datatype_string(f"n_bytes long, n_removed long, n_spans long, {last}").fields])
    return source_.mapInArrow(_cut_texts(length, digest, schema.names), schema)
