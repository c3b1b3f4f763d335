"""A prefix trie of conversations: distributed MSD radix partitioning, multikey quicksort in small buckets.

Turns are encoded by a dictionary: a turn (role, text) is named by its SHA-256, and each
different name gets a number.  Texts are read once and never shuffled.  A node is a
sequence of turns that conversations start with.

Conversations with equal sequences are one sequence with a count; its members' ids are only
listed for their hash, which tasks extend part by part in ascending order.  All sequences
begin in one bucket, the root.  In each round the next turns of the sequences in a
bucket, 1, 2, 4 ... of them, are its digits: sequences are counted by all their prefixes,
which gives the nodes that are still too large to be local, and falls into the buckets
below them.  Since digits double in length, a prefix of n turns that very many
sequences share takes log n rounds.

A bucket of one sequence is a chain of nodes, which columns say directly, however long it is.  A
bucket of at most `LOCAL` turns goes to one task: multikey quicksort splits it by the
next turn into less, equal and greater, and each equal part is a node.  What the nodes of
large buckets sum over their subtrees is gathered by doubling: a node's sums over 2^i
levels go to its ancestor 2^i levels up, so n levels take log n joins.

Defined cases: turns are ordered by number, null first, and by their name where numbers
repeat; a null role or text is empty; rows without a conversation's id belong to none and
are left out; a conversation all of whose turns were replaced by nothing is a member of
the root only; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.ranks import running
from murmuration.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a bucket that one task finishes.
LOCAL = 2_048
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encode(turns: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The saved (conv, pos, tid, words): each turn's place in its conversation, from 1, its number in the dictionary and its words."""
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    name = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))
    named = turns.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), name.alias("name"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))
    named = scratch.save(named)
    words = scratch.save(named.groupBy("name").agg(F.first("words").alias("words")).withColumn("tid", F.monotonically_increasing_id()))
    placed = running(named.select("conv", "turn", "name"), ["conv"], ["turn", "name"], [], scratch)
    return scratch.save(placed.join(words, "name").select("conv", (F.col("before") + 1).alias("pos"), "tid", "words"))


def rebuild(coded: DataFrame, scratch: Scratch, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv) and the saved (conv, pos, tid, words) of conversations that begin as another does.

    The first h turns are those of conversation c - c % every (all if fewer, none if it
    is absent), then come c's own after its first h; h is the CRC-32 of c modulo `most`.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    convs = scratch.save(coded.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    asked = convs.select("conv", (F.col("conv") - F.col("conv") % every).alias("head"), h("conv").alias("h"))
    bases = convs.where(F.col("conv") % every == 0).select(F.col("conv").alias("head"), "n")
    lengths = scratch.save(asked.join(bases, "head", "left").select("conv", "head", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("given")))
    first = coded.where((F.col("conv") % every == 0) & (F.col("pos") < most)).select(F.col("conv").alias("head"), "pos", "tid", "words")
    given = lengths.join(first, "head").where("pos <= given").select("conv", "pos", "tid", "words")
    own = coded.where(F.col("pos") > h("conv")).join(lengths.select("conv", "h", "given"), "conv")
    return convs.select("conv"), scratch.save(given.union(own.select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "tid", "words")))


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids joined by commas, hashed seq by seq; rows come sorted and one sequence in one task."""
    at, state, done = None, None, []

    def flush() -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["seq", "ends"])

    for batch in batches:
        for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if seq != at:
                if state is not None:
                    done.append((at, state.hexdigest()))
                at, state = seq, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) > 10_000:
            yield from flush()
            done.clear()
    if state is not None:
        done.append((at, state.hexdigest()))
    if done:
        yield from flush()


def sequences(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Saved (seq, n, m, ends) and (seq, pos, tid, words, rest): the different sequences, and their turns.

    seq: the smallest member; n: turns; m: members; ends: the hash of their ids;
    rest: words from this turn to the end.
    """
    sums = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", "pos", "tid"), 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{i}") for i in range(4)]
    shape = ["n", *[f"d{i}" for i in range(4)]]
    by_conv = convs.join(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), *sums), "conv", "left").na.fill(0, ["n"])
    by_conv = scratch.save(by_conv.select("conv", "n", *[F.coalesce(f"d{i}", F.lit(0)).cast("decimal(38,0)").alias(f"d{i}") for i in range(4)]))
    unique = scratch.save(by_conv.groupBy(*shape).agg(F.min("conv").alias("seq"), F.count(F.lit(1)).alias("m")))
    listed = scratch.save(by_conv.join(unique, shape).select("seq", "conv"))
    parts = max(1, int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = listed.repartitionByRange(parts, "seq", "conv").withColumn("part", F.spark_partition_id())
    joined = ranged.groupBy("seq", "part").agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))  # a part is one task's share of all ids
    hashed = joined.repartition("seq").sortWithinPartitions("seq", "part").select("seq", "ids").mapInArrow(_hash_ids, "seq long, ends string")
    seqs = scratch.save(unique.select("seq", "n", "m").join(hashed, "seq"))
    kept = scratch.save(turns.withColumnRenamed("conv", "seq").join(seqs.select("seq"), "seq"))
    total = seqs.select("seq").join(kept.groupBy("seq").agg(F.sum("words").alias("all")), "seq")
    rest = running(kept, ["seq"], ["pos"], ["words"], scratch).join(total, "seq")
    return seqs, scratch.save(rest.select("seq", "pos", "tid", "words", (F.col("all") - F.col("before_words")).alias("rest")))


def _quicksort(rows: list[tuple], depth: int, parent: int) -> Iterator[tuple]:
    """Nodes below a bucket; rows: (seq, m, ends, tids, words) whose next turn is at `depth` of their lists.

    Yields NODE rows, the depth counted from the bucket, children before parents, and last
    (children, leaves, saved) of the bucket itself.
    """
    # a step is (rows, depth, frame) to split, or a frame alone to close its node; frame: [seq, depth, parent, n, children, leaves, saved, own, ends, frame above]
    top: list = [parent, depth, None, 0, 0, 0, 0, 0, EMPTY, None]
    steps: list = [(rows, depth, top)]
    while steps:
        step = steps.pop()
        if len(step) == 1:
            f = step[0]
            f[5] = f[5] or 1
            f[6] += f[7]
            yield f[0], f[1], f[2], f[3], f[4], f[5], f[6], f[8]
            above = f[9]
            above[4] += 1
            above[5] += f[5]
            above[6] += f[6]
            continue
        part, d, frame = step
        pivot = part[len(part) // 2][3][d]
        less, equal, greater = [], [], []
        for row in part:
            t = row[3][d]
            (less if t < pivot else greater if t > pivot else equal).append(row)
        for other in (less, greater):
            if other:
                steps.append((other, d, frame))
        n = sum(r[1] for r in equal)
        node = [min(r[0] for r in equal), d + 1, frame[0], n, 0, 0, 0, (n - 1) * equal[0][4][d], EMPTY, frame]
        steps.append((node,))
        below = []
        for row in equal:
            if len(row[3]) > d + 1:
                below.append(row)
            else:
                node[8] = row[2]
        if below:
            steps.append((below, d + 1, node))
    yield top[4], top[5], top[6]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets (bucket, depth, parent, seq, m, ends, tids, words), sorted by bucket and each in one task: their nodes.

    The last columns are the bucket's name and its children, leaves and saved tokens, in one row with no node.
    """
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "bucket"]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.binary()]
    out: list[tuple] = []

    def close(bucket: bytes, depth: int, parent: int, rows: list) -> None:
        *nodes, (children, leaves, saved) = _quicksort(rows, 0, parent)
        out.extend((c, d + depth, p, n, k, lv, s, e, None) for c, d, p, n, k, lv, s, e in nodes)
        out.append((None, None, None, None, children, leaves, saved, None, bucket))

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return made

    at, rows = None, []
    for batch in batches:
        for bucket, depth, parent, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if at is not None and at[0] != bucket:
                close(*at, rows)
                rows = []
            at = bucket, depth, parent
            rows.append(row)
        if len(out) > 20_000:
            yield flush()
    if at is not None:
        close(*at, rows)
    if out:
        yield flush()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, keys): the names of all prefixes that the next turns make of a named one."""
    for batch in batches:
        keys = []
        for key, tids in zip(batch.column("key").to_pylist(), batch.column("tids").to_pylist(), strict=True):
            made = []
            for t in tids:
                key = hashlib.sha256(key + t.to_bytes(8, "little")).digest()
                made.append(key)
            keys.append(made)
        yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(keys, pa.list_(pa.binary()))], names=["seq", "keys"])


def nodes(seqs: DataFrame, turns: DataFrame, scratch: Scratch, local: int = LOCAL) -> DataFrame:
    """All nodes of the trie of the saved sequences, with the columns of `NODE`."""
    root = F.lit(b"").cast("binary")
    live = scratch.save(seqs.select("seq", "n", "m", "ends", root.alias("key"), F.lit(0).cast("long").alias("depth")))
    large: list[DataFrame] = []  # nodes whose bucket was split: key, parent, depth, conv_id, n_convs, own, ends
    first = live.agg(F.min("seq").alias("conv_id"), F.sum("m").alias("n_convs"), F.max(F.when(F.col("n") == 0, F.col("ends"))).alias("ends")).where("conv_id is not null")
    large.append(scratch.save(first.select(root.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("own"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"))))
    settled: list[DataFrame] = []  # sequences in their local bucket: seq, n, m, ends, key, depth, alone, parent
    live = live.where("n > 0")
    digits = 1
    while live.limit(1).count():
        held = turns.join(live.select("seq", "key", "depth"), "seq").where(f"pos > depth and pos <= depth + {digits}")
        next_ = held.groupBy("seq", "key").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("t"))  # at most `digits`
        next_ = scratch.save(next_.select("seq", "key", F.col("t.tid").alias("tids"), F.col("t.words").alias("words")))
        named = next_.select("seq", "key", "tids").mapInArrow(_prefixes, "seq long, keys array<binary>")
        told = scratch.save(live.join(named, "seq").join(next_.select("seq", "words"), "seq"))
        each = told.select("seq", "n", "m", "ends", "depth", "key", "keys", F.posexplode("keys").alias("i", "at"), F.col("words"))
        each = each.select("at", F.when(F.col("i") == 0, F.col("key")).otherwise(F.get("keys", F.col("i") - 1)).alias("parent"), (F.col("depth") + F.col("i") + 1).alias("depth"), "seq", "m", F.get("words", "i").alias("words"), (F.col("n") - F.col("depth") - F.col("i") - 1).alias("left"), "ends")
        counted = each.groupBy("at").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("seq").alias("conv_id"), F.sum("m").alias("n_convs"), F.count(F.lit(1)).alias("kinds"),
            F.sum("left").alias("turns"), F.first("words").alias("words"), F.max(F.when(F.col("left") == 0, F.col("ends"))).alias("ends"),
        )
        counted = scratch.save(counted.withColumn("split", (F.col("kinds") > 1) & (F.col("turns") > local)))
        split = counted.where("split")
        large.append(scratch.save(split.select(F.col("at").alias("key"), "parent", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"))))
        # a sequence goes on below its deepest split prefix; the bucket is the next prefix, if there is one here
        deepest = each.join(split.select("at"), "at").groupBy("seq").agg(F.max(F.struct("depth", "at")).alias("p"))
        moved = told.join(deepest, "seq", "left").select("seq", "n", "m", "ends", "keys", F.col("depth").alias("d0"), F.coalesce("p.at", "key").alias("key"), F.coalesce("p.depth", "depth").alias("depth"))
        moved = scratch.save(moved.where("n > depth").withColumn("bucket", F.get("keys", (F.col("depth") - F.col("d0")).cast("int"))))
        kinds = counted.where("not split").select(F.col("at").alias("bucket"), (F.col("kinds") == 1).alias("alone"))
        settled.append(scratch.save(moved.where("bucket is not null").join(kinds, "bucket").select("seq", "n", "m", "ends", "bucket", "depth", "key", "alone")))
        live = moved.where("bucket is null").select("seq", "n", "m", "ends", "key", "depth")
        digits *= 2
    upper = scratch.save(_union(large))
    buckets = scratch.save(_union(settled)) if settled else None
    if buckets is None:
        return upper.selectExpr("conv_id", "depth", "CAST(null AS bigint) AS parent_conv_id", "n_convs", "0L AS n_children", "1L AS n_leaves", "0L AS saved_tokens", "ends AS ends_sha256")
    above = upper.select("key", F.col("conv_id").alias("parent"))
    chains = turns.join(buckets.where("alone").join(above, "key").select("seq", "n", "m", "ends", "depth", "parent"), "seq").where("pos > depth")
    last = F.col("pos") == F.col("n")
    chain_nodes = chains.select(
        F.col("seq").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth") + 1, F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("m").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("m") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    heads = turns.join(buckets.where("alone").select("seq", "m", "key", "depth"), "seq").where("pos = depth + 1")
    chain_sums = heads.groupBy("key").agg(F.count(F.lit(1)).alias("children"), F.count(F.lit(1)).alias("leaves"), F.sum((F.col("m") - 1) * F.col("rest")).alias("saved"))
    local_rows = turns.join(buckets.where("not alone").join(above, "key").select("seq", "m", "ends", "bucket", "depth", "parent"), "seq").where("pos > depth")
    local_rows = local_rows.groupBy("bucket", "depth", "parent", "seq", "m", "ends").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("t"))
    dealt = local_rows.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "depth", "parent", "seq", "m", "ends", F.col("t.tid").alias("tids"), F.col("t.words").alias("words"))
    finished = scratch.save(dealt.mapInArrow(_finish, f"{NODE}, bucket binary"))
    owners = buckets.where("not alone").select("bucket", "key").distinct()
    local_sums = finished.where("bucket is not null").join(owners, "bucket").groupBy("key").agg(F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    summed = _sum_up(upper, scratch.save(chain_sums.union(local_sums)), scratch)
    return finished.where("bucket is null").drop("bucket").union(chain_nodes).union(summed)


def _sum_up(upper: DataFrame, below: DataFrame, scratch: Scratch) -> DataFrame:
    """The large buckets' nodes with their children and the sums over their subtrees; below: (key, children, leaves, saved) of small buckets."""
    own = below.groupBy("key").agg(F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    split = upper.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    start = upper.join(own, "key", "left").join(split, "key", "left")
    children = zero("children") + zero("more")
    leaves = F.when(children == 0, F.lit(1).cast("long")).otherwise(zero("leaves"))
    start = scratch.save(start.select("key", "parent", "depth", "conv_id", "n_convs", "ends", children.alias("n_children"), leaves.alias("leaves"), (F.col("own") + zero("saved")).alias("saved")))
    state = start.select("key", F.col("parent").alias("up"), "leaves", "saved")
    while state.where("up is not null").limit(1).count():
        given = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("gl"), F.sum("saved").alias("gs"))
        farther = state.select(F.col("key").alias("up"), F.col("up").alias("far"))
        state = scratch.save(state.join(given, "key", "left").join(farther, "up", "left").select("key", F.col("far").alias("up"), (F.col("leaves") + zero("gl")).alias("leaves"), (F.col("saved") + zero("gs")).alias("saved")))
    named = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = start.drop("leaves", "saved").join(state, "key").join(named, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def trie(turns: DataFrame, local: int = LOCAL, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of conversations (conv_id, turn, role, text) as they are."""
    scratch = scratch or Scratch(turns.sparkSession)
    coded = encode(turns, scratch)
    return nodes(*sequences(coded.select("conv").distinct(), coded, scratch), scratch, local)


def rebuilt_trie(turns: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of conversations that were rebuilt by :func:`rebuild`."""
    scratch = Scratch(turns.sparkSession)
    return nodes(*sequences(*rebuild(encode(turns, scratch), scratch), scratch), scratch, local)
