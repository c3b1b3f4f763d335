"""A Merkle manifest of a table: bottom-up build, top-down proof push.

Each row is a leaf, the SHA-256 of its columns.  Within a group the leaves, in the order
of their key, are hashed by runs of `FANOUT` to the next level, until one node is left, the
group's subroot; subroots, ordered by group, give the root in the same way.  Every level
is a saved table of runs, (tree, run, hashes), so a level costs one exchange of an eighth of
the one below, and a lost executor one level.

Proofs are pushed down: runs join the path of the node above them, and each child puts its
own siblings before what it inherits.  A path is a list of (left, right): the siblings'
digests before and after the node.  Leaves meet their path once, with their run, so long
paths are shuffled for one leaf in `FANOUT` only.

Positions of leaves in their group come from :mod:`murmuration.llm.ranks`; no group, hot or
not, is one task's work, and nothing but one number a level reaches the driver.

Defined cases: a null is hashed as `-`; a null key comes first in its group, a null
group before all others; rows with equal key and group are ordered by their leaf, so
repeated rows are leaves of their own; an empty table has no root and gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.ranks import running
from murmuration.llm.scratch import Scratch

FANOUT = 8


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each column as `-` if null, else its UTF-8 length, `:` and itself."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return digest(*told)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


class Levels:
    """The saved runs of all trees, from the leaves up, and the trees' tops.

    runs[i]: (tree, run, nodes, n), nodes in order with their digest `h`, n of the tree's
    level; a tree of one node is a run of one on the first level.  tops: (tree, h, level).
    """

    def __init__(self, nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT):
        """nodes: (tree, pos, h, n) and more columns, which the lowest runs keep."""
        self.scratch, self.fanout, self.runs = scratch, fanout, []
        tops = []
        more = [c for c in nodes.columns if c not in ("tree", "n")]
        while True:
            level = len(self.runs)
            run = F.expr(f"pos div {fanout}").alias("run")
            grouped = nodes.groupBy("tree", run).agg(F.sort_array(F.collect_list(F.struct(*more))).alias("nodes"), F.first("n").alias("n"))
            self.runs.append(scratch.save(grouped))
            tops.append(self.runs[-1].where("n = 1").select("tree", F.col("nodes")[0]["h"].alias("h"), F.lit(level).alias("level")))
            upper = self.runs[-1].where("n > 1")
            if not upper.limit(1).count():
                break
            nodes = upper.select("tree", F.col("run").alias("pos"), F.sha2(F.array_join("nodes.h", ""), 256).alias("h"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"))
            more = ["pos", "h"]
        out = tops[0]
        for t in tops[1:]:
            out = out.union(t)
        self.tops = scratch.save(out)

    def push(self, paths: DataFrame) -> DataFrame:
        """(tree, node, path): each lowest node, with its columns, and its path; paths: (tree, level, path) of the tops."""
        above: DataFrame | None = None
        for level in range(len(self.runs) - 1, -1, -1):
            own = paths.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("run"), "path")
            runs = self.runs[level]
            alone = runs.where("n = 1").join(own, ["tree", "run"]).select("tree", "run", F.explode("nodes").alias("node"), "path")
            if above is None:
                found = alone
            else:
                told = runs.where("n > 1").join(above, ["tree", "run"]).select("tree", "run", "nodes", "path", F.posexplode("nodes").alias("i", "node"))
                h = F.col("nodes.h")
                beside = F.struct(F.array_join(F.slice(h, 1, F.col("i")), "").alias("left"), F.array_join(F.slice(h, F.col("i") + 2, F.lit(self.fanout)), "").alias("right"))
                found = told.select("tree", "run", "node", F.concat(F.array(beside), F.col("path")).alias("path")).union(alone)
            if level == 0:
                return found.select("tree", "node", "path")
            above = self.scratch.save(found.select("tree", F.col("node.pos").alias("run"), "path"))
        raise AssertionError("a tree has a level")


def build(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None, fanout: int = FANOUT, scratch: Scratch | None = None) -> DataFrame:
    """(key, group, leaf, changed, subroot, root, path) of every row.

    tampered: expressions that replace columns; `changed` is the leaf of the row so replaced.
    path: (left, right) from the leaf's run to the root; :func:`proof` and :func:`fold` read it.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    column = {c: F.col(f"`{c}`") for c in columns}
    changed = column | (tampered or {})
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    leaves = scratch.save(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("grp"), tree.alias("tree"), leaf(list(column.values())).alias("h"), leaf(list(changed.values())).alias("changed")))
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    placed = running(leaves, ["tree"], ["key", "h"], [], scratch).withColumnRenamed("before", "pos").join(sizes, "tree")
    lower = Levels(placed.select("tree", "pos", "h", "n", "key", "grp", "changed"), scratch, fanout)
    ordered = running(lower.tops, [], ["tree"], [], scratch).crossJoin(F.broadcast(lower.tops.agg(F.count(F.lit(1)).alias("n"))))  # one row
    upper = Levels(ordered.select(F.lit("").alias("tree"), F.col("before").alias("pos"), "h", "n", F.col("tree").alias("of"), F.col("level").alias("at")), scratch, fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    roots = upper.tops.select(F.col("h").alias("root"))
    pushed = upper.push(upper.tops.select("tree", "level", none.alias("path")))
    subroots = scratch.save(pushed.select(F.col("node.of").alias("tree"), F.col("node.at").alias("level"), "path", F.col("node.h").alias("subroot")).crossJoin(F.broadcast(roots)))
    found = lower.push(subroots.select("tree", "level", "path"))
    told = found.join(subroots.select("tree", "subroot", "root"), "tree")
    return told.select(F.col("node.key").alias(key), F.col("node.grp").alias(group), F.col("node.h").alias("leaf"), F.col("node.changed").alias("changed"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """The digest of all siblings, from the leaf's to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["left"], h, x["right"]))
