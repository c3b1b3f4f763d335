"""Exact running totals within groups, with no task that holds a whole group.

A window over a group is one task's work, however large the group is.  Here rows are
dealt by ranges of (group, order, row), so that a hot group, and even one repeated key,
is cut into many ranges.  Totals of the ranges give what stands before each, and a
window inside a range gives the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.scratch import Scratch

#: Rows of a range, at least where there are few and at most where there are many.
FEW, MANY = 4_000, 250_000
#: Rows (about 100 bytes each) up to which a table goes to all tasks; beyond, a shuffle join is used.
BROADCAST_ROWS = 100_000
#: Ids (8 bytes each) up to which a table of ids is broadcast; beyond, a shuffle join is used.
BROADCAST_IDS = 2_000_000


def sized(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def running(table: DataFrame, groups: list[str], order: list[str], sums: list[str], scratch: Scratch) -> DataFrame:
    """The saved table's columns, `before` (rows before this one in its group) and `before_<s>` for each of the sums.

    Groups must not be null; orders ascend, null first; rows that are equal in both
    follow each other in any order.
    """
    rows = table.count()
    spread = min(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // FEW)
    ranges = max(1, spread, -(-rows // MANY))
    placed = table.withColumn("__row", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(ranges, *groups, *order, "__row").withColumn("__range", F.spark_partition_id())
    dealt = scratch.save(dealt)
    totals = dealt.groupBy(*groups, "__range").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(s).alias(f"__n_{s}") for s in sums])
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    told = [F.coalesce(F.sum(f"__n{c}").over(earlier), F.lit(0)).alias(f"__start{c}") for c in ["", *[f"_{s}" for s in sums]]]
    starts = scratch.save(totals.select(*groups, "__range", *told))
    inside = Window.partitionBy(*groups, "__range").orderBy(*order, "__row").rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.join(sized(starts, starts.count()), [*groups, "__range"])
    return both.select(
        *table.columns,
        (F.col("__start") + F.count(F.lit(1)).over(inside)).alias("before"),
        *[(F.col(f"__start_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in sums],
    )


def shares_ids(docs: DataFrame, key: str) -> bool:
    """Whether two rows or more have one id; only ids are read."""
    return bool(docs.select(F.col(f"`{key}`").alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows, saved with `__row`, a number of their own, for tables in which ids are shared."""
    return scratch.save(docs.withColumn("__row", F.monotonically_increasing_id()))


def built(saved: DataFrame) -> DataFrame:
    """The saved table of ids as the side that is held in a join with whole rows.

    Those move only where the ids are too many for every task, and are not sorted then either.
    """
    return F.broadcast(saved) if saved.count() <= BROADCAST_IDS else saved.hint("shuffle_hash")


def without(docs: DataFrame, key: str, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose key is none of the ids, a table of one column."""
    gone = built(scratch.save(ids.toDF("__gone").distinct()))
    return docs.join(gone, F.col(f"`{key}`").cast("long") == F.col("__gone"), "left_anti")
