"""Total orders at scale: global ranks and running sums without one task that sees all rows, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.session import cut, parallelism, rows_of

MAX_PARTITIONS = 100_000


def running(df: DataFrame, order: list[str], size: str | None = None, rank: str = "rank", offset: str = "offset") -> DataFrame:
    """``df`` with its 0-based ``rank`` in the total order of ``order`` and, for a ``size`` column, the sum of sizes before it.

    Range partitioning, a sort within partitions, a running sum within each, and one number per partition added: the rows
    pass one shuffle and no partition waits for another. ``order`` must be a total order for a repeatable result; null sizes
    count as 0. Nulls come first in the order.
    """
    from pyspark.sql import Window

    amount = F.coalesce(F.col(size), F.lit(0)).cast("bigint") if size else F.lit(0).cast("bigint")
    r = df.withColumn("_size", amount).repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    r = cut(r.withColumns({"_pid": F.spark_partition_id(), "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = rows_of(r.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s")).orderBy("_pid"), MAX_PARTITIONS)
    starts, at, total = [], 0, 0
    for p in parts:
        starts.append((p["_pid"], at, total))
        at, total = at + p.n, total + p.s
    base = df.sparkSession.createDataFrame(starts, "_pid int, _start long, _before long")
    r = r.join(F.broadcast(base), "_pid").withColumn(rank, F.col("_start") + F.col("_idx"))
    if size:
        inside = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
        r = r.withColumn(offset, F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return r.drop("_size", "_pid", "_idx", "_start", "_before")


def after(keys: list[tuple[str, object, bool]]) -> Column:
    """Keyset condition: rows that come after the given key values; each key is (column, value, descending)."""
    cond, equal = F.lit(False), F.lit(True)
    for name, value, descending in keys:
        c, v = F.col(name), F.lit(value)
        cond = cond | (equal & ((c < v) if descending else (c > v)))
        equal = equal & (c == v)
    return cond


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; planned as a top-k, not a full sort."""
    if not 0 < limit <= 10_000 or offset < 0:
        raise ValueError("limit must be in 1..10000, offset not negative")
    got = df.orderBy(*order)
    return got.limit(limit) if not offset else got.offset(offset).limit(limit)


def has_more(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """A page, and one row that tells whether there is another: one row more than asked for is read, nothing is counted."""
    probe = page(df, order, limit + 1)
    return probe.limit(limit), probe.agg((F.count(F.lit(1)) > limit).alias("has_more"))


def shards(df: DataFrame, order: list[str], per_shard: int) -> DataFrame:
    """``df`` with the number of its shard of ``per_shard`` consecutive rows."""
    return running(df, order).withColumn("shard", F.floor(F.col("rank") / per_shard)).drop("rank")
