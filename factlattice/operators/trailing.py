"""Totals over trailing periods by block decomposition.

The calendar of each entity is cut into blocks as long as the window. Within a block, prefix sums run forward and suffix sums
backward; the total of any trailing window is the prefix up to its last day plus the suffix, in the block before, from its
first day. So each day costs the same whatever the window's length, and nothing is subtracted (no cancellation in doubles).
One shuffle by entity serves all windows: rows are first summed to one per entity and day, so a hot entity is at most its days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(events: DataFrame, entity: str, at: str, amount: str) -> DataFrame:
    """(entity, day, total, n): one row for each day with an event; a null amount counts as 0; rows without entity or time are left out."""
    day = F.to_date(F.col(at))
    ok = events.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    return ok.groupBy(F.col(entity).alias("entity"), day.alias("day")).agg(F.sum(F.coalesce(F.col(amount), F.lit(0))).alias("total"),
        F.count(F.lit(1)).alias("n"))


def calendar(days: DataFrame) -> DataFrame:
    """Every day from the entity's first to its last, with 0 where nothing happened; ``i`` counts from 0.

    Each day with events fills the gap up to the next one, so no join is needed and the exchange by entity is the windows' own.
    """
    by = Window.partitionBy("entity").orderBy("day")
    known = days.select(
        "entity", F.col("day").alias("_day"), "total", "n", F.lead("day").over(by).alias("_next"), F.first("day").over(by).alias("_first")
    )
    grid = known.withColumn("day", F.explode(F.sequence("_day", F.coalesce(F.date_sub("_next", 1), F.col("_day")))))
    own = F.col("day") == F.col("_day")
    zero = F.lit(0)
    return grid.select("entity", "day", F.datediff("day", "_first").alias("i"), F.when(own, F.col("total")).otherwise(zero).alias("total"),
        F.when(own, F.col("n")).otherwise(zero).alias("n"))


def trailing(cal: DataFrame, windows: Sequence[int], value: str = "total") -> DataFrame:
    """``cal`` with ``sum_w`` and ``avg_w`` for each window of w days, the day included.

    In the first w - 1 days the total holds the days there are, and the average divides by their number.
    """
    out = cal
    by = Window.partitionBy("entity").orderBy("i")
    for w in windows:
        block = F.floor(F.col("i") / w).alias("b")
        out = out.withColumn("_b", block)
        inside = Window.partitionBy("entity", "_b").orderBy("i")
        out = out.withColumn("_p", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        back = Window.partitionBy("entity", "_b").orderBy(F.desc("i"))
        out = out.withColumn("_s", F.sum(value).over(back.rowsBetween(Window.unboundedPreceding, 0)))
        start = F.lag("_s", w - 1).over(by) if w > 1 else F.col("_s")
        whole = F.pmod(F.col("i"), F.lit(w)) == w - 1  # the window is one block: its prefix is the total
        # before the first full window the suffix of block 0 starts at day 0, so the prefix alone is right as well
        total: Column = F.when(whole | (F.col("i") < w - 1), F.col("_p")).otherwise(F.col("_p") + start)
        out = out.withColumn(f"sum_{w}", total).withColumn(f"avg_{w}", F.col(f"sum_{w}") / F.least(F.col("i") + 1, F.lit(w)))
    return out.drop("_b", "_p", "_s")


def trailing_totals(events: DataFrame, entity: str, at: str, amount: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """One row for each entity and day from its first to its last event: day total, and totals and averages over ``windows``."""
    cal = calendar(daily(events, entity, at, amount))
    return trailing(cal, windows)
