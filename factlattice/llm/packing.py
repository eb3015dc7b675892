"""Filling containers of fixed capacity with texts (best-fit decreasing with a segment tree over remaining capacities).

Within a shard, items go from the longest to the shortest, each into the open container with the least room that still holds
it. A segment tree over remaining capacities counts the open containers of each room; the tightest one that fits is found by
one descent, in time logarithmic in the capacity. A text longer than the capacity is split: full containers, and a rest that is packed like any item.
No other text is split.

Shards are formed by a hash of the item, so any number of items is packed in parallel with bounded memory, and equal lengths
never gather in one place. Each shard ends with a few loosely filled containers; a second round takes these as items, whole,
and packs them together in far fewer shards, so sharding costs almost no space.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.session import cut, rows_of

ITEMS_PER_SHARD = 20_000
MAX_TARGETS = 1000
LOOSE = 0.97  # containers filled below this share are packed once more


class Rooms:
    """Open containers by remaining capacity: a segment tree of counts, and a stack of containers at each leaf."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, container: int) -> None:
        if room:
            self.at[room].append(container)
            self._add(room, 1)

    def tightest(self, need: int) -> int:
        """The least room of an open container that is at least ``need``; -1 if none."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:  # up to the first right sibling with an open container, then down its left side
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.at[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container (0, 1, ...) of each of ``sizes``, which come from largest to smallest and are at most ``capacity``."""
    rooms, out, opened = Rooms(capacity), [], 0
    for size in sizes:
        room = rooms.tightest(size) if size else -1
        if size and room >= 0:
            c = rooms.take(room)
        elif size:
            c, room, opened = opened, capacity, opened + 1
        else:
            c = 0
            opened = max(opened, 1)
            out.append(c)
            continue
        rooms.put(room - size, c)
        out.append(c)
    return out


def known_targets(targets: DataFrame) -> list:
    """The usable targets: a short list by nature, whose size is checked."""
    return rows_of(targets.where((F.col("capacity") > 0) & F.col("target").isNotNull()).select("target", "capacity").distinct().orderBy("target"),
        MAX_TARGETS)


def pieces(items: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, capacity, item, piece, size): each item for each target; an item above the capacity in full pieces and a rest.

    Targets with a null or non-positive capacity and items with a null size are left out; an item of size 0 is one piece."""
    rows = known_targets(targets)
    if not rows:
        return items.limit(0).select(F.lit("").alias("target"), F.lit(0).cast("bigint").alias("capacity"), "item", F.lit(0).alias("piece"), "size")
    each = items.where("size is not null").withColumn("_t", F.explode(F.array(*[F.struct(F.lit(r.target).alias("target"),
        F.lit(int(r.capacity)).cast("bigint").alias("capacity")) for r in rows]))).select("*", "_t.*").drop("_t")
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity"))).cast("int")
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("size", F.least(F.col("capacity").cast("bigint"), F.col("size") - F.col("piece").cast("bigint") * F.col("capacity")))


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["size", "unit", "piece"], ascending=[False, True, True], kind="stable")
    capacity = int(frame["capacity"].iloc[0])
    frame["bin"] = best_fit_decreasing(frame["size"].tolist(), capacity)
    frame["fill"] = frame.groupby("bin")["size"].transform("sum")
    return frame[["target", "shard", "unit", "piece", "size", "bin", "fill"]]


_PACKED = "target string, shard long, unit string, piece long, size long, bin long, fill long"


def _round(units: DataFrame, shards: int) -> DataFrame:
    """One packing of ``units(target, capacity, unit, piece, size)``."""
    s = units.withColumn("shard", F.pmod(F.xxhash64("unit", "piece"), F.lit(shards)))
    return s.groupBy("target", "shard").applyInPandas(_pack, _PACKED)


def pack(items: DataFrame, targets: DataFrame, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """(target, container, item, piece, size) for ``items(item, size)`` and ``targets(target, capacity)``.

    No container holds more than the capacity, and every piece is in exactly one. Ties in size go by item. Repeated items are
    items of their own only if their ``item`` differs. Empty input gives no rows.
    """
    whole = F.col("size").cast("bigint")
    p = pieces(items, targets).select("target", F.col("capacity").cast("bigint").alias("capacity"), F.col("item").cast("string").alias("unit"),
        F.col("piece").cast("bigint").alias("piece"), whole.alias("size"))
    p = cut(p)  # the sizes may have cost tokenising; they are read three times
    full = (F.col("size") == F.col("capacity")) & (F.col("size") > 0)
    done = p.where(full).select("target", F.concat_ws("-", F.lit("f"), "unit", "piece").alias("container"), "unit", "piece", "size")
    rest = p.where(~full)
    first = cut(_round(rest, max(1, math.ceil(rest.count() / items_per_shard)))).withColumn("container", F.concat_ws("-", F.lit("a"), "shard", "bin"))
    caps = p.sparkSession.createDataFrame([(r.target, int(r.capacity)) for r in known_targets(targets)], "target string, capacity long")
    loose = first.groupBy("target", "container").agg(F.max("fill").alias("size")).join(F.broadcast(caps),
        "target").where(F.col("size") < F.col("capacity") * LOOSE)
    loose = cut(loose.select("target", "capacity", F.col("container").alias("unit"), F.lit(0).cast("bigint").alias("piece"), "size"))
    merged = _round(loose, max(1, math.ceil(loose.count() / items_per_shard))).select("target", F.col("unit").alias("container"),
        F.concat_ws("-", F.lit("b"), "shard", "bin").alias("to"))
    placed = first.join(merged, ["target", "container"], "left").select("target", F.coalesce("to", "container").alias("container"), "unit", "piece",
        "size")
    return placed.unionByName(done).select("target", "container", F.col("unit").alias("item"), "piece", "size")
