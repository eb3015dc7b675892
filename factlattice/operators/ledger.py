"""Bitemporal history of changing attributes, built by a sweep over valid time.

Input: versions of keys, each known since ``recorded`` and valid from ``start``. Versions are ordered by (start, recorded, id).
A version that arrives late falls between two others: it splits the interval of the version before it. Nothing is
overwritten: the split interval gets a new ledger row, known from the late version's recorded time on, and its earlier row is
closed in recorded time. So the ledger answers both "what was true on day x" and "what did we believe, on day y, was true".

The sweep: with r the rank in recorded time, the successor of a version when it arrives is the next version with smaller r,
and each later arrival splits the nearest version before it with smaller r. Both come from one pass with a stack.

Skew: rows are range-partitioned by (key, order), so one hot key simply spans several partitions. Pass 1 sweeps each partition
by itself. What a partition can't know is settled in pass 2, which gets only rows at partition borders: the versions that have
no smaller r before them in their partition (they split an earlier partition's version), and the stack entries that such a
version of a later partition can reach. Entries out of reach, which is nearly all of them where records come in order, are
final after a comparison with one number per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlattice.session import cut, parallelism, small_copy

_ROW = "key string, id string, start long, recorded long, pid int, pos long, open boolean, pending boolean, head boolean, prev_id string, s0_start long, s0_id string, kid_start array<long>, kid_recorded array<long>, kid_id array<string>"
_COLS = [c.strip().split(" ")[0] for c in _ROW.split(", ")]


class _Entry:
    """A version on the stack; kids are the versions that split it, in valid order."""

    __slots__ = ("row", "rank", "kids")

    def __init__(self, row: dict, rank: tuple):
        self.row, self.rank, self.kids = row, rank, []


def _emit(out: list, e: _Entry, pending: bool, s0: tuple | None) -> None:
    r = e.row
    r["pending"], r["s0_start"], r["s0_id"] = pending, s0[0] if s0 else None, s0[1] if s0 else None
    r["kid_start"], r["kid_recorded"], r["kid_id"] = [k[0] for k in e.kids], [k[1] for k in e.kids], [k[2] for k in e.kids]
    out.append(tuple(r[c] for c in _COLS))


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass 1 over one sorted partition. A key that ends inside is final; the stack of the last key stays pending. Of the first
    key, which may go on from the partition before, versions without a smaller r before them are ``open``."""
    stack: list[_Entry] = []
    key, last, pos, first_key = None, None, 0, True
    for frame in frames:
        out: list[tuple] = []
        for k, fid, start, recorded, pid in zip(frame["key"], frame["id"], frame["start"], frame["recorded"], frame["pid"], strict=True):
            if pos and k != key:
                for e in stack:
                    _emit(out, e, False, None)
                stack, last, first_key = [], None, False
            key, rank = k, (recorded, start, fid)
            while stack and stack[-1].rank > rank:
                _emit(out, stack.pop(), False, (start, fid))
            if stack:
                stack[-1].kids.append((start, recorded, fid))
            row = {"key": k, "id": fid, "start": start, "recorded": recorded, "pid": pid, "pos": pos, "open": first_key and not stack,
                "head": first_key and pos == 0, "prev_id": last}
            stack.append(_Entry(row, rank))
            last, pos = fid, pos + 1
        if out:
            yield pd.DataFrame(out, columns=_COLS).astype({"s0_start": "Int64"})
    out = []
    for e in stack:
        _emit(out, e, True, None)
    if out:
        yield pd.DataFrame(out, columns=_COLS).astype({"s0_start": "Int64"})


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Pass 2 over the border rows of one key, partition by partition."""
    frame = frame.sort_values(["pid", "pos"])
    out: list[tuple] = []
    stack: list[_Entry] = []
    last_of: str | None = None
    for _, part in frame.groupby("pid", sort=True):
        waiting: list[_Entry] = []
        for row in part.to_dict("records"):
            e = _Entry({c: row[c] for c in _COLS}, (row["recorded"], row["start"], row["id"]))
            e.kids = list(zip(row["kid_start"], row["kid_recorded"], row["kid_id"], strict=True))
            if row["head"]:
                e.row["prev_id"] = last_of
            if row["open"]:
                while stack and stack[-1].rank > e.rank:
                    _emit(out, stack.pop(), False, (row["start"], row["id"]))
                if stack:
                    stack[-1].kids.append((row["start"], row["recorded"], row["id"]))
            if row["pending"]:
                waiting.append(e)
            else:
                s0 = None if pd.isna(row["s0_start"]) else (int(row["s0_start"]), row["s0_id"])
                _emit(out, e, False, s0)
        stack += waiting
        if waiting:
            last_of = waiting[-1].row["id"]
    for e in stack:
        _emit(out, e, False, None)
    got = pd.DataFrame(out, columns=_COLS)
    got["s0_start"] = got["s0_start"].astype("Int64")
    return got


def ledger(versions: DataFrame, partitions: int | None = None) -> DataFrame:
    """The ledger of ``versions(key STRING, id STRING, start BIGINT, recorded BIGINT)``; times in microseconds.

    Result: ``key, id, valid_from, valid_to, next_id, prev_id, known_from, known_to, current``. ``valid_to`` null: still valid;
    ``known_to`` null: still believed, then ``current`` is true, and there is exactly one such row of each version;
    ``next_id`` and ``prev_id`` are the versions after and before (``prev_id`` as known now). Repeated input rows must be
    removed before; a null start or recorded time sorts first, as the smallest BIGINT. An empty input gives no rows.
    """
    spark = versions.sparkSession
    least = F.lit(-(2**63)).cast("bigint")
    v = versions.select("key", "id", F.coalesce("start", least).alias("start"), F.coalesce("recorded", least).alias("recorded"))
    order = ["key", "start", "recorded", "id"]
    v = v.repartitionByRange(partitions or parallelism(spark), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    swept = cut(v.mapInPandas(_sweep, _ROW))

    # per key and partition, for keys that touch a border: the earliest record that a later partition holds
    rank = F.struct("recorded", "start", "id")
    border = swept.where("pending or open").groupBy("key", "pid").agg(F.min(rank).alias("least"),
        F.max(F.when(F.col("open"), F.lit(1)).otherwise(0)).alias("has_open"))
    crossing = border.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("_n > 1")
    later = crossing.withColumn("later", F.min("least").over(Window.partitionBy("key").orderBy("pid").rowsBetween(1, Window.unboundedFollowing)))
    later = later.select("key", "pid", "later")  # at most a few rows per partition: a key crosses a border only as its first or last
    bound = 2 * swept.rdd.getNumPartitions() + 2
    tagged = swept.join(small_copy(later.withColumn("crosses", F.lit(True)), bound), ["key", "pid"], "left")
    reach = F.col("later").isNotNull() & (rank > F.col("later"))
    touched = F.coalesce("crosses", F.lit(False))
    # of the entries below the reach only the top one can get another child; it is the one that the later record splits
    below = tagged.where(touched & F.col("pending") & ~F.col("open") & F.col("later").isNotNull() & ~reach)
    top = below.groupBy("key", "pid").agg(F.max("pos").alias("top"))
    tagged = tagged.join(small_copy(top, bound), ["key", "pid"], "left")
    unsure = touched & (F.col("open") | (F.col("pending") & (reach | F.coalesce(F.col("pos") == F.col("top"), F.lit(False)))))
    merged = tagged.where(unsure).select(*_COLS).groupBy("key").applyInPandas(_merge, _ROW)
    settled = tagged.where(~unsure).select(*_COLS).unionByName(merged)

    first = F.array(F.struct(F.col("s0_start").alias("valid_to"), F.col("s0_id").alias("next_id"), F.col("recorded").alias("known_from")))
    kids = F.reverse(F.arrays_zip(F.col("kid_start").alias("valid_to"), F.col("kid_id").alias("next_id"), F.col("kid_recorded").alias("known_from")))
    steps = F.concat(first, F.transform(kids, lambda k: F.struct(k["valid_to"].alias("valid_to"), k["next_id"].alias("next_id"),
        k["known_from"].alias("known_from"))))
    rows = settled.select("key", "id", "start", "prev_id", steps.alias("steps"))
    rows = rows.select("key", "id", "start", "prev_id", "steps", F.posexplode("steps").alias("_i", "s"))
    known_to = F.when(F.col("_i") + 1 < F.size("steps"), F.col("steps")[F.col("_i") + 1]["known_from"])
    return rows.select(
        "key", "id", F.col("start").alias("valid_from"), F.col("s.valid_to").alias("valid_to"), F.col("s.next_id").alias("next_id"), "prev_id",
        F.col("s.known_from").alias("known_from"), known_to.alias("known_to"), (F.col("_i") + 1 == F.size("steps")).alias("current"),
    )
