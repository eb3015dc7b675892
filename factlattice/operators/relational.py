"""Filters, joins and sets on entity-attribute-value facts and their neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(facts: DataFrame) -> DataFrame:
    """Facts that are open and not retracted."""
    return facts.where(F.col("valid_to").isNull() & (F.coalesce("status", F.lit("")) != "RETRACTED"))


def as_of(facts: DataFrame, at: str) -> DataFrame:
    """Facts valid at an instant, half-open: from ``valid_from`` up to, not including, ``valid_to``."""
    t = F.lit(at).cast("timestamp_ntz")
    return facts.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def facet_filter(entities: DataFrame, facts: DataFrame, conditions: dict[str, Column], key: str = "entity_id") -> DataFrame:
    """Entities that meet a condition on each of several properties.

    All conditions are met in one pass over the facts: one aggregation with a flag for each property, then one semi join,
    whatever their number. An entity with several values of a property needs one that fits.
    """
    wanted = facts.where(F.col("property").isin(*conditions))
    flags = [F.bool_or((F.col("property") == p) & F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, (p, c) in enumerate(conditions.items())]
    met = wanted.groupBy(key).agg(*flags).where(reduce(lambda a, b: a & b, [F.col(f"_{i}") for i in range(len(conditions))]))
    return entities.join(met.select(key), key, "left_semi")


def facet_counts(facts: DataFrame, value: Column, max_values: int | None = None, key: str = "entity_id") -> DataFrame:
    """(property, value, entities) with, for each property, the range of numeric values and the sum of counts over all values, before
    the cut to ``max_values`` (most entities first, then by value)."""
    per = facts.groupBy("property", value.alias("value")).agg(F.count_distinct(key).alias("entities"))
    number = F.col("value").try_cast("double")
    whole = per.groupBy("property").agg(F.min(number).alias("low"), F.max(number).alias("high"), F.sum("entities").alias("property_entities"))
    # the first of each property are picked before and after the shuffle, so no task sees all values of a property
    top = per if max_values is None else top_per_key(per, ["property"], [F.desc("entities"), F.col("value")], max_values)
    return top.join(whole, "property").select("property", "value", "entities", "low", "high", "property_entities")


def flag(df: DataFrame, other: DataFrame, on: list[str], name: str) -> DataFrame:
    """``df`` with a boolean: whether ``other`` has its key. ``other`` is made distinct, so no row is repeated."""
    return df.join(other.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def either(df: DataFrame, table: DataFrame, left: str, rights: list[str]) -> DataFrame:
    """Join where ``left`` equals any of several columns of ``table``: a union of equi joins, never a nested loop. Each pair of rows
    comes once, from the first column that matches; repeated rows of either side stay repeated."""
    arms = []
    for i, r in enumerate(rights):
        earlier = reduce(lambda a, b: a | b, [F.coalesce(df[left] == table[x], F.lit(False)) for x in rights[:i]], F.lit(False))
        arms.append(df.join(table, (df[left] == table[r]) & ~earlier))
    return reduce(DataFrame.union, arms)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by ``order``: one hash aggregation with partial results, no sort of a group."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_m"))
    return got.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def drift(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, or whose other columns differ (null-safe): (keys, kind)."""
    rest = [c for c in expected.columns if c not in keys]
    e, a = expected.withColumn("_e", F.lit(1)), actual.select(*keys, *[F.col(c).alias(f"{c}__a") for c in rest]).withColumn("_a", F.lit(1))
    both = e.join(a, keys, "full_outer")
    differ = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"{c}__a")) for c in rest], F.lit(False))
    kind = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(differ, "changed")
    return both.select(*keys, kind.alias("kind")).where("kind is not null")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``batch`` replacing those of the same key, new ones added. One full outer join."""
    rest = [c for c in base.columns if c not in keys]
    b = batch.select(*keys, *[F.col(c).alias(f"{c}__n") for c in rest]).withColumn("_n", F.lit(True))
    both = base.join(b, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("_n"), F.col(f"{c}__n")).otherwise(F.col(c)).alias(c) for c in rest])


def changes(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): inserted, changed or unchanged by digest, and retired for stored keys that a complete snapshot leaves out."""
    s, i = stored.select(key, F.col(digest).alias("_s"), F.lit(True).alias("_has")), incoming.select(key, F.col(digest).alias("_i"),
        F.lit(True).alias("_new"))
    both = s.join(i, key, "full_outer")
    kind = F.when(F.col("_has").isNull(), "inserted").when(F.col("_new").isNull(), "retired").when(F.col("_s").eqNullSafe(F.col("_i")),
        "unchanged").otherwise("changed")
    return both.select(key, kind.alias("change"))


def compare(facts: DataFrame, entities: list[str], value: Column) -> DataFrame:
    """One row for each property, one column for each entity, and whether the entities differ (a missing value differs)."""
    wanted = facts.where(F.col("entity_id").isin(*entities)).select("property", "entity_id", value.alias("v"))
    per = wanted.groupBy("property").pivot("entity_id", entities).agg(F.min("v"))
    cells = F.array(*[F.coalesce(F.col(f"`{e}`"), F.lit("\u0000")) for e in entities])
    return per.withColumn("differs", F.size(F.array_distinct(cells)) > 1)


SALT_ABOVE = 20_000  # rows of a blocking key that one task joins with the whole key


def _blocks(records: DataFrame, keys: Column, ident: str) -> DataFrame:
    return records.select(F.col(ident).alias("id"),
        F.explode(F.array_distinct(keys)).alias("block")).where("block is not null and block <> ''").distinct()


def blocking_pairs(records: DataFrame, keys: Column, ident: str = "id", max_block: int | None = None) -> DataFrame:
    """(a, b, block): distinct pairs a < b that share a blocking key, with the first such key.

    A key of more than ``SALT_ABOVE`` rows is split: one side by salts, the other copied to each, so no task holds all its pairs.
    With ``max_block``, a larger block is an error, never cut or left out; ``oversized_blocks`` names such blocks beforehand."""
    b = _blocks(records, keys, ident)
    sizes = b.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    if max_block is not None:
        sizes = sizes.withColumn("n", F.when(F.col("n") > max_block, F.raise_error(F.concat(F.lit("block above the limit: "),
            "block"))).otherwise(F.col("n")))
    b = b.join(sizes.select("block", F.ceil(F.col("n") / SALT_ABOVE).cast("int").alias("parts")), "block")
    left = b.select(F.col("id").alias("a"), "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"))
    right = b.select(F.col("id").alias("b"), "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return left.join(right, ["block", "salt"]).where("a < b").groupBy("a", "b").agg(F.min("block").alias("block"))


def oversized_blocks(records: DataFrame, keys: Column, max_block: int, ident: str = "id") -> DataFrame:
    """(block, n): blocks that ``blocking_pairs`` refuses."""
    return _blocks(records, keys, ident).groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_block)


def episodes(df: DataFrame, keys: list[str], order: list[Column], state: str) -> DataFrame:
    """``df`` with ``episode``: 1, 2, ... counting the changes of ``state`` along the order of each key; nulls are a state too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    change = F.when(first | ~F.col(state).eqNullSafe(F.lag(state).over(w)), 1).otherwise(0)
    return df.withColumn("_c", change).withColumn("episode", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
