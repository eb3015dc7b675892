"""One canonical claim for each entity and property: a cascade of criteria applied to survivors, with the reason.

Not one sort: a criterion that nobody meets is skipped, and corroboration counts sources among those left by then. The first three
criteria are one lexicographic maximum; corroboration and consistency work on counts by value and source. All of it is hash
aggregation with partial results, so a hot field is reduced before each shuffle; only the distinct ranks of one, three numbers each,
pass a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(claims: DataFrame, consistent: Column, keys: tuple[str, str] = ("entity", "property")) -> DataFrame:
    """``claims(entity, property, claim, source, value, authority INT, reliability DOUBLE, observed TIMESTAMP, eligible BOOLEAN)``.

    Result: entity, property, claim, value, rule (the step that left one claim), candidates, conflicts (other values among the
    eligible). Steps: sole eligible candidate; highest authority; highest reliability; latest observation; most distinct sources
    for the same value; consistent values, if any; least claim id. Entities without an eligible claim have no row, nor has a null entity or
    property.
    """
    k, ranks = list(keys), ["_a", "_r", "_o"]
    c = claims.where(F.coalesce("eligible", F.lit(False)) & F.col(k[0]).isNotNull() & F.col(k[1]).isNotNull()).select(
        *k, "claim", "value", "source", F.col("authority").alias("_a"), F.col("reliability").alias("_r"),
        F.unix_micros(F.col("observed").cast("timestamp")).alias("_o"), F.coalesce(consistent, F.lit(False)).alias("_ok"),
    )
    w = Window.partitionBy(*k)
    best = c.groupBy(*k, *ranks).agg(F.count(F.lit(1)).alias("_n")).withColumn("_best", F.max(F.struct(*ranks)).over(w))  # a null is lowest
    first = F.col("_a").eqNullSafe(F.col("_best._a"))
    second = first & F.col("_r").eqNullSafe(F.col("_best._r"))
    third = second & F.col("_o").eqNullSafe(F.col("_best._o"))
    left = [F.sum(F.when(x, F.col("_n")).otherwise(0)).alias(f"_left{i}") for i, x in enumerate((first, second, third), 1)]
    best = best.groupBy(*k, "_best").agg(F.sum("_n").alias("candidates"), *left)
    values = c.groupBy(*k, "value").agg(F.lit(1).alias("_one")).where("value is not null").groupBy(*k).agg(F.count(F.lit(1)).alias("_values"))

    b = best.select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(k)], *[F.col(f"_best.{x}").alias(f"_b{x}") for x in ranks], "candidates",
        "_left1", "_left2", "_left3")
    on = F.lit(True)
    for i, x in enumerate(k):
        on = on & (c[x] == b[f"_k{i}"])
    for x in ranks:
        on = on & c[x].eqNullSafe(b[f"_b{x}"])
    rest = ["candidates", "_left1", "_left2", "_left3"]
    alive = c.join(b, on).select(*k, "claim", "value", "source", "_ok", *rest)
    by_value = alive.groupBy(*k, "value", *rest).agg(
        F.count_distinct("source").alias("_sources"), F.count(F.lit(1)).alias("_n"), F.count_if("_ok").alias("_nok"), F.min("claim").alias("_claim"),
        F.min(F.when(F.col("_ok"), F.col("claim"))).alias("_okclaim"),
    )
    level = by_value.groupBy(*k, *rest, "_sources").agg(
        F.sum("_n").alias("_n"), F.sum("_nok").alias("_nok"), F.min(F.struct("_claim", "value")).alias("_any"),
        F.min(F.when(F.col("_okclaim").isNotNull(), F.struct(F.col("_okclaim").alias("_claim"), "value"))).alias("_sound"),
    )
    won = level.groupBy(*k, *rest).agg(F.max(F.struct("_sources", "_n", "_nok", "_any", "_sound")).alias("_t")).join(values, k, "left")
    pick = F.coalesce("_t._sound", "_t._any")
    final = F.when(F.col("_t._nok") > 0, F.col("_t._nok")).otherwise(F.col("_t._n"))
    rule = (
        F.when(F.col("candidates") == 1, "SOLE_ELIGIBLE_CANDIDATE").when(F.col("_left1") == 1, "AUTHORITY").when(F.col("_left2") == 1,
        "RELIABILITY").when(F.col("_left3") == 1, "RECENCY")
        .when(F.col("_t._n") == 1, "CORROBORATION").when(final == 1, "CONSISTENCY").otherwise("TIEBREAK")
    )
    return won.select(*k, pick["_claim"].alias("claim"), pick["value"].alias("value"), rule.alias("rule"),
        F.col("candidates").cast("bigint").alias("candidates"), F.coalesce(F.col("_values") - 1, F.lit(-1)).cast("bigint").alias("conflicts"))
