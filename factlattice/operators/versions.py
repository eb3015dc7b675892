"""Slowly changing versions: append, close, retract; current and earlier views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_versions(observations: DataFrame, keys: list[str], at: str, value: str, ident: Column | None = None) -> DataFrame:
    """Versions from observations: a run of equal values is one version from its first time to the next run's first time.

    Result: keys, value, valid_from, valid_to (null: open), observations. Ties in time go by value. A null value is a value.
    """
    w = Window.partitionBy(*keys).orderBy(at, value)
    new = F.when(F.row_number().over(w) == 1, 1).when(~F.col(value).eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    runs = observations.select(*keys, at, value).withColumn("_new", new).withColumn("_run",
        F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = runs.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(at).alias("valid_from"), F.count(F.lit(1)).alias("observations"))
    return v.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("_run"))).drop("_run")


def append(open_versions: DataFrame, drafts: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Open versions after drafts: unchanged ones stay, changed ones are closed at the draft's time and followed by a new one.

    Result: keys, value, valid_from, valid_to, outcome in (UNCHANGED, CLOSED, CREATED, KEPT).
    """
    o = open_versions.select(*keys, F.col(value).alias("_old"), F.col("valid_from").alias("_from"), F.lit(True).alias("_has"))
    d = drafts.select(*keys, F.col(value).alias("_new"), F.col(at).alias("_at"), F.lit(True).alias("_got"))
    both = o.join(d, keys, "full_outer")
    same = F.col("_has") & F.col("_got") & F.col("_old").eqNullSafe(F.col("_new"))
    none = F.lit(None).cast(dict(open_versions.dtypes)["valid_from"])
    row = lambda v, f, t, o: F.struct(v.alias(value), f.alias("valid_from"), t.alias("valid_to"), F.lit(o).alias("outcome"))
    out = (
        F.when(F.col("_got").isNull(), F.array(row(F.col("_old"), F.col("_from"), none, "KEPT"))).when(same,
        F.array(row(F.col("_old"), F.col("_from"), none, "UNCHANGED")))
        .when(F.col("_has").isNull(), F.array(row(F.col("_new"), F.col("_at"), none, "CREATED")))
        .otherwise(F.array(row(F.col("_old"), F.col("_from"), F.col("_at"), "CLOSED"), row(F.col("_new"), F.col("_at"), none, "CREATED")))
    )
    return both.select(*keys, F.explode(out).alias("r")).select(*keys, "r.*")


def retract(versions: DataFrame, targets: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Open versions of the target keys closed at the given time with status RETRACTED; the rest as they are."""
    hit = versions.join(targets.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    do = F.col("_hit") & F.col("valid_to").isNull()
    when = F.lit(at).cast(dict(versions.dtypes)["valid_to"])
    return hit.withColumns({"valid_to": F.when(do, when).otherwise(F.col("valid_to")),
        "status": F.when(do, "RETRACTED").otherwise(F.col("status"))}).drop("_hit")
