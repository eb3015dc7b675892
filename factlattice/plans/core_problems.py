"""The pN_ queries of the general problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.functions.ids import canonical_uuid
from factlattice.operators import dedup, history, quantities, trailing
from factlattice.session import table

WINDOWS = (7, 30)
SURGE_SHARE_NUM, SURGE_SHARE_DEN = 3, 4  # three quarters of the longer window


def _usage(spark: SparkSession, root: str) -> DataFrame:
    kept = dedup.unique_messages(table(spark, root, "api_usage_events"), ["tenant_id", "occurred_at", "rows_served"])
    return kept.select(canonical_uuid(F.col("tenant_id")).alias("tenant_id"), "occurred_at", F.col("rows_served").cast("bigint").alias("rows_served"))


def p3_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals and averages of rows served over 7 and 30 days, for every tenant and UTC day from its first to its last message."""
    t = trailing.trailing_totals(_usage(spark, root), "tenant_id", "occurred_at", "rows_served", WINDOWS)
    return t.select(
        F.col("entity").alias("tenant_id"), F.date_format("day", "yyyy-MM-dd").alias("usage_day"), F.col("total").alias("rows_day"),
        F.col("n").alias("messages"),
        "sum_7", F.round("avg_7", 6).alias("avg_7"), "sum_30", F.round("avg_30", 6).alias("avg_30"),
    )


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Days of a sudden silence or surge: at least 29 days after the first, something in 30 days, and nothing or most of it in 7."""
    t = trailing.trailing_totals(_usage(spark, root), "tenant_id", "occurred_at", "rows_served", WINDOWS)
    short, long = F.col("sum_7"), F.col("sum_30")
    kind = F.when(short == 0, "quiet").when(short * SURGE_SHARE_DEN >= long * SURGE_SHARE_NUM, "surge")
    hit = t.where((F.col("i") >= WINDOWS[1] - 1) & (long > 0)).withColumn("kind", kind).where(F.col("kind").isNotNull())
    return hit.select(F.col("entity").alias("tenant_id"), F.date_format("day", "yyyy-MM-dd").alias("usage_day"), "kind")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Published versions whose stored period or predecessor contradicts the ledger."""
    return history.period_errors(table(spark, root, "facts"))


def p4_history(spark: SparkSession, root: str) -> DataFrame:
    """The whole bitemporal ledger of the published facts."""
    return history.fact_ledger(table(spark, root, "facts"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries that repeat a message already kept."""
    return dedup.repeated_copies(table(spark, root, "api_usage_events"))


def _quantities(spark: SparkSession, root: str) -> DataFrame:
    return quantities.all_quantities(table(spark, root, "facts"), table(spark, root, "acme_catalog"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Values recorded in a unit or scale other than the common one."""
    return _quantities(spark, root).where(quantities.is_foreign()).select("record_table", "record_id", "field").distinct()


def p1_values(spark: SparkSession, root: str) -> DataFrame:
    """Every measured value in the common unit, with the unit taken, whether its size decided, and the flag of uncertainty."""
    q = _quantities(spark, root)
    return q.select(
        "record_table", "record_id", "field", F.col("_quantity").alias("quantity"), F.round("_common", 6).alias("common_value"),
        quantities.common_unit(F.col("_quantity")).alias("common_unit"),
        F.col("_unit").alias("recorded_unit"), F.col("_by_size").alias("by_size"), F.round("_posterior", 4).alias("posterior"),
        quantities.uncertain().alias("uncertain"),
    )
