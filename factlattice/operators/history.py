"""History of the facts table: published versions, their true periods and predecessors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.functions.ids import canonical_uuid
from factlattice.operators.ledger import ledger

PUBLISHED = ("ACTIVE", "SUPERSEDED")


def published_versions(facts: DataFrame) -> DataFrame:
    """The distinct published versions: one row of each id (repeated rows are equal); rows without id, entity or property are left out."""
    v = facts.where(F.col("status").isin(*PUBLISHED) & F.col("id").isNotNull() & F.col("entity_id").isNotNull() & F.col("property").isNotNull())
    return v.groupBy("id", "entity_id", "property", "valid_from", "recorded_at", "valid_to",
        "supersedes_fact_id").agg(F.lit(1).alias("_one")).drop("_one")


def fact_ledger(facts: DataFrame) -> DataFrame:
    """The bitemporal ledger of the published versions, with the entity and property; see ``ledger``."""
    v = published_versions(facts)
    led = ledger(_versions(v).select("key", "id", "start", "recorded"))
    parts = F.split("key", "\\u0001")
    times = [F.timestamp_micros(F.when(F.col(c) != F.lit(-(2**63)).cast("bigint"), F.col(c))).cast("timestamp_ntz").alias(c) for c in ("valid_from",
        "valid_to", "known_from", "known_to")]
    return led.select(parts[0].alias("entity_id"), parts[1].alias("property"), F.col("id").alias("fact_id"), *times, "next_id", "prev_id", "current")


def _versions(v: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return v.select(
        F.concat_ws("\u0001", canonical_uuid(F.col("entity_id")), "property").alias("key"), F.col("id"), micros("valid_from").alias("start"),
        micros("recorded_at").alias("recorded"),
        micros("valid_to").alias("stored_to"), F.col("supersedes_fact_id").alias("stored_prev"),
    )


def period_errors(facts: DataFrame) -> DataFrame:
    """(fact_id, field): published versions whose stored ``valid_to`` or ``supersedes_fact_id`` contradicts the ledger.

    'valid_to': the version has a successor and ends elsewhere than where that starts. 'supersedes_fact_id': the reference is
    not the predecessor's id, null for the first; letter case and spelling aside.
    """
    v = published_versions(facts)
    keyed = _versions(v)
    now = ledger(keyed.select("key", "id", "start", "recorded")).where("current").select("id", "valid_to", "next_id", "prev_id")
    both = keyed.select("id", "stored_to", "stored_prev").join(now, "id")
    bad_to = F.col("next_id").isNotNull() & ~F.col("stored_to").eqNullSafe(F.when(F.col("valid_to") != F.lit(-(2**63)).cast("bigint"),
        F.col("valid_to")))
    bad_prev = ~canonical_uuid(F.col("stored_prev")).eqNullSafe(canonical_uuid(F.col("prev_id")))
    found = F.filter(F.array(F.when(bad_to, F.lit("valid_to")), F.when(bad_prev, F.lit("supersedes_fact_id"))), lambda x: x.isNotNull())
    return both.select(F.col("id").alias("fact_id"), F.explode(found).alias("field"))
