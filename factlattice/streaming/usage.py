"""Usage messages as a stream: parsed with an exact key set, malformed ones set aside, each event persisted once, monthly counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions.ids import canonical_uuid

# The fields of a message; old messages lack the first and the last two.
FIELDS = ("schema_version", "id", "tenant_id", "api_key_id", "vertical_id", "occurred_at", "route_key", "method", "status", "rows_served",
    "duration_ms", "access_tier", "billing_source")
LEGACY = tuple(f for f in FIELDS if f not in ("schema_version", "access_tier", "billing_source"))
SCHEMA = "schema_version int, id string, tenant_id string, api_key_id string, vertical_id string, occurred_at timestamp, route_key string, method string, status int, rows_served int, duration_ms int, access_tier string, billing_source string"


def parse(messages: DataFrame, body: str = "body") -> DataFrame:
    """``messages`` with the event's fields and ``malformed``: not JSON, another key set, or no id, tenant or time."""
    keys = F.array_sort(F.json_object_keys(body))
    known = lambda fields: keys == F.array(*[F.lit(f) for f in sorted(fields)])
    e = messages.withColumn("_e", F.from_json(body, SCHEMA))
    ok = F.coalesce((known(FIELDS) | known(LEGACY)) & F.col("_e.id").isNotNull() & F.col("_e.tenant_id").isNotNull()
        & F.col("_e.occurred_at").isNotNull(), F.lit(False))
    return e.select(*messages.columns, "_e.*", (~ok).alias("malformed"))


def deduplicated(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of events with each id once, for repeats within ``delay``; spelling of ids aside."""
    return events.withColumn("id", canonical_uuid(F.col("id"))).withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["id"])


def month(at: Column) -> Column:
    return F.date_format(F.date_trunc("month", at), "yyyy-MM")


def monthly(events: DataFrame) -> DataFrame:
    """(tenant_id, month, events, rows_served) of events that didn't fail (status below 500); batch or stream."""
    ok = events.where(F.col("status") < 500)
    return ok.groupBy("tenant_id", month(F.col("occurred_at")).alias("month")).agg(F.count(F.lit(1)).alias("events"),
        F.sum(F.coalesce("rows_served", F.lit(0))).cast("bigint").alias("rows_served"))


def run_once(stream: DataFrame, table_path: str, quarantine_path: str, checkpoint: str):
    """Consume all that is there, then stop: malformed messages to quarantine, new ids to the table, each once across batches.

    Every batch writes under its own number and replaces what a broken attempt at it left, and the ids of other batches are in an
    exact quotient table, so a batch that is run again changes nothing.
    """
    from factlattice.operators.dedup import QuotientTable

    seen = QuotientTable(f"{table_path}_ids")

    def batch(df: DataFrame, number: int) -> None:
        parsed = parse(df)
        parsed.where("malformed").write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        seen.fresh(parsed.where("not malformed").drop("malformed"), number).write.mode("overwrite").parquet(f"{table_path}/batch={number}")
        seen.record(df.sparkSession.read.parquet(f"{table_path}/batch={number}"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_gaps(requests: DataFrame, key: str = "source", at: str = "at", seconds: int = 60) -> DataFrame:
    """``requests`` with the number in the trailing window of ``seconds`` up to each, and the gap to the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.unix_micros(at))
    span = w.rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumns({"in_window": F.count(F.lit(1)).over(span), "gap_s": (F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w)) / 1e6})


def transitions(observations: DataFrame, key: str, at: str, active: str) -> DataFrame:
    """``observations`` with ``generation``: how often the condition has become active so far."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(at)
    rise = F.when(F.col(active) & ~F.coalesce(F.lag(active).over(w), F.lit(False)), 1).otherwise(0)
    return observations.withColumn("_r", rise).withColumn("generation", F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")
