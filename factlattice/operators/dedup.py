"""Exactly one copy of each message that was delivered at least once (exact quotient tables).

A fixed-width identifier of 128 bits is permuted by a small Feistel network, which is a bijection, so that no two identifiers
ever share a permuted value. The leading bits of the permuted value are the quotient: it picks the shard. The rest, the
remainder, is stored complete beside it. Membership in a shard is therefore exact: no false matches, unlike a filter.
The table itself is Tungsten's hash map, keyed by (quotient, remainder); partial aggregation inserts each identifier once per
map task, so a message repeated millions of times costs one shuffled row per task, and the quotient spreads keys evenly
whatever structure the identifiers have. A table can be kept as parquet, partitioned by quotient, for later batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions.ids import HEX32, bare_hex

ROUNDS = 4
QUOTIENT_BITS = 12
_ORDER_BASE = 10**20  # above any BIGINT moved to start at 0
_LEAST = 2**63


def _long(hex16: Column) -> Column:
    return F.conv(hex16, 16, -10).cast("bigint")


def permuted(hex32: Column, rounds: int = ROUNDS) -> tuple[Column, Column]:
    """The two halves of the 128 bits in ``hex32`` after a Feistel permutation (a bijection for any round function)."""
    left, right = _long(F.substring(hex32, 1, 16)), _long(F.substring(hex32, 17, 16))
    for k in range(rounds):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(k)))
    return left, right


def quotient_key(event_id: Column, message_id: Column, bits: int = QUOTIENT_BITS) -> list[Column]:
    """The key of a delivery: kind (0 event id, 1 message id, null neither), quotient, remainder (two words, or text).

    Identifiers that aren't 32 hexadecimal digits keep their own text as remainder, so they are exact too.
    """
    e, m = bare_hex(event_id), F.when(message_id != "", message_id)
    kind = F.when(e != "", F.lit(0)).when(m.isNotNull(), F.lit(1)).cast("tinyint")
    text = F.when(e != "", e).otherwise(m)
    fixed = F.when(text.rlike(HEX32), text)
    left, right = permuted(fixed)
    quotient = F.when(fixed.isNotNull(), F.shiftrightunsigned(left, 64 - bits)).otherwise(F.pmod(F.xxhash64(text), F.lit(2**bits)))
    return [
        kind.alias("_kind"), quotient.cast("int").alias("_quotient"), left.bitwiseAND(F.lit(2 ** (64 - bits) - 1)).alias("_rem_hi"),
        right.alias("_rem_lo"), F.when(fixed.isNull(), text).alias("_rem_text"),
    ]


KEY = ["_kind", "_quotient", "_rem_hi", "_rem_lo", "_rem_text"]


def _order(at: Column, delivery_id: Column) -> Column:
    """Earliest delivery first, then smallest id, as one number that a hash aggregate can keep in place; null times come last."""
    micros = F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(253402300800000000)) + F.lit(62135596800000000)
    return (micros.cast("decimal(18,0)") * F.lit(str(_ORDER_BASE)).cast("decimal(21,0)")).cast("decimal(38,0)") + (delivery_id.cast("decimal(20,0)")
        + F.lit(str(_LEAST)).cast("decimal(20,0)"))


def first_copies(deliveries: DataFrame, id_col="id", message_col="message_id", at_col="delivered_at", key_col="delivery_id") -> DataFrame:
    """``key_col`` of the delivery to keep of each message: earliest, then smallest ``key_col``.

    Deliveries with the same event id (spelling aside) are copies; without an event id, those with the same message id; with
    neither, each delivery stands for itself. A null ``key_col`` can't be named and is left out. Empty input gives no rows.
    """
    d = deliveries.where(F.col(key_col).isNotNull()).select(F.col(key_col).alias("_d"), F.col(at_col).alias("_at"),
        *quotient_key(F.col(id_col), F.col(message_col)))
    known = d.where(F.col("_kind").isNotNull())
    kept = known.groupBy(*KEY).agg(F.min(_order(F.col("_at"), F.col("_d"))).alias("_o"))
    moved = (F.col("_o") % F.lit(str(_ORDER_BASE)).cast("decimal(21,0)")).cast("decimal(21,0)") - F.lit(str(_LEAST)).cast("decimal(20,0)")
    first = kept.select(moved.cast("bigint").alias(key_col))
    return first.unionByName(d.where(F.col("_kind").isNull()).select(F.col("_d").alias(key_col)).distinct())


def repeated_copies(deliveries: DataFrame, **cols) -> DataFrame:
    """``delivery_id`` of every copy but the one to keep. The anti join is on the delivery's own key, so no message is hot in it.
    A delivery row that is itself repeated (the same key) is one delivery."""
    key = cols.get("key_col", "delivery_id")
    return deliveries.where(F.col(key).isNotNull()).select(key).distinct().join(first_copies(deliveries, **cols), key, "left_anti")


def unique_messages(deliveries: DataFrame, columns: list[str], **cols) -> DataFrame:
    """One row of each message, with ``columns`` of the copy to keep."""
    key = cols.get("key_col", "delivery_id")
    return deliveries.select(key, *[c for c in columns if c != key]).join(first_copies(deliveries, **cols), key, "left_semi")


class QuotientTable:
    """Identifiers seen in earlier batches, as parquet by batch number and shard; a batch compares itself shard by shard.

    ``fresh`` gives the rows of a batch whose identifier no other batch has brought, one each; ``record`` keeps their identifiers
    under the batch's number, replacing what an earlier attempt at that batch left. So a repeated batch gives the same rows.
    """

    def __init__(self, path: str, shards: int = 64):
        self.path, self.shards = path, shards

    def _keyed(self, df: DataFrame, id_col: str, message_col: str) -> DataFrame:
        k = df.select("*", *quotient_key(F.col(id_col), F.col(message_col) if message_col in df.columns else F.lit(None).cast("string")))
        return k.withColumn("_shard", F.floor(F.col("_quotient") * self.shards / 2**QUOTIENT_BITS).cast("int"))

    def fresh(self, batch: DataFrame, number: int, id_col: str = "id", message_col: str = "message_id", order: list[str] | None = None) -> DataFrame:
        """Of copies within the batch the first by ``order`` stays (all columns, if not given). Rows without any identifier all stay."""
        from pyspark.sql.utils import AnalysisException

        rows = self._keyed(batch, id_col, message_col)
        first = rows.where("_kind is not null").groupBy("_shard", *KEY).agg(F.min(F.struct(*(order or []),
            *[c for c in batch.columns if c not in (order or [])])).alias("_r"))
        one = first.select("_shard", *KEY, *[F.col(f"_r.{c}").alias(c) for c in batch.columns])
        try:
            seen = batch.sparkSession.read.parquet(self.path).where(F.col("batch") != number)
        except AnalysisException:  # no batch was recorded yet
            seen = None
        if seen is not None:
            cond = F.lit(True)
            for c in ["_shard", *KEY]:
                cond = cond & one[c].eqNullSafe(seen[c])
            one = one.join(seen, cond, "left_anti")
        return one.select(*batch.columns).unionByName(rows.where("_kind is null").select(*batch.columns))

    def record(self, rows: DataFrame, number: int, id_col: str = "id", message_col: str = "message_id") -> None:
        k = self._keyed(rows, id_col, message_col).where("_kind is not null").select("_shard", *KEY)
        k.write.mode("overwrite").partitionBy("_shard").parquet(f"{self.path}/batch={number}")
