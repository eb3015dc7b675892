"""One group identifier for all records linked directly or indirectly (alternating large-star and small-star).

Both operations rewrite edges to point at smaller identifiers. Large-star links each greater neighbour of a node to the least
node around it; small-star does so with the lesser neighbours and the node. Alternated until nothing changes, every record
hangs on its component's least identifier; the rounds grow with the logarithm of the longest chain. All work is aggregations
and equi joins on the executors. Nodes with very many neighbours (a component's centre becomes one) are salted: their number is
bounded by the edge count over ``HOT_DEGREE``'s floor, so their list is small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.functions.ids import canonical_uuid
from factlattice.session import cut

HOT_SHARE = 1000  # a node is hot with more than one thousandth of all rows of a join ...
HOT_DEGREE = 100_000  # ... and at least so many
SALTS = 64
MAX_ROUNDS = 100


def _with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs(u, v)`` with ``m``, the least of u and all its v. Partial aggregation first; hot nodes are joined by salted keys."""
    stat = pairs.groupBy("u").agg(F.min("v").alias("lo"), F.count(F.lit(1)).alias("deg"))
    least = stat.select("u", F.least("u", "lo").alias("m"), "deg")
    floor = max(HOT_DEGREE, rows // HOT_SHARE)
    if rows <= HOT_DEGREE:  # no node can be hot
        return pairs.join(least.drop("deg"), "u")
    hot = least.where(F.col("deg") > floor).select("u").withColumn("hot", F.lit(True))  # fewer than HOT_SHARE rows
    salted = pairs.join(F.broadcast(hot), "u", "left").withColumn("salt",
        F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = least.withColumn("salt", F.explode(F.when(F.col("deg") > floor, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread.drop("deg"), ["u", "salt"]).select("u", "v", "m")


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return (r.n, r.s)


def connected(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of all nodes of ``edges(u, v)``: component is the least node linked with it, itself for a lone self-link.

    Repeated, reversed and self edges are harmless; edges with a null end are left out. Empty input gives no rows.
    """
    clean = cut(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v").distinct())
    nodes = clean.select(F.col("u").alias("node")).unionByName(clean.select(F.col("v").alias("node"))).distinct()
    e = cut(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _with_least(large, before[0])
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def redirect_edges(redirects: DataFrame) -> DataFrame:
    """The links of active redirects with both ends present, in canonical spelling; whatever the reason."""
    e = redirects.where(F.col("active")).select(canonical_uuid(F.col("from_entity_id")).alias("u"), canonical_uuid(F.col("to_entity_id")).alias("v"))
    return e.where(F.col("u").isNotNull() & F.col("v").isNotNull())
