"""Bounded walks and chains over edge tables, by joins. Frontiers are distinct before each join; lineage is cut each round."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.session import cut


def bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(start, node, hops): nodes within ``depth`` (1 to 4) hops of each start, each once with the fewest hops; starts at 0.

    ``edges(src, dst)``; direction out, in or both."""
    if not 1 <= depth <= 4:
        raise ValueError("depth must be 1 to 4")
    out, back = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), edges.select(F.col("dst").alias("node"),
        F.col("src").alias("next"))
    step = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    seen = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def resolve_chains(links: DataFrame) -> DataFrame:
    """(src, target, hops, cycle): where following ``links(src, dst)``, one for each src, ends. Pointer doubling: a chain of n links
    takes log2(n) rounds, so the loop ends by itself: only cycles go on beyond the number of links. A chain that runs into a cycle
    has no target. Null ends are left out; empty input gives no rows."""
    links = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    p = cut(links.groupBy("src").agg(F.min("dst").alias("dst")).select("src", "dst", F.lit(1).cast("bigint").alias("hops")))
    total = p.count()
    while True:
        n = p.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("hops").alias("_h"))
        j = p.join(n, p["dst"] == n["_s"], "left")
        p2 = cut(j.select("src", F.coalesce("_d", "dst").alias("dst"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"),
            F.col("_s").isNotNull().alias("_more")))
        more = p2.where("_more").count()
        p = p2.drop("_more")
        longest = p.agg(F.max("hops")).first()[0] or 0
        if not more or longest > 2 * total:  # only cycles go on beyond the number of links
            break
    ends = p.join(links.select(F.col("src").alias("dst")).distinct().withColumn("_on", F.lit(True)), "dst", "left")
    cyc = F.coalesce("_on", F.lit(False))
    return ends.select("src", F.when(~cyc, F.col("dst")).alias("target"), F.when(~cyc, F.col("hops")).alias("hops"), cyc.alias("cycle"))


def lineage(dependencies: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, input, depth): all inputs of each root, direct and indirect, with the least depth; cycles end where they close.

    ``dependencies(derived, input)``, ``roots(root)``. Goes on until nothing new is found; with ``max_depth``, inputs further back are
    an error."""
    d = dependencies.select("derived", "input").distinct()
    seen = cut(roots.select(F.col("root"), F.col("root").alias("input")).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in count(1):
        nxt = frontier.select("root", F.col("input").alias("derived")).join(d, "derived").select("root", "input").distinct()
        frontier = cut(nxt.join(seen.select("root", "input"), ["root", "input"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"inputs more than {max_depth} steps back")
        seen = seen.unionByName(frontier)
        if depth % 32 == 0:  # the plan stays short
            seen = cut(seen)
    return seen.where("depth > 0")


def bottom_up(dependencies: DataFrame, good: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node): derived nodes all of whose inputs are good, directly or in turn. ``good(node)`` are those that need no inputs.

    Goes on until nothing new is found; needing more than ``max_rounds``, if given, is an error."""
    d = cut(dependencies.select("derived", "input").distinct())
    ok = cut(good.select("node").distinct())
    for done in count():
        need = d.groupBy("derived").agg(F.count(F.lit(1)).alias("need"))
        have = d.join(ok.withColumnRenamed("node", "input"), "input", "left_semi").groupBy("derived").agg(F.count(F.lit(1)).alias("have"))
        new = cut(need.join(have, "derived").where("need = have").select(F.col("derived").alias("node")).join(ok, "node", "left_anti"))
        if new.isEmpty():
            break
        if done == max_rounds:
            raise ValueError(f"more than {max_rounds} rounds needed")
        ok = cut(ok.unionByName(new))
    return ok
