"""Incremental work: rolling windows of a source, feeds of settled changes, affected results, order of derivations, merges."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.operators import graph
from factlattice.session import cut


def rolling_windows(today: str, cursor: str | None, history_start: str, recent_days: int = 45, step_days: int = 120) -> list[tuple[str, str, str]]:
    """The windows (kind, from, to) of one run: the recent days, and the next stretch of history behind the cursor.

    The cursor moves forward by ``step_days``; past the recent window, or without a cursor, it starts at the beginning of history."""
    now, start = date.fromisoformat(today), date.fromisoformat(history_start)
    recent = max(start, now - timedelta(days=recent_days))
    at = date.fromisoformat(cursor) if cursor else start
    at = start if at >= recent or at < start else at
    end = min(at + timedelta(days=step_days - 1), recent)
    return [("recent", recent.isoformat(), now.isoformat()), ("history", at.isoformat(), end.isoformat())]


def in_windows(df: DataFrame, at: Column, windows: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` with the kind of the first window its date lies in; rows outside all of them left out."""
    d = F.date_format(at, "yyyy-MM-dd")
    kind = F.coalesce(*[F.when(d.between(a, b), k) for k, a, b in windows])
    return df.withColumn("window", kind).where("window is not null")


def year_windows(first: int, last: int, bundles: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """Consecutive windows of whole years: the given bundles first, then one for each later year up to ``last``."""
    out = [(f"{a}-01-01", f"{b}-12-31") for a, b in bundles]
    after = max([b for _, b in bundles], default=first - 1)
    return out + [(f"{y}-01-01", f"{y}-12-31") for y in range(max(first, after + 1), last + 1)]


def settled(df: DataFrame, changed: str, since: str, until: str, settle_seconds: int) -> DataFrame:
    """Rows changed after ``since`` and early enough before ``until`` that no earlier change can still come in."""
    limit = F.lit(until).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(settle_seconds))
    return df.where((F.col(changed) > F.lit(since).cast("timestamp_ntz")) & (F.col(changed) <= limit))


def guarded(df: DataFrame, least: int) -> DataFrame:
    """``df``, unless it has fewer than ``least`` rows: then it is refused, so a broken snapshot never replaces a good one."""
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} rows where at least {least} were expected")
    return df


def affected(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """(node): the changed inputs and everything derived from them, directly or in turn; cycles end where they close.

    ``dependencies(derived, input)``, ``changed(node)``. Each round meets only what is new."""
    d = dependencies.select("derived", "input").where("derived is not null and input is not null").distinct()
    seen = cut(changed.select("node").where("node is not null").distinct())
    frontier = seen
    rounds = 0
    while True:
        nxt = frontier.join(d, frontier["node"] == d["input"]).select(F.col("derived").alias("node")).distinct()
        frontier = cut(nxt.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        rounds += 1
        if rounds % 16 == 0:
            seen = cut(seen)


def levels(dependencies: DataFrame) -> DataFrame:
    """(node, level): an order in which everything comes after its inputs: 0 without inputs, else one above the highest of them.

    Nodes on a cycle, or behind one, are an error: they have no order."""
    d = cut(dependencies.select("derived", "input").where("derived is not null and input is not null").distinct())
    nodes = d.select(F.col("derived").alias("node")).union(d.select("input")).distinct()
    done = cut(nodes.join(d.select(F.col("derived").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)))
    left, level = d, 0
    while True:
        left = cut(left.join(done.where(F.col("level") == level).select(F.col("node").alias("input")), "input", "left_anti").select("derived",
            "input"))
        level += 1
        ready = nodes.join(done, "node", "left_anti").join(left.select(F.col("derived").alias("node")), "node", "left_anti").withColumn("level",
            F.lit(level))
        ready = cut(ready)
        if ready.isEmpty():
            break
        done = cut(done.unionByName(ready))
    stuck = left.agg(F.count(F.lit(1))).first()[0]
    if stuck:
        raise ValueError(f"{stuck} dependencies are on or behind a cycle")
    return done


def closes_cycle(dependencies: DataFrame, new: DataFrame) -> DataFrame:
    """``new(derived, input)`` with ``refused``: whether the link would close a cycle with the links there are (or is one by itself)."""
    ups = graph.lineage(dependencies, new.select(F.col("input").alias("root")).distinct())
    hit = new.join(ups.select(F.col("root").alias("input"), F.col("input").alias("derived"), F.lit(True).alias("_up")), ["input", "derived"], "left")
    return hit.select("derived", "input", (F.coalesce("_up", F.lit(False)) | (F.col("derived") == F.col("input"))).alias("refused"))


def merge_entities(entities: DataFrame, redirects: DataFrame, merges: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Entities and redirects after ``merges(loser, survivor)``: losers are MERGED, and each has one active redirect, the new one.

    ``entities(entity_id, status)``, ``redirects(from_entity_id, to_entity_id, active, created_at)``. Of several merges of one loser the
    least survivor counts; a merge into itself or into another loser is an error."""
    m = merges.where("loser is not null and survivor is not null").groupBy("loser").agg(F.min("survivor").alias("survivor"))
    loops = m.join(m.select(F.col("loser").alias("survivor")), "survivor", "left_semi").limit(1).collect()
    if loops:
        raise ValueError(f"{loops[0].survivor} is merged itself")
    e = entities.join(m.select(F.col("loser").alias("entity_id"), F.lit(True).alias("_lost")), "entity_id", "left")
    e = e.withColumn("status", F.when(F.col("_lost"), "MERGED").otherwise(F.col("status"))).drop("_lost")
    r = redirects.join(m.select(F.col("loser").alias("from_entity_id"), F.lit(True).alias("_lost")), "from_entity_id", "left").withColumn("active",
        F.col("active") & F.col("_lost").isNull()).drop("_lost")
    new = m.select(F.col("loser").alias("from_entity_id"), F.col("survivor").alias("to_entity_id"), F.lit(True).alias("active"),
        F.lit(at).cast(dict(redirects.dtypes)["created_at"]).alias("created_at"))
    return e, r.select(*new.columns).unionByName(new)


def insert_new(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` whose key is not stored, one of each key (the least of all columns); keys compare null-safely."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys,
        *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else rows.distinct()
    cond = F.lit(True)
    s = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    for k in keys:
        cond = cond & one[k].eqNullSafe(s[f"_{k}"])
    return one.join(s, cond, "left_anti").select(*rows.columns)


def reconcile(stored: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, revision, outcome): ``stored(key, digest, revision)`` against incoming records: CREATED (revision 1), UNCHANGED, or REVISED
    (one more). Of several incoming rows of a key the least digest counts; stored keys that don't come in are left out."""
    i = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest).alias("_new"))
    s = stored.select(key, F.col(digest).alias("_old"), "revision")
    same = F.col("_old").eqNullSafe(F.col("_new"))
    j = i.join(s, key, "left")
    return j.select(
        key, F.when(F.col("revision").isNull(), 1).when(same, F.col("revision")).otherwise(F.col("revision") + 1).cast("int").alias("revision"),
        F.when(F.col("revision").isNull(), "CREATED").when(same, "UNCHANGED").otherwise("REVISED").alias("outcome"),
    )


def immutable_violations(stored: DataFrame, patch: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """(key, column): where a patch would change a column that may never change; null in the patch changes nothing."""
    j = stored.select(key, *[F.col(c).alias(f"_{c}") for c in fixed]).join(patch.select(key, *fixed), key)
    bad = F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fixed])
    return j.select(key, F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("column"))
