"""Finding entities: by exact identifier, by ranked search, in batches of codes; strong identifiers that contradict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.functions import text as tx


def alias_keys(entities: DataFrame) -> DataFrame:
    """(kind, value, entity_id): the inverted index of names, slugs and aliases, each key once."""
    own = F.array(F.struct(F.lit("name").alias("kind"), F.lower("canonical_name").alias("value")),
        F.struct(F.lit("slug").alias("kind"), F.col("canonical_slug").alias("value")))
    more = F.coalesce(F.transform("aliases", lambda a: F.struct(a["alias_type"].alias("kind"), F.upper(F.coalesce(a["normalized_value"],
        a["alias_value"])).alias("value"))), F.array().cast("array<struct<kind:string,value:string>>"))
    k = entities.select("entity_id", F.explode(F.concat(own, more)).alias("k"))
    return k.select("k.kind", "k.value", "entity_id").where("value is not null and kind is not null").distinct()


def lookup(codes: DataFrame, keys: DataFrame) -> DataFrame:
    """(code, entity_id, matched): entities that a code names, with the kinds of keys that matched. ``codes(code, candidate)``.

    Candidates are distinct before the join, so a code asked for a million times is looked up once."""
    wanted = codes.select("code", "candidate").distinct()
    hit = wanted.join(keys, wanted["candidate"] == keys["value"])
    return hit.groupBy("code", "entity_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("matched"))


def screen(items: DataFrame, keys: DataFrame) -> DataFrame:
    """(item, outcome, entities): each item of an inventory with what its codes found: MATCHED (one entity), AMBIGUOUS (several),
    NOT_FOUND, or NO_CODE where it has none. ``items(item, candidate)``, candidate null for an item without a code."""
    hit = items.join(keys.select("value", "entity_id").distinct(), items["candidate"] == F.col("value"), "left")
    g = hit.groupBy("item").agg(F.count_distinct("entity_id").alias("entities"), F.count("candidate").alias("codes"))
    outcome = F.when(F.col("codes") == 0, "NO_CODE").when(F.col("entities") == 0, "NOT_FOUND").when(F.col("entities") == 1,
        "MATCHED").otherwise("AMBIGUOUS")
    return g.select("item", outcome.alias("outcome"), "entities")


def strong_conflicts(entities: DataFrame) -> DataFrame:
    """(alias_type, value, entities): strong identifiers that more than one live entity claims."""
    live = entities.where(F.coalesce("status", F.lit("")) != "MERGED")
    a = live.select("entity_id", F.explode("aliases").alias("a")).where("a.strong and a.normalized_value is not null")
    return a.groupBy(F.col("a.alias_type").alias("alias_type"),
        F.upper("a.normalized_value").alias("value")).agg(F.count_distinct("entity_id").alias("entities")).where("entities > 1")


def search(entities: DataFrame, query: str, threshold: float = 0.2) -> DataFrame:
    """(entity_id, tier, score, canonical_name): exact identifiers first (tier 0), then all words in the name (1), then similar
    names by shared trigrams (2); each entity once, by its best tier and score. Scores of tier 1 are a stand-in for a text rank."""
    words = [w for w in query.lower().split() if w]
    exact = query.strip().upper()
    e = entities.where(F.coalesce("status", F.lit("")) != "MERGED").select("entity_id", "canonical_name", "canonical_slug",
        F.transform("aliases", lambda a: F.upper(a["normalized_value"])).alias("keys"))
    name = F.col("canonical_name")
    is_exact = (F.upper(name) == exact) | (F.col("canonical_slug") == query.strip().lower()) | F.coalesce(F.array_contains("keys", exact),
        F.lit(False))
    sim = tx.trigram_similarity(F.coalesce(name, F.lit("")), F.lit(query))
    full = tx.contains_all(F.coalesce(name, F.lit("")), words)
    scored = e.withColumn("sim", sim).withColumn("tier", F.when(is_exact, 0).when(full, 1).when(F.col("sim") >= threshold, 2))
    score = F.when(F.col("tier") == 0, 1.0).when(F.col("tier") == 1,
        F.lit(float(len(words))) / F.greatest(F.size(tx.tokens(name)), F.lit(1))).otherwise(F.col("sim") * 0.8)
    return scored.where("tier is not null").select("entity_id", "tier", F.round(score, 6).alias("score"), "canonical_name")
