"""The pN_ queries of the problems tagged llm, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm import components, garbled, matching, packing, survivors, tokens
from factlattice.session import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every entity id in an active redirect with the least id of its group."""
    c = components.connected(components.redirect_edges(table(spark, root, "entity_redirects")))
    return c.select(F.col("node").alias("entity_id"), F.col("component").alias("group_id"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Of each field with rival open claims, the claim to keep."""
    return survivors.keepers(table(spark, root, "facts"))


def p7_truths(spark: SparkSession, root: str) -> DataFrame:
    """Every claimed value of each field with the probability that it is true, and whether it stays in the entity's record."""
    return survivors.truths(table(spark, root, "facts"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue rows with the entity that is the same model of the same maker."""
    return matching.matches(*matching.session_tables(spark, root)).select("catalog_id", "entity_id")


def p6_matches(spark: SparkSession, root: str) -> DataFrame:
    """The same with the confidence of each match."""
    return matching.matches(*matching.session_tables(spark, root))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_texts(table(spark, root, "documents"))


def p9_packed(spark: SparkSession, root: str) -> DataFrame:
    """Every document, by its size in tokens, in a container of each target size."""
    items = tokens.token_counts(table(spark, root, "documents")).select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"))
    targets = table(spark, root, "packing_targets").select("target", F.col("capacity_tokens").alias("capacity"))
    return packing.pack(items, targets).select("target", "container", F.col("item").cast("bigint").alias("doc_id"), "piece",
        F.col("size").alias("n_tokens"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with text that was read in a wrong encoding."""
    return garbled.examined(table(spark, root, "documents")).where("damaged").select("doc_id")


def p10_repaired(spark: SparkSession, root: str) -> DataFrame:
    """The damaged documents with the text restored where possible, the encodings and the strength of the evidence."""
    return garbled.examined(table(spark, root, "documents")).where("damaged").select("doc_id", "text", F.round("gain", 3).alias("gain"), "mapping")


QUERIES = {
    "p2_found": p2_found, "p6_found": p6_found, "p6_matches": p6_matches, "p7_found": p7_found, "p7_truths": p7_truths, "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p10_found": p10_found, "p10_repaired": p10_repaired,
}

SQL = {
    "p2_found": """
WITH RECURSIVE raw AS (SELECT regexp_replace(lower(from_entity_id), '[^0-9a-f]', '', 'g') AS a, regexp_replace(lower(to_entity_id), '[^0-9a-f]', '',
'g') AS b
  FROM entity_redirects WHERE active AND from_entity_id IS NOT NULL AND to_entity_id IS NOT NULL),
e AS (SELECT a, b FROM raw UNION SELECT b, a FROM raw),
reach AS (SELECT DISTINCT a AS n, a AS m FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.m),
g AS (SELECT n, min(m) AS m FROM reach GROUP BY n)
SELECT concat_ws('-', substr(n, 1, 8), substr(n, 9, 4), substr(n, 13, 4), substr(n, 17, 4), substr(n, 21, 12)) AS entity_id,
  concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) AS group_id FROM g""",
    "p7_found": """
WITH c AS (SELECT DISTINCT id, entity_id, property, status, valid_from, CASE WHEN confidence > 1 THEN round(confidence / 100, 9) ELSE confidence END
AS conf FROM facts
  WHERE valid_to IS NULL AND status IN ('ACTIVE', 'PROPOSED', 'DISPUTED') AND normalized_value IS NOT NULL
  AND lower(trim(replace(normalized_value, '"', ''))) NOT IN ('', 'null', 'n/a', 'na', 'none', 'unknown', 'not specified', 'tbd', '-', '--')),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, property ORDER BY CASE WHEN status = 'DISPUTED' THEN 1 ELSE 0 END, coalesce(conf, -1) DESC,
valid_from DESC NULLS LAST, id) AS k,
  count(*) OVER (PARTITION BY entity_id, property) AS n FROM c)
SELECT entity_id, property, id AS fact_id FROM r WHERE k = 1 AND n > 1""",
}
