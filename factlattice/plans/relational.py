"""Queries for filters, joins, aggregations, windows, pages, sets and graphs over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlattice.functions import numbers
from factlattice.operators import graph, ordering, relational, resolve, selection, versions
from factlattice.plans.registry import Registry
from factlattice.session import table

query = Registry()

_CLAIMS_SQL = """claims AS (
  SELECT l_partkey AS entity, 'quantity' AS property, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim, l_suppkey AS source,
CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value,
    l_suppkey % 101 AS authority, (l_suppkey % 7) / 10.0 AS reliability, l_shipdate AS observed, l_quantity <= 45 AS consistent FROM lineitem WHERE
l_suppkey % 10 NOT IN (0, 1)
  UNION ALL SELECT l_partkey, 'returnflag', concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey), l_suppkey, l_returnflag, l_suppkey % 101,
(l_suppkey % 7) / 10.0, l_shipdate, TRUE
  FROM lineitem WHERE l_suppkey % 10 NOT IN (0, 1))"""


def claims(spark, root):
    """Claims about parts by suppliers: an entity-attribute-value view of the order lines."""
    li = table(spark, root, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    both = F.array(
        F.struct(F.lit("quantity").alias("property"), F.col("l_quantity").cast("bigint").cast("string").alias("value"),
        (F.col("l_quantity") <= 45).alias("consistent")),
        F.struct(F.lit("returnflag").alias("property"), F.col("l_returnflag").alias("value"), F.lit(True).alias("consistent")),
    )
    return li.select(
        F.col("l_partkey").alias("entity"), key.alias("claim"), F.col("l_suppkey").alias("source"), (F.col("l_suppkey") % 101).alias("authority"),
        ((F.col("l_suppkey") % 7) / 10).alias("reliability"),
        F.col("l_shipdate").alias("observed"), (~(F.col("l_suppkey") % 10).isin(0, 1)).alias("eligible"), F.explode(both).alias("c"),
    ).select("*", "c.*").drop("c")


@query(f"""WITH {_CLAIMS_SQL},
n AS (SELECT *, count(*) OVER (PARTITION BY entity, property) AS n FROM claims),
a AS (SELECT *, authority = max(authority) OVER (PARTITION BY entity, property) AS k FROM n), a1 AS (SELECT * FROM a WHERE k),
b AS (SELECT * EXCLUDE (k), reliability = max(reliability) OVER (PARTITION BY entity, property) AS k FROM a1), b1 AS (SELECT * FROM b WHERE k),
c AS (SELECT * EXCLUDE (k), observed = max(observed) OVER (PARTITION BY entity, property) AS k FROM b1), c1 AS (SELECT * FROM c WHERE k),
s AS (SELECT entity, property, value, count(DISTINCT source) AS sources FROM c1 GROUP BY 1, 2, 3),
d AS (SELECT c1.* EXCLUDE (k), s.sources = max(s.sources) OVER (PARTITION BY c1.entity, c1.property) AS k FROM c1 JOIN s ON s.entity = c1.entity AND
s.property = c1.property AND s.value = c1.value),
d1 AS (SELECT * FROM d WHERE k),
e AS (SELECT * EXCLUDE (k), consistent OR NOT bool_or(consistent) OVER (PARTITION BY entity, property) AS k FROM d1), e1 AS (SELECT * FROM e WHERE k),
cnt AS (SELECT entity, property, (SELECT 1) AS one, min(claim) AS claim FROM e1 GROUP BY 1, 2),
ca AS (SELECT entity, property, count(*) AS x FROM a1 GROUP BY 1, 2), cb AS (SELECT entity, property, count(*) AS x FROM b1 GROUP BY 1, 2), cc AS
(SELECT entity, property, count(*) AS x FROM c1 GROUP BY 1, 2),
cd AS (SELECT entity, property, count(*) AS x FROM d1 GROUP BY 1, 2), ce AS (SELECT entity, property, count(*) AS x FROM e1 GROUP BY 1, 2),
v AS (SELECT entity, property, count(DISTINCT value) - 1 AS conflicts FROM claims GROUP BY 1, 2)
SELECT cnt.entity, cnt.property, cnt.claim, n.value, CASE WHEN n.n = 1 THEN 'SOLE_ELIGIBLE_CANDIDATE' WHEN ca.x = 1 THEN 'AUTHORITY' WHEN cb.x = 1
THEN 'RELIABILITY' WHEN cc.x = 1 THEN 'RECENCY'
  WHEN cd.x = 1 THEN 'CORROBORATION' WHEN ce.x = 1 THEN 'CONSISTENCY' ELSE 'TIEBREAK' END AS rule, n.n AS candidates, v.conflicts
FROM cnt JOIN n ON n.entity = cnt.entity AND n.property = cnt.property AND n.claim = cnt.claim JOIN ca ON ca.entity = cnt.entity AND ca.property =
cnt.property JOIN cb ON cb.entity = cnt.entity AND cb.property = cnt.property
JOIN cc ON cc.entity = cnt.entity AND cc.property = cnt.property JOIN cd ON cd.entity = cnt.entity AND cd.property = cnt.property JOIN ce ON ce.entity
= cnt.entity AND ce.property = cnt.property
JOIN v ON v.entity = cnt.entity AND v.property = cnt.property""")
def canonical_selection(spark, root):
    """Which claim wins for each part and property, and by which criterion."""
    return selection.cascade(claims(spark, root), F.col("consistent"))


_ENUM = "property IN ('refrigerant', 'lifecycle_status', 'series_name')"
_TEXT = "lower(trim(replace(normalized_value, '\"', '')))"


@query(f"""WITH p AS (SELECT property, {_TEXT} AS value, count(DISTINCT entity_id) AS entities FROM facts WHERE {_ENUM} AND valid_to IS NULL AND
status <> 'RETRACTED' AND normalized_value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, sum(entities) OVER (PARTITION BY property) AS property_entities, row_number() OVER (PARTITION BY property ORDER BY entities DESC,
value) AS k FROM p)
SELECT property, value, entities, CAST(property_entities AS BIGINT) AS property_entities FROM k WHERE k <= 5""")
def facet_top_values(spark, root):
    """The five most frequent values of each enumerated property, with the sum of counts over all values."""
    f = relational.current(table(spark, root, "facts")).where(_ENUM).where("normalized_value is not null")
    text = F.lower(F.trim(F.replace("normalized_value", F.lit('"'), F.lit(""))))
    return relational.facet_counts(f, text, 5).select("property", "value", "entities", "property_entities")


@query("""SELECT property, min(TRY_CAST(normalized_value AS DOUBLE)) AS low, max(TRY_CAST(normalized_value AS DOUBLE)) AS high, count(DISTINCT
entity_id) AS entities FROM facts
WHERE property IN ('seer2', 'list_price_usd', 'warranty_years') AND valid_to IS NULL AND status <> 'RETRACTED' GROUP BY 1""")
def facet_ranges(spark, root):
    """The numeric range of each property, before any cut to values."""
    f = relational.current(table(spark, root, "facts")).where("property in ('seer2', 'list_price_usd', 'warranty_years')")
    n = F.col("normalized_value").try_cast("double")
    return f.groupBy("property").agg(F.min(n).alias("low"), F.max(n).alias("high"), F.count_distinct("entity_id").alias("entities"))


@query(f"""SELECT entity_id, canonical_name FROM entities e WHERE
EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id AND property = 'seer2' AND valid_to IS NULL AND status <> 'RETRACTED' AND
TRY_CAST(normalized_value AS DOUBLE) BETWEEN 14 AND 20) AND
EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id AND property = 'refrigerant' AND valid_to IS NULL AND status <> 'RETRACTED' AND {_TEXT}
IN ('r-454b', 'r-32')) AND
EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id AND property = 'list_price_usd' AND valid_to IS NULL AND status <> 'RETRACTED')""")
def facet_filter(spark, root):
    """Entities within a range, with one of several values, and with any value, of three properties: one aggregation, one semi join."""
    v = F.lower(F.trim(F.replace("normalized_value", F.lit('"'), F.lit(""))))
    cond = {"seer2": F.col("normalized_value").try_cast("double").between(14, 20), "refrigerant": v.isin("r-454b", "r-32"),
        "list_price_usd": F.lit(True)}
    return relational.facet_filter(table(spark, root, "entities"), relational.current(table(spark, root, "facts")), cond).select("entity_id",
        "canonical_name")


@query("""SELECT property, count(*) AS facts, count(DISTINCT entity_id) AS entities FROM facts WHERE valid_from <= TIMESTAMP '2025-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2025-06-01') GROUP BY 1""")
def facts_as_of(spark, root):
    """What was valid at an instant, by property."""
    f = relational.as_of(table(spark, root, "facts"), "2025-06-01 00:00:00")
    return f.groupBy("property").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("entity_id").alias("entities"))


@query("""SELECT n_name, o_orderpriority, count(*) AS lines, count(DISTINCT c_custkey) AS customers, round(sum(l_extendedprice), 2) AS total FROM
lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def evidence_chain(spark, root):
    """A chain of four tables, the small one broadcast, summed by two keys."""
    t = lambda n: table(spark, root, n)
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"),
        F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("c_custkey").alias("customers"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT entity_type, status, count(*) AS entities, count(CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id) THEN 1 END)
AS traceable,
round(count(CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id) THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM
entities e GROUP BY 1, 2""")
def coverage(spark, root):
    """Share of entities that any fact stands behind."""
    e = relational.flag(table(spark, root, "entities").select("entity_id", "entity_type", "status"), table(spark, root, "facts"), ["entity_id"],
        "traceable")
    return e.groupBy("entity_type", "status").agg(F.count(F.lit(1)).alias("entities"), F.count_if("traceable").alias("traceable"),
        F.round(F.count_if("traceable") / F.count(F.lit(1)), 6).alias("coverage"))


@query("""SELECT entity_type, status, grouping(entity_type) AS g_type, grouping(status) AS g_status, count(*) AS n FROM entities GROUP BY ROLLUP (entity_type, status)""")
def coverage_rollup(spark, root):
    """Counts at all levels in one pass."""
    return table(spark, root, "entities").rollup("entity_type", "status").agg(F.grouping("entity_type").cast("bigint").alias("g_type"),
        F.grouping("status").cast("bigint").alias("g_status"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def anti_join(spark, root):
    """Parts without a line above a quantity."""
    li = table(spark, root, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, root, "part").select("p_partkey", "p_name").join(li, "p_partkey", "left_anti")


_KEYS_SQL = """keys AS (SELECT DISTINCT * FROM (SELECT 'name' AS kind, lower(canonical_name) AS value, entity_id FROM entities UNION ALL SELECT 'slug', canonical_slug, entity_id FROM entities
UNION ALL SELECT a.alias_type, upper(coalesce(a.normalized_value, a.alias_value)), entity_id FROM (SELECT entity_id, unnest(aliases) AS a FROM
entities) x) y WHERE value IS NOT NULL AND kind IS NOT NULL)"""
_CODES_SQL = "codes AS (SELECT DISTINCT model AS code, upper(regexp_replace(model, '[^0-9A-Za-z]', '', 'g')) AS candidate FROM acme_catalog WHERE model IS NOT NULL)"


def _codes(spark, root):
    c = table(spark, root, "acme_catalog").where("model is not null").select(F.col("model").alias("code"))
    return c.select("code", F.upper(F.regexp_replace("code", "[^0-9A-Za-z]", "")).alias("candidate")).distinct()


@query(f"WITH {_KEYS_SQL} SELECT kind, count(*) AS keys, count(DISTINCT value) AS distinct_values, count(DISTINCT entity_id) AS entities FROM keys GROUP BY 1")
def key_index(spark, root):
    """The inverted index of names and aliases, by kind."""
    k = resolve.alias_keys(table(spark, root, "entities"))
    return k.groupBy("kind").agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("value").alias("distinct_values"),
        F.count_distinct("entity_id").alias("entities"))


@query(f"WITH {_KEYS_SQL}, {_CODES_SQL} SELECT code, entity_id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS matched FROM codes JOIN keys ON keys.value = codes.candidate GROUP BY 1, 2")
def code_lookup(spark, root):
    """Entities named by catalogue codes, with the kind of key that matched."""
    return resolve.lookup(_codes(spark, root), resolve.alias_keys(table(spark, root, "entities")))


@query(f"""WITH {_KEYS_SQL}, {_CODES_SQL}, h AS (SELECT code AS item, count(DISTINCT entity_id) AS entities, count(candidate) AS codes FROM codes LEFT
JOIN (SELECT DISTINCT value, entity_id FROM keys) k ON k.value = codes.candidate GROUP BY 1)
SELECT item, CASE WHEN codes = 0 THEN 'NO_CODE' WHEN entities = 0 THEN 'NOT_FOUND' WHEN entities = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS outcome,
entities FROM h""")
def inventory_screening(spark, root):
    """Each item of an inventory with the outcome of its screening."""
    items = _codes(spark, root).withColumnRenamed("code", "item")
    return resolve.screen(items, resolve.alias_keys(table(spark, root, "entities")))


@query("""SELECT a.alias_type, upper(a.normalized_value) AS value, count(DISTINCT entity_id) AS entities FROM (SELECT entity_id, unnest(aliases) AS a
FROM entities WHERE coalesce(status, '') <> 'MERGED') x
WHERE a.strong AND a.normalized_value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT entity_id) > 1""")
def strong_conflicts(spark, root):
    """Strong identifiers that several live entities claim."""
    return resolve.strong_conflicts(table(spark, root, "entities"))


@query("""SELECT entity_id, alias_type, alias_value, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources, count(DISTINCT s) AS n FROM (SELECT
entity_id, a.alias_type AS alias_type, a.alias_value AS alias_value, unnest(a.sources) AS s
FROM (SELECT entity_id, unnest(aliases) AS a FROM entities) x) y WHERE alias_value IS NOT NULL GROUP BY 1, 2, 3""")
def alias_sources(spark, root):
    """The sources behind each alias."""
    a = table(spark, root, "entities").select("entity_id", F.explode("aliases").alias("a")).select("entity_id", "a.alias_type", "a.alias_value",
        F.explode("a.sources").alias("s")).where("alias_value is not null")
    g = a.groupBy("entity_id", "alias_type", "alias_value").agg(F.collect_set("s").alias("s"))
    return g.select("entity_id", "alias_type", "alias_value", F.array_join(F.array_sort("s"), ",").alias("sources"),
        F.size("s").cast("bigint").alias("n"))


@query("""SELECT route_key, count(*) AS requests, CAST(coalesce(sum(rows_served), 0) AS BIGINT) AS rows_served FROM api_usage_events WHERE occurred_at
>= TIMESTAMP '2025-12-01' AND occurred_at < TIMESTAMP '2026-01-01'
AND status < 500 GROUP BY 1""")
def usage_by_route(spark, root):
    """A month's requests and rows by route, from events that carry all they need."""
    e = table(spark, root,
        "api_usage_events").where("occurred_at >= timestamp_ntz '2025-12-01' and occurred_at < timestamp_ntz '2026-01-01' and status < 500")
    return e.groupBy("route_key").agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("rows_served"), F.lit(0)).alias("rows_served"))


@query("""WITH k AS (SELECT api_key_id, min(lower(tenant_id)) AS owner FROM api_usage_events WHERE api_key_id IS NOT NULL AND tenant_id IS NOT NULL
GROUP BY 1)
SELECT owner, route_key, count(*) AS requests, CAST(coalesce(sum(rows_served), 0) AS BIGINT) AS rows_served FROM api_usage_events e JOIN k ON
k.api_key_id = e.api_key_id
WHERE occurred_at >= TIMESTAMP '2025-12-01' AND occurred_at < TIMESTAMP '2026-01-01' GROUP BY 1, 2""")
def usage_by_owner(spark, root):
    """The same through a join on keys: both sides are reduced first, so the join meets one row for each key and route."""
    e = table(spark, root, "api_usage_events")
    keys = e.where("api_key_id is not null and tenant_id is not null").groupBy("api_key_id").agg(F.min(F.lower("tenant_id")).alias("owner"))
    month = e.where("occurred_at >= timestamp_ntz '2025-12-01' and occurred_at < timestamp_ntz '2026-01-01'")
    per = month.groupBy("api_key_id", "route_key").agg(F.count(F.lit(1)).alias("c"), F.sum("rows_served").alias("r"))
    return per.join(keys, "api_key_id").groupBy("owner", "route_key").agg(F.sum("c").alias("requests"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("rows_served"))


@query("""SELECT lower(tenant_id) AS tenant_id, strftime(occurred_at, '%Y-%m') AS month, count(*) AS events, CAST(sum(coalesce(rows_served, 0)) AS
BIGINT) AS rows_served FROM api_usage_events
WHERE status < 500 AND tenant_id IS NOT NULL GROUP BY 1, 2""")
def usage_monthly(spark, root):
    """Events and rows by tenant and UTC month."""
    from factlattice.streaming import usage

    e = table(spark, root, "api_usage_events").where("tenant_id is not null").withColumn("tenant_id", F.lower("tenant_id"))
    return usage.monthly(e)


@query("""SELECT route_key, count(*) AS n, median(duration_ms) AS median_ms, list_sort(list(duration_ms))[CAST(floor(0.95 * (count(duration_ms) - 1))
AS BIGINT) + 1] AS p95_ms, round(avg(duration_ms), 6) AS mean_ms
FROM api_usage_events WHERE route_key IS NOT NULL AND duration_ms IS NOT NULL GROUP BY 1""")
def latency(spark, root):
    """Median, nearest-rank p95 and mean. The rank is found by counts of values, so no group is collected."""
    from pyspark.sql import Window

    e = table(spark, root, "api_usage_events").where("route_key is not null and duration_ms is not null")
    per = e.groupBy("route_key", "duration_ms").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("route_key").orderBy("duration_ms")
    p = per.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy("route_key"))})
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("duration_ms")))
    g = p.groupBy("route_key").agg(
        F.max("n").alias("n"), at(F.floor(0.95 * (F.col("n") - 1))).alias("p95_ms"), at(F.floor((F.col("n") - 1) / 2)).alias("_a"),
        at(F.floor(F.col("n") / 2)).alias("_b"), F.round(F.sum(F.col("c") * F.col("duration_ms")) / F.max("n"), 6).alias("mean_ms")
    )
    return g.select("route_key", "n", ((F.col("_a") + F.col("_b")) / 2).alias("median_ms"), "p95_ms", "mean_ms")


@query("""SELECT status, count(*) AS n, count(*) FILTER (WHERE confidence IS NULL) AS no_confidence, count(*) FILTER (WHERE valid_to IS DISTINCT FROM
NULL) AS closed, count(*) FILTER (WHERE unit IS NOT NULL AND property = 'seer2') AS odd_unit,
max(CASE WHEN output_kind = 'SOURCE' THEN recorded_at END) AS last_source FROM facts GROUP BY 1""")
def filtered_counts(spark, root):
    """Several filtered counts and a filtered maximum in one pass."""
    return table(spark, root, "facts").groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence").isNull()).alias("no_confidence"),
        F.count_if(~F.col("valid_to").eqNullSafe(F.lit(None))).alias("closed"),
        F.count_if(F.col("unit").isNotNull() & (F.col("property") == "seer2")).alias("odd_unit"),
        F.max(F.when(F.col("output_kind") == "SOURCE", F.col("recorded_at"))).alias("last_source"),
    )


@query("SELECT doc_kind, strftime(published_at, '%Y') AS year, count(*) AS n, max(published_at) AS last FROM documents WHERE published_at IS NOT NULL GROUP BY 1, 2")
def browse_index(spark, root):
    """Documents by kind and year."""
    d = table(spark, root, "documents").where("published_at is not null")
    return d.groupBy("doc_kind", F.date_format("published_at", "yyyy").alias("year")).agg(F.count(F.lit(1)).alias("n"),
        F.max("published_at").alias("last"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) x WHERE k = 1")
def latest_per_key(spark, root):
    """The latest order of each customer, without sorting a group."""
    o = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return relational.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) x WHERE k <= 3")
def top_per_key(spark, root):
    """The three dearest parts of each brand."""
    return relational.top_per_key(table(spark, root, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_brand",
        "p_partkey", "p_retailprice")


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def first_occurrence(spark, root):
    """The first of equal texts; grouped by a hash of fixed width, so long texts don't travel as keys twice."""
    d = table(spark, root, "documents").where("text is not null")
    g = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "text")).alias("f"), F.count(F.lit(1)).alias("copies"))
    return g.select("f.text", "f.doc_id", "copies")


@query("""WITH o AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS
BIGINT) AS episode FROM o""")
def status_episodes(spark, root):
    """Runs of equal status along each customer's orders, numbered."""
    o = relational.episodes(table(spark, root, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("episode").cast("bigint").alias("episode"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice < 200000) OR (o_totalprice = 200000 AND o_orderkey < 1000) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
def keyset_page(spark, root):
    """The 50 orders after a given one in a descending total order: a top-k, no scan of earlier pages."""
    o = table(spark, root, "orders").where(ordering.after([("o_totalprice", 200000.0, True), ("o_orderkey", 1000, True)]))
    return ordering.page(o.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.desc("o_orderkey")], 50)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 40 OFFSET 100")
def offset_page(spark, root):
    """A page by offset."""
    return ordering.page(table(spark, root, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], 40, 100)


@query("SELECT CAST(floor((rn - 1) / 100) AS BIGINT) AS shard, min(canonical_slug) AS first_slug, max(canonical_slug) AS last_slug, count(*) AS n FROM (SELECT canonical_slug, row_number() OVER (ORDER BY canonical_slug, entity_id) AS rn FROM entities) x GROUP BY 1")
def sitemap_shards(spark, root):
    """Consecutive shards of slugs: global ranks without a single-task window."""
    s = ordering.shards(table(spark, root, "entities").select("canonical_slug", "entity_id"), ["canonical_slug", "entity_id"], 100)
    return s.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.min("canonical_slug").alias("first_slug"),
        F.max("canonical_slug").alias("last_slug"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS x, s_acctbal AS y FROM supplier), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 =
0 THEN NULL ELSE s_nationkey END AS x, s_acctbal AS y FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT -s_suppkey, 0, 0.0 FROM supplier WHERE s_suppkey % 11 = 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unexpected' ELSE 'changed' END AS kind FROM a FULL
OUTER JOIN b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y""")
def snapshot_drift(spark, root):
    """Differences between an expected and an actual set."""
    s = table(spark, root, "supplier")
    a = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("x"), F.col("s_acctbal").alias("y"))
    b = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("x"),
        F.col("s_acctbal").alias("y"))
    return relational.drift(a, b.unionByName(s.where("s_suppkey % 11 = 0").select((-F.col("s_suppkey")).alias("id"), F.lit(0).alias("x"),
        F.lit(0.0).alias("y"))), ["id"])


@query("""WITH b AS (SELECT c_custkey, c_name || '!' AS c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey +
1000000000, c_name, 0.0 FROM customer WHERE c_custkey % 10 = 0)
SELECT c_custkey, c_name, c_acctbal FROM b UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM
b)""")
def bulk_upsert(spark, root):
    """A set-based upsert."""
    c = table(spark, root, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit("!")))
    new = c.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000000).alias("c_custkey"), "c_name", F.lit(0.0).alias("c_acctbal"))
    return relational.upsert(c, changed.unionByName(new), ["c_custkey"])


@query("""WITH i AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 4
<> 0), s AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'inserted' WHEN i.doc_id IS NULL THEN 'retired' WHEN s.h = i.h THEN
'unchanged' ELSE 'changed' END AS change FROM s FULL OUTER JOIN i ON s.doc_id = i.doc_id""")
def change_detection(spark, root):
    """A complete snapshot against what is stored, by digest. (Two versions are made of the one table by changing and leaving out rows.)"""
    d = table(spark, root, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    stored = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2("t", 256).alias("h"))
    incoming = d.where("doc_id % 4 <> 0").select("doc_id", F.sha2(F.concat("t", F.when(F.col("doc_id") % 9 == 0, "x").otherwise("")), 256).alias("h"))
    return relational.changes(stored, incoming, "doc_id", "h")


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT lang FROM documents UNION SELECT source FROM documents) a UNION ALL SELECT 'intersect',
count(*) FROM (SELECT entity_id FROM facts INTERSECT SELECT entity_id FROM entities) b
UNION ALL SELECT 'except', count(*) FROM (SELECT entity_id FROM entities EXCEPT SELECT entity_id FROM facts) c UNION ALL SELECT 'except_all', count(*)
FROM (SELECT p_brand FROM part EXCEPT ALL SELECT p_brand FROM part WHERE p_size > 25) d""")
def set_operations(spark, root):
    """Union, intersection and differences of sets and of multisets."""
    t = lambda n: table(spark, root, n)
    n = lambda name, df: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    docs, e, f, p = t("documents"), t("entities").select("entity_id"), t("facts").select("entity_id"), t("part")
    got = [
        n("union", docs.select("lang").union(docs.select("source")).distinct()), n("intersect", f.intersect(e)), n("except", e.subtract(f)),
        n("except_all", p.select("p_brand").exceptAll(p.where("p_size > 25").select("p_brand"))),
    ]
    return got[0].union(got[1]).union(got[2]).union(got[3])


@query("SELECT a.lang, a.n AS docs, b.n AS recalls FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a JOIN (SELECT lang, count(*) AS n FROM documents WHERE doc_kind = 'recall_notice' GROUP BY 1) b ON a.lang IS NOT DISTINCT FROM b.lang")
def null_safe_join(spark, root):
    """A join in which null equals null."""
    d = table(spark, root, "documents")
    a = d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    b = d.where("doc_kind = 'recall_notice'").groupBy(F.col("lang").alias("l2")).agg(F.count(F.lit(1)).alias("recalls"))
    return a.join(b, F.col("lang").eqNullSafe(F.col("l2"))).select("lang", "docs", "recalls")


@query("SELECT o_orderpriority AS property, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS \"F\", min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS \"O\", min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS \"P\" FROM orders GROUP BY 1")
def compare_pivot(spark, root):
    """Properties by entities, pivoted over a known list."""
    return table(spark, root, "orders").groupBy(F.col("o_orderpriority").alias("property")).pivot("o_orderstatus",
        ["F", "O", "P"]).agg(F.min("o_orderkey"))


@query("""WITH k AS (SELECT s_suppkey AS id, 'n' || s_nationkey || ':' || CAST(floor(s_acctbal / 500) AS BIGINT) AS block FROM supplier UNION SELECT
s_suppkey, 'b' || CAST(round(s_acctbal) AS BIGINT) FROM supplier)
SELECT l.id AS a, r.id AS b, min(l.block) AS block FROM k l JOIN k r ON l.block = r.block AND l.id < r.id GROUP BY 1, 2""")
def blocking_pairs(spark, root):
    """Candidate pairs that share a blocking key, each once with its first key."""
    s = table(spark, root, "supplier").withColumn("id", F.col("s_suppkey"))
    keys = F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(":"),
        F.floor(F.col("s_acctbal") / 500).cast("bigint").cast("string")), F.concat(F.lit("b"), F.round("s_acctbal").cast("bigint").cast("string")))
    return relational.blocking_pairs(s, keys)


@query("SELECT least(from_entity_id, to_entity_id) || '|' || greatest(from_entity_id, to_entity_id) AS pair, count(*) AS n FROM entity_redirects WHERE active AND to_entity_id IS NOT NULL GROUP BY 1")
def symmetric_edges(spark, root):
    """Links without direction, counted."""
    r = table(spark, root, "entity_redirects").where("active and to_entity_id is not null")
    return r.groupBy(F.concat_ws("|", F.least("from_entity_id", "to_entity_id"),
        F.greatest("from_entity_id", "to_entity_id")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM
customer), s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h1 AS (SELECT DISTINCT b AS node FROM s WHERE a = 'r0'), h2 AS (SELECT DISTINCT s.b AS node FROM h1 JOIN s ON s.a = h1.node WHERE s.b <> 'r0' AND s.b
NOT IN (SELECT node FROM h1)),
h3 AS (SELECT DISTINCT s.b AS node FROM h2 JOIN s ON s.a = h2.node WHERE s.b <> 'r0' AND s.b NOT IN (SELECT node FROM h1) AND s.b NOT IN (SELECT node
FROM h2))
SELECT 'r0' AS start, 'r0' AS node, 0 AS hops UNION ALL SELECT 'r0', node, 1 FROM h1 UNION ALL SELECT 'r0', node, 2 FROM h2 UNION ALL SELECT 'r0',
node, 3 FROM h3""")
def bounded_walk(spark, root):
    """Nodes within three hops of a region."""
    n, c = table(spark, root, "nation"), table(spark, root, "customer")
    t = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    edges = n.select(t("n", "n_nationkey").alias("src"), t("r", "n_regionkey").alias("dst")).union(c.select(t("c", "c_custkey"), t("n",
        "c_nationkey")))
    return graph.bfs(edges, spark.createDataFrame([("r0",)], "node string"), 3)


@query("""WITH RECURSIVE l AS (SELECT from_entity_id AS src, min(to_entity_id) AS dst FROM entity_redirects WHERE active AND to_entity_id IS NOT NULL
GROUP BY 1),
w AS (SELECT src, dst, 1 AS hops FROM l UNION ALL SELECT w.src, l.dst, w.hops + 1 FROM w JOIN l ON l.src = w.dst WHERE w.hops < 200)
SELECT src, dst AS target, CAST(hops AS BIGINT) AS hops FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = w.dst)""")
def redirect_ends(spark, root):
    """Where chains of redirects, whatever their reason, end; chains that run into a cycle have no end."""
    r = table(spark, root, "entity_redirects").where("active and to_entity_id is not null").select(F.col("from_entity_id").alias("src"),
        F.col("to_entity_id").alias("dst"))
    return graph.resolve_chains(r).where("not cycle").select("src", "target", "hops")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT id AS derived, supersedes_fact_id AS input FROM facts WHERE supersedes_fact_id IS NOT NULL),
w AS (SELECT derived AS root, input, 1 AS depth FROM d UNION ALL SELECT w.root, d.input, w.depth + 1 FROM w JOIN d ON d.derived = w.input WHERE
w.depth < 60)
SELECT root, input, min(depth) AS depth FROM w WHERE root <> input GROUP BY 1, 2""")
def fact_lineage(spark, root):
    """All facts behind each fact, through any number of steps (the SQL goes 60 steps back)."""
    f = table(spark, root, "facts")
    d = f.where("supersedes_fact_id is not null").select(F.col("id").alias("derived"), F.col("supersedes_fact_id").alias("input"))
    return graph.lineage(d, d.select(F.col("derived").alias("root")))


@query("""WITH o AS (SELECT user_id, ts, event_type, CASE WHEN row_number() OVER w = 1 OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1
ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS run FROM o), v AS (SELECT user_id, run,
min(event_type) AS event_type, min(ts) AS valid_from, count(*) AS observations FROM r GROUP BY 1, 2)
SELECT user_id, event_type, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY run) AS valid_to, observations FROM v""")
def version_runs(spark, root):
    """Versions of each user's state from observations."""
    return versions.to_versions(table(spark, root, "events"), ["user_id"], "ts", "event_type").select("user_id", "event_type", "valid_from",
        "valid_to", "observations")


@query("""WITH o AS (SELECT c_custkey AS k, c_mktsegment AS v, TIMESTAMP '2020-01-01' AS f FROM customer WHERE c_custkey % 2 = 0), d AS (SELECT
c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS v, TIMESTAMP '2024-01-01' AS t FROM customer WHERE c_custkey % 5 <> 0)
SELECT o.k, o.v, o.f AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, 'KEPT' AS outcome FROM o WHERE k NOT IN (SELECT k FROM d) UNION ALL SELECT
o.k, o.v, o.f, NULL, 'UNCHANGED' FROM o JOIN d ON o.k = d.k AND o.v IS NOT DISTINCT FROM d.v
UNION ALL SELECT o.k, o.v, o.f, d.t, 'CLOSED' FROM o JOIN d ON o.k = d.k AND o.v IS DISTINCT FROM d.v UNION ALL SELECT d.k, d.v, d.t, NULL, 'CREATED'
FROM d LEFT JOIN o ON o.k = d.k WHERE o.k IS NULL OR o.v IS DISTINCT FROM d.v""")
def version_append(spark, root):
    """Drafts appended to open versions: kept, unchanged, closed, created."""
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    o = c.where("k % 2 = 0").withColumn("valid_from", F.expr("timestamp_ntz '2020-01-01'"))
    d = c.where("k % 5 <> 0").select("k", F.when(F.col("k") % 3 == 0, "NEW").otherwise(F.col("v")).alias("v"),
        F.expr("timestamp_ntz '2024-01-01'").alias("at"))
    return versions.append(o, d, ["k"], "v", "at")


@query("""WITH g AS (SELECT doc_kind, (lower(coalesce(text, '')) LIKE '%recall%') AS predicted, (doc_kind = 'recall_notice') AS gold FROM documents),
s AS (SELECT count(*) FILTER (WHERE predicted AND gold) AS tp, count(*) FILTER (WHERE predicted AND NOT gold) AS fp,
count(*) FILTER (WHERE NOT predicted AND gold) AS fn FROM g) SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS p, round(tp / CAST(tp + fn
AS DOUBLE), 6) AS r, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1,
round((tp / CAST(tp + fp AS DOUBLE) + 1.96 * 1.96 / (2.0 * (tp + fp)) - 1.96 * sqrt(tp / CAST(tp + fp AS DOUBLE) * (1 - tp / CAST(tp + fp AS DOUBLE))
/ (tp + fp) + 1.96 * 1.96 / (4.0 * (tp + fp) * (tp + fp)))) / (1 + 1.96 * 1.96 / (tp + fp)), 6) AS p_low FROM s""")
def extraction_scores(spark, root):
    """Precision, recall, F1 and a Wilson bound of a rule against the documents' kinds."""
    d = table(spark, root, "documents").select(F.lower(F.coalesce("text", F.lit(""))).contains("recall").alias("p"),
        (F.col("doc_kind") == "recall_notice").alias("g"))
    s = d.agg(F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(F.col("p") & ~F.col("g")).alias("fp"),
        F.count_if(~F.col("p") & F.col("g")).alias("fn"))
    p, r, f1 = numbers.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    low, _ = numbers.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return s.select("tp", "fp", "fn", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1, 6).alias("f1"), F.round(low, 6).alias("p_low"))


@query("""SELECT value_type, count(*) AS n, count(*) FILTER (WHERE CASE value_type WHEN 'number' THEN TRY_CAST(normalized_value AS DOUBLE) IS NOT NULL
WHEN 'integer' THEN TRY_CAST(normalized_value AS DOUBLE) = floor(TRY_CAST(normalized_value AS DOUBLE))
WHEN 'string' THEN normalized_value LIKE '"%' WHEN 'enum' THEN normalized_value LIKE '"%' ELSE TRUE END) AS agree FROM facts WHERE normalized_value IS
NOT NULL GROUP BY 1""")
def type_agreement(spark, root):
    """Whether values are of their declared type."""
    v, k = F.col("normalized_value"), F.col("value_type")
    n = v.try_cast("double")
    ok = F.when(k == "number", n.isNotNull()).when(k == "integer", F.coalesce(n == F.floor(n), F.lit(False))).when(k.isin("string", "enum"),
        v.startswith('"')).otherwise(True)
    return table(spark, root, "facts").where(v.isNotNull()).groupBy("value_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("agree"))


@query("""SELECT property, count(*) AS n, count(*) FILTER (WHERE valid_to <= valid_from) AS empty_period, count(*) FILTER (WHERE recorded_at <
valid_from) AS early, count(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 1) AS other_scale,
count(*) FILTER (WHERE value_type = 'quantity' AND unit IS NULL AND TRY_CAST(normalized_value AS DOUBLE) IS NOT NULL) AS no_unit FROM facts GROUP BY
1""")
def consistency_checks(spark, root):
    """Failed checks by property, in one pass."""
    c = lambda e: F.count_if(F.expr(e))
    return table(spark, root, "facts").groupBy("property").agg(
        F.count(F.lit(1)).alias("n"), c("valid_to <= valid_from").alias("empty_period"), c("recorded_at < valid_from").alias("early"),
        c("confidence not between 0 and 1").alias("other_scale"),
        c("value_type = 'quantity' and unit is null and try_cast(normalized_value as double) is not null").alias("no_unit"),
    )

