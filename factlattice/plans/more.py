"""Queries for search, lookups, links, rollups, incremental work, canonical values and usage messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factlattice.functions import canonical, identifiers
from factlattice.operators import dedup, ordering, relational, search, sync, versions
from factlattice.plans.registry import Registry
from factlattice.session import table
from factlattice.sources import tabular
from factlattice.streaming import usage

query = Registry()


def _c(name):
    return F.col(name)


def _notices(spark, root):
    """Orders in the part of notices: what a notice search filters by."""
    o = table(spark, root, "orders")
    return o.select(_c("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        (_c("o_orderkey") % 17 == 0).alias("nationwide"), F.concat(F.lit("Customer "), _c("o_custkey").cast("string"), F.lit(" "), "o_orderpriority",
        F.lit(" heater recall")).alias("title"))


def _notice_keys(spark, root):
    li = table(spark, root, "lineitem")
    k = F.array(F.struct(F.lit("part").alias("kind"), (_c("l_partkey") % 50).cast("string").alias("value")),
        F.struct(F.lit("state").alias("kind"), (_c("l_suppkey") % 40).cast("string").alias("value")),
        F.struct(F.lit("flag").alias("kind"), _c("l_returnflag").alias("value")))
    return li.select(_c("l_orderkey").alias("id"), F.explode(k).alias("k")).select("k.kind", "k.value", "id").distinct()


_HIT_SQL = """n AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_orderkey % 17 = 0 AS nationwide FROM orders),
hit AS (SELECT * FROM n WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-12-31' AND
o_orderdate > TIMESTAMP '1996-03-01' AND o_orderpriority ILIKE '%medium%'
AND id IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 IN (3, 4, 5)) AND (nationwide OR id IN (SELECT l_orderkey FROM lineitem WHERE
l_suppkey % 40 = 7)) AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))"""


def _wanted():
    return search.Filters(
        keys={"part": ["3", "4", "5"], "state": ["7"], "flag": ["R"]}, instead={"state": F.col("nationwide")}, equal={"o_orderstatus": ["O", "P"]},
        between={"o_orderdate": ("1996-01-01", "2000-12-31")},
        changed_since=("o_orderdate", "1996-03-01"), words=("title", ["heater", "recall"]), like={"o_orderpriority": "Medium"},
    )


@query(f"WITH {_HIT_SQL} SELECT id, o_custkey, o_orderstatus, o_orderdate FROM hit")
def notice_search(spark, root):
    """A search with seven kinds of filters at once: keys, a state or nationwide, dates, changes, words, and part of a name."""
    return search.matching(_notices(spark, root), _notice_keys(spark, root), _wanted()).select("id", "o_custkey", "o_orderstatus", "o_orderdate")


@query(f"WITH {_HIT_SQL} SELECT count(DISTINCT id) AS total FROM hit")
def notice_search_total(spark, root):
    """How many notices a search finds."""
    return search.total(search.matching(_notices(spark, root), _notice_keys(spark, root), _wanted()))


@query("""WITH n AS (SELECT o_orderkey AS id, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey < 1000)) SELECT * FROM n ORDER BY o_orderdate DESC, id DESC LIMIT 25""")
def notice_page(spark, root):
    """The page of notices after a cursor, latest first."""
    import datetime

    return search.page(_notices(spark, root), "o_orderdate", "id", 25, (datetime.datetime(1998, 6, 1), 1000)).select("id", "o_orderdate")


def _search_index(spark, root):
    e = table(spark, root, "entities").where("coalesce(status, '') <> 'MERGED'")
    alias = F.array_join(F.filter(F.transform("aliases", lambda a: a["alias_value"]), lambda v: v.isNotNull()), " ")
    return e, search.inverted_index(e, "entity_id", {"name": (F.coalesce("canonical_name", F.lit("")), 1.0), "alias": (F.coalesce(alias, F.lit("")),
        0.9), "type": (F.coalesce("entity_type", F.lit("")), 0.6)})


_RANK_SQL = r"""e AS (SELECT entity_id AS id, canonical_name, canonical_slug, entity_type, aliases FROM entities WHERE coalesce(status, '') <> 'MERGED'),
f AS (SELECT id, 1.0 AS boost, coalesce(canonical_name, '') AS t FROM e UNION ALL SELECT id, 0.9,
coalesce(array_to_string(list_filter(list_transform(aliases, lambda a: a.alias_value), lambda v: v IS NOT NULL), ' '), '') FROM e UNION ALL SELECT id,
0.6, coalesce(entity_type, '') FROM e),
w AS (SELECT id, boost, unnest(string_split_regex(lower(t), '[^\p{L}\p{N}]+')) AS token FROM f), p AS (SELECT id, boost, token, count(*) AS n FROM w
WHERE token IN ('air', 'works') GROUP BY 1, 2, 3),
b AS (SELECT id, token, max(boost * (1 - 1.0 / (1 + n))) AS s FROM p GROUP BY 1, 2), r AS (SELECT id, round(sum(s), 6) AS score FROM b GROUP BY 1
HAVING count(*) = 2),
x AS (SELECT DISTINCT id FROM e WHERE canonical_slug LIKE 'corvanth%')"""


@query(f"WITH {_RANK_SQL} SELECT id, 0 AS tier, 1.0 AS score FROM x UNION ALL SELECT id, 1, score FROM r WHERE id NOT IN (SELECT id FROM x)")
def ranked_search(spark, root):
    """Exact matches, then entities that have every word, by boosted fields, over an inverted index."""
    e, index = _search_index(spark, root)
    exact = e.where(_c("canonical_slug").startswith("corvanth")).select(_c("entity_id").alias("id"))
    return search.tiered(exact, search.ranked(index, ["Air", "works"]))


@query(f"WITH {_RANK_SQL} SELECT (SELECT count(*) FROM x) + (SELECT count(DISTINCT id) FROM r WHERE id NOT IN (SELECT id FROM x)) AS total")
def ranked_search_total(spark, root):
    """The honest total of a tiered search: nothing counted twice."""
    return search.total(ranked_search(spark, root))


@query("""WITH p AS (SELECT DISTINCT lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') AS
product, lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') || '-0' || l_linenumber AS
package, l_orderkey FROM lineitem)
SELECT product, count(DISTINCT package) AS packages, count(DISTINCT l_orderkey) AS notices FROM p WHERE substr(package, 1, 10) IN (SELECT product FROM
p WHERE substr(product, 5, 1) IN ('1', '2')) GROUP BY 1""")
def package_rollup(spark, root):
    """Notices of packages found by their product's code: an equi join on the product part instead of a range."""
    a, b = F.lpad((_c("l_partkey") % 100000).cast("string"), 5, "0"), F.lpad((_c("l_suppkey") % 10000).cast("string"), 4, "0")
    li = table(spark, root, "lineitem").select(F.concat_ws("-", a, b, F.concat(F.lit("0"), _c("l_linenumber").cast("string"))).alias("package"),
        "l_orderkey").withColumn("product", identifiers.product_of_package(_c("package")))
    asked = li.where(F.substring("product", 5, 1).isin("1", "2")).select("product").distinct()
    return li.join(asked, "product", "left_semi").groupBy("product").agg(F.count_distinct("package").alias("packages"),
        F.count_distinct("l_orderkey").alias("notices"))


@query("""WITH c AS (SELECT doc_id, lower(hex(substr(sha256(coalesce(text, '')), 1, 1))) AS k, sha256(coalesce(text, '')) AS h FROM documents), k AS
(SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE h END AS at_digest, 'K' || doc_id % 97 AS code FROM c)
SELECT k.code, count(*) AS valid FROM k JOIN c ON c.doc_id = k.doc_id AND c.h = k.at_digest GROUP BY 1""")
def digest_guarded(spark, root):
    """Keys taken from a text count only while the text is still the one they were taken from."""
    c = table(spark, root, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    k = c.select("doc_id", F.when(_c("doc_id") % 6 == 0, "old").otherwise(_c("h")).alias("h"),
        F.concat(F.lit("K"), (_c("doc_id") % 97).cast("string")).alias("code"))
    return k.join(c, ["doc_id", "h"]).groupBy("code").agg(F.count(F.lit(1)).alias("valid"))


@query("""WITH n AS (SELECT o_orderkey AS id, 'u' || o_orderkey AS url FROM orders), c AS (SELECT DISTINCT l_orderkey AS recall_id, 'u' || (l_partkey
* 3) AS url FROM lineitem),
j AS (SELECT n.id AS cited, c.recall_id AS citing FROM c JOIN n ON n.url = c.url WHERE n.id <> c.recall_id)
SELECT id, coalesce(a.k, 0) AS cites, coalesce(b.k, 0) AS cited_by FROM n LEFT JOIN (SELECT citing, count(*) AS k FROM j GROUP BY 1) a ON a.citing =
id LEFT JOIN (SELECT cited, count(*) AS k FROM j GROUP BY 1) b ON b.cited = id WHERE a.k IS NOT NULL OR b.k IS NOT NULL""")
def citation_links(spark, root):
    """How many notices each one cites, and is cited by, through the keys of URLs; links to itself don't count."""
    n = table(spark, root, "orders").select(_c("o_orderkey").alias("cited"), F.concat(F.lit("u"), _c("o_orderkey").cast("string")).alias("url"))
    c = table(spark, root, "lineitem").select(_c("l_orderkey").alias("citing"),
        F.concat(F.lit("u"), (_c("l_partkey") * 3).cast("string")).alias("url")).distinct()
    j = c.join(n, "url").where("citing <> cited")
    ends = j.select(F.explode(F.array(F.struct(_c("citing").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(_c("cited").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.a").alias("cites"), F.sum("e.b").alias("cited_by"))


@query("""SELECT 'customer' AS dataset, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_custkey IN (7, 17, 42) UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_suppkey IN (7, 17, 42) UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey IN (7, 17, 42)""")
def dataset_fanout(spark, root):
    """Codes looked up in several datasets, each hit with its dataset."""
    arm = lambda t, k, n: table(spark, root, t).where(_c(k).isin(7, 17, 42)).select(F.lit(t).alias("dataset"), _c(k).cast("string").alias("id"),
        _c(n).alias("name"))
    return arm("customer", "c_custkey", "c_name").unionByName(arm("supplier", "s_suppkey", "s_name")).unionByName(arm("part", "p_partkey", "p_name"))


@query("""SELECT r_name, v.kind, r_regionkey * v.weight AS score FROM region, (VALUES ('read', 1), ('write', 10), ('admin', 100)) v(kind, weight)""")
def literal_cross(spark, root):
    """Each region with each of a few fixed values: an array exploded, not a join."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight")) for k, w in (("read", 1), ("write", 10), ("admin", 100))])
    return table(spark, root, "region").select("r_name", "r_regionkey", F.explode(kinds).alias("v")).select("r_name", "v.kind",
        (_c("r_regionkey") * _c("v.weight")).alias("score"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS nation, floor(s_acctbal / 1000) AS band FROM supplier), p AS (SELECT a.id AS a, b.id AS b,
a.nation <> b.nation AS other_nation, a.band <> b.band AS other_band, (a.id + b.id) % 5 = 0 AS never FROM s a JOIN s b ON a.id < b.id AND a.id % 10 =
b.id % 10)
SELECT a, b, concat_ws(',', CASE WHEN never THEN 'NEVER_MERGE' END, CASE WHEN other_nation THEN 'RELATED_MISMATCH' END, CASE WHEN other_band THEN
'HARD_CONFLICT' END) AS reasons FROM p""")
def pair_rejections(spark, root):
    """Why candidate pairs may not be merged, every reason in a fixed order."""
    s = table(spark, root, "supplier").select(_c("s_suppkey").alias("id"), _c("s_nationkey").alias("nation"),
        F.floor(_c("s_acctbal") / 1000).alias("band"))
    pairs = relational.blocking_pairs(s, F.array((_c("id") % 10).cast("string")))
    x, y = s.select(*[_c(c).alias(f"{c}_a") for c in s.columns]), s.select(*[_c(c).alias(f"{c}_b") for c in s.columns])
    j = pairs.join(x, pairs["a"] == _c("id_a")).join(y, pairs["b"] == _c("id_b"))
    why = F.array(F.when((_c("a") + _c("b")) % 5 == 0, "NEVER_MERGE"), F.when(_c("nation_a") != _c("nation_b"), "RELATED_MISMATCH"),
        F.when(_c("band_a") != _c("band_b"), "HARD_CONFLICT"))
    return j.select("a", "b", F.array_join(why, ",").alias("reasons"))


@query("""WITH asked AS (SELECT DISTINCT slug FROM (SELECT canonical_slug AS slug FROM entities UNION ALL SELECT from_slug FROM entity_redirects) x
WHERE slug IS NOT NULL), own AS (SELECT canonical_slug AS slug, min(entity_id) AS e FROM entities WHERE coalesce(status, '') <> 'MERGED' AND
canonical_slug IS NOT NULL GROUP BY 1),
red AS (SELECT from_slug AS slug, min(lower(to_entity_id)) AS e FROM entity_redirects WHERE active AND to_entity_id IS NOT NULL AND from_slug IS NOT
NULL GROUP BY 1)
SELECT asked.slug, coalesce(own.e, red.e) AS entity_id, own.e IS NULL AND red.e IS NOT NULL AS redirected FROM asked LEFT JOIN own ON own.slug =
asked.slug LEFT JOIN red ON red.slug = asked.slug""")
def slug_fallback(spark, root):
    """Entities by slug, else by the redirect of a retired slug."""
    e, r = table(spark, root, "entities"), table(spark, root, "entity_redirects")
    asked = e.select(_c("canonical_slug").alias("slug")).union(r.select("from_slug")).where("slug is not null").distinct()
    own = e.where("coalesce(status, '') <> 'MERGED' and canonical_slug is not null").groupBy(_c("canonical_slug").alias("slug")).agg(F.min("entity_id").alias("own"))
    red = r.where("active and to_entity_id is not null and from_slug is not null").groupBy(_c("from_slug").alias("slug")).agg(F.min(F.lower("to_entity_id")).alias("red"))
    return asked.join(own, "slug", "left").join(red, "slug", "left").select("slug", F.coalesce("own", "red").alias("entity_id"),
        (_c("own").isNull() & _c("red").isNotNull()).alias("redirected"))


@query("""WITH l AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS o FROM lineitem), x AS (SELECT s AS entity, o AS other, 'out' AS direction FROM l
UNION ALL SELECT o, s, 'in' FROM l)
SELECT entity, direction, count(*) AS links, min(other) AS first FROM x GROUP BY 1, 2""")
def relationships(spark, root):
    """Links of each entity as subject and as object: a union of two sides, no OR join."""
    li = table(spark, root, "lineitem").select(_c("l_partkey").alias("s"), _c("l_suppkey").alias("o")).distinct()
    both = li.select(F.explode(F.array(F.struct(_c("s").alias("entity"), _c("o").alias("other"), F.lit("out").alias("direction")),
        F.struct(_c("o").alias("entity"), _c("s").alias("other"), F.lit("in").alias("direction")))).alias("x"))
    return both.groupBy("x.entity", "x.direction").agg(F.count(F.lit(1)).alias("links"), F.min("x.other").alias("first"))


@query("""WITH u AS (SELECT l_partkey, string_agg(DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 12, '0'), ', ' ORDER BY lpad(CAST(l_suppkey AS VARCHAR),
12, '0')) AS more FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN coalesce('000000000000, ' || more, '000000000000') ELSE coalesce(more, '') END AS upc FROM part
LEFT JOIN u ON l_partkey = p_partkey""")
def side_file_codes(spark, root):
    """Codes of a side file added to each model's own, sorted, joined into one text."""
    code = F.lpad(_c("l_suppkey").cast("string"), 12, "0")
    more = table(spark, root, "lineitem").select(_c("l_partkey").alias("p_partkey"),
        code.alias("c")).distinct().groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("c")), ", ").alias("more"))
    own = F.when(_c("p_partkey") % 3 == 0, "000000000000")
    return table(spark, root, "part").select("p_partkey").join(more, "p_partkey", "left").select("p_partkey",
        F.concat_ws(", ", own, "more").alias("upc"))


@query("""SELECT e.entity_id, (SELECT min(a.alias_value) FROM (SELECT unnest(e.aliases) AS a) x WHERE a.alias_type = 'model_number') AS first_model, (SELECT min(r.from_slug) FROM entity_redirects r WHERE r.active AND lower(r.to_entity_id) = e.entity_id) AS old_slug FROM (SELECT DISTINCT entity_id, aliases FROM entities) e""")
def first_alias(spark, root):
    """Each entity's first model number and the first slug redirected to it: aggregations joined, no correlated subquery."""
    e = table(spark, root, "entities").select("entity_id", "aliases").distinct()
    model = F.array_min(F.transform(F.filter("aliases", lambda a: a["alias_type"] == "model_number"), lambda a: a["alias_value"]))
    old = table(spark, root,
        "entity_redirects").where("active and to_entity_id is not null").groupBy(F.lower("to_entity_id").alias("entity_id")).agg(F.min("from_slug").alias("old_slug"))
    return e.select("entity_id", model.alias("first_model")).join(old, "entity_id", "left")


@query("""SELECT entity_id, property, count(DISTINCT id) AS candidates, count(DISTINCT CASE WHEN supersedes_fact_id IS NOT NULL THEN id END) AS with_predecessor, max(recorded_at) AS last_recorded FROM facts f WHERE valid_from <= TIMESTAMP '2025-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2025-06-01') AND EXISTS (SELECT 1 FROM entities e WHERE e.entity_id = f.entity_id) GROUP BY 1, 2""")
def fact_candidates(spark, root):
    """Candidates for each field at an instant, with what stands behind them, of entities that exist."""
    f = relational.as_of(table(spark, root, "facts"), "2025-06-01 00:00:00").join(table(spark, root, "entities").select("entity_id").distinct(),
        "entity_id", "left_semi")
    return f.groupBy("entity_id", "property").agg(F.count_distinct("id").alias("candidates"),
        F.count_distinct(F.when(_c("supersedes_fact_id").isNotNull(), _c("id"))).alias("with_predecessor"),
        F.max("recorded_at").alias("last_recorded"))


@query("""SELECT e.entity_id, count(DISTINCT f.property) AS properties, count(f.id) AS facts, CAST(min(date_diff('day', CAST(f.recorded_at AS DATE),
DATE '2026-06-01')) AS BIGINT) AS stale_days, count(DISTINCT CASE WHEN f.status = 'DISPUTED' THEN f.property END) > 0 AS disputed
FROM (SELECT DISTINCT entity_id FROM entities) e LEFT JOIN facts f ON f.entity_id = e.entity_id GROUP BY 1""")
def entity_signals(spark, root):
    """Coverage, counts and age of what is known of each entity."""
    e, f = table(spark, root, "entities").select("entity_id").distinct(), table(spark, root, "facts")
    g = f.groupBy("entity_id").agg(
        F.count_distinct("property").alias("properties"), F.count("id").alias("facts"),
        F.datediff(F.lit("2026-06-01").cast("date"), F.max("recorded_at").cast("date")).cast("bigint").alias("stale_days"),
        (F.count_distinct(F.when(_c("status") == "DISPUTED", _c("property"))) > 0).alias("disputed")
    )
    j = e.join(g, "entity_id", "left")
    return j.select("entity_id", F.coalesce("properties", F.lit(0)).alias("properties"), F.coalesce("facts", F.lit(0)).alias("facts"), "stale_days",
        F.coalesce("disputed", F.lit(False)).alias("disputed"))


@query("""SELECT status AS source, count(DISTINCT id) AS facts, count(*) AS rows, count(DISTINCT entity_id) AS entities FROM facts GROUP BY 1""")
def contribution_tally(spark, root):
    """What each kind of claim contributed."""
    return table(spark, root, "facts").groupBy(_c("status").alias("source")).agg(F.count_distinct("id").alias("facts"),
        F.count(F.lit(1)).alias("rows"), F.count_distinct("entity_id").alias("entities"))


@query("""SELECT 'NO_TEXT' AS code, least(count(*), 1000000) AS n FROM documents WHERE text IS NULL UNION ALL SELECT 'NO_LANGUAGE', least(count(*),
1000000) FROM documents WHERE lang IS NULL UNION ALL SELECT 'NO_TENANT', least(count(*), 1000000) FROM api_usage_events WHERE tenant_id IS NULL
UNION ALL SELECT 'NO_TARGET', least(count(*), 1000000) FROM entity_redirects WHERE to_entity_id IS NULL UNION ALL SELECT 'FAILED', least(count(*),
1000000) FROM api_usage_events WHERE status >= 500""")
def health_counts(spark, root):
    """Five counts of what is wrong, each bounded for display; one scan of each table."""
    d = table(spark, root, "documents").agg(F.count_if(_c("text").isNull()).alias("NO_TEXT"), F.count_if(_c("lang").isNull()).alias("NO_LANGUAGE"))
    u = table(spark, root, "api_usage_events").agg(F.count_if(_c("tenant_id").isNull()).alias("NO_TENANT"),
        F.count_if(_c("status") >= 500).alias("FAILED"))
    r = table(spark, root, "entity_redirects").agg(F.count_if(_c("to_entity_id").isNull()).alias("NO_TARGET"))
    long = lambda x: x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"),
        F.least(_c(c), F.lit(1000000)).alias("n")) for c in x.columns])).alias("r")).select("r.*")
    return long(d).unionByName(long(u)).unionByName(long(r))


@query("""SELECT count(*) AS n, count(brand) AS brand, count(model) AS model, count(series) AS series, count(refrigerant) AS refrigerant, count(efficiency.seer2) AS seer2, count(lifecycle.status) AS status, round(count(brand) / CAST(count(*) AS DOUBLE), 6) AS brand_share FROM acme_catalog""")
def field_coverage(spark, root):
    """In how many records each field is filled, in one pass."""
    c = table(spark, root, "acme_catalog")
    fields = {"brand": "brand", "model": "model", "series": "series", "refrigerant": "refrigerant", "seer2": "efficiency.seer2",
        "status": "lifecycle.status"}
    return c.agg(F.count(F.lit(1)).alias("n"), *[F.count(v).alias(k) for k, v in fields.items()],
        F.round(F.count("brand") / F.count(F.lit(1)), 6).alias("brand_share"))


@query("""SELECT lang, max(doc_id) AS last_id, max(CASE WHEN doc_kind = 'recall_notice' THEN published_at END) AS last_recall, arg_max(source, doc_id) AS source_of_last FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def source_state(spark, root):
    """The last record of each group, when its last success was, and what came last."""
    d = table(spark, root, "documents").where("source is not null")
    return d.groupBy("lang").agg(F.max("doc_id").alias("last_id"), F.max(F.when(_c("doc_kind") == "recall_notice",
        _c("published_at"))).alias("last_recall"), F.max_by("source", "doc_id").alias("source_of_last"))


@query("""WITH a AS (SELECT entity_id, a.alias_type AS t, a.alias_value AS v, unnest(a.sources) AS s FROM (SELECT DISTINCT entity_id, unnest(aliases)
AS a FROM entities) x)
SELECT DISTINCT entity_id, t AS alias_type, v AS alias_value, array_to_string(list_sort(list_distinct(list(s) OVER (PARTITION BY entity_id))), ',') AS
entity_sources FROM a WHERE v IS NOT NULL""")
def sources_of_all_aliases(spark, root):
    """Each alias with the sources of all aliases of its entity."""
    a = table(spark, root, "entities").select("entity_id", F.explode("aliases").alias("a")).distinct().select("entity_id", "a.alias_type",
        "a.alias_value", F.explode("a.sources").alias("s")).where("alias_value is not null")
    w = Window.partitionBy("entity_id")  # an entity has a handful of aliases
    return a.withColumn("entity_sources", F.array_join(F.array_sort(F.collect_set("s").over(w)), ",")).select("entity_id", "alias_type",
        "alias_value", "entity_sources").distinct()


@query("""WITH k AS (SELECT upper(regexp_replace(model, '[^0-9A-Za-z]', '', 'g')) AS key, model, count(*) AS n FROM acme_catalog WHERE model IS NOT
NULL GROUP BY 1, 2)
SELECT key, model AS preferred FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY model = key DESC, n DESC, model) AS r FROM k) x WHERE r =
1""")
def preferred_spellings(spark, root):
    """Of all spellings of a key the one to show: the canonical form, else the most frequent, else the first by code points."""
    k = table(spark, root, "acme_catalog").where("model is not null").groupBy(F.upper(F.regexp_replace("model", "[^0-9A-Za-z]", "")).alias("key"),
        "model").agg(F.count(F.lit(1)).alias("n"))
    best = k.groupBy("key").agg(F.min(F.struct((_c("model") != _c("key")).alias("a"), (-_c("n")).alias("b"), "model")).alias("m"))
    return best.select("key", _c("m.model").alias("preferred"))


@query("""SELECT name, entity_id AS chosen FROM (SELECT lower(canonical_name) AS name, entity_id, row_number() OVER (PARTITION BY lower(canonical_name) ORDER BY first_seen_at NULLS LAST, updated_at NULLS LAST, canonical_slug, entity_id) AS k FROM entities WHERE canonical_name IS NOT NULL AND canonical_slug IS NOT NULL) x WHERE k = 1""")
def provisional_entity(spark, root):
    """Of entities of one name the one to work with for now: seen first, changed first, first slug."""
    late = F.lit("9999-12-31").cast("timestamp_ntz")
    e = table(spark, root, "entities").where("canonical_name is not null and canonical_slug is not null")
    g = e.groupBy(F.lower("canonical_name").alias("name")).agg(F.min(F.struct(F.coalesce("first_seen_at", late).alias("a"),
        F.coalesce("updated_at", late).alias("b"), "canonical_slug", "entity_id")).alias("m"))
    return g.select("name", _c("m.entity_id").alias("chosen"))


@query("""SELECT id, CAST(row_number() OVER (ORDER BY entity_id, property, valid_from NULLS FIRST, recorded_at NULLS FIRST, status, confidence NULLS FIRST, unit NULLS FIRST, id) - 1 AS BIGINT) AS rank FROM (SELECT DISTINCT id, entity_id, property, valid_from, recorded_at, status, confidence, unit FROM facts) x""")
def evidence_order(spark, root):
    """The place of every fact in a total order of eight keys."""
    f = table(spark, root, "facts").select("id", "entity_id", "property", "valid_from", "recorded_at", "status", "confidence", "unit").distinct()
    return ordering.running(f, ["entity_id", "property", "valid_from", "recorded_at", "status", "confidence", "unit", "id"]).select("id", "rank")


@query("""WITH r AS (SELECT o_orderkey AS request, l_linenumber AS rule, (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN l_returnflag
= 'R' THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS spec FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
m AS (SELECT request, max(spec) AS top FROM r GROUP BY 1) SELECT r.request, m.top AS specificity, CASE WHEN count(DISTINCT rule) > 1 THEN
'AMBIGUOUS_SCOPE' ELSE 'CHOSEN' END AS outcome, min(rule) AS rule FROM r JOIN m ON m.request = r.request AND m.top = r.spec GROUP BY 1, 2""")
def most_specific_rule(spark, root):
    """The most specific of the rules that fit a request; a tie is reported as ambiguous."""
    li = table(spark, root, "lineitem")
    spec = (_c("l_linenumber") % 2 == 0).cast("int") + (_c("l_returnflag") == "R").cast("int") + (_c("l_linestatus") == "O").cast("int")
    r = li.join(table(spark, root, "orders").select("o_orderkey"), _c("l_orderkey") == _c("o_orderkey")).groupBy(_c("o_orderkey").alias("request"),
        spec.alias("spec")).agg(F.count_distinct("l_linenumber").alias("k"), F.min("l_linenumber").alias("rule"))
    top = r.groupBy("request").agg(F.max(F.struct("spec", "k", "rule")).alias("t"))
    return top.select("request", _c("t.spec").alias("specificity"), F.when(_c("t.k") > 1, "AMBIGUOUS_SCOPE").otherwise("CHOSEN").alias("outcome"),
        _c("t.rule").alias("rule"))


@query("""SELECT o_orderkey, CASE WHEN d BETWEEN '2000-06-17' AND '2000-08-01' THEN 'recent' ELSE 'history' END AS "window" FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) x WHERE d BETWEEN '2000-06-17' AND '2000-08-01' OR d BETWEEN '1997-01-01' AND '1997-04-30'""")
def rolling_windows(spark, root):
    """The orders that one run of an incremental source reads: the last 45 days, and 120 days of history behind the cursor."""
    return sync.in_windows(table(spark, root, "orders"), _c("o_orderdate"),
        sync.rolling_windows("2000-08-01", "1997-01-01", "1992-01-01")).select("o_orderkey", "window")


@query("""SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 300 SECOND""")
def settled_changes(spark, root):
    """Changes since a point that are old enough that nothing earlier can still come in."""
    return sync.settled(table(spark, root, "events"), "ts", "2024-01-01 06:00:00", "2024-01-02 00:00:00", 300).select("event_id", "ts")


@query("""WITH RECURSIVE d AS (SELECT DISTINCT id AS derived, supersedes_fact_id AS input FROM facts WHERE supersedes_fact_id IS NOT NULL), s AS (SELECT id AS node FROM facts WHERE status = 'RETRACTED' UNION SELECT d.derived FROM s JOIN d ON d.input = s.node) SELECT node FROM s""")
def affected_facts(spark, root):
    """Everything that has to be looked at again after some facts were retracted."""
    f = table(spark, root, "facts")
    d = f.where("supersedes_fact_id is not null").select(_c("id").alias("derived"), _c("supersedes_fact_id").alias("input"))
    return sync.affected(d, f.where("status = 'RETRACTED'").select(_c("id").alias("node")))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT p_partkey AS derived, p_partkey // 2 AS input FROM part WHERE p_partkey > 1 UNION SELECT p_partkey,
p_partkey // 3 FROM part WHERE p_partkey > 2), n AS (SELECT derived AS node FROM d UNION SELECT input FROM d),
w AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT derived FROM d) UNION SELECT d.derived, w.level + 1 FROM w JOIN d ON d.input = w.node)
SELECT node, max(level) AS level FROM w GROUP BY 1""")
def derivation_levels(spark, root):
    """An order in which every derived thing comes after its inputs."""
    p = table(spark, root, "part").select("p_partkey")
    k = _c("p_partkey")
    d = p.where(k > 1).select(k.alias("derived"), F.floor(k / 2).cast("bigint").alias("input")).unionByName(p.where(k > 2).select(k.alias("derived"),
        F.floor(k / 3).cast("bigint").alias("input")))
    return sync.levels(d)


@query("""WITH RECURSIVE d AS (SELECT DISTINCT id AS derived, supersedes_fact_id AS input FROM facts WHERE supersedes_fact_id IS NOT NULL), new AS
(SELECT DISTINCT supersedes_fact_id AS derived, id AS input FROM facts WHERE supersedes_fact_id IS NOT NULL AND property = 'seer2' UNION SELECT id,
min(id) OVER () FROM facts WHERE property = 'airflow'),
up AS (SELECT DISTINCT input AS root, input AS node FROM new UNION SELECT up.root, d.input FROM up JOIN d ON d.derived = up.node) SELECT derived,
input, derived = input OR EXISTS (SELECT 1 FROM up WHERE up.root = new.input AND up.node = new.derived) AS refused FROM new""")
def refused_cycles(spark, root):
    """Which new links would close a cycle."""
    f = table(spark, root, "facts")
    d = f.where("supersedes_fact_id is not null").select(_c("id").alias("derived"), _c("supersedes_fact_id").alias("input"))
    first = f.where("property = 'airflow'").agg(F.min("id")).first()[0]
    new = f.where("supersedes_fact_id is not null and property = 'seer2'").select(_c("supersedes_fact_id").alias("derived"),
        _c("id").alias("input")).union(f.where("property = 'airflow'").select(_c("id").alias("derived"), F.lit(first).alias("input"))).distinct()
    return sync.closes_cycle(d, new)


@query("""WITH m AS (SELECT lower(from_entity_id) AS loser, min(lower(to_entity_id)) AS survivor FROM entity_redirects WHERE active AND to_entity_id
IS NOT NULL AND reason = 'MERGE' GROUP BY 1), ok AS (SELECT * FROM m WHERE survivor NOT IN (SELECT loser FROM m))
SELECT 'entity ' || status AS kind, count(*) AS n FROM (SELECT e.entity_id, CASE WHEN ok.loser IS NOT NULL THEN 'MERGED' ELSE coalesce(e.status, '')
END AS status FROM entities e LEFT JOIN ok ON ok.loser = e.entity_id) x GROUP BY 1
UNION ALL SELECT 'redirect ' || a, count(*) FROM (SELECT CASE WHEN active AND lower(from_entity_id) NOT IN (SELECT loser FROM ok) THEN 'active' ELSE
'closed' END AS a FROM entity_redirects WHERE from_entity_id IS NOT NULL AND active IS NOT NULL UNION ALL SELECT 'active' FROM ok) y GROUP BY 1""")
def entity_merge(spark, root):
    """Entities merged into others: their status, and one active redirect for each."""
    r = table(spark, root,
        "entity_redirects").where("from_entity_id is not null and active is not null").select(F.lower("from_entity_id").alias("from_entity_id"),
        F.lower("to_entity_id").alias("to_entity_id"), "active", "created_at", "reason")
    m = r.where("active and to_entity_id is not null and reason = 'MERGE'").groupBy(_c("from_entity_id").alias("loser")).agg(F.min("to_entity_id").alias("survivor"))
    m = m.join(m.select(_c("loser").alias("survivor")).distinct(), "survivor", "left_anti")
    e, rr = sync.merge_entities(table(spark, root, "entities").select("entity_id", F.coalesce("status", F.lit("")).alias("status")), r.drop("reason"),
        m, "2026-06-01 00:00:00")
    a = e.groupBy(F.concat(F.lit("entity "), "status").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(rr.groupBy(F.concat(F.lit("redirect "), F.when(_c("active"),
        "active").otherwise("closed")).alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT DISTINCT p_brand, p_type, min(p_name) OVER (PARTITION BY p_brand, p_type) AS p_name FROM part WHERE (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size > 45)""")
def idempotent_insert(spark, root):
    """Rows inserted only where their key is new, one of each key."""
    p = table(spark, root, "part")
    return sync.insert_new(p.where("p_size > 45").select("p_brand", "p_type"), p.select("p_brand", "p_type", "p_name"), ["p_brand", "p_type"])


@query("""WITH t AS (SELECT DISTINCT entity_id FROM entities WHERE status = 'MERGED') SELECT status, count(*) AS n, count(valid_to) AS closed FROM
(SELECT CASE WHEN t.entity_id IS NOT NULL AND f.valid_to IS NULL THEN 'RETRACTED' ELSE f.status END AS status, CASE WHEN t.entity_id IS NOT NULL AND
f.valid_to IS NULL THEN TIMESTAMP '2026-06-01' ELSE f.valid_to END AS valid_to
FROM facts f LEFT JOIN t ON t.entity_id = f.entity_id) x GROUP BY 1""")
def retracted_facts(spark, root):
    """Open facts of merged entities retracted at a time; all others as they are."""
    f, e = table(spark, root, "facts"), table(spark, root, "entities")
    r = versions.retract(f, e.where("status = 'MERGED'").select("entity_id"), ["entity_id"], "2026-06-01 00:00:00")
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("valid_to").alias("closed"))


@query("""SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1)) - 1 - ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) // 4) * 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT o_orderkey, sha256(o_orderkey || chr(0) || o_orderpriority) AS h FROM orders) x""")
def derived_uuids(spark, root):
    """Identifiers derived from the parts that make a record."""
    return table(spark, root, "orders").select("o_orderkey", canonical.derived_uuid(_c("o_orderkey").cast("string"),
        _c("o_orderpriority")).alias("uuid"))


@query("""SELECT event_id, '{"a":' || event_id || ',"b":[' || event_id % 3 || ',"x"],"k":' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '}' AS json, TRUE AS same, event_id % 3 = 0 AS same_list FROM events""")
def canonical_values(spark, root):
    """JSON with keys in order, and equality of objects whatever their keys' order, of lists in order."""
    i, k = _c("event_id").cast("string"), F.get_json_object("props", "$.k")
    m = (_c("event_id") % 3).cast("string")
    one = F.concat(F.lit('{ "k" : '), k, F.lit(', "b": ['), m, F.lit(', "x"], "a": '), i, F.lit("}"))
    two = F.concat(F.lit('{"a":'), i, F.lit(',"k":'), k, F.lit(',"b":['), m, F.lit(',"x"]}'))
    lists = canonical.same_value(F.concat(F.lit("[0,"), m, F.lit("]")), F.concat(F.lit("["), m, F.lit(",0]")))
    return table(spark, root, "events").select("event_id", canonical.canonical_json(one).alias("json"), canonical.same_value(one, two).alias("same"),
        lists.alias("same_list"))


@query("""SELECT o_orderkey, round(greatest(0.0, least(1.0, CASE WHEN rp < r THEN least(s, 0.5) ELSE s END)), 4) AS extraction, round((CASE WHEN a
THEN 0.8 ELSE 1.0 END) * (CASE WHEN b THEN 0.6 ELSE 1.0 END), 4) AS normalisation, round(least(1.0, o_custkey % 120 / 100.0) * 0.5 + (CASE WHEN a THEN
1.0 ELSE 0.25 END) * 0.5, 4) AS claim, coalesce(CASE WHEN b THEN 0.5 END, o_custkey % 120 / 100.0) AS reliability, least(60.0, power(2.0,
greatest(o_custkey % 9 - 1, 0))) AS backoff
FROM (SELECT *, 0.8 * (CASE WHEN r = 0 THEN 1 ELSE rp / CAST(r AS DOUBLE) END) + 0.2 * (op / CAST(o AS DOUBLE)) - 0.25 * (o_custkey % 3) /
CAST(greatest(r + o, 1) AS DOUBLE) - 0.15 * (o_custkey % 2) / CAST(greatest(r + o, 1) AS DOUBLE) AS s FROM
(SELECT o_orderkey, o_custkey, o_orderkey % 5 AS r, least(o_orderkey % 5, o_custkey % 4) AS rp, 4 AS o, o_custkey % 5 AS op, o_orderkey % 2 = 0 AS a,
o_orderkey % 3 = 0 AS b FROM orders) x) y""")
def confidence_scores(spark, root):
    """Scores of extraction, normalisation and claims, reliability, and the wait before another attempt."""
    k, c = _c("o_orderkey"), _c("o_custkey")
    required = k % 5
    return table(spark, root, "orders").select(
        "o_orderkey", canonical.extraction_confidence(required, F.least(required, c % 4), F.lit(4), c % 5, c % 3, c % 2).alias("extraction"),
        canonical.normalisation_confidence(k % 3 == 0, F.lit(False), k % 2 == 0, F.lit(False)).alias("normalisation"),
        canonical.claim_confidence(c % 120, F.when(k % 2 == 0, F.lit(None).cast("double")).otherwise(0.25)).alias("claim"),
        canonical.reliability(F.when(k % 3 == 0, 0.5), c % 120).alias("reliability"), canonical.backoff_seconds(c % 9).alias("backoff"),
    )


@query("""SELECT delivery_id, id IS NULL OR tenant_id IS NULL OR occurred_at IS NULL OR delivery_id % 50 = 0 AS malformed FROM api_usage_events""")
def usage_messages(spark, root):
    """Usage messages written as JSON and read back with an exact set of keys; malformed ones are told apart."""
    e = table(spark, root, "api_usage_events")
    stamp = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    cells = [stamp.alias(f) if f == "occurred_at" else _c(f) for f in usage.FIELDS]
    body = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    m = e.select("delivery_id", F.when(_c("delivery_id") % 50 == 0, F.concat(F.lit('{"extra":1,'), F.substring(body, 2,
        1 << 20))).otherwise(body).alias("body"))
    return usage.parse(m).select("delivery_id", "malformed")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS in_window, round((us - lag(us) OVER (PARTITION BY user_id ORDER BY us)) / 1000000.0, 3) AS gap_s FROM e""")
def rate_gaps(spark, root):
    """Requests in the trailing ten minutes of each source, and the gap to the one before."""
    e = table(spark, root, "events").select("event_id", "user_id", _c("ts").cast("timestamp").alias("at"))
    return usage.rate_gaps(e, "user_id", "at", 600).select("event_id", "in_window", F.round("gap_s", 3).alias("gap_s"))


@query("""SELECT event_id, CAST(sum(r) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation FROM (SELECT event_id, user_id, ts, CASE WHEN value > 50 AND NOT coalesce(lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) THEN 1 ELSE 0 END AS r FROM events) x""")
def incident_generations(spark, root):
    """How often a condition has become active so far."""
    e = table(spark, root, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), (_c("value") > 50).alias("active"))
    return usage.transitions(e, "user_id", "at", "active").select("event_id", _c("generation").cast("bigint").alias("generation"))


@query("""WITH k AS (SELECT *, CASE WHEN id IS NOT NULL THEN 'e' || regexp_replace(lower(id), '[^0-9a-f]', '', 'g') ELSE 'm' || message_id END AS msg FROM api_usage_events) SELECT route_key, count(*) AS events, CAST(sum(coalesce(rows_served, 0)) AS BIGINT) AS rows_served FROM (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY delivered_at, delivery_id) AS n FROM k) x WHERE n = 1 GROUP BY 1""")
def usage_once(spark, root):
    """Usage by route with each event counted once."""
    u = dedup.unique_messages(table(spark, root, "api_usage_events"), ["route_key", "rows_served"])
    return u.groupBy("route_key").agg(F.count(F.lit(1)).alias("events"),
        F.sum(F.coalesce("rows_served", F.lit(0))).cast("bigint").alias("rows_served"))


@query("""SELECT entity_id, canonical_name FROM entities e WHERE
EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id AND property = 'seer2' AND TRY_CAST(normalized_value AS DOUBLE) BETWEEN 15 AND 21) AND
EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id AND property = 'refrigerant' AND replace(normalized_value, '"', '') IN ('R-32',
'R-454B')) AND
EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.entity_id AND property = 'warranty_years' AND normalized_value IS NOT NULL)""")
def url_filters(spark, root):
    """Filters as a URL has them: values, a range, and whether there is any."""
    asked = search.parse_filters("page=2&filter.seer2.min=15&filter.seer2.max=21&filter.refrigerant=R-32,R-454B&filter.warranty_years.exists=true")
    f = table(spark, root, "facts").where("normalized_value is not null")
    cond = search.facet_conditions(asked, F.replace("normalized_value", F.lit('"'), F.lit("")))
    return relational.facet_filter(table(spark, root, "entities"), f, cond).select("entity_id", "canonical_name")


@query("""SELECT l_orderkey, array_to_string(list_slice(list_sort(list(DISTINCT l_partkey)), 1, 3), ',') AS parts, count(DISTINCT l_partkey) > 3 AS
truncated
FROM lineitem GROUP BY 1""")
def bounded_lists(spark, root):
    """Lists cut for display, with a mark where something was cut; the mark keeps the cut honest."""
    g = table(spark, root, "lineitem").select("l_orderkey",
        "l_partkey").distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p"))
    b = g.select("l_orderkey", search.bounded(_c("p"), 3).alias("b"))
    return b.select("l_orderkey", F.array_join("b.items", ",").alias("parts"), _c("b.truncated").alias("truncated"))


@query("""WITH s AS (SELECT c_custkey, c_name AS d, c_custkey % 4 + 1 AS r FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey, CASE WHEN
c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END AS d FROM customer WHERE c_custkey % 7 <> 0)
SELECT i.c_custkey, CAST(CASE WHEN s.r IS NULL THEN 1 WHEN s.d = i.d THEN s.r ELSE s.r + 1 END AS INT) AS revision, CASE WHEN s.r IS NULL THEN
'CREATED' WHEN s.d = i.d THEN 'UNCHANGED' ELSE 'REVISED' END AS outcome
FROM i LEFT JOIN s ON s.c_custkey = i.c_custkey""")
def record_revisions(spark, root):
    """Incoming records against stored ones: created, unchanged, or one revision more. (Both are made of the one table.)"""
    c, k = table(spark, root, "customer"), _c("c_custkey")
    stored = c.where(k % 3 != 0).select(k, _c("c_name").alias("d"), (k % 4 + 1).alias("revision"))
    incoming = c.where(k % 7 != 0).select(k, F.when(k % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(_c("c_name")).alias("d"))
    return sync.reconcile(stored, incoming, "c_custkey", "d")


@query("""SELECT s_suppkey, 's_nationkey' AS "column" FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT s_suppkey, 's_name' FROM supplier WHERE s_suppkey % 4 = 1""")
def immutable_columns(spark, root):
    """Where a patch would change what may never change."""
    s, k = table(spark, root, "supplier"), _c("s_suppkey")
    patch = s.select(k, F.when(k % 6 == 0, _c("s_nationkey") + 1).alias("s_nationkey"),
        F.when(k % 4 == 1, F.concat("s_name", F.lit("x"))).otherwise(_c("s_name")).alias("s_name"))
    return sync.immutable_violations(s, patch, "s_suppkey", ["s_nationkey", "s_name"])


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN repeat('A1', 30) WHEN 2 THEN '7-A' WHEN 3 THEN p_name WHEN 4
THEN 'see lot ' || p_partkey || ' on box' WHEN 5 THEN '1/2/' || (1000 + p_partkey % 9000) WHEN 6 THEN CAST(1990 + p_partkey % 60 AS VARCHAR) WHEN 7
THEN p_partkey || ' lbs' ELSE '$' || (p_partkey + 100) END AS t FROM part)
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'TOO_LONG' WHEN 2 THEN 'TOO_SHORT' WHEN 3 THEN 'NO_DIGIT' WHEN 4 THEN 'SENTENCE'
WHEN 5 THEN 'DATE' WHEN 6 THEN 'YEAR' WHEN 7 THEN 'MEASURE' ELSE 'MONEY' END AS reason FROM p
UNION ALL SELECT -p_partkey - 1, NULL FROM part""")
def identifier_rejections(spark, root):
    """Why texts can't be identifiers, and that model numbers can."""
    p, k = table(spark, root, "part"), _c("p_partkey")
    s = k.cast("string")
    t = (
        F.when(k % 9 == 0, " ").when(k % 9 == 1, F.lit("A1" * 30)).when(k % 9 == 2, "7-A").when(k % 9 == 3, _c("p_name")).when(k % 9 == 4,
        F.concat(F.lit("see lot "), s, F.lit(" on box")))
        .when(k % 9 == 5, F.concat(F.lit("1/2/"), (k % 9000 + 1000).cast("string"))).when(k % 9 == 6, (k % 60 + 1990).cast("string")).when(k % 9 == 7,
        F.concat(s, F.lit(" lbs"))).otherwise(F.concat(F.lit("$"), (k + 100).cast("string")))
    )
    good = p.select((-k - 1).alias("p_partkey"), identifiers.rejection(F.concat(F.lit("FL-"), (k + 100).cast("string"))).alias("reason"))
    return p.select("p_partkey", identifiers.rejection(t).alias("reason")).unionByName(good)


@query("""SELECT c_custkey, '"' || replace(CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_name ELSE c_name || ' "x"' END, '"', '""') || '"' AS cell, '""' AS nothing FROM customer""")
def report_cells(spark, root):
    """Cells of a report: every one quoted, formulas disarmed."""
    raw = F.when(_c("c_custkey") % 2 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.concat("c_name", F.lit(' "x"')))
    return table(spark, root, "customer").select("c_custkey", tabular.csv_field(raw, always=True).alias("cell"),
        tabular.csv_field(F.lit(None).cast("string"), always=True).alias("nothing"))
