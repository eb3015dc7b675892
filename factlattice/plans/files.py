"""Queries for sources and agency records: files are written to the shared folder from the tables, then read by the sources."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from factlattice.operators import structuring
from factlattice.plans.registry import Registry
from factlattice.session import scratch, table
from factlattice.sources import documents, tabular

query = Registry()


def _c(name):
    return F.col(name)


def _s(c):
    return _c(c).cast("string")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name || ', \"x\"' AS s_name FROM supplier WHERE s_nationkey IN (3, 5, 7)")
def csv_scan(spark, root):
    """A CSV file with quoted cells, read with a filter on a column and a projection by name."""
    path = scratch(spark, "csv")
    table(spark, root, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "x"')).alias("s_name"), "s_nationkey").write.csv(path, header=True,
        quote='"', escape='"')
    return tabular.read_csv(spark, path, where=("s_nationkey", ["3", "5", "7"]), columns=["s_suppkey", "s_name"],
        line_breaks=False).select("s_suppkey", "s_name")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS ordinal, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def csv_preamble(spark, root):
    """A CSV file behind lines of remarks; rows are numbered in file order."""
    path = scratch(spark, "preamble")
    n = table(spark, root, "nation").select((_c("n_nationkey") + 10).alias("k"), F.concat_ws(",", _s("n_nationkey"), "n_name").alias("value"))
    head = spark.createDataFrame([(0, "# exported"), (1, "# nations"), (2, "key,name")], "k int, value string")
    head.union(n).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)  # remarks stand at the head of one file
    return tabular.read_csv(spark, path, preamble="^#").select("ordinal", "key", "name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def json_records(spark, root):
    """Records of a whole JSON file by a JSON pointer."""
    path = scratch(spark, "json")
    items = table(spark, root, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct(_c("n_nationkey").alias("id"),
        _c("n_name").alias("name"))))).alias("a"))  # 25 fixed rows
    items.select(F.concat(F.lit('{"data":{"a/b":'), "a", F.lit("}}"))).write.text(path)
    return tabular.read_json_records(spark, path, "/data/a~1b", "struct<id:bigint,name:string>").select("record.*")


@query("""SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts, CAST(min_by(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS VARCHAR) AS first, CASE WHEN count(*) = 1 THEN CAST(min(l_partkey) AS VARCHAR) END AS single FROM lineitem GROUP BY 1""")
def json_paths(spark, root):
    """Every value at a path with a wildcard, and one of them by policy."""
    g = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey",
        "l_suppkey"))).alias("lines"))  # an order has a few lines
    j = g.select("l_orderkey", F.to_json(F.struct(F.struct("lines").alias("o"))).alias("j"))
    v = tabular.json_values(_c("j"), ["o", "lines", "*", "l_partkey"])
    return j.select("l_orderkey", tabular.pick(v, "join", ";").alias("parts"), tabular.pick(v, "first").alias("first"),
        tabular.pick(v, "single").alias("single"))


@query("""SELECT p_partkey, p_name || ' & co' AS name, CAST(p_size AS VARCHAR) AS size, p_type AS type, 'u/' || p_partkey AS href FROM part""")
def html_fields(spark, root):
    """Fields of HTML records: text and attribute by selector, a table's cell by its label, a definition by its term."""
    page = F.concat(
        F.lit("<html><body><div class='item'><h2><a href='u/"), _s("p_partkey"), F.lit("'>"), _c("p_name"),
        F.lit(" &amp; co</a></h2><table><tr><th>Size:</th><td>"), _s("p_size"), F.lit("</td></tr></table><dl><dt>Type</dt><dd>"), _c("p_type"),
        F.lit("</dd></dl></div></body></html>")
    )
    pages = table(spark, root, "part").select(_c("p_partkey").alias("page_id"), page.alias("html"))
    fields = {"name": ("css", "h2 a", None), "href": ("css", "h2 a", "href"), "size": ("table", "Size", "exact"), "type": ("dl", "Type", "exact")}
    r = documents.html_records(pages, "div.item", fields)
    return r.select(_c("page_id").alias("p_partkey"), *[F.element_at(_c("values")[n], 1).alias(n) for n in ("name", "size", "type", "href")])


@query("""SELECT catalog_id, CAST(cooling_capacity_btuh AS VARCHAR) AS capacity, CAST(net_weight_lb AS VARCHAR) || ' lb' AS weight FROM acme_catalog WHERE cooling_capacity_btuh IS NOT NULL AND net_weight_lb IS NOT NULL""")
def label_values(spark, root):
    """Values behind labels in lines of text, the labels written in several ways."""
    c = table(spark, root, "acme_catalog").where("cooling_capacity_btuh is not null and net_weight_lb is not null")
    t = c.select("catalog_id", F.concat(F.lit("Spec sheet\nCapacity: "), _s("cooling_capacity_btuh"), F.lit("\r\n Weight = "), _s("net_weight_lb"),
        F.lit(" lb\nno label here")).alias("text"))
    lines = documents.label_lines(t).where("label is not null")
    return lines.groupBy("catalog_id").agg(F.max(F.when(_c("label") == "Capacity", _c("value"))).alias("capacity"),
        F.max(F.when(_c("label") == "Weight", _c("value"))).alias("weight"))


@query(r"""SELECT doc_id, count(*) AS pressures, CAST(max(CAST(p AS BIGINT)) AS BIGINT) AS highest FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+) psig', 1)) AS p FROM documents WHERE text IS NOT NULL) x GROUP BY 1""")
def line_values(spark, root):
    """Every match of a pattern in every line of every document."""
    lines = documents.label_lines(table(spark, root, "documents").where("text is not null").select("doc_id", "text"))
    return documents.line_matches(lines, "([0-9]+) psig").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pressures"),
        F.max(_c("matched").cast("bigint")).alias("highest"))


@query("""SELECT CAST(floor(s_suppkey / 100) AS BIGINT) || '.zip' AS path, s_suppkey || '.txt' AS member, s_name AS content FROM supplier""")
def archive_members(spark, root):
    """Members of archives that fit a name pattern, safe and whole; each archive is made from a hundred suppliers."""

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("readme.md", "x")
            for k, n in zip(f["s_suppkey"], f["s_name"], strict=True):
                z.writestr(f"{k}.txt", n)
        return pd.DataFrame({"path": [f"{f['bucket'].iloc[0]}.zip"], "content": [out.getvalue()]})

    files = table(spark, root, "supplier").select(F.floor(_c("s_suppkey") / 100).alias("bucket"), "s_suppkey",
        "s_name").groupBy("bucket").applyInPandas(pack, "path string, content binary")
    m = documents.zip_members(files, "*.txt")
    return m.where("issue is null").select("path", "member", _c("bytes").cast("string").alias("content"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY') THEN 'NOT_ALLOWED' WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 3 THEN 'ROBOTS' WHEN c_custkey % 2 = 0 THEN 'UNCHANGED' ELSE 'PLANNED' END AS reason FROM customer""")
def target_plan(spark, root):
    """Which pages of a site map are to be read, or why not."""
    loc = F.concat(F.lit("https://x.org/"), "c_mktsegment", F.lit("/"), _s("c_nationkey"), F.lit("/"), _s("c_custkey"))
    urls = table(spark, root, "customer").select("c_custkey", loc.alias("loc"),
        F.when(_c("c_custkey") % 2 == 0, "2024-01-01").otherwise("2025-06-01").alias("lastmod"))
    return documents.plan_targets(urls, ["https://x.org/HOUSEHOLD/", "https://x.org/MACHINERY/"], ["https://x.org/MACHINERY/3/"],
        "2025-01-01").select("c_custkey", "reason")


@query("""SELECT c_custkey, c_mktsegment = 'AUTOMOBILE' OR c_name LIKE '%7' AS blocked FROM customer""")
def robots_patterns(spark, root):
    """Paths against patterns with wildcards and an end mark."""
    path = F.concat(F.lit("/s/"), "c_mktsegment", F.lit("/"), "c_name")
    hit = F.lit(False)
    for p in ("/s/AUTO*/", "/*7$"):
        hit = hit | path.rlike(documents.robots_pattern(p))
    return table(spark, root, "customer").select("c_custkey", hit.alias("blocked"))


_FDA = "recall_number event_id classification product_type recalling_firm city state country recall_initiation_date report_date termination_date distribution_pattern product_quantity reason_for_recall product_description code_info more_code_info".split()


def _reports(spark, root):
    """Orders written as enforcement reports."""
    o, k, cust = table(spark, root, "orders"), _c("o_orderkey"), _c("o_custkey")
    cells = {
        "recall_number": F.when(k % 20 == 0, "N/A").otherwise(F.concat(F.lit("F-"), _s("o_orderkey"))),
        "recalling_firm": F.concat(F.lit("Firm  "), (cust % 50).cast("string")), "recall_initiation_date": F.date_format("o_orderdate", "yyyyMMdd"),
        "distribution_pattern": F.when(k % 3 == 0, "Nationwide").when(k % 3 == 1,
        "Distributed to TX, CA and OH").otherwise("Sold in Florida and Canada"),
        "product_quantity": F.concat(F.format_number(cust * 10, 0), F.lit(" cases of 12 oz jars")),
        "reason_for_recall": F.when(k % 4 == 0, "Undeclared milk and eggs").when(k % 4 == 1, "Potential Salmonella contamination").when(k % 4 == 2,
        "Lack of sterility assurance").otherwise("Software error"), "code_info": F.concat(F.lit("Lot: L"), (k + 100).cast("string")),
    }
    r = o.select(*[cells.get(c, F.lit(None).cast("string")).alias(c) for c in _FDA])
    return r.withColumn("openfda", F.from_json(F.lit("{}"), "package_ndc array<string>, product_ndc array<string>"))


_FDA_SQL = """r AS (SELECT 'F-' || o_orderkey AS recall_number, o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 20 <> 0)"""


@query(f"""WITH {_FDA_SQL} SELECT recall_number, strftime(o_orderdate, '%Y-%m-%d') AS initiated, CAST(o_custkey * 10 AS DOUBLE) AS quantity, 'cases'
AS unit, o_orderkey % 3 = 0 AS nationwide, CASE o_orderkey % 3 WHEN 1 THEN 'CA,OH,TX' WHEN 2 THEN 'FL' ELSE '' END AS states,
CASE o_orderkey % 4 WHEN 0 THEN 'UNDECLARED_ALLERGEN' WHEN 1 THEN 'MICROBIAL_CONTAMINATION' WHEN 2 THEN 'STERILITY' ELSE 'SOFTWARE' END AS classes,
CASE WHEN o_orderkey % 4 = 0 THEN 'milk,egg' ELSE '' END AS allergens, 'L' || (o_orderkey + 100) AS lots FROM r""")
def enforcement_reports(spark, root):
    """Enforcement reports structured: dates, quantity, distribution, reason, codes."""
    e = structuring.enforcement(_reports(spark, root))
    j = lambda c: F.array_join(c, ",")
    return e.select(
        "recall_number", _c("dates.initiated").alias("initiated"), _c("quantity.total").alias("quantity"), _c("quantity.unit").alias("unit"),
        _c("distribution.nationwide_us").alias("nationwide"), j("distribution.us_states").alias("states"),
        j("reason.classes").alias("classes"), j("reason.allergens").alias("allergens"), j("codes.lots").alias("lots"),
    )


@query(f"""WITH {_FDA_SQL}, k AS (SELECT 'lot' AS kind, 'L' || (o_orderkey + 100) AS value, recall_number FROM r UNION SELECT 'firm', 'FIRM ' ||
o_custkey % 50, recall_number FROM r UNION SELECT 'state', unnest(CASE o_orderkey % 3 WHEN 1 THEN ['CA', 'OH', 'TX'] WHEN 2 THEN ['FL'] ELSE [] END),
recall_number FROM r
UNION SELECT 'country', 'CA', recall_number FROM r WHERE o_orderkey % 3 = 2 UNION SELECT 'reason', CASE o_orderkey % 4 WHEN 0 THEN
'UNDECLARED_ALLERGEN' WHEN 1 THEN 'MICROBIAL_CONTAMINATION' WHEN 2 THEN 'STERILITY' ELSE 'SOFTWARE' END, recall_number FROM r
UNION SELECT 'allergen', unnest(['milk', 'egg']), recall_number FROM r WHERE o_orderkey % 4 = 0 UNION SELECT 'pathogen', 'salmonella', recall_number
FROM r WHERE o_orderkey % 4 = 1) SELECT kind, value, count(*) AS notices FROM k GROUP BY 1, 2""")
def enforcement_keys(spark, root):
    """The inverted keys of enforcement reports, counted."""
    return structuring.notice_keys(structuring.enforcement(_reports(spark, root))).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("notices"))


_PRODUCT = "RecallNumber string, RecallDate string, Title string, Description string, Products array<struct<Name:string,Model:string,NumberOfUnits:string>>, Hazards array<struct<Name:string>>, Remedies array<struct<Name:string>>, ProductUPCs array<struct<UPC:string>>, ManufacturerCountries array<struct<Country:string>>"


def _products(spark, root):
    """Orders with their lines written as product recalls."""
    g = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("Part "), _s("l_partkey")).alias("Name"),
        F.concat(F.lit("m-"), _s("l_partkey")).alias("Model"), F.concat(F.lit("About "),
        _c("l_quantity").cast("int").cast("string")).alias("NumberOfUnits"))).alias("Products"))
    k = _c("l_orderkey")
    none = lambda t: F.lit(None).cast(t)
    one = lambda v, n: F.array(F.struct(v.alias(n)))
    return g.select(
        F.concat(F.lit("R"), _s("l_orderkey")).alias("RecallNumber"), F.lit("2026-01-02T00:00:00").alias("RecallDate"),
        F.concat(F.lit("Acme <b>Lamps</b> "), _s("l_orderkey")).alias("Title"), none("string").alias("Description"), "Products",
        one(F.when(k % 2 == 0, "Fire hazard").otherwise("The lamp can overheat and shock the user"), "Name").alias("Hazards"),
        one(F.when(k % 3 == 0, "Refund").otherwise("Replace; stop using"), "Name").alias("Remedies"),
        none("array<struct<UPC:string>>").alias("ProductUPCs"), one(F.lit("China"), "Country").alias("ManufacturerCountries"),
    )


@query("""SELECT 'R' || l_orderkey AS recall_number, 'Acme Lamps ' || l_orderkey AS title, '2026-01-02' AS recalled_on, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS units, CASE WHEN l_orderkey % 2 = 0 THEN 'fire' ELSE 'burn,electric-shock' END AS hazards, CASE WHEN l_orderkey % 3 = 0 THEN 'refund' ELSE 'replace,stop-use' END AS remedies, count(DISTINCT l_partkey) AS models FROM lineitem GROUP BY l_orderkey""")
def product_recalls(spark, root):
    """Product recalls structured: units, hazards, remedies, models."""
    p = structuring.product_recalls(_products(spark, root))
    return p.select("recall_number", "title", "recalled_on", "units", F.array_join("hazards", ",").alias("hazards"),
        F.array_join("remedies", ",").alias("remedies"), F.size("model_keys").cast("bigint").alias("models"))


@query("""WITH k AS (SELECT 'model' AS kind, 'M' || l_partkey AS value, l_orderkey FROM lineitem UNION SELECT 'country', 'China', l_orderkey FROM
lineitem UNION SELECT 'hazard', unnest(CASE WHEN l_orderkey % 2 = 0 THEN ['fire'] ELSE ['burn', 'electric-shock'] END), l_orderkey FROM lineitem
UNION SELECT 'remedy', unnest(CASE WHEN l_orderkey % 3 = 0 THEN ['refund'] ELSE ['replace', 'stop-use'] END), l_orderkey FROM lineitem) SELECT kind,
value, count(*) AS notices FROM k GROUP BY 1, 2""")
def product_recall_keys(spark, root):
    """The inverted keys of product recalls, counted."""
    return structuring.product_keys(structuring.product_recalls(_products(spark, root))).groupBy("kind",
        "value").agg(F.count(F.lit(1)).alias("notices"))


@query("""SELECT s_suppkey AS pd_id, upper(regexp_replace(s_name, '[^0-9A-Za-z]', '', 'g')) AS model_key, s_suppkey % 5 = 0 AS is_pattern, CASE WHEN s_suppkey % 2 = 0 THEN 'US,CA' ELSE 'JP' END AS markets, CASE WHEN s_suppkey % 3 = 0 THEN 'Mars' ELSE '' END AS unknown_markets, '00036000291452' AS gtins, '123' AS rejected, '2025-01-02' AS certified_on FROM supplier""")
def certified_models(spark, root):
    """Rows of a list of certified models structured: markets, codes, patterns, dates."""
    k = _c("s_suppkey")
    rows = table(spark, root, "supplier").select(
        k.alias("pd_id"), F.lit("Acme").alias("brand_name"), F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.when(k % 5 == 0,
        "*").otherwise("")).alias("model_number"), F.concat(F.when(k % 2 == 0, "United States, Canada").otherwise("japan"), F.when(k % 3 == 0,
        ", Mars").otherwise("")).alias("markets"),
        F.lit("036000291452; 123").alias("upc"), F.lit("01/02/2025").alias("date_certified"),
        F.lit(None).cast("string").alias("date_available_on_market"),
    )
    m = structuring.certified_models(rows)
    j = lambda c: F.array_join(c, ",")
    return m.select("pd_id", "model_key", "is_pattern", j("markets").alias("markets"), j("unknown_markets").alias("unknown_markets"),
        j("gtins").alias("gtins"), j("rejected_upcs").alias("rejected"), "certified_on")


@query("""SELECT o_orderkey AS notice_id, 'Lamp & cord ' || o_orderkey AS title, 'electric-shock' AS hazards, 'Home|' || o_orderpriority AS categories, strftime(o_orderdate, '%Y-%m-%d') AS updated_on, o_orderstatus = 'F' AS archived FROM orders WHERE o_orderstatus <> 'P'""")
def consumer_notices(spark, root):
    """Index rows of consumer products structured; other organisations left out."""
    o = table(spark, root, "orders")
    rows = o.select(
        _c("o_orderkey").alias("NID"), F.concat(F.lit("<i>Lamp</i> &amp; cord "), _s("o_orderkey")).alias("Title"), F.lit("u").alias("URL"),
        F.when(_c("o_orderstatus") == "P", "Food").otherwise("Consumer product safety").alias("Organization"),
        F.lit("Electrical shock").alias("Issue"),
        F.concat(F.lit("Home > "), "o_orderpriority").alias("Category"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("Last updated"),
        F.when(_c("o_orderstatus") == "F", "1").otherwise("0").alias("Archived"),
    )
    n = structuring.consumer_notices(rows)
    return n.select("notice_id", "title", F.array_join("hazards", ",").alias("hazards"), F.array_join("categories", "|").alias("categories"),
        "updated_on", "archived")
