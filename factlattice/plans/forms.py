"""Queries for the forms of texts, identifiers, numbers and dates, over the whole tables, each with SQL written independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlattice.functions import dates, identifiers, numbers, recalls, text
from factlattice.operators import normalise
from factlattice.plans.registry import Registry
from factlattice.session import table

query = Registry()
_WIDE = "".join(chr(0xFF00 + i) for i in range(1, 95))
_NARROW = "".join(chr(0x20 + i) for i in range(1, 95)).replace("'", "''")
_FROM, _TO = "‐‑‒–—―−‘’‚‛“”„", "-------" + "''" * 4 + '"' * 3
_BLANKS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _c(name):
    return F.col(name)


@query(rf"""SELECT catalog_id, trim(regexp_replace(lower(replace(translate(translate(brand, '{_WIDE}', '{_NARROW}'), '{_FROM}', '{_TO}'), '⁄', '/')),
'{_BLANKS}+', ' ', 'g')) AS comparison_key
FROM acme_catalog WHERE brand IS NOT NULL""")
def comparison_keys(spark, root):
    """Brands in the form in which spellings are compared."""
    return table(spark, root, "acme_catalog").where("brand is not null").select("catalog_id",
        text.comparison_key(_c("brand")).alias("comparison_key"))


@query(rf"""SELECT doc_id, sha256(trim(regexp_replace(text, '{_BLANKS}+', ' ', 'g'), ' ')) AS collapsed, sha256(regexp_replace(text,
'^{_BLANKS}+|{_BLANKS}+$', '', 'g')) AS trimmed,
sha256(replace(translate(text, '{_FROM}⁄', '{_TO}/'), '…', '...')) AS folded FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text,
'[\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{00a0}}\x{{0085}}]')
UNION ALL SELECT doc_id, sha256(trim(regexp_replace(text, '{_BLANKS}+', ' ', 'g'), ' ')), sha256(regexp_replace(text, '^{_BLANKS}+|{_BLANKS}+$', '',
'g')), 'special blanks' FROM documents
WHERE text IS NOT NULL AND regexp_matches(text, '[\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{00a0}}\x{{0085}}]')""")
def text_cleanups(spark, root):
    """Digests of each text trimmed, with single blanks, and with plain punctuation (not where it has special blanks)."""
    d, t = table(spark, root, "documents").where("text is not null"), _c("text")
    special = t.rlike(r"[\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{00a0}\x{0085}]")
    return d.select("doc_id", F.sha2(text.collapse(t), 256).alias("collapsed"), F.sha2(text.trim(t), 256).alias("trimmed"),
        F.when(special, "special blanks").otherwise(F.sha2(text.fold_punctuation(t), 256)).alias("folded"))


@query(r"""SELECT doc_id, length(text) - length(regexp_replace(text, '[\x{00ad}\x{200b}\x{feff}]', '', 'g')) AS debris, length(text) -
length(regexp_replace(text, '[\x{00ad}\x{200b}\x{feff}\x{200c}-\x{200f}\x{2060}\x{2066}-\x{2069}]', '', 'g')) AS format_signs
FROM documents WHERE text IS NOT NULL""")
def invisible_signs(spark, root):
    """How many invisible characters each text has: debris only, and all that formatting may put in."""
    d, t = table(spark, root, "documents").where("text is not null"), _c("text")
    n = lambda c: (F.length(t) - F.length(c)).cast("bigint")
    return d.select("doc_id", n(text.strip_debris(t)).alias("debris"), n(text.strip_format(t)).alias("format_signs"))


@query("""SELECT p_partkey, p_name || ' & A B &nope; ½ <' AS decoded, replace(p_name, ' ', '&amp;') || '&lt;b&gt; &quot;x&quot; &#39;y&#39;' AS escaped, p_name || ' & co' AS cleaned FROM part""")
def markup(spark, root):
    """Entities decoded, signs escaped, and tags dropped, in names put into markup."""
    n = _c("p_name")
    raw = F.concat(n, F.lit(" &amp; &#65; &#x42; &nope; &frac12; &lt;"))
    plain = F.concat(F.replace(n, F.lit(" "), F.lit("&")), F.lit("<b> \"x\" 'y'"))
    notice = F.concat(F.lit("<p class='x'>"), n, F.lit("&nbsp;&amp;<br/>  co</p>"))
    return table(spark, root, "part").select("p_partkey", text.decode_entities(raw).alias("decoded"), text.escape_html(plain).alias("escaped"),
        text.clean_notice(notice).alias("cleaned"))


@query("""SELECT c_custkey, array_to_string(list_transform(string_split(lower(c_mktsegment) || ' of ' || c_name, ' '), lambda w: upper(substr(w, 1,
1)) || lower(substr(w, 2))), ' ') AS titled, regexp_replace(c_name, '0+', '#') AS first_replaced,
regexp_replace(c_name, '([0-9])', '<\\1>', 'g') AS every_replaced, replace(replace(c_name, '#', ''), '0', '') AS stripped FROM customer""")
def rewritten_names(spark, root):
    """Names in title case, with the first and with every match of a pattern replaced, and without some characters."""
    n = _c("c_name")
    return table(spark, root, "customer").select(
        "c_custkey", text.title_case(F.concat(F.lower("c_mktsegment"), F.lit(" of "), n)).alias("titled"),
        text.replace_pattern(n, "0+", "#").alias("first_replaced"), text.replace_pattern(n, "([0-9])", "<$1>", every=True).alias("every_replaced"),
        text.strip_characters(n, "#0").alias("stripped"),
    )


@query(f"""SELECT catalog_id, regexp_replace(upper(strip_accents(replace(replace(translate(model, '{_WIDE}', '{_NARROW}'), 'ø', ''), 'Ø', ''))), '[^A-Z0-9]', '', 'g') AS model_key, upper(regexp_replace(model, '[\\s\\x{{00a0}}\\x{{3000}}]+', '', 'g')) AS lot_key FROM acme_catalog WHERE model IS NOT NULL""")
def model_keys(spark, root):
    """Model numbers as lookup keys without accents, and as lot keys without blanks only."""
    return table(spark, root, "acme_catalog").where("model is not null").select("catalog_id", text.model_key(_c("model")).alias("model_key"),
        identifiers.lot_key(_c("model")).alias("lot_key"))


_DIGITS = "lpad(CAST(l_partkey * 7919 + l_suppkey * 104729 + l_orderkey * 13 AS VARCHAR), 12, '3')"
_W14 = " + ".join(f"{1 if i % 2 else 3} * CAST(substr(lpad({{0}}, 14, '0'), {i + 1}, 1) AS INT)" for i in range(13))
_VALID = "(10 - (" + _W14 + ") % 10) % 10 = CAST(substr(lpad({0}, 14, '0'), 14, 1) AS INT)"
_UPCE = "(substr(e, 1, 1) || CASE WHEN substr(e, 7, 1) IN ('0', '1', '2') THEN substr(e, 2, 2) || substr(e, 7, 1) || '0000' || substr(e, 4, 3) WHEN substr(e, 7, 1) = '3' THEN substr(e, 2, 3) || '00000' || substr(e, 5, 2) WHEN substr(e, 7, 1) = '4' THEN substr(e, 2, 4) || '00000' || substr(e, 6, 1) ELSE substr(e, 2, 5) || '0000' || substr(e, 7, 1) END || substr(e, 8, 1))"


@query(f"""WITH d AS (SELECT DISTINCT l_partkey, l_suppkey, {_DIGITS} AS code, CAST(l_partkey % 2 AS VARCHAR) || lpad(CAST((l_suppkey * 7919 +
l_partkey) % 10000000 AS VARCHAR), 7, '0') AS e FROM lineitem), x AS (SELECT *, {_UPCE} AS a FROM d)
SELECT DISTINCT code, e AS upce, a AS expanded, CASE WHEN {_VALID.format("code")} THEN lpad(code, 14, '0') END AS gtin, {_VALID.format("code")} AS
upc_ok,
array_to_string(list_sort(list_distinct(list_filter([CASE WHEN {_VALID.format("e")} THEN lpad(e, 14, '0') END, CASE WHEN {_VALID.format("a")} THEN
lpad(a, 14, '0') END], lambda v: v IS NOT NULL))), ',') AS readings FROM x WHERE len(code) = 12""")
def trade_codes(spark, root):
    """Codes of 12 digits checked and padded, codes of 8 digits expanded, and everything that these may mean."""
    li = table(spark, root, "lineitem")
    code = F.lpad((_c("l_partkey") * 7919 + _c("l_suppkey") * 104729 + _c("l_orderkey") * 13).cast("string"), 12, "3")
    e = F.concat((_c("l_partkey") % 2).cast("string"), F.lpad(((_c("l_suppkey") * 7919 + _c("l_partkey")) % 10000000).cast("string"), 7, "0"))
    d = li.select(code.alias("code"), e.alias("upce")).where(F.length("code") == 12).distinct()
    return d.select("code", "upce", identifiers.expand_upce(_c("upce")).alias("expanded"), identifiers.gtin14(_c("code")).alias("gtin"),
        identifiers.upc_mod10(_c("code")).alias("upc_ok"), F.array_join(identifiers.gtin_readings(_c("upce")), ",").alias("readings"))


@query("""WITH d AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem), x AS (SELECT p, s, n, CASE WHEN p % 3 = 0 THEN
lpad(CAST(p % 10000 AS VARCHAR), 4, '0') ELSE lpad(CAST(p % 100000 AS VARCHAR), 5, '0') END AS a,
CASE WHEN s % 4 = 0 THEN lpad(CAST(s % 1000 AS VARCHAR), 3, '0') ELSE lpad(CAST(s % 10000 AS VARCHAR), 4, '0') END AS b, CASE WHEN n = 1 THEN '7' ELSE
'0' || n END AS c FROM d),
y AS (SELECT DISTINCT a, b, c, CASE WHEN CAST(len(a) AS VARCHAR) || len(b) || len(c) IN ('442', '532', '541', '542') THEN lpad(a, 5, '0') || '-' ||
lpad(b, 4, '0') || '-' || lpad(c, 2, '0') END AS package,
CASE WHEN CAST(len(a) AS VARCHAR) || len(b) IN ('44', '53', '54') THEN lpad(a, 5, '0') || '-' || lpad(b, 4, '0') END AS product FROM x)
SELECT a || '-' || b || '-' || c AS code, package, product, substr(package, 1, 10) AS of_package, coalesce(package, product) AS typed FROM y""")
def drug_codes(spark, root):
    """Package and product codes in one layout, the product of a package, and what a typed code means."""
    p, s, n = _c("l_partkey"), _c("l_suppkey"), _c("l_linenumber")
    pad = lambda c, m, w: F.lpad((c % m).cast("string"), w, "0")
    d = table(spark, root, "lineitem").select(
        F.when(p % 3 == 0, pad(p, 10000, 4)).otherwise(pad(p, 100000, 5)).alias("a"),
        F.when(s % 4 == 0, pad(s, 1000, 3)).otherwise(pad(s, 10000, 4)).alias("b"),
        F.when(n == 1, "7").otherwise(F.concat(F.lit("0"), n.cast("string"))).alias("c")
    ).distinct()
    code, product = F.concat_ws("-", "a", "b", "c"), F.concat_ws("-", "a", "b")
    package = identifiers.ndc_package(code)
    return d.select(code.alias("code"), package.alias("package"), identifiers.ndc_product(product).alias("product"),
        identifiers.product_of_package(package).alias("of_package"),
        F.coalesce(identifiers.ndc_input(code), identifiers.ndc_input(product)).alias("typed"))


@query(f"""SELECT entity_id, kind, value, CASE WHEN x = '' THEN NULL ELSE x END AS normalised FROM (SELECT entity_id, kind, value, CASE kind WHEN
'upc' THEN CASE WHEN len(d) BETWEEN 1 AND 11 THEN lpad(d, 12, '0') ELSE d END
WHEN 'ahri_ref' THEN CASE WHEN regexp_full_match(d, '0+') THEN '0' ELSE ltrim(d, '0') END ELSE upper(regexp_replace(w, '[^0-9A-Za-z]', '', 'g')) END
AS x FROM (SELECT DISTINCT entity_id, a.alias_type AS kind, a.alias_value AS value, translate(a.alias_value, '{_WIDE}', '{_NARROW}') AS w,
regexp_replace(translate(a.alias_value, '{_WIDE}', '{_NARROW}'), '[^0-9]', '', 'g') AS d FROM (SELECT entity_id, unnest(aliases) AS a FROM entities) e
WHERE a.alias_value IS NOT NULL AND a.alias_type IS NOT NULL) y) z""")
def alias_forms(spark, root):
    """Aliases normalised by the profile of their kind."""
    a = table(spark, root, "entities").select("entity_id", F.explode("aliases").alias("a")).select("entity_id", _c("a.alias_type").alias("kind"),
        _c("a.alias_value").alias("value")).where("kind is not null and value is not null").distinct()
    return a.select("entity_id", "kind", "value", identifiers.for_alias(_c("kind"), _c("value")).alias("normalised"))


@query(rf"""SELECT canonical_slug, array_to_string(list_distinct(list_filter([n, lower(n), upper(n)], lambda x: x <> '')), '|') IS NOT NULL AS some,
regexp_replace(lower(n), '[^a-z0-9]+', '', 'g') AS bare_lower, regexp_replace(upper(n), '[^A-Z0-9]+', '', 'g') AS bare_upper,
trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (SELECT canonical_slug, regexp_replace(canonical_name,
'^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS n FROM entities WHERE canonical_name IS NOT NULL) x""")
def identifier_candidates(spark, root):
    """The spellings under which a typed name may be stored."""
    e = table(spark, root, "entities").where("canonical_name is not null").select("canonical_slug",
        identifiers.candidates(_c("canonical_name")).alias("c"), text.trim(_c("canonical_name")).alias("n"))
    held = lambda x: F.when(F.array_contains("c", x) | (x == ""), x)
    return e.select("canonical_slug", (F.size("c") > 0).alias("some"), held(F.regexp_replace(F.lower("n"), "[^a-z0-9]+", "")).alias("bare_lower"),
        held(F.regexp_replace(F.upper("n"), "[^A-Z0-9]+", "")).alias("bare_upper"), held(text.slugify(_c("n"))).alias("slug"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE round(l_extendedprice, 2) END AS value FROM lineitem""")
def decimal_forms(spark, root):
    """Prices read back from text with grouped thousands; a wrong grouping is no number."""
    shown = F.format_number("l_extendedprice", 2)
    odd = F.when(_c("l_linenumber") % 3 == 0, F.concat(F.lit("1,23"), F.lit(".5"))).otherwise(shown)
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.parse_decimal(odd).alias("value"))


@query("""SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN TRUE WHEN o_orderstatus = 'O' THEN FALSE END AS flag, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def boolean_words(spark, root):
    """Words for yes and no, with odd spacing and case; others are neither."""
    word = F.when(_c("o_orderstatus") == "F", " Equipped ").when(_c("o_orderstatus") == "O", "NOT  included").otherwise("maybe")
    return table(spark, root, "orders").groupBy("o_orderstatus", "o_orderpriority",
        numbers.parse_boolean(word).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+01:30' ELSE '-05:00' END AS stamp,
strftime(ts, '%Y-%m-%d') AS compact, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS loose,
strftime(ts + INTERVAL 45 DAY, '%Y-%m-%d') AS later, date_diff('day', CAST(ts AS DATE), DATE '2025-01-01') AS stale_days, CAST(NULL AS VARCHAR) AS
no_offset FROM events""")
def date_readings(spark, root):
    """Times with an offset, compact and loose dates, days added and days since, read back from written forms."""
    ts, i = _c("ts"), _c("event_id")
    base = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")
    stamp = F.concat(base, F.when(i % 3 == 0, "z").when(i % 3 == 1, "+0130").otherwise("-05:00"))
    loose = F.when(i % 4 == 0, F.date_format(ts, "MM/yyyy")).when(i % 4 == 2, F.date_format(ts, "MMMM yyyy")).when(i % 4 == 1,
        F.date_format(ts, "dd-MMM-yy")).otherwise(F.date_format(ts, "M/d/yyyy."))
    return table(spark, root, "events").select(
        "event_id", dates.normalise_datetime(stamp).alias("stamp"), dates.compact_date(F.date_format(ts, "yyyyMMdd")).alias("compact"),
        dates.loose_date(loose).alias("loose"), dates.add_days(ts, 45).alias("later"),
        dates.days_between(ts, F.lit("2025-01-01").cast("timestamp_ntz")).alias("stale_days"), dates.normalise_datetime(base).alias("no_offset"),
    )


@query("""SELECT CAST(catalog_id AS BIGINT) AS catalog_id, 'capacity' AS property, CASE WHEN cooling_capacity_btuh < 1000 OR cooling_capacity_btuh >
300000 THEN 'OUT_OF_RANGE' END AS failure, floor(cooling_capacity_btuh * 0.29307107017222 / 3516.85284206664 * 100 + 0.5) / 100 AS number, 'ton' AS
unit FROM acme_catalog WHERE cooling_capacity_btuh IS NOT NULL
UNION ALL SELECT catalog_id, 'weight', CASE WHEN net_weight_lb % 2 = 1 THEN 'UNKNOWN_UNIT' END, CASE WHEN net_weight_lb % 2 = 1 THEN net_weight_lb
ELSE floor(net_weight_lb * 0.45359237 * 10 + 0.5) / 10 END, CASE WHEN net_weight_lb % 2 = 1 THEN 'stone' ELSE 'kg' END FROM acme_catalog WHERE
net_weight_lb IS NOT NULL""")
def rule_quantities(spark, root):
    """Rules of normalisation over written quantities: parsed, converted, rounded, and refused with a reason."""
    written = table(spark, root, "acme_catalog").select("catalog_id",
        F.concat(F.format_number("cooling_capacity_btuh", 0), F.lit(" btu/h")).alias("cap"),
        F.concat(_c("net_weight_lb").cast("string"), F.when(_c("net_weight_lb") % 2 == 1, " stone").otherwise(" LB")).alias("wt"))
    rules = [normalise.Rule("capacity", "cap", [("quantity",), ("convert", "ton"), ("round", 2), ("range", 1000 / 12000 - 0.004, 25.0)],
        unit_required=True), normalise.Rule("weight", "wt", [("quantity",), ("convert", "kg"), ("round", 1)], unit_required=True)]
    return normalise.normalise(written, "catalog_id", rules).select("catalog_id", "property", "failure", "number", "unit")


@query("""SELECT id, CASE WHEN v IN ('r-410a', 'r410a') THEN 'R-410A' WHEN v IN ('r-454b', 'r454b') THEN 'R-454B' WHEN v IN ('r-32', 'r32') THEN 'R-32' WHEN v IN ('r-22', 'r22') THEN 'R-22' END AS term FROM (SELECT DISTINCT id, lower(trim(replace(normalized_value, '"', ''))) AS v FROM facts WHERE property = 'refrigerant' AND normalized_value IS NOT NULL) x""")
def vocabulary_terms(spark, root):
    """Refrigerants by their canonical term, aliases folded; null for unmapped ones."""
    f = table(spark, root, "facts").where("property = 'refrigerant' and normalized_value is not null").select("id",
        F.replace("normalized_value", F.lit('"'), F.lit("")).alias("v")).distinct()
    rule = normalise.Rule("term", "v", [("vocabulary", {"R-410A": ["r410a"], "R-454B": ["r454b"], "R-32": ["r32"], "R-22": ["r22"]})])
    n = normalise.normalise(f, "id", [rule])
    return n.select("id", F.when(_c("failure").isNull(), _c("value")).alias("term"))


@query("""SELECT o_orderkey, 'Supplier ' || o_custkey AS firm, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 1000 ELSE o_custkey END AS units_us, CASE
WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS units_canada, CASE WHEN o_orderkey % 5 = 0 THEN 'FL,NY' ELSE 'TX' END AS states,
o_orderkey % 7 = 0 AS nationwide, CASE WHEN o_orderkey % 11 = 0 THEN 'CA' ELSE '' END AS countries, 'A' || (o_orderkey + 100) || ',B-' || o_custkey AS
lots, 'FL-' || (o_orderkey + 600) AS models FROM orders WHERE o_custkey > 0""")
def notice_facts(spark, root):
    """Firm, units by country, geography, lots and models read out of written notices."""
    o, c = _c("o_orderkey"), _c("o_custkey")
    s = lambda x: x.cast("string")
    title = F.when(o % 2 == 0, F.concat(F.lit("Supplier "), s(c),
        F.lit(" Recalls Heaters Due to Fire Hazard"))).otherwise(F.concat(F.lit("Heaters recalled by Supplier "), s(c),
        F.lit(" due to fire; sold online")))
    units = F.concat(F.lit("About "), s(c), F.when(o % 2 == 0, " thousand").otherwise(""),
        F.when(o % 3 == 0, F.concat(F.lit(" (in addition, "), s(o), F.lit(" were sold in Canada)"))).otherwise(""))
    where = F.concat(F.when(o % 5 == 0, "Sold in Florida and NY").otherwise("Sold in TX"),
        F.when(o % 7 == 0, "; nationwide").when(o % 7 == 1, "; not distributed nationwide").otherwise(""),
        F.when(o % 11 == 0, "; Canada").otherwise(""))
    codes = F.concat(F.lit("Lot #: A"), s(o + 100), F.lit(", B-"), s(c), F.lit(". Model number FL-"), s(o + 600), F.lit(", sold from 2020"))
    d = table(spark, root, "orders").where("o_custkey > 0").select("o_orderkey", title.alias("t"), recalls.country_units(units).alias("u"),
        recalls.distribution(where).alias("d"), codes.alias("c"))
    return d.select(
        "o_orderkey", recalls.title_firm(_c("t")).alias("firm"), _c("u.us").alias("units_us"), _c("u.canada").alias("units_canada"),
        F.array_join("d.us_states", ",").alias("states"), _c("d.nationwide_us").alias("nationwide"),
        F.array_join("d.countries", ",").alias("countries"),
        F.array_join(recalls.after_marker(_c("c"), "(?:lot|batch)"), ",").alias("lots"),
        F.array_join(recalls.model_numbers(_c("c")), ",").alias("models"),
    )
