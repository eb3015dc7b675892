"""Queries for text, identifier, number, date, source and sink functions over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlattice.functions import dates, identifiers, numbers, recalls, text, vocabulary
from factlattice.operators import resolve
from factlattice.plans.registry import Registry
from factlattice.session import spread, table
from factlattice.sources import documents as sources
from factlattice.sources import tabular

query = Registry()
_SPACES = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@query(rf"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '{_SPACES}+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents WHERE text IS NOT NULL")
def word_counts(spark, root):
    """Words of each document, by any white space."""
    return table(spark, root, "documents").where("text is not null").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("SELECT entity_id, trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM entities")
def slugs(spark, root):
    """Slugs of names."""
    return table(spark, root, "entities").select("entity_id", text.slugify(F.col("canonical_name")).alias("slug"))


@query("""SELECT property, count(*) AS n, count(*) FILTER (WHERE lower(trim(replace(normalized_value, '"', ''))) IN ('', '-', '--', '---', 'n/a',
'n.a.', 'na', 'none', 'null', 'nil', 'unknown', 'unspecified', 'tbd', 'not applicable', 'not available')) AS null_tokens
FROM facts WHERE normalized_value IS NOT NULL GROUP BY 1""")
def null_tokens(spark, root):
    """How often a value is a word for no value."""
    v = F.replace("normalized_value", F.lit('"'), F.lit(""))
    return table(spark, root, "facts").where("normalized_value is not null").groupBy("property").agg(F.count(F.lit(1)).alias("n"),
        F.count_if(text.is_null_token(v)).alias("null_tokens"))


@query(r"SELECT doc_id FROM documents WHERE list_has_all(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ['model', 'units', 'consumers'])")
def token_search(spark, root):
    """Documents that have every word of a query."""
    return table(spark, root, "documents").where(text.contains_all(F.col("text"), ["model", "units", "consumers"])).select("doc_id")


_GRAMS = r"""(SELECT DISTINCT b AS name, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT b, w, unnest(generate_series(1, len(w) + 1)) AS i FROM (SELECT b, unnest(list_filter(string_split_regex(lower(b), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM %s) y) z)"""


@query(rf"""WITH brands AS (SELECT DISTINCT brand AS b FROM acme_catalog WHERE brand IS NOT NULL), q AS (SELECT 'Corvanth Air Works' AS b), gb AS
{_GRAMS % "brands"}, gq AS {_GRAMS % "q"},
c AS (SELECT name, count(*) AS total, count(*) FILTER (WHERE g IN (SELECT g FROM gq)) AS shared FROM gb GROUP BY 1)
SELECT name AS brand, round(shared / CAST(total + (SELECT count(*) FROM gq) - shared AS DOUBLE), 6) AS similarity FROM c WHERE shared / CAST(total +
(SELECT count(*) FROM gq) - shared AS DOUBLE) >= 0.2""")
def similar_brands(spark, root):
    """Brands that share enough trigrams with a name."""
    b = table(spark, root, "acme_catalog").where("brand is not null").select("brand").distinct()
    return b.withColumn("s", text.trigram_similarity(F.col("brand"), F.lit("Corvanth Air Works"))).where("s >= 0.2").select("brand",
        F.round("s", 6).alias("similarity"))


@query("SELECT entity_id, canonical_name FROM entities WHERE lower(canonical_name) LIKE '%air works%'")
def substring_search(spark, root):
    """Names that contain a text, letter case aside; no wildcard to escape."""
    return table(spark, root, "entities").where(text.contains_folded(F.col("canonical_name"), F.lit("Air WORKS"))).select("entity_id",
        "canonical_name")


_WIDE = "".join(chr(0xFF00 + i) for i in range(1, 95))  # full-width forms of the printable ASCII signs
_NARROW = "".join(chr(0x20 + i) for i in range(1, 95)).replace("'", "''")


@query(rf"""SELECT catalog_id, upper(regexp_replace(m, '[^0-9A-Za-z]', '', 'g')) AS model_number, CASE WHEN d = '' OR len(d) >= 12 THEN d ELSE lpad(d,
12, '0') END AS digits
FROM (SELECT catalog_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT catalog_id, translate(model, '{_WIDE}', '{_NARROW}') AS m FROM
acme_catalog) x) y""")
def identifier_forms(spark, root):
    """Model numbers of all rows, in any spelling, in the forms under which identifiers meet."""
    c, m = table(spark, root, "acme_catalog"), F.col("model")
    return c.select("catalog_id", identifiers.normalise(m).alias("model_number"), identifiers.normalise(m, keep="digits", pad_to=12).alias("digits"))


_WEIGHTED = " + ".join(f"{1 if i % 2 else 3} * CAST(substr(u, {i + 1}, 1) AS INT)" for i in range(13))


@query(f"""SELECT entity_id, code, CASE WHEN u IS NULL THEN FALSE ELSE (10 - ({_WEIGHTED}) % 10) % 10 = CAST(substr(u, 14, 1) AS INT) END AS valid
FROM (SELECT entity_id, code, CASE WHEN regexp_full_match(code, '[0-9]{{8,14}}') THEN lpad(code, 14, '0') END AS u FROM (SELECT entity_id,
a.alias_value AS code FROM (SELECT entity_id, unnest(aliases) AS a FROM entities) x WHERE a.alias_type = 'upc' AND a.alias_value IS NOT NULL) y) z""")
def check_digits(spark, root):
    """Whether each product code, of 8 to 14 digits, carries a right check digit; anything else doesn't."""
    a = table(spark, root, "entities").select("entity_id", F.explode("aliases").alias("a")).where("a.alias_type = 'upc'").select("entity_id",
        F.col("a.alias_value").alias("code"))
    return a.where("code is not null").select("entity_id", "code", identifiers.check_digit_ok(F.col("code")).alias("valid"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(-(l_extendedprice * l_discount) * 10 + 0.5) / 10 AS rounded FROM lineitem""")
def half_up_rounding(spark, root):
    """Rounding half up towards plus infinity."""
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.js_round(-(F.col("l_extendedprice") * F.col("l_discount")), 1).alias("rounded"))


_SPELLED = "lower(regexp_replace(unit, '[ .]', '', 'g'))"


@query(f"""WITH u AS (SELECT DISTINCT id, property, {_SPELLED} AS u, TRY_CAST(normalized_value AS DOUBLE) AS v FROM facts WHERE
TRY_CAST(normalized_value AS DOUBLE) IS NOT NULL AND unit IS NOT NULL)
SELECT id, property, round(CASE WHEN u IN ('kg', 'kgs') THEN v WHEN u = 'g' THEN v * 0.001 WHEN u IN ('oz', 'ounces') THEN v * 0.028349523125 WHEN u
IN ('lb', 'lbs', 'pounds') THEN v * 0.45359237
WHEN u IN ('btu/h', 'btuh') THEN v * 0.29307107017222 WHEN u IN ('kbtu/h', 'kbtuh', 'mbh') THEN v * 293.07107017222 WHEN u IN ('ton', 'tons') THEN v *
3516.85284206664 WHEN u IN ('w', 'watt', 'watts') THEN v WHEN u IN ('kw', 'kilowatts') THEN v * 1000
WHEN u IN ('ft', 'feet', 'foot') THEN v * 0.3048 WHEN u IN ('in', 'inches') THEN v * 0.0254 WHEN u = 'cm' THEN v * 0.01 WHEN u = 'mm' THEN v * 0.001
WHEN u IN ('m', 'metres', 'meters') THEN v
WHEN u = 'cfm' THEN v * 0.00047194745 / 0.001 WHEN u = 'l/s' THEN v WHEN u IN ('m3/h', 'm³/h') THEN v / 3600 / 0.001 WHEN u IN ('v', 'volt', 'volts')
THEN v WHEN u IN ('kv', 'kilovolts') THEN v * 1000 WHEN u IN ('mv', 'millivolts') THEN v * 0.001
WHEN u IN ('°f', 'degf', 'fahrenheit') THEN (v - 32) * 5 / 9 WHEN u IN ('°c', 'degc', 'celsius') THEN v END, 3) AS base_value FROM u""")
def unit_conversion(spark, root):
    """Every number with a unit, in the base unit of its dimension (kg, W, m, L/s, V, °C); null for units that aren't listed."""
    names = {"kgs": "kg", "ounces": "oz", "lbs": "lb", "pounds": "lb", "btuh": "BTU/h", "kbtuh": "kBTU/h", "mbh": "kBTU/h", "tons": "ton",
        "watt": "W", "watts": "W", "kilowatts": "kW", "feet": "ft", "foot": "ft", "inches": "in", "metres": "m", "meters": "m"}
    names |= {"m³/h": "m3/h", "volt": "V", "volts": "V", "kilovolts": "kV", "millivolts": "mV", "degf": "°F", "fahrenheit": "°F", "degc": "°C",
        "celsius": "°C"} | {u.lower(): u for u in numbers.UNITS if u != "K"}
    spelled = F.lower(F.regexp_replace("unit", "[ .]", ""))
    f = table(spark, root, "facts").select("id", "property", spelled.alias("s"),
        F.col("normalized_value").try_cast("double").alias("v")).where("v is not null and s is not null").distinct()
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("s"))
    base = F.lit(None).cast("double")
    for target in ("kg", "W", "m", "L/s", "V", "°C"):
        base = F.coalesce(base, numbers.convert(F.col("v"), F.col("u"), target))
    return f.withColumn("u", unit).select("id", "property", F.round(base, 3).alias("base_value"))


@query("""SELECT catalog_id, CASE WHEN TRY_CAST(lifecycle.discontinued_on AS DATE) IS NOT NULL THEN strftime(CAST(lifecycle.discontinued_on AS DATE),
'%Y-%m-%d') END AS iso, strftime(CAST(lifecycle.discontinued_on AS DATE), '%Y-%m-%d') AS from_us,
strftime(CAST(lifecycle.discontinued_on AS DATE), '%Y-%m-%d') AS from_words FROM acme_catalog WHERE lifecycle.discontinued_on IS NOT NULL""")
def date_forms(spark, root):
    """Dates read back from three spellings."""
    c = table(spark, root, "acme_catalog").select("catalog_id", F.col("lifecycle.discontinued_on").alias("d")).where("d is not null")
    us = F.date_format(F.to_date("d"), "MM/dd/yyyy")
    words = F.date_format(F.to_date("d"), "MMMM d, yyyy")
    return c.select("catalog_id", dates.normalise_date(F.col("d")).alias("iso"), dates.normalise_date(us).alias("from_us"),
        dates.normalise_date(words).alias("from_words"))


# What speaks of each class, written for the comparison only: patterns over words with single blanks.
_SPEAKS = """
HAZARD|fire|fires?|flames?|flammab[^ ]*|ignit[^ ]*|combust[^ ]*
HAZARD|burn|burns?|scald[^ ]*|overheat[^ ]*
HAZARD|electric-shock|shocks?|electrocut[^ ]*|electrical hazard[^ ]*
HAZARD|carbon-monoxide|carbon monoxide|co poisoning
HAZARD|explosion|explo[^ ]*|burst[^ ]*|ruptur[^ ]*
HAZARD|laceration|lacerat[^ ]*|cuts?|sharp (edge|point)[^ ]*|punctur[^ ]*
HAZARD|fall|falls?|falling
HAZARD|tip-over|tip over[^ ]*|tipover[^ ]*|tipping
HAZARD|entrapment|entrap[^ ]*|pinch[^ ]*|crush[^ ]*
HAZARD|strangulation|strang(l|ul)[^ ]*|entangle[^ ]*
HAZARD|suffocation|suffocat[^ ]*|asphyxia[^ ]*
HAZARD|choking|chok[^ ]*
HAZARD|ingestion|ingest[^ ]*|swallow[^ ]*|button batter[^ ]*|magnet[^ ]*
HAZARD|drowning|drown[^ ]*
HAZARD|chemical|chemical[^ ]*|poison[^ ]*|toxic[^ ]*|methanol|benzene|formaldehyde|phthalate[^ ]*|cadmium|mercury|asbestos|child resistant
HAZARD|lead|lead (paint|content|poisoning|exposure|ban)|lead (level|hazard)[^ ]*|contain(s|ing)? lead|of lead|excessive lead
HAZARD|microbial|microb[^ ]*|bacteri[^ ]*|mou?ld[^ ]*|fung[^ ]*|legionella|pseudomonas|burkholderia
HAZARD|crash|crash[^ ]*|loss of control|lose control
HAZARD|impact-injury|head injur[^ ]*|impact[^ ]*|struck by|blunt
HAZARD|injury|(physical|injury) hazard[^ ]*|risk of (serious )?injur[^ ]*
HAZARD|non-compliance|violat[^ ]*|fails? to (meet|comply)|mandatory (safety )?standard[^ ]*|labell?ing|non ?complian[^ ]*
REMEDY|refund|refund[^ ]*|reimburse[^ ]*|money back
REMEDY|repair|repair[^ ]*|retrofit[^ ]*|(fix|modification|free) kit[^ ]*|free part[^ ]*
REMEDY|replace|replac[^ ]*
REMEDY|new-instructions|(new|revised|updated|new safety) instructions|warning (label|sticker)[^ ]*
REMEDY|dispose|dispos[^ ]*|destroy[^ ]*|discard[^ ]*|throw (it|them) away
REMEDY|label|new labels?|replacement label[^ ]*
REMEDY|inspect|inspect[^ ]*
REMEDY|firmware-update|firmware|software update[^ ]*|update the (product|app)
REMEDY|stop-use|stop using|immediately stop|discontinue use
REMEDY|no-remedy|no remedy
PATHOGEN|listeria_monocytogenes|listeria|listeriosis|l monocytogenes
PATHOGEN|salmonella|salmonell(a|osis)
PATHOGEN|e_coli|e ?coli|escherichia[^ ]*|stec|o157[^ ]*
PATHOGEN|clostridium_botulinum|clostridium|(c )?botulinum|botulism
PATHOGEN|mold|mou?ld(s|y)?|fung(us|al|i)|aspergillus
PATHOGEN|yeast|yeasts?
PATHOGEN|staphylococcus|staphylococc[^ ]*|s aureus|staph
PATHOGEN|pseudomonas|pseudomonas
PATHOGEN|burkholderia|burkholderia[^ ]*|b cepacia
PATHOGEN|bacillus_cereus|(bacillus|b) cereus
PATHOGEN|cronobacter|cronobacter[^ ]*
PATHOGEN|hepatitis_a|hepatitis a
PATHOGEN|norovirus|norovirus[^ ]*
PATHOGEN|cyclospora|cyclospora[^ ]*
""".strip().splitlines()
_ARMS = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{n}' AS class, count(*) AS docs FROM w WHERE regexp_matches(t, ' ({p}) ')" for k, n,
    p in (x.split("|", 2) for x in _SPEAKS))


@query(rf"WITH w AS (SELECT ' ' || ltrim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL) SELECT * FROM ({_ARMS}) x WHERE docs > 0")
def notice_classes(spark, root):
    """Hazards, remedies and pathogens that texts speak of in English, whatever their language is given as."""
    d = table(spark, root, "documents").where("text is not null")
    named = lambda kind: lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("class"))
    kinds = {"HAZARD": recalls.HAZARDS, "REMEDY": recalls.REMEDIES, "PATHOGEN": recalls.PATHOGENS}
    hit = d.select(vocabulary.hits(vocabulary.padded(F.col("text")), kinds).alias("h"))
    return hit.select(F.explode(F.concat(*[F.transform(vocabulary.pick(F.col("h"), k, v), named(k)) for k,
        v in kinds.items()])).alias("c")).groupBy("c.kind", "c.class").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, coalesce(n_chars, 0) >= 120 AND length(text) >= 20 AS indexable FROM documents WHERE text IS NOT NULL")
def indexable(spark, root):
    """Texts long enough to be indexed."""
    return table(spark, root, "documents").where("text is not null").select("doc_id",
        ((F.coalesce("n_chars", F.lit(0)) >= 120) & (F.length("text") >= 20)).alias("indexable"))


@query("SELECT catalog_id, regexp_replace(regexp_replace(lower(image_url), '^https?://(www\\.)?|[?#].*$', '', 'g'), '/+$', '') AS url_key FROM acme_catalog WHERE image_url IS NOT NULL")
def url_keys(spark, root):
    """Keys under which pages meet."""
    return table(spark, root, "acme_catalog").where("image_url is not null").select("catalog_id",
        sources.url_key(F.col("image_url")).alias("url_key"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, root):
    """A field of JSON text."""
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_digests(spark, root):
    """SHA-256 of each text."""
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, CAST(coalesce(sum(strlen(coalesce(text, '')) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", strlen(coalesce(text, '')) AS length FROM documents")
def bundle_offsets(spark, root):
    """Where each text lies in the file that holds them all, one a line: running byte offsets without a single-task window."""
    return tabular.bundle_refs(table(spark, root, "documents").select("doc_id", "text"), "doc_id", F.col("text"), ["doc_id"])


@query("""SELECT s_suppkey || ',' || CASE WHEN regexp_matches(s_name, '[",\\r\\n]') THEN '"' || replace(s_name, '"', '""') || '"' ELSE s_name END || ',' || s_nationkey AS line FROM supplier""")
def csv_export(spark, root):
    """Suppliers as exact CSV lines."""
    return tabular.csv_lines(table(spark, root, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def jsonl_export(spark, root):
    """Nations as JSON lines."""
    return tabular.jsonl_lines(table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT o_orderkey, 'orders;' || 'row=' || o_orderkey || ';column=' || o_orderpriority AS locator FROM orders")
def locators(spark, root):
    """Locators of values."""
    return table(spark, root, "orders").select("o_orderkey", F.concat(F.lit("orders;"), tabular.locator(row=F.col("o_orderkey"),
        column=F.col("o_orderpriority"))).alias("locator"))


_TRIM = lambda c: f"regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


@query(f"""SELECT catalog_id, CASE WHEN {_TRIM("brand")} <> '' AND {_TRIM("model")} <> '' AND {_TRIM("series")} <> ''
THEN {_TRIM("brand")} || '|' || {_TRIM("model")} || '|' || {_TRIM("series")} ELSE 'catalog#' || catalog_id END AS record_key FROM acme_catalog""")
def record_keys(spark, root):
    """Composite keys of all rows, in any spelling, all or nothing."""
    return table(spark, root, "acme_catalog").select("catalog_id", tabular.composite_key([F.col("brand"), F.col("model"), F.col("series")], "|",
        F.concat(F.lit("catalog#"), F.col("catalog_id"))).alias("record_key"))


@query()
def notice_records(spark, root):
    """Every document's structured record: reasons, hazards, remedies, geography, codes."""
    d = spread(table(spark, root, "documents").select("doc_id", "text"))
    return recalls.structured(d).select("doc_id", "r.*")


@query()
def entity_search(spark, root):
    """Entities for a query, exact names first, then all words, then similar names."""
    return resolve.search(table(spark, root, "entities"), "corvanth air works")
