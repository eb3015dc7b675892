"""Agency records structured into nested ones, one select each: enforcement reports, product recalls, consumer notices, model lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions import dates, identifiers, recalls, text

# Unit words of product quantities and the units they stand for.
UNIT_WORDS = {
    "lb": "pounds", "lbs": "pounds", "pound": "pounds", "pounds": "pounds", "kg": "kilograms", "kgs": "kilograms", "kilogram": "kilograms",
    "kilograms": "kilograms", "oz": "ounces", "ounce": "ounces", "ounces": "ounces",
    "unit": "units", "units": "units", "each": "units", "ea": "units", "piece": "units", "pieces": "units", "pcs": "units", "case": "cases",
    "cases": "cases", "cs": "cases", "box": "boxes", "boxes": "boxes",
    "carton": "cartons", "cartons": "cartons", "bottle": "bottles", "bottles": "bottles", "btls": "bottles", "vial": "vials", "vials": "vials",
    "bag": "bags", "bags": "bags", "jar": "jars", "jars": "jars",
    "can": "cans", "cans": "cans", "package": "packages", "packages": "packages", "pack": "packages", "packs": "packages", "pkgs": "packages",
    "tablet": "tablets", "tablets": "tablets", "capsule": "capsules", "capsules": "capsules",
    "kit": "kits", "kits": "kits", "device": "devices", "devices": "devices", "tray": "trays", "trays": "trays", "syringe": "syringes",
    "syringes": "syringes", "tube": "tubes", "tubes": "tubes", "pouch": "pouches", "pouches": "pouches",
    "container": "containers", "containers": "containers", "tub": "tubs", "tubs": "tubs", "gal": "gallons", "gallon": "gallons", "gallons": "gallons",
    "liter": "liters", "liters": "liters", "pallet": "pallets", "pallets": "pallets",
    "dozen": "dozen", "lot": "lots", "lots": "lots", "bar": "bars", "bars": "bars", "ampule": "ampules", "ampules": "ampules", "ampoules": "ampules",
    "bundle": "bundles", "bundles": "bundles", "set": "sets", "sets": "sets",
    "system": "systems", "systems": "systems",
}
# What stands behind a number that describes one package, not an amount of packages: sizes, and words that join.
PACKAGE_SIZES = ("ounces", "lots", "grams", "gram", "g", "gm", "mg", "mcg", "ml", "fl", "in", "cm", "mm", "count", "ct", "x", "of", "per")


def quantity(c: Column) -> Column:
    """items(value, unit), and the total and unit where there is just one item; no items for null and for text without a number.

    The first number of a text is an amount; a later one is too, unless what follows it makes it the size of a package. A unit
    is the word behind the number, up to a slash or hyphen, as ``UNIT_WORDS`` has it or as it stands; digits within a code such as
    A12 or 1.2.3 are no number."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?<![0-9a-z.,])([0-9][0-9,]*(?:\.[0-9]+)?)(?=[a-z(]|$)", "$1 "),
        r"[\s;:()]+|,(?![0-9])"), lambda w: (w != "") & (w != "total"))
    names = F.create_map(*[F.lit(x) for kv in UNIT_WORDS.items() for x in kv])

    def amounts(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            word = F.regexp_extract(F.get(ws, i + 1), r"^([a-z][a-z.]*)", 1)
            word = F.nullif(F.regexp_replace(word, r"\.+$", ""), F.lit(""))
            number = F.when(w.rlike(r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$"), F.replace(w, F.lit(","), F.lit("")).try_cast("double"))
            return F.struct(number.alias("value"), F.coalesce(F.try_element_at(names, word), word).alias("unit"))

        return F.filter(F.transform(ws, one), lambda x: x["value"].isNotNull())

    def kept(items: Column) -> Column:
        return F.filter(items, lambda x, i: (i == 0) | ~F.coalesce(x["unit"].isin(*PACKAGE_SIZES), F.lit(False)))

    whole = recalls.let(recalls.let(words, amounts), kept)
    return recalls.let(whole, lambda k: F.struct(k.alias("items"), F.when(F.size(k) == 1, F.get(k, F.lit(0))["value"]).alias("total"),
        F.when(F.size(k) == 1, F.get(k, F.lit(0))["unit"]).alias("unit")))


def usable_number(c: Column) -> Column:
    """Whether a recall number isn't a placeholder."""
    return F.coalesce(c.rlike(r"[0-9]") & ~F.lower(F.trim(c)).isin("n/a", "na", "none", "null", "tbd"), F.lit(False))


def enforcement(records: DataFrame) -> DataFrame:
    """FDA-style enforcement reports (all fields STRING, openfda STRUCT of arrays) structured; rows without a usable number left out."""
    d = lambda c: dates.compact_date(F.col(c))
    codes = F.concat_ws("\n", "product_description", "code_info", "more_code_info")
    listed = F.array_union(F.transform(F.coalesce("openfda.package_ndc", F.array().cast("array<string>")), identifiers.ndc_package),
        recalls.ndcs(codes))
    return records.where(usable_number(F.col("recall_number"))).select(
        "recall_number", "event_id", "classification", "product_type",
        F.struct(F.col("recalling_firm").alias("name"), "city", "state", "country").alias("firm"),
        F.struct(d("recall_initiation_date").alias("initiated"), d("report_date").alias("reported"),
        d("termination_date").alias("terminated")).alias("dates"), recalls.distribution(F.col("distribution_pattern")).alias("distribution"),
        quantity(F.col("product_quantity")).alias("quantity"), recalls.reason(F.col("reason_for_recall")).alias("reason"),
        F.struct(recalls.gtins(codes).alias("gtins"), F.array_sort(F.filter(listed, lambda x: x.isNotNull())).alias("ndcs"),
        recalls.after_marker(codes, "(?:lot|batch)").alias("lots"), recalls.after_marker(codes, "serial").alias("serial_numbers")).alias("codes"),
        F.sha2(F.to_json(F.struct(*records.columns)), 256).alias("raw_sha256"),
    )


def product_recalls(records: DataFrame) -> DataFrame:
    """CPSC-style product recalls with nested lists structured; rows without a number and title left out."""
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<Name:string>>")), lambda x: x["Name"])
    products = F.col("Products")
    whole = F.concat_ws("\n", "Title", "Description", F.array_join(F.coalesce(names(F.col("Hazards")), F.array().cast("array<string>")), "\n"))
    units = F.transform(products, lambda p: recalls.unit_counts(p["NumberOfUnits"]))
    known = F.filter(units, lambda u: u.isNotNull())
    return records.where(F.col("RecallNumber").isNotNull() & (F.coalesce(text.trim(F.col("Title")), F.lit("")) != "")).select(
        F.col("RecallNumber").alias("recall_number"), F.substring("RecallDate", 1, 10).alias("recalled_on"),
        text.clean_notice(F.col("Title")).alias("title"), F.transform(products, lambda p: text.clean_item(p["Name"])).alias("products"),
        F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda a, u: a + u)).alias("units"),
        recalls.classes(whole, recalls.HAZARDS).alias("hazards"),
        recalls.classes(F.array_join(names(F.col("Remedies")), "\n"), recalls.REMEDIES).alias("remedies"),
        F.array_distinct(F.filter(F.transform(products, lambda p: text.model_key(p["Model"])), lambda m: m != "")).alias("model_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("ProductUPCs", F.array().cast("array<struct<UPC:string>>")),
        lambda u: identifiers.gtin_readings(u["UPC"]))))).alias("gtins"),
        F.transform(F.coalesce("ManufacturerCountries", F.array().cast("array<struct<Country:string>>")), lambda c: c["Country"]).alias("countries"),
    )


def product_keys(structured: DataFrame) -> DataFrame:
    """(kind, value, recall_number): the inverted keys of structured product recalls, each once."""
    of = lambda kind, c: F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    k = F.concat(of("gtin", F.col("gtins")), of("model", F.col("model_keys")), of("hazard", F.col("hazards")), of("remedy", F.col("remedies")),
        of("country", F.col("countries")))
    return structured.select("recall_number", F.explode(k).alias("k")).select("k.kind", "k.value",
        "recall_number").where("value is not null").distinct()


def consumer_notices(index: DataFrame) -> DataFrame:
    """Health-Canada-style index rows of consumer products structured."""
    return index.where("Organization = 'Consumer product safety'").select(
        F.col("NID").alias("notice_id"), text.clean_notice(F.col("Title")).alias("title"), F.col("URL").alias("url"),
        F.split(F.coalesce("Category", F.lit("")), r"\s*[;>|]\s*").alias("categories"),
        recalls.classes(F.concat_ws("\n", "Title", "Issue"), recalls.HAZARDS).alias("hazards"),
        dates.normalise_date(F.substring("Last updated", 1, 10)).alias("updated_on"),
        (F.lower("Archived").isin("1", "true", "yes")).alias("archived"),
    )


MARKETS = {"united states": "US", "canada": "CA", "mexico": "MX", "japan": "JP", "taiwan": "TW", "switzerland": "CH"}  # fixed values


def certified_models(rows: DataFrame) -> DataFrame:
    """Model list rows (all STRING) structured: markets as codes and unknowns, product codes as GTIN-14 and rejects, patterns flagged."""
    markets = F.filter(F.transform(F.split(F.coalesce("markets", F.lit("")), r"\s*,\s*"), lambda m: F.trim(m)), lambda m: m != "")
    code = F.create_map(*[F.lit(x) for kv in MARKETS.items() for x in kv])
    upcs = F.filter(F.split(F.coalesce("upc", F.lit("")), r"[\s,;]+"), lambda u: u != "")
    return rows.select(
        "pd_id", text.clean_notice(F.col("brand_name")).alias("brand"), text.trim(F.col("model_number")).alias("model_number"),
        text.model_key(F.col("model_number")).alias("model_key"), F.col("model_number").rlike(r"[*?#]").alias("is_pattern"),
        F.filter(F.transform(markets, lambda m: F.element_at(code, F.lower(m))), lambda m: m.isNotNull()).alias("markets"),
        F.filter(markets, lambda m: ~F.map_contains_key(code, F.lower(m))).alias("unknown_markets"),
        F.array_sort(F.array_distinct(F.filter(F.transform(upcs, identifiers.gtin14), lambda g: g.isNotNull()))).alias("gtins"),
        F.filter(upcs, lambda u: ~identifiers.check_digit_ok(u)).alias("rejected_upcs"),
        dates.normalise_date(F.col("date_certified")).alias("certified_on"),
        dates.normalise_date(F.col("date_available_on_market")).alias("on_market"),
    )


def notice_keys(enforced: DataFrame) -> DataFrame:
    """(kind, value, recall_number): the inverted keys of structured enforcement reports, eleven kinds, each key once: gtin, ndc, ndc_product,
    lot, serial, firm, state, country, reason, allergen, pathogen. Null and empty values give no key."""
    of = lambda kind, c: F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    firm = F.array(F.upper(text.collapse(F.col("firm.name"))))
    k = F.concat(
        of("gtin", F.col("codes.gtins")), of("ndc", F.col("codes.ndcs")),
        of("ndc_product", F.transform("codes.ndcs", identifiers.product_of_package)), of("lot", F.col("codes.lots")),
        of("serial", F.col("codes.serial_numbers")), of("firm", firm),
        of("state", F.col("distribution.us_states")), of("country", F.col("distribution.countries")), of("reason", F.col("reason.classes")),
        of("allergen", F.col("reason.allergens")), of("pathogen", F.col("reason.pathogens")),
    )
    return enforced.select("recall_number", F.explode(k).alias("k")).select("k.kind", "k.value",
        "recall_number").where("value is not null and value <> ''").distinct()
