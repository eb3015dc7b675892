import pytest
from pyspark.sql import functions as F

from factlattice.operators import normalise, structuring


def test_rules(spark):
    df = spark.createDataFrame(
        [("r1", " 24acc6-36 ", "36,000 BTU/h", "Yes", "R410A", "Jan 5, 2024", "n/a"), ("r2", "--", "3 parsec", "maybe", "??", "soon", "x"),
        ("r3", None, "10", None, "r-32", "2024-02-30", None)],
        "id string, model string, cap string, inv string, gas string, on string, note string",
    )
    rules = [
        normalise.Rule("model", "model", [("trim",), ("identifier",)]),
        normalise.Rule("capacity", "cap", [("quantity",), ("convert", "kW"), ("round", 2), ("range", 1, 100)], unit_required=True),
        normalise.Rule("inverter", "inv", [("boolean",)]),
        normalise.Rule("refrigerant", "gas", [("vocabulary", {"R-410A": ["r410a"], "R-32": ["r32"]})]), normalise.Rule("on", "on", [("date",)]),
        normalise.Rule("note", "note", [("null_token",), ("upper",)]),
    ]
    n = normalise.normalise(df, "id", rules)
    got = {(r.id, r.property): (r.number if r.number is not None else r.value, r.unit, r.failure) for r in n.collect()}
    assert got[("r1", "model")] == ("24ACC636", None, None) and got[("r1", "capacity")] == (pytest.approx(10.55), "kW",
        None) and got[("r1", "inverter")][0] == "true"
    assert got[("r1", "refrigerant")][0] == "R-410A" and got[("r1", "on")][0] == "2024-01-05" and got[("r1", "note")][2] == "EMPTY_VALUE"
    assert [got[("r2", p)][2] for p in ("model", "capacity", "inverter", "refrigerant", "on", "note")] == ["IDENTIFIER_EMPTY_AFTER_NORMALIZATION",
        "UNKNOWN_UNIT", "UNPARSEABLE_BOOLEAN", "UNMAPPED_VOCABULARY", "UNPARSEABLE_DATE", None]
    assert got[("r3", "capacity")][2] == "MISSING_UNIT" and got[("r3", "on")][2] == "UNPARSEABLE_DATE" and ("r3", "model") not in got
    p = {r.id: r for r in normalise.payload(n, "id").collect()}
    assert p["r1"].units == {"capacity": "kW"} and p["r3"].properties == {"refrigerant": "R-32"} and len(p["r2"].failures) == 5
    with pytest.raises(ValueError, match="no field"):
        normalise.normalise(df, "id", [normalise.Rule("x", "nope", [("fly",)])])


def test_enforcement(spark):
    fields = "recall_number event_id classification product_type recalling_firm city state country recall_initiation_date report_date termination_date distribution_pattern product_quantity reason_for_recall product_description code_info more_code_info".split()
    row = dict.fromkeys(fields) | {
        "recall_number": "F-0001-2026", "recalling_firm": "Acme", "recall_initiation_date": "20260105", "report_date": "bad",
        "distribution_pattern": "Nationwide and online; TX, CA", "product_quantity": "1,200 cases of 12 oz",
        "reason_for_recall": "Undeclared milk; Listeria",
        "product_description": "Soup UPC 0 36000 29145 2", "code_info": "Lot: A12, B34", "more_code_info": None,
    }
    other = dict.fromkeys(fields) | {"recall_number": "N/A"}
    df = spark.createDataFrame([tuple(r[f] for f in fields) for r in (row, other)], ", ".join(f"{f} string" for f in fields)).withColumn("openfda",
        F.from_json(F.lit('{"package_ndc":["0002-1433-80"]}'), "package_ndc array<string>, product_ndc array<string>"))
    got = structuring.enforcement(df).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.dates.initiated, r.dates.reported) == ("2026-01-05",
        None) and r.distribution.nationwide_us and r.distribution.internet_sales and r.distribution.us_states == ["CA", "TX"]
    assert (r.quantity.total, r.quantity.unit) == (1200,
        "cases") and r.reason.allergens == ["milk"] and r.reason.pathogens == ["listeria_monocytogenes"]
    assert r.codes.gtins == ["00036000291452"] and r.codes.ndcs == ["00002-1433-80"] and r.codes.lots == ["A12", "B34"]


@pytest.mark.parametrize(("text", "items"), [
    ("1,200 cases of 12 oz", [(1200, "cases")]), ("33850 units/kits", [(33850, "units")]),
    ("a) 1,200 cases; b) 300 cases", [(1200, "cases"), (300, "cases")]), ("N/A", []), (None, []), ("", []), ("5lbs", [(5, "pounds")]),
    ("lot A12 3 vials", [(3, "vials")]),
    ("10,000", [(10000, None)]), ("2 x 1.5 gal", [(2, "x"), (1.5, "gallons")]), ("403,200 tablets", [(403200, "tablets")]),
])
def test_quantities_of_products(spark, text, items):
    r = spark.createDataFrame([(text,)], "v string").select(structuring.quantity(F.col("v")).alias("q")).first().q
    assert [(x.value, x.unit) for x in r["items"]] == items and (r.total, r.unit) == (items[0] if len(items) == 1 else (None, None))


def test_product_recalls_and_keys(spark):
    schema = "RecallNumber string, RecallDate string, Title string, Description string, Products array<struct<Name:string,Model:string,NumberOfUnits:string>>, Hazards array<struct<Name:string>>, Remedies array<struct<Name:string>>, ProductUPCs array<struct<UPC:string>>, ManufacturerCountries array<struct<Country:string>>"
    rows = [("26-001", "2026-01-02T00:00:00", "Acme <b>Heaters</b>", None, [("Heater", "X-1", "About 1,000"), ("Cord", None, "about 2 thousand")],
        [("Fire hazard",)], [("Refund",)], [("036000291452",)], [("China",)]), (None, None, "x", None, None, None, None, None, None),
        ("26-002", None, "No lists", None, None, None, None, None, None)]
    s = structuring.product_recalls(spark.createDataFrame(rows, schema))
    r = {x.recall_number: x for x in s.collect()}
    assert set(r) == {"26-001",
        "26-002"} and r["26-001"].units == 3000 and r["26-001"].hazards == ["fire"] and r["26-001"].remedies == ["refund"] and r["26-001"].title == "Acme Heaters" and r["26-002"].units is None
    assert {(k.kind, k.value) for k in structuring.product_keys(s).collect()} == {("gtin", "00036000291452"), ("model", "X1"), ("hazard", "fire"),
        ("remedy", "refund"), ("country", "China")}


def test_notices_and_models(spark):
    n = spark.createDataFrame([("1", "Lamp &amp; cord", "u", "Consumer product safety", "Electrical shock", "Home > Lamps", "2026-02-03", "0"),
        ("2", "x", "u", "Food", "y", None, None, None)],
        "NID string, Title string, URL string, Organization string, Issue string, Category string, `Last updated` string, Archived string")
    r = structuring.consumer_notices(n).collect()
    assert len(r) == 1 and r[0].title == "Lamp & cord" and r[0].hazards == ["electric-shock"] and r[0].updated_on == "2026-02-03" and r[0].categories == ["Home", "Lamps"]
    m = spark.createDataFrame([("p", "Acme", " AB*1 ", "United States, Canada, Mars", "036000291452; 123", "2025-01-02", None)],
        "pd_id string, brand_name string, model_number string, markets string, upc string, date_certified string, date_available_on_market string")
    r = structuring.certified_models(m).first()
    assert r.markets == ["US",
        "CA"] and r.unknown_markets == ["Mars"] and r.gtins == ["00036000291452"] and r.rejected_upcs == ["123"] and r.is_pattern and r.certified_on == "2025-01-02"
