import pytest
from pyspark.sql import functions as F

from factlattice.functions import dates, ids, identifiers, numbers, recalls, text, values


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("f", "value", "want"), [
    (text.comparison_key, " N/A&shy;  –  Ｘ ", "n/a - x"), (text.title_case, "ab\tcd  eF", "Ab\tCd  Ef"),
    (text.decode_entities, "a&amp;b &#65; &#x42; &nope; &frac12;", "a&b A B &nope; ½"), (text.collapse, "  a\xa0 b　c﻿", "a b c"),
    (text.fold_punctuation, "‘a’ “b” – …", "'a' \"b\" - ..."), (text.strip_debris, "a\xadb​c‍", "abc‍"), (text.strip_format, "a‍b", "ab"),
    (text.slugify, " Élan 24-ANB/7 ", "lan-24-anb-7"), (text.model_key, "éX-24 b", "EX24B"),
    (text.escape_html, "<a href='x'>\"&", "&lt;a href=&#39;x&#39;&gt;&quot;&amp;"),
    (lambda c: text.replace_pattern(c, "[0-9]+", "#"), "a12b34", "a#b34"), (lambda c: text.replace_pattern(c, "[0-9]+", "#", True), "a12b34", "a#b#"),
    (text.clean_notice, "<p>a&nbsp;b</p>", "a b"),
    (ids.canonical_uuid, " {1B4E28BA-2FA1-11D2-883F-0016D3CCA427} ", "1b4e28ba-2fa1-11d2-883f-0016d3cca427"),
    (ids.canonical_uuid, "urn:uuid:1B4E28BA2FA111D2883F0016D3CCA427", "1b4e28ba-2fa1-11d2-883f-0016d3cca427"), (ids.canonical_uuid, "  ", None),
    (ids.canonical_uuid, " Ab ", "ab"), (ids.canonical_uuid, None, None),
    (identifiers.expand_upce, "04252614", "042100005264"), (identifiers.expand_upce, "94252614", None),
    (identifiers.ndc_package, "0002-1433-80", "00002-1433-80"), (identifiers.ndc_package, "50090-347-01", "50090-0347-01"),
    (identifiers.ndc_package, "1-2-3", None), (identifiers.ndc_input, "50090034701", "50090-0347-01"),
    (lambda c: identifiers.normalise(c, keep="digits", strip_zeros=True), "00-00", "0"),
    (lambda c: identifiers.normalise(c, keep="digits", pad_to=5), "1234567", "1234567"),
    (lambda c: identifiers.normalise(c, keep="digits", pad_to=5), "a12", "00012"),
    (lambda c: identifiers.alias_chain(c, [("strip_prefix", "M-"), ("uppercase",), ("strip_characters", "-"), ("left_pad", 6)]), "M-a-1", "0000A1"),
    (dates.normalise_date, "March 3, 2024", "2024-03-03"), (dates.normalise_date, "31/12/2024", "2024-12-31"),
    (dates.normalise_date, "2023-02-29", None), (dates.normalise_date, "20240229", "2024-02-29"),
    (dates.normalise_datetime, "2024-01-02 03:04+0130", "2024-01-02T03:04:00+01:30"), (dates.normalise_datetime, "2024-01-02", None),
    (dates.normalise_datetime, "2024-01-02T24:00:00Z", None), (dates.compact_date, "20249999", "2024-99-99"),
    (dates.loose_date, "12/2025", "2025-12"), (dates.loose_date, "03-Jan-26", "2026-01-03"), (dates.loose_date, "Sept 2025", "2025-09"),
    (dates.loose_date, "05JAN2026", "2026-01-05"), (dates.loose_date, "1/2/3/4", None), (dates.loose_date, "2025", None),
    (dates.loose_date, None, None), (dates.loose_date, "Sept, 2025", "2025-09"), (dates.loose_date, "1/2/2024.", "2024-01-02"),
    (dates.loose_date, "2/30/2024", None),
])
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("f", "value", "want"), [
    (dates.ambiguous, "03/04/2024", True), (dates.ambiguous, "03/03/2024", False), (identifiers.check_digit_ok, "036000291452", True),
    (identifiers.check_digit_ok, "036000291453", False), (identifiers.check_digit_ok, "12", False), (identifiers.check_digit_ok, None, False),
    (values.is_meaningful, '"n/a"', False), (values.is_meaningful, None, False), (values.is_meaningful, "null", False),
    (values.is_meaningful, '"  "', False), (values.is_meaningful, "0", True), (text.is_null_token, " N/A ", True),
    (numbers.parse_boolean, "Equipped", True), (numbers.parse_boolean, "maybe", None),
    (numbers.parse_decimal, "1,234.5", 1234.5), (numbers.parse_decimal, "1,23", None),
    (identifiers.candidates, " 24-ANB ", ["24-ANB", "24-anb", "24anb", "24ANB"]),
    (identifiers.digit_codes, "0 36000 29145 2, 12345678 and x", ["036000291452", "12345678"]), (text.trigrams, "ab", ["  a", " ab", "ab "]),
    (identifiers.gtin_readings, "04252614", ["00042100005264"]), (recalls.unit_counts, "About 1.2 million (plus 5)", 1200000),
    (recalls.states, "Sold in West Virginia, TX and OR, CA. Not IN stores", ["CA", "OR", "TX", "WV"]),
    (recalls.gtins, "UPC 0 36000 29145 2", ["00036000291452"]),
    (lambda c: recalls.after_marker(c, "(?:lot|batch)"), "Lot #: A123, B-456 and C7/8. Exp", ["A123", "B-456", "C7/8"]),
    (lambda c: recalls.reason(c)["allergens"], "contains milk", []), (recalls.states, "IN OR AROUND", []),
    (recalls.states, "AZ  CA  IN  MA", ["AZ", "CA", "IN", "MA"]), (recalls.states, "to IN, FL", ["FL", "IN"]), (recalls.states, None, []),
    (lambda c: recalls.distribution(c)["nationwide_us"], "Not distributed nationwide", False),
    (lambda c: recalls.distribution(c)["countries"], "New Mexico, Canada and the United Kingdom", ["CA", "GB"]),
    (lambda c: recalls.distribution(c)["international"], "no foreign distribution", False),
    (lambda c: recalls.distribution(c)["us_military"], "VA hospitals", True),
    (lambda c: recalls.country_units(c)["canada"], "About 5,000 (In addition, about 700 were sold in Canada)", 700),
    (recalls.model_numbers, "Model numbers FL-600, FL-650 and SL-650, sold from 2020; Model 167B rated 1875 watts",
    ["167B", "FL-600", "FL-650", "SL-650"]), (recalls.model_numbers, "model year 2021 cars", []), (recalls.model_numbers, None, []),
    (recalls.title_firm, "Acme Recalls Heaters", "Acme"), (recalls.title_firm, "Heaters Recalled by Bolt Co. Due to Fire", "Bolt Co."),
    (lambda c: recalls.trades(c, F.lit("shock hazard")), "Acme Recalls Ceiling Fans", ["electrical"]),
    (lambda c: recalls.trades(c, F.lit("")), "Hair Dryers recalled", []),
    (lambda c: recalls.reason(c)["classes"], "elevated levels of lead", ["CHEMICAL_CONTAMINATION"]),
    (lambda c: recalls.reason(c)["classes"], None, []), (lambda c: recalls.reason(c)["allergens"], "undeclared milk and eggs", ["milk", "egg"]),
])
def test_other(spark, f, value, want):
    assert one(spark, value, f) == want


def test_rounding_and_statistics(spark):
    r = spark.createDataFrame([(-2.5, 3, 1, 0)], "x double, tp int, fp int, fn int")
    p, rec, f1 = numbers.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    low, high = numbers.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    got = r.select(numbers.js_round(F.col("x")), p, rec, f1, low, high, numbers.convert(F.lit(50.0), F.lit("°C"), "°F"),
        numbers.convert(F.lit(1.0), F.lit("kg"), "°F")).first()
    assert got[0] == -2 and got[1:4] == (0.75, 1.0,
        pytest.approx(6 / 7)) and got[4] < 0.75 < got[5] and got[6] == pytest.approx(122) and got[7] is None
    assert r.where("x > 0").select(*numbers.prf(F.col("tp"), F.col("fp"), F.col("fn"))).count() == 0
