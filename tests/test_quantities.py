import pytest
from pyspark.sql import functions as F

from factlattice.operators import quantities as q

FACTS = "id string, property string, normalized_value string, unit string, feed_id string, _unit string"
CATALOG = "catalog_id bigint, feed_id string, capacity_unit string, notes string, cooling_capacity_btuh bigint, net_weight_lb int"

CASES = [
    ("cooling_capacity", "36000", "BTU/h", 36000, False), ("cooling_capacity", "36000", " btuh ", 36000, False),
    ("cooling_capacity", "36", "kBTU/h", 36000, True), ("cooling_capacity", "36", "BTU/h", 36000, True),
    ("cooling_capacity", "36", None, 36000, True), ("cooling_capacity", '"3 ton"', "BTU/h", 36000, True),
    ("cooling_capacity", '"3-1/2 tons"', None, 42000, True), ("cooling_capacity", '"7½ tons"', None, 90000, True),
    ("cooling_capacity", '"7 1/2 ton"', None, 90000, True), ("cooling_capacity", "\"12'000 BTU/h (3.52 kW)\"", None, 12000, False),
    ("cooling_capacity", '"3.517 kW (12000 BTU/h)"', None, 12000.5, True),
    ("cooling_capacity", '{"value": 2.5, "unit": "Tons"}', None, 30000, True), ("cooling_capacity", '"10\\u00a0551 W"', "BTU/h", 36001.5, True),
    ("cooling_capacity", '"approx. 7,03 kW"', None, 23987.4, True), ("cooling_capacity", "30000", "kW", 30000, False),
    ("net_weight", "200", "lb", 200, False), ("net_weight", "90718", "lb", 200, True), ("net_weight", '"448 lb 1 oz"', None, 448.0625, True),
    ("net_weight", "100", "KG", 220.46, True), ("net_weight", '"1,712 oz"', None, 107, True),
    ("refrigerant_charge", "6.5", None, 6.5, False), ("refrigerant_charge", '"5,216 g"', "lb", 11.499, True),
    ("airflow", '"1 359 m3/h"', None, 799.88, True), ("airflow", '"4,080 ft3/min"', "CFM", 4080, False),
    ("airflow", '"400 cu ft/min"', None, 400, False),
    ("line_length_max", '"110 ft 8 in"', None, 110.6667, True), ("line_length_max", '"90.0 Ft."', "ft", 90, False),
    ("max_ambient", "50", "°C", 122, True), ("max_ambient", '"118 deg F"', None, 118, False), ("supply_voltage", "230000", None, 230, True),
    ("supply_voltage", '"0,22 kV"', "V", 220, True), ("supply_voltage", '"230 VAC"', None, 230, False),
]


def frames(spark, facts, catalog=()):
    return spark.createDataFrame([(*r, None, "clash") for r in facts], FACTS), spark.createDataFrame(list(catalog), CATALOG)


def test_readings(spark):
    rows = [(str(i), p, v, u) for i, (p, v, u, _, _) in enumerate(CASES)]
    rows += [(f"n{i}", "cooling_capacity", v, None) for i, v in enumerate([None, "null", '""', '" "', '"n/a"', '"TBD"', '"Unknown "', '"--"'])]
    f, c = frames(spark, rows)
    got = {r.record_id: r for r in q.all_quantities(f, c).withColumn("foreign", q.is_foreign()).collect()}
    assert len(got) == len(CASES)
    for i, (p, v, u, want, foreign) in enumerate(CASES):
        assert got[str(i)]["_common"] == pytest.approx(want, rel=1e-4), (p, v, u)
        assert got[str(i)]["foreign"] == foreign, (p, v, u)


def test_notes_hold_for_the_whole_feed(spark):
    rows = [
        (1, "a", None, "Kälteleistung in Watt.", 10551, 200), (2, "a", None, None, 35169, None),
        (3, "b", "BTUh", "Pallets are limited to 900 kg each. Gewichte in kg.", 36000, 80), (4, "b", "BTUh", None, 36, 90),
        (5, "c", "BTU/h", "A ton-rated sling is needed for units above 400 lb.", 240000, 90718),
        (6, "d", None, "Certified ratings in kW are available on request.", 12000, 300), (7, None, "tons", None, 3, None),
        (8, "e", None, "Weights in pounds, capacities in BTU per hour.", 9000, 100),
        (9, "f", None, "capacity col = kBtuh, see cover sheet Weights in kilograms.", 36, 100),
    ]
    f, c = frames(spark, [], rows)
    hit = q.all_quantities(f, c).where(q.is_foreign()).select("record_id", "field").collect()
    got = {(int(r[0]), r[1][:3]) for r in hit}
    assert got == {(1, "coo"), (2, "coo"), (3, "net"), (4, "coo"), (4, "net"), (5, "net"), (7, "coo"), (9, "coo"), (9, "net")}


def test_mixture_learns_units_from_sizes(spark):
    rows = [(f"a{i}", "net_weight", str(100 + i), "lb") for i in range(200)] + [(f"g{i}", "net_weight", str(round((100 + i) * 453.6)),
        None) for i in range(50)] + [(f"o{i}", "net_weight", str(round((80 + i) * 16)), None) for i in range(30)]
    f, c = frames(spark, rows)
    got = q.all_quantities(f, c).where("record_id like 'g%' or record_id like 'o%'").select(F.substring("record_id", 1, 1).alias("k"), "_unit",
        "_posterior").collect()
    assert all(r["_unit"] == ("g" if r.k == "g" else "oz") and r["_posterior"] > 0.5 for r in got)


def test_each_source_has_its_own_weights(spark):
    # 10 may be tons, thousands of BTU/h or kilowatts; the other figures of its feed tell which
    rows = [(i, "tons", None, None, 1 + i % 2, None) for i in range(60)] + [(100 + i, "thousands", None, None, 100 + 2 * i, None) for i in range(60)]
    named = [(f"a{i}", "cooling_capacity", str(round(9000 * 1.016**i)), "BTU/h") for i in range(200)]
    f, c = frames(spark, named, [*rows, (900, "tons", None, None, 10, None), (901, "thousands", None, None, 10, None)])
    got = {r.record_id: (r["_unit"], r["_posterior"]) for r in q.all_quantities(f, c).where("record_id in ('0', '100', '900', '901')").collect()}
    assert got["0"][0] == "ton" and got["0"][1] > 0.99 and got["100"][0] == "kBTU/h" and got["100"][1] > 0.99
    assert got["900"][0] == "ton" and got["901"][0] == "kBTU/h"


def test_what_is_not_known_is_flagged(spark):
    named = [(f"n{i}", "net_weight", str(90 + i), "lb") for i in range(150)] + [(f"k{i}", "net_weight", str(40 + i),
        "kg") for i in range(75)] + [(f"f{i}", "airflow", str(400 + i), "CFM") for i in range(100)]
    loose = [("amb", "net_weight", "100", None), ("sure", "net_weight", "600", None), ("air", "airflow", "450", None), ("odd", "airflow", "7", None),
        ("neg", "max_ambient", "-5", None), ("alone", "line_length_max", "50", None), ("nothing", "net_weight", "0", None),
        ("no", "net_weight", '"heavy"', None)]
    f, c = frames(spark, named + loose)
    got = {r.record_id: (r["_unit"], r.u) for r in q.all_quantities(f, c).withColumn("u",
        q.uncertain()).where(F.col("record_id").isin([x[0] for x in loose])).collect()}
    assert got["sure"] == ("lb", False) and got["air"] == ("CFM", False) and got["odd"] == ("CFM", True) and got["neg"] == ("°F",
        True) and got["alone"] == ("ft", False)
    assert got["amb"][0] == "lb" and got["amb"][1] and got["nothing"] == (None, True) and got["no"] == (None, False)


def test_notes_that_speak_of_other_figures(spark):
    notes = ["Net weight of the pallet is 900 kg.", "A ton-rated output stage.", "Weights are available in kg on request.",
        "Gewichte wahlweise in kg.", "Cooling output 3 tons each."]
    f, c = frames(spark, [], [(i, f"x{i}", None, n, 36000, 200) for i, n in enumerate(notes)])
    assert q.all_quantities(f, c).where(q.is_foreign()).count() == 0


def test_empty(spark):
    f, c = frames(spark, [])
    assert q.all_quantities(f, c).where(q.is_foreign()).count() == 0
