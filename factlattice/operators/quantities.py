"""Quantities recorded in different units, brought to one common unit each.

Three sources of the unit, in this order: a unit inside the value, the unit column (or a statement that holds for a whole
feed), and, where none is named or the named one can't be true, the size. For the last, the values of a quantity are a mixture
on the log scale: one density of true values, shifted by the known conversion factor of each unit. The density is taken from
the values whose unit is named; the weights of the units are fitted by expectation maximisation over the values without one, first
for all sources together, then for each source (a feed) by its own values on top of ``SOURCE_PRIOR`` values' worth of the common
weights. Each such value has a posterior for its unit, and is uncertain where that is below ``SURE`` or can't be told.

The common fit is tiny: counts of log-values in bins of fixed width, a few hundred numbers whatever the number of rows. What
depends on the source stays distributed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.functions.values import is_meaningful, json_scalar, squeezed
from factlattice.session import cut, rows_of

BIN = 0.02  # decades
KERNEL = 0.1  # decades, smoothing of the density of true values
SURE = 0.9
EM_ROUNDS = 25
SOURCE_PRIOR = 20.0


@dataclass(frozen=True)
class Quantity:
    """A measured property: its common unit, the other units as (factor, offset) to it, and the range of true values if known."""

    name: str
    common: str
    units: dict[str, tuple[float, float]]
    low: float | None = None
    high: float | None = None


_MASS = {"lb": (1.0, 0.0), "kg": (2.2046226218487757, 0.0), "g": (0.0022046226218487757, 0.0), "oz": (0.0625, 0.0)}
# Conversion factors to the common unit, and ranges of true values.
QUANTITIES = {
    q.name: q
    for q in (
        Quantity("cooling_capacity", "BTU/h", {"BTU/h": (1.0, 0.0), "kBTU/h": (1000.0, 0.0), "ton": (12000.0, 0.0), "W": (3.412141633, 0.0),
        "kW": (3412.141633, 0.0)}, 8000, 250000),
        Quantity("net_weight", "lb", _MASS, 50, 1100),
        Quantity("refrigerant_charge", "lb", _MASS),
        Quantity("airflow", "CFM", {"CFM": (1.0, 0.0), "L/s": (2.118880003, 0.0), "m3/h": (0.5885777786, 0.0)}),
        Quantity("line_length_max", "ft", {"ft": (1.0, 0.0), "in": (1 / 12, 0.0), "m": (3.280839895, 0.0), "cm": (0.03280839895, 0.0),
        "mm": (0.003280839895, 0.0)}),
        Quantity("max_ambient", "°F", {"°F": (1.0, 0.0), "°C": (1.8, 32.0), "K": (1.8, -459.67)}),
        Quantity("supply_voltage", "V", {"V": (1.0, 0.0), "kV": (1000.0, 0.0), "mV": (0.001, 0.0)}, 200, 480),
    )
}

# Spellings of units, lower case without blanks, dots and case; the same spelling never means two units of one quantity.
SPELLINGS = {
    "BTU/h": "btu/h btuh btu/hr btuhr btuperhour btus/h btu btu/hour btus/hr btusperhour",
    "kBTU/h": "kbtu/h kbtuh kbtu/hr mbh mbtuh mbtu/h kbtu kbtuperhour thousandbtuperhour thousandbtu/h",
    "ton": "ton tons tr nominaltons nominalton tonsofrefrigeration rt refrigerationtons tonref tonnage",
    "W": "w watt watts vatios",
    "kW": "kw kilowatt kilowatts",
    "lb": "lb lbs lbm pound pounds lb(m) #",
    "kg": "kg kgs kilogram kilograms kilogramme kilogrammes kilo kilos",
    "g": "g gr gram grams gramme grammes",
    "oz": "oz ounce ounces ozs",
    "CFM": "cfm cuft/min ft3/min ft³/min cubicfeetperminute scfm cuft/m ft^3/min",
    "L/s": "l/s lps l/sec liter/s litres/s liters/s litrespersecond literspersecond",
    "m3/h": "m3/h m³/h cmh m3/hr m³/hr m^3/h cubicmetresperhour cubicmetersperhour",
    "ft": "ft foot feet ' ′ lf",
    "in": 'in inch inches " ″',
    "m": "m metre metres meter meters mtr",
    "cm": "cm centimetre centimetres centimeter centimeters",
    "mm": "mm millimetre millimetres millimeter millimeters",
    "°F": "°f ºf degf f fahrenheit degreesf degreesfahrenheit degfahrenheit ℉",
    "°C": "°c ºc degc c celsius centigrade degreesc degreescelsius degcelsius ℃",
    "K": "k kelvin",
    "V": "v volt volts vac vdc",
    "kV": "kv kilovolt kilovolts",
    "mV": "mv millivolt millivolts",
}

# Vulgar fractions in one sign.
_FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}


def unit_key(text: Column) -> Column:
    """A unit's spelling without blanks, dots and case."""
    return F.regexp_replace(F.lower(text), r"(?U)[\s.  ​]+", "")


def spellings(spark: SparkSession) -> DataFrame:
    """(quantity, spelling, unit): a fixed table of a few hundred rows."""
    rows = [(q.name, s, u) for q in QUANTITIES.values() for u in q.units for s in dict.fromkeys(SPELLINGS[u].split(" "))]
    return spark.createDataFrame(rows, "quantity string, spelling string, unit string")


_NUM = r"(?:\d{1,3}(?:[,'’\s  ]\d{3})+(?![\d])(?:\.\d+)?|\d+(?:[.,]\d+)?)"
_GROUPED = r"^[^\d]*?(?!0,)\d{1,3}(?:[,'’  \s]\d{3})+(?!\d)(?:\.\d+)?(?![.,]?\d)"


def number(text: Column) -> Column:
    """The leading number: grouped thousands (comma, apostrophe, blank), decimal point or comma, and mixed fractions."""
    head = F.regexp_extract(text, rf"^[^\d½¼¾⅓⅔⅛⅜⅝⅞]*?(-?{_NUM})", 1)
    plain = F.when(text.rlike(_GROUPED), F.regexp_replace(head, r"(?U)[,'’\s  ]", "")).otherwise(F.regexp_replace(head, ",", ".")).try_cast("double")
    slash = r"(?U)^[^\d]*?(?:(\d+)[\s-]+)?(\d+)\s*/\s*(\d+)"
    part = lambda k: F.regexp_extract(text, slash, k).try_cast("double")
    fraction = F.when(text.rlike(slash), F.coalesce(part(1), F.lit(0.0)) + part(2) / F.nullif(part(3), F.lit(0.0)))
    sign = F.regexp_extract(text, "([½¼¾⅓⅔⅛⅜⅝⅞])", 1)
    vulgar = F.lit(None).cast("double")
    for k, v in _FRACTIONS.items():
        vulgar = F.when(sign == k, F.lit(v)).otherwise(vulgar)
    first = F.regexp_extract(text, r"^[^\d]*(\d+)", 1).try_cast("double")
    return F.coalesce(fraction, F.when(text.rlike("[½¼¾⅓⅔⅛⅜⅝⅞]"), F.coalesce(first, F.lit(0.0)) + vulgar), plain)


def readings(df: DataFrame, value: str, unit: str, quantity: str) -> DataFrame:
    """``df`` with ``_number``, ``_second`` (the smaller part of a compound value such as feet and inches), ``_inside`` and
    ``_second_inside`` (their units as spelled) and ``_named`` (the unit column). ``value`` is JSON text: number, text or
    {"value", "unit"}. A conversion in brackets is dropped first."""
    raw = F.trim(F.col(value))
    is_object = F.col("_object")
    df = df.withColumn("_object", raw.startswith("{"))
    text = F.when(is_object, F.get_json_object(raw, "$.value")).otherwise(json_scalar(F.col(value)))
    df = df.withColumn("_text", squeezed(F.regexp_replace(text, r"[(\[][^)\]]*[)\]]", " ")))  # staged columns, so that no text is parsed twice
    rest = F.regexp_extract(F.col("_text"),
        rf"(?U)^[^\d½¼¾⅓⅔⅛⅜⅝⅞]*?-?(?:\d+[\s-]+\d+\s*/\s*\d+|\d+\s*/\s*\d+|{_NUM}\s*[½¼¾⅓⅔⅛⅜⅝⅞]?|[½¼¾⅓⅔⅛⅜⅝⅞])\s*[-–]?\s*(.*)$", 1)
    compound = rf"(?U)^([^\d]+?)\s*({_NUM})\s*([^\d]+)$"
    df = df.withColumn("_rest", rest)
    df = df.withColumn("_two", ~is_object & F.col("_rest").rlike(compound) & ~F.col("_rest").rlike(r"(?i)^(?:ft|m|cu ?ft)[3³^]"))
    two = F.col("_two")
    inside = F.when(is_object, F.get_json_object(raw, "$.unit")).when(two, F.regexp_extract("_rest", compound, 1)).otherwise(F.col("_rest"))
    return df.withColumns({
        "_number": number(F.col("_text")), "_second": F.when(two, F.regexp_replace(F.regexp_extract("_rest", compound, 2), ",",
        ".").try_cast("double")),
        "_inside": unit_key(inside), "_second_inside": F.when(two, unit_key(F.regexp_extract("_rest", compound, 3))), "_named": unit_key(F.col(unit)),
        "_quantity": F.col(quantity),
    }).drop("_object", "_text", "_rest", "_two")


def _per_quantity(quantity: Column, make) -> Column:
    """A fixed choice by quantity, from a handful of constants."""
    out = F.lit(None)
    for q in QUANTITIES.values():
        out = F.when(quantity == q.name, make(q)).otherwise(out)
    return out


def to_common(quantity: Column, unit: Column, value: Column) -> Column:
    """``value`` of ``unit`` in the common unit of ``quantity``; null where either is unknown."""

    def one(q: Quantity) -> Column:
        out = F.lit(None).cast("double")
        for u, (factor, offset) in q.units.items():
            out = F.when(unit == u, value * F.lit(factor) + F.lit(offset)).otherwise(out)
        return out

    return _per_quantity(quantity, one)


def common_unit(quantity: Column) -> Column:
    return _per_quantity(quantity, lambda q: F.lit(q.common))


def can_be(quantity: Column, common_value: Column) -> Column:
    """Whether a value in the common unit lies in the quantity's range of true values; true where no range is known."""

    def one(q: Quantity) -> Column:
        return F.lit(True) if q.low is None else F.coalesce(common_value.between(q.low, q.high), F.lit(False))

    return F.coalesce(_per_quantity(quantity, one), F.lit(True))


def resolve_units(df: DataFrame) -> DataFrame:
    """``df`` (with the columns of ``readings``) with ``_unit``, the unit that is named and can be true, else null; and ``_mixed``,
    true for a compound value of two units."""
    s = F.broadcast(spellings(df.sparkSession))
    for name, to in (("_inside", "_u_in"), ("_second_inside", "_u_2"), ("_named", "_u_col")):
        t = s.select(F.col("quantity").alias("_quantity"), F.col("spelling").alias(name), F.col("unit").alias(to))
        df = df.join(t, ["_quantity", name], "left")
    q, n = F.col("_quantity"), F.col("_number")
    mixed = F.col("_u_2").isNotNull() & F.col("_u_in").isNotNull()
    fits = lambda u: u.isNotNull() & can_be(q, to_common(q, u, n))
    named = F.when(F.col("_u_in").isNotNull(), F.col("_u_in")).otherwise(F.col("_u_col"))
    return df.withColumn("_mixed", mixed).withColumn("_unit", F.when(mixed, F.col("_u_in")).when(fits(named), named))


def _fit(q: Quantity, named: dict[int, int], free: dict[int, int]) -> tuple[dict[str, float], dict[tuple[int, str], float]]:
    """Weights of the units, and the likelihood of each unit for each bin of values without one: an EM with one shared density.

    A quantity without a range has the range of its named values; without any of these, only the common unit is possible."""
    width = max(1, round(KERNEL / BIN))
    if q.low is not None:
        first, last, floor = math.floor(math.log10(q.low) / BIN), math.ceil(math.log10(q.high) / BIN), 1.0  # every value in the range is possible
    elif named:
        first, last, floor = min(named) - 3 * width, max(named) + 3 * width, 0.0
    else:
        return {u: float(u == q.common) for u in q.units}, {(b, q.common): 1.0 for b in free}
    density = {b: floor + sum(named.get(b + k, 0) * math.exp(-0.5 * (k / width) ** 2) for k in range(-3 * width, 3 * width + 1)) for b in range(first,
        last + 1)}
    total = sum(density.values()) or 1.0
    lo, hi = (math.log10(q.low), math.log10(q.high)) if q.low is not None else (-math.inf, math.inf)

    def like(u: str, b: int) -> float:
        factor, offset = q.units[u]
        common = 10 ** ((b + 0.5) * BIN) * factor + offset
        if common <= 0:
            return 0.0
        x = math.log10(common)
        return density.get(math.floor(x / BIN), 0.0) / total if lo <= x + BIN / 2 and x - BIN / 2 <= hi else 0.0

    likes = {(b, u): v for b in free for u in q.units if (v := like(u, b)) > 0}
    weight = {u: (4.0 if u == q.common else 1.0) for u in q.units}  # the column's own unit is expected
    for _ in range(EM_ROUNDS):
        new = {u: (4.0 if u == q.common else 1.0) for u in q.units}
        for b, n in free.items():
            p = {u: weight[u] * likes.get((b, u), 0.0) for u in q.units}
            if (s := sum(p.values())) > 0:
                for u in p:
                    new[u] += n * p[u] / s
        weight = new
    whole = sum(weight.values())
    return {u: w / whole for u, w in weight.items()}, likes


def _by_source(counts: DataFrame, fitted: DataFrame) -> DataFrame:
    """(_quantity, _source, _bin, _fit, _p, _p_common): the likeliest unit of each bin of a source and its posterior, and that of the
    common unit. ``counts(_quantity, _source, _bin, n)``, ``fitted(_quantity, _bin, units ARRAY<STRUCT<unit, like, weight>>)``."""
    near = counts.join(F.broadcast(fitted), ["_quantity", "_bin"])
    add = lambda items, f: F.aggregate(items, F.lit(0.0), lambda a, u: a + f(u))
    all_ = add("units", lambda u: u["like"] * u["weight"])
    shares = F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), (F.col("n") * u["like"] * u["weight"] / F.col("all")).alias("r")))
    part = near.withColumn("all", all_).select("_quantity", "_source", F.explode(shares).alias("s"))
    own = part.groupBy("_quantity", "_source", "s.unit").agg(F.sum("s.r").alias("r"))
    own = own.groupBy("_quantity", "_source").agg(F.map_from_entries(F.collect_list(F.struct("unit", "r"))).alias("own"))  # five units at most
    common = common_unit(F.col("_quantity"))
    score = lambda u: u["like"] * (F.coalesce(F.col("own")[u["unit"]], F.lit(0.0)) + F.lit(SOURCE_PRIOR) * u["weight"])
    scored = F.transform("units", lambda u: F.struct(score(u).alias("p"), (u["unit"] == common).alias("c"), u["unit"].alias("unit")))
    p = near.join(own, ["_quantity", "_source"]).withColumn("_scored", scored).withColumn("_all", add("_scored", lambda u: u["p"]))
    best, base = F.array_max("_scored"), add(F.filter("_scored", lambda u: u["c"]), lambda u: u["p"])
    return p.select(
        "_quantity", "_source", "_bin", best["unit"].alias("_fit"), (best["p"] / F.col("_all")).alias("_p"), (base / F.col("_all")).alias("_p_common")
    )


def assign_by_size(df: DataFrame, source: str = "_source") -> DataFrame:
    """``df`` with ``_unit`` filled from the mixtures, ``_by_size`` and ``_posterior``, that of the unit taken (null where it can't be told).

    Quantities without a known range keep the common unit, and so do values that fit the range as they stand; their posterior
    says how likely that is. No unit is given where nothing fits. ``source``: the column by which sources are told apart."""
    q, n = F.col("_quantity"), F.col("_number")
    free = F.col("_unit").isNull() & (n > 0)
    df = df.withColumn("_bin", F.when(free, F.floor(F.log10(n) / BIN).cast("int")))
    named_bin = F.floor(F.log10(to_common(q, F.col("_unit"), n)) / BIN).cast("int")
    counts = cut(df.where(n > 0).groupBy(q, F.when(free, F.coalesce(source, F.lit(""))).alias("_source"), free.alias("free"),
        F.coalesce("_bin", named_bin).alias("_bin")).agg(F.count(F.lit(1)).alias("n")).where("_bin is not null"))
    got = rows_of(counts.groupBy("_quantity", "free", "_bin").agg(F.sum("n").alias("n")),
        500_000)  # a double has fewer than 617 decades: at most 31,000 bins for each quantity and kind
    table = []
    for x in QUANTITIES.values():
        named = {r._bin: r.n for r in got if r._quantity == x.name and not r.free}
        weights, likes = _fit(x, named, {r._bin: r.n for r in got if r._quantity == x.name and r.free})
        by_bin: dict[int, list] = {}
        for (b, u), like in likes.items():
            by_bin.setdefault(b, []).append((u, like, weights[u]))
        table += [(x.name, b, units) for b, units in by_bin.items()]
    fitted = df.sparkSession.createDataFrame(table, "_quantity string, _bin int, units array<struct<unit:string,like:double,weight:double>>")
    sized = _by_source(counts.where("free").select("_quantity", "_source", "_bin", "n"), fitted)
    loose = df.where("_bin is not null").withColumn("_s", F.coalesce(source, F.lit(""))).join(sized.withColumnRenamed("_source", "_s"),
        ["_quantity", "_s", "_bin"], "left").drop("_s")
    rest = df.where("_bin is null").withColumns({"_fit": F.lit(None).cast("string"), "_p": F.lit(None).cast("double"),
        "_p_common": F.lit(None).cast("double")})
    df = rest.unionByName(loose)
    base, unknown = common_unit(q), F.col("_unit").isNull() & n.isNotNull()
    plain = unknown & can_be(q, n)
    fits = unknown & ~can_be(q, n) & can_be(q, to_common(q, F.col("_fit"), n))
    return df.withColumns({
        "_by_size": unknown, "_posterior": F.when(plain, F.col("_p_common")).when(fits, F.col("_p")),
        "_unit": F.when(F.col("_unit").isNotNull(), F.col("_unit")).when(plain, base).when(fits, F.col("_fit")),
    }).drop("_bin", "_fit", "_p", "_p_common")


def uncertain() -> Column:
    """Whether the unit was taken by size and isn't sure, or can't be told (on the columns of ``normalised``)."""
    return F.col("_by_size") & F.coalesce(F.col("_posterior") < SURE, F.lit(True))


def normalised(df: DataFrame, value: str, unit: str, quantity: str, source: str | None = None) -> DataFrame:
    """``df``, rows of known quantities with a meaningful value only, with ``_unit``, ``_mixed``, ``_by_size``, ``_posterior`` and ``_common``,
    the value in the common unit (null where no number is readable)."""
    known = df.where(F.col(quantity).isin(*QUANTITIES) & is_meaningful(F.col(value)))
    known = known.withColumn("_source", F.col(source) if source else F.lit(""))
    done = assign_by_size(cut(resolve_units(readings(known, value, unit, quantity)))).drop("_source")  # read once, used to fit and to assign
    q = F.col("_quantity")
    extra = F.when(F.col("_mixed"), F.coalesce(to_common(q, F.col("_u_2"), F.col("_second")), F.lit(0.0))).otherwise(F.lit(0.0))
    return done.withColumn("_common", to_common(q, F.col("_unit"), F.col("_number")) + extra)


def is_foreign() -> Column:
    """Recorded, wholly or partly, in a unit or scale other than the common one (on the columns of ``normalised``)."""
    q = F.col("_quantity")
    whole = F.col("_unit").isNotNull() & (F.col("_unit") != common_unit(q))
    part = F.col("_mixed") & (F.col("_u_2") != common_unit(q))
    return F.coalesce(whole | part, F.lit(False))


# Statements in feed notes. A clause states the unit of the column if it names the figures and a unit. A unit behind an amount (900 kg)
# or as the first part of a compound (ton-rated) is that of something else, and so is what may be had elsewhere or on demand.
_ELSEWHERE = r"(?iU)\b(?:available|request|optional|demand|may|can|verfügbar|erhältlich|anfrage|wahlweise|disponibles?|demande|option|solicitud|pedido|opcional|puede|disponibile|richiesta|disponível|sob consulta)\b"
_AMOUNT = r"(?U)\d[\d.,'’]*\s*[^\W\d_]+"
_COMPOUND = r"(?U)\b[^\W\d_]+-(?=[^\W\d_])"
_SAYS_WEIGHT = r"(?iU)weight|\bwt\b|gewicht|poids|peso|mass|masa"
_SAYS_CAPACITY = r"(?iU)capacit|capacid|cooling|puissance|potencia|leistung|tonelaje|tonnage|\bsizes?\b|output|\bratings?\b|figures"
# Unit words in notes, most specific first.
_NOTE_CAPACITY = (
    ("kBTU/h", r"(?iU)\bkbtu|\bmbh\b|thousands? of btu|miles de btu|milliers de btu|tausend btu|mil btu"),
    ("kW", r"(?iU)\bkw\b|kilowatt|kilovatio"),
    ("W", r"(?iU)\bwatts?\b|vatios|\bw\b"),
    ("ton", r"(?iU)\btons?\b|tonnage|tonelaje|\bTR\b|toneladas|tonnes de froid|kältetonnen"),
    ("BTU/h", r"(?iU)\bbtu"),
)
_NOTE_WEIGHT = (
    ("kg", r"(?iU)\bkgs?\b|kilogram|kilogramo|metric"),
    ("g", r"(?iU)\bgrams?\b|\bgrammes?\b|\bgramos?\b|\bgramm\b"),
    ("oz", r"(?iU)\bounces?\b|\boz\b|onzas"),
    ("lb", r"(?iU)\blbs?\b|pounds?\b|libras?\b|livres?\b|pfund"),
)


def stated_unit(notes: Column, says: str, units: tuple) -> Column:
    """The unit that a feed's notes state for the figures that ``says`` matches; null where they state none."""
    clauses = F.split(F.regexp_replace(notes, r"(?U)([.;,])\s+|(?<=[a-z]) (?=(?:wt|Weights?|Gewichte|Poids|Pesos?|Masses|Net weight)\b)", "\u0001"),
        "\u0001")
    about = F.filter(clauses, lambda c: c.rlike(says) & ~c.rlike(_ELSEWHERE))

    def one(clause: Column) -> Column:
        c = F.regexp_replace(F.regexp_replace(clause, _AMOUNT, " "), _COMPOUND, " ")
        out = F.lit(None).cast("string")
        for unit, pattern in reversed(units):
            out = F.when(c.rlike(pattern), unit).otherwise(out)
        return out

    return F.get(F.filter(F.transform(about, one), lambda u: u.isNotNull()), F.lit(0))


def catalog_quantities(catalog: DataFrame) -> DataFrame:
    """(catalog_id, feed_id, field, _quantity, value, named): one row for each figure of a catalogue row, with the unit its feed states.

    A statement in any row's notes holds for the whole feed (``feed_id``); of several, the first by name."""
    own_cap, own_wt = stated_unit(F.col("notes"), _SAYS_CAPACITY, _NOTE_CAPACITY), stated_unit(F.col("notes"), _SAYS_WEIGHT, _NOTE_WEIGHT)
    feeds = catalog.where(F.col("notes").isNotNull() & F.col("feed_id").isNotNull()).select("feed_id", own_cap.alias("c"), own_wt.alias("w"))
    feeds = feeds.groupBy("feed_id").agg(F.min("c").alias("_cap_note"), F.min("w").alias("_wt_note"))
    rows = catalog.select("catalog_id", "feed_id", "capacity_unit", "cooling_capacity_btuh", "net_weight_lb").join(feeds, "feed_id", "left")
    figures = F.array(
        F.struct(F.lit("cooling_capacity_btuh").alias("field"), F.lit("cooling_capacity").alias("_quantity"),
        F.col("cooling_capacity_btuh").cast("string").alias("value"), F.coalesce("_cap_note", "capacity_unit").alias("named")),
        F.struct(F.lit("net_weight_lb").alias("field"), F.lit("net_weight").alias("_quantity"), F.col("net_weight_lb").cast("string").alias("value"),
        F.col("_wt_note").alias("named")),
    )
    return rows.select("catalog_id", "feed_id", F.explode(figures).alias("f")).select("catalog_id", "feed_id",
        "f.*").where(F.col("value").isNotNull())


def all_quantities(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every figure of both tables with its common value: record_table, record_id, field and the columns of ``normalised``.
    Repeated rows of a fact are one. Fitted together, so that figures without a unit learn from all named ones."""
    f = facts.where(F.col("property").isin(*QUANTITIES) & F.col("id").isNotNull()).select(
        F.lit("facts").alias("record_table"), F.col("id").alias("record_id"), F.lit("normalized_value").alias("field"),
        F.col("property").alias("quantity"), F.col("normalized_value").alias("value"), F.col("unit").alias("named"), F.lit("facts").alias("source"),
    )
    c = catalog_quantities(catalog).select(
        F.lit("acme_catalog").alias("record_table"), F.col("catalog_id").cast("string").alias("record_id"), "field",
        F.col("_quantity").alias("quantity"), "value", "named", F.concat(F.lit("feed "), F.coalesce("feed_id", F.lit(""))).alias("source"),
    )
    return normalised(f.unionByName(c), "value", "named", "quantity", "source")
