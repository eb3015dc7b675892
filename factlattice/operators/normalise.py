"""Normalisation rules compiled to Columns: raw text in, typed value, unit or a named failure out. No row loops.

A rule names a property, the field it reads and a chain of transforms. Each transform maps a struct (text, number, unit, failure)
to the next; once there is a failure, the rest of the chain leaves it alone. Unknown means failure, never a guess.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions import dates, identifiers, numbers, text

KINDS = (
    "trim", "collapse", "lower", "upper", "title", "strip_characters", "replace", "punctuation", "decode_entities", "unicode", "null_token",
    "identifier", "boolean", "decimal", "integer", "quantity", "convert", "round", "range", "vocabulary", "date", "datetime", "required",
)


@dataclass(frozen=True)
class Rule:
    property: str
    field: str
    transforms: list[tuple] = field(default_factory=list)
    unit_required: bool = False


def validate(rules: list[Rule], columns: list[str]) -> list[str]:
    """What is wrong with a rule set, before anything runs."""
    said = []
    for r in rules:
        if r.field not in columns:
            said.append(f"{r.property}: no field {r.field}")
        said += [f"{r.property}: unknown transform {t[0]}" for t in r.transforms if t[0] not in KINDS]
        said += [f"{r.property}: unknown unit {t[1]}" for t in r.transforms if t[0] == "convert" and t[1] not in numbers.UNITS]
    said += [f"{p}: declared twice" for p in {r.property for r in rules} if sum(r.property == p for r in rules) > 1]
    return sorted(said)


def _state(t: Column, n: Column, u: Column, f: Column) -> Column:
    return F.struct(t.cast("string").alias("text"), n.cast("double").alias("number"), u.cast("string").alias("unit"),
        f.cast("string").alias("failure"))


def _step(s: Column, kind: str, args: tuple) -> Column:
    t, n, u = s["text"], s["number"], s["unit"]
    null = F.lit(None)
    keep = lambda c: _state(c, n, u, null)
    fail = lambda bad, code, good: F.when(bad, _state(t, n, u, F.lit(code))).otherwise(good)
    simple = {"trim": text.trim, "collapse": text.collapse, "lower": F.lower, "upper": F.upper, "title": text.title_case,
        "punctuation": text.fold_punctuation, "decode_entities": text.decode_entities, "unicode": text.nfkc}
    if kind in simple:
        return keep(simple[kind](t))
    if kind == "strip_characters":
        return keep(text.strip_characters(t, args[0]))
    if kind == "replace":
        return keep(text.replace_pattern(t, args[0], args[1], every=len(args) > 2 and args[2]))
    if kind == "required":
        return fail(t.isNull() | (t == ""), "EMPTY_VALUE", s)
    if kind == "null_token":
        return fail(t.isNull() | text.is_null_token(t), "EMPTY_VALUE", s)
    if kind == "identifier":
        x = identifiers.normalise(t, **(args[0] if args else {}))
        return fail(x == "", "IDENTIFIER_EMPTY_AFTER_NORMALIZATION", keep(x))
    if kind == "boolean":
        b = numbers.parse_boolean(t)
        return fail(b.isNull(), "UNPARSEABLE_BOOLEAN", keep(b.cast("string")))
    if kind == "decimal":
        x = numbers.parse_decimal(t, *args)
        return fail(x.isNull(), "UNPARSEABLE_NUMBER", _state(t, x, u, null))
    if kind == "integer":
        return fail(n.isNull() | (n != F.floor(n)), "NOT_AN_INTEGER", s)
    if kind == "quantity":
        p = r"^\s*([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*([^0-9\s].*?)?\s*$"
        x, unit = numbers.parse_decimal(F.regexp_extract(t, p, 1)), F.nullif(F.regexp_extract(t, p, 2), F.lit(""))
        known = F.lit(None).cast("string")
        for name in numbers.UNITS:
            known = F.when(F.lower(unit) == name.lower(), name).otherwise(known)
        return F.when(x.isNull(), _state(t, n, u, F.lit("UNPARSEABLE_NUMBER"))).when(unit.isNotNull() & known.isNull(),
            _state(t, x, unit, F.lit("UNKNOWN_UNIT"))).otherwise(_state(t, x, F.coalesce(known, u), null))
    if kind == "convert":
        x = numbers.convert(n, u, args[0])
        return F.when(u.isNull(), _state(t, n, u, F.lit("MISSING_UNIT"))).when(x.isNull(),
            _state(t, n, u, F.lit("DIMENSION_MISMATCH"))).otherwise(_state(t, x, F.lit(args[0]), null))
    if kind == "round":
        return _state(t, numbers.js_round(n, args[0]), u, null)
    if kind == "range":
        return fail(~F.coalesce(n.between(args[0], args[1]), F.lit(False)), "OUT_OF_RANGE", s)
    if kind == "vocabulary":
        key, term = text.comparison_key(t), F.lit(None).cast("string")
        for canonical, aliases in args[0].items():
            term = F.when(key.isin(*[x.lower() for x in (canonical, *aliases)]), canonical).otherwise(term)
        return fail(term.isNull(), "UNMAPPED_VOCABULARY", keep(term))
    if kind == "date":
        x = dates.normalise_date(t)
        return fail(x.isNull(), "UNPARSEABLE_DATE", keep(x))
    if kind == "datetime":
        x = dates.normalise_datetime(t)
        return fail(x.isNull(), "UNPARSEABLE_DATE", keep(x))
    raise ValueError(f"unknown transform {kind}")


def normalise(records: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, property, value, number, unit, failure, raw): one row for each record and rule with a non-null field, in one pass.

    The n-th transforms of all rules are one projection, so no step's expression is copied into the next."""
    wrong = validate(rules, records.columns)
    if wrong:
        raise ValueError("; ".join(wrong))
    null = F.lit(None)
    df = records.select(F.col(key), *[F.col(r.field).cast("string").alias(f"_raw{i}") for i, r in enumerate(rules)])
    df = df.withColumns({f"_s{i}": _state(F.col(f"_raw{i}"), null, null, null) for i in range(len(rules))})
    for depth in range(max((len(r.transforms) for r in rules), default=0)):
        steps = {}
        for i, r in enumerate(rules):
            if depth < len(r.transforms):
                kind, *args = r.transforms[depth]
                s = F.col(f"_s{i}")
                steps[f"_s{i}"] = F.when(s["failure"].isNotNull(), s).otherwise(_step(s, kind, tuple(args)))
        df = df.withColumns(steps)
    got = []
    for i, r in enumerate(rules):
        s = F.col(f"_s{i}")
        if r.unit_required:
            s = F.when(s["failure"].isNull() & s["unit"].isNull(), _state(s["text"], s["number"], s["unit"], F.lit("MISSING_UNIT"))).otherwise(s)
        got.append(F.struct(F.lit(r.property).alias("property"), s.alias("s"), F.col(f"_raw{i}").alias("raw")))
    long = df.select(F.col(key), F.explode(F.array(*got)).alias("r")).where("r.raw is not null")
    return long.select(key, "r.property", F.col("r.s.text").alias("value"), F.col("r.s.number").alias("number"), F.col("r.s.unit").alias("unit"),
        F.col("r.s.failure").alias("failure"), "r.raw")


def payload(normalised: DataFrame, key: str) -> DataFrame:
    """(key, properties, units, failures): the good values of each record as maps, the failures as a list."""
    good = F.col("failure").isNull()
    value = F.coalesce(F.col("number").cast("string"), F.col("value"))
    g = normalised.groupBy(key).agg(
        F.collect_list(F.when(good, F.struct("property", value.alias("v")))).alias("p"),
        F.collect_list(F.when(good & F.col("unit").isNotNull(), F.struct("property", "unit"))).alias("u"),
        F.array_sort(F.collect_list(F.when(~good, F.concat_ws(":", "property", "failure")))).alias("failures"),
    )
    return g.select(key, F.map_from_entries("p").alias("properties"), F.map_from_entries("u").alias("units"), "failures")
