"""Product and entity identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factlattice.functions.text import collapse, fold_punctuation, nfkc, slugify, title_case, trim

_DROP = {"alphanumeric": "[^0-9A-Za-z]", "digits": "[^0-9]", "letters": "[^A-Za-z]"}
# How each kind of alias is normalised.
PROFILES = {"model_number": {}, "ahri_ref": {"keep": "digits", "strip_zeros": True}, "manufacturer_sku": {}, "upc": {"keep": "digits", "pad_to": 12},
    "series_name": {}}


def normalise(c: Column, keep: str = "alphanumeric", case: str = "upper", strip_zeros: bool = False, pad_to: int | None = None, max_length: int
    | None = None) -> Column:
    """Kept characters of the NFKC form only, in one case; optionally without leading zeros (one stays), padded with zeros (never cut), cut."""
    x = F.regexp_replace(fold_punctuation(nfkc(c)), _DROP[keep], "")
    x = F.upper(x) if case == "upper" else F.lower(x) if case == "lower" else x
    if strip_zeros:
        x = F.when(x.rlike("^0+$"), "0").otherwise(F.regexp_replace(x, "^0+", ""))
    if pad_to is not None:
        x = F.when((F.length(x) > 0) & (F.length(x) < pad_to), F.lpad(x, pad_to, "0")).otherwise(x)
    return x if max_length is None else F.substring(x, 1, max_length)


def for_alias(alias_type: Column, c: Column) -> Column:
    """Normalised by the profile of the alias type; null where nothing is left."""
    out = normalise(c)
    for kind, options in PROFILES.items():
        if options:
            out = F.when(alias_type == kind, normalise(c, **options)).otherwise(out)
    return F.nullif(out, F.lit(""))


def match(a: Column, b: Column, **options) -> Column:
    """Both non-empty after normalisation, and equal."""
    x, y = normalise(a, **options), normalise(b, **options)
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def candidates(c: Column) -> Column:
    """The spellings under which a typed identifier may be stored."""
    t = trim(c)
    got = F.array(t, F.lower(t), F.upper(t), F.regexp_replace(F.lower(t), "[^a-z0-9]+", ""), F.regexp_replace(F.upper(t), "[^A-Z0-9]+", ""),
        slugify(t))
    return F.filter(F.array_distinct(got), lambda x: x != "")


def check_digit_ok(digits: Column) -> Column:
    """GS1 check digit of 8 to 14 digits; false for anything else."""
    back = F.split(F.reverse(digits), "")
    weigh = F.transform(F.slice(back, 2, 13), lambda d, i: d.try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(weigh, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    right = F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == F.get(back, F.lit(0)).try_cast("int")
    return F.coalesce(F.when(digits.rlike("^[0-9]{8,14}$"), right), F.lit(False))


def gtin14(digits: Column) -> Column:
    """A valid code padded to 14 digits; null for an invalid one."""
    return F.when(check_digit_ok(digits), F.lpad(digits, 14, "0"))


def expand_upce(c: Column) -> Column:
    """UPC-E of 8 digits as UPC-A; null for anything else."""
    s = lambda a, n: F.substring(c, a, n)
    d6 = s(7, 1)
    body = (
        F.when(d6.isin("0", "1", "2"), F.concat(s(2, 2), d6, F.lit("0000"), s(4, 3))).when(d6 == "3", F.concat(s(2, 3), F.lit("00000"), s(5, 2)))
        .when(d6 == "4", F.concat(s(2, 4), F.lit("00000"), s(6, 1))).otherwise(F.concat(s(2, 5), F.lit("0000"), d6))
    )
    return F.when(c.rlike("^[01][0-9]{7}$"), F.concat(s(1, 1), body, s(8, 1)))


def gtin_readings(c: Column) -> Column:
    """Every valid GTIN-14 that 8 to 14 digits may mean: as they stand, or as UPC-E."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.array_sort(F.array_distinct(F.filter(F.array(gtin14(d), gtin14(expand_upce(d))), lambda x: x.isNotNull())))


def ndc_package(c: Column) -> Column:
    """A package code in the 5-4-2 layout; null for other layouts."""
    p = r"^([0-9]{4,5})-([0-9]{3,4})-([0-9]{1,2})$"
    a, b, d = (F.regexp_extract(c, p, k) for k in (1, 2, 3))
    layout = F.concat(F.length(a), F.length(b), F.length(d)).cast("string")
    short = F.concat_ws("-", F.lpad(a, 5, "0"), F.lpad(b, 4, "0"), F.lpad(d, 2, "0"))
    return F.when(layout.isin("442", "532", "541", "542"), short)


def ndc_product(c: Column) -> Column:
    """A product code in the 5-4 layout; null for other layouts."""
    p = r"^([0-9]{4,5})-([0-9]{3,4})$"
    t = trim(c)
    a, b = F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)
    return F.when(F.concat(F.length(a), F.length(b)).cast("string").isin("44", "53", "54"), F.concat_ws("-", F.lpad(a, 5, "0"), F.lpad(b, 4, "0")))


def ndc_input(c: Column) -> Column:
    """A typed code: package, product, or 11 plain digits."""
    t = trim(c)
    return F.coalesce(ndc_package(t), ndc_product(t), F.when(t.rlike("^[0-9]{11}$"), F.concat_ws("-", F.substring(t, 1, 5), F.substring(t, 6, 4),
        F.substring(t, 10, 2))))


def product_of_package(ndc: Column) -> Column:
    return F.substring(ndc, 1, 10)


def lot_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))


def digit_codes(c: Column) -> Column:
    """Codes of 8 to 14 digits in a list, blanks and hyphens between digits dropped."""
    parts = F.transform(F.split(c, r"[,;/|]|\band\b"), lambda p: F.regexp_replace(p, r"(?<=[0-9])[ -](?=[0-9])", ""))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"(?<![0-9])([0-9]{8,14})(?![0-9])"), F.lit(1)))))


def upc_mod10(c: Column) -> Column:
    """Whether 12 digits carry a right check digit."""
    return F.coalesce(c.rlike("^[0-9]{12}$") & check_digit_ok(c), F.lit(False))


def alias_chain(c: Column, steps: list[tuple]) -> Column:
    """A declared chain of operations; an unknown one is an error when the plan is built."""
    for op, *args in steps:
        if op == "uppercase":
            c = F.upper(c)
        elif op == "lowercase":
            c = F.lower(c)
        elif op == "title_case":
            c = title_case(c)
        elif op == "collapse_whitespace":
            c = collapse(c)
        elif op == "strip_whitespace":
            c = F.regexp_replace(c, r"(?U)\s+", "")
        elif op == "strip_characters":
            c = F.translate(c, args[0], "")
        elif op == "strip_non_digits":
            c = F.regexp_replace(c, "[^0-9]", "")
        elif op == "strip_prefix":
            c = F.when(c.startswith(args[0]), F.substring(c, len(args[0]) + 1, 1 << 30)).otherwise(c)
        elif op == "left_pad":
            c = F.when(F.length(c) < args[0], F.lpad(c, args[0], args[1] if len(args) > 1 else "0")).otherwise(c)
        elif op == "normalize_punctuation":
            c = fold_punctuation(c)
        elif op == "unicode_normalize":
            from factlattice.functions.text import nfkc

            c = nfkc(c)
        elif op == "strip_format_characters":
            from factlattice.functions.text import strip_format

            c = strip_format(c)
        else:
            raise ValueError(f"unknown alias operation {op}")
    return c


def gtin_candidates(c: Column) -> Column:
    """Every GTIN-14 that typed input may mean: its digits as a whole if there are 8 to 14, and each code in a list."""
    whole = F.regexp_replace(c, "[^0-9]", "")
    every = F.transform(F.array_union(F.array(whole), digit_codes(c)), gtin_readings)
    return F.array_sort(F.array_distinct(F.flatten(every)))


_MEASURE = r"(?i)^[0-9.,]+ ?(?:in|inch|ft|mm|cm|m|lb|lbs|oz|kg|g|v|volts?|w|watts?|kw|amps?|hz|btu|btuh|cfm|psig?|gal|l)$"


def rejection(c: Column) -> Column:
    """Why a text can't be an identifier; null where it may be one. The first reason counts: EMPTY, TOO_LONG (over 40 signs), TOO_SHORT
    (under 3 letters and digits), NO_DIGIT, SENTENCE (over 3 words), DATE, YEAR, MEASURE, MONEY."""
    t = trim(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(t, "[^0-9A-Za-z]", "")
    return (
        F.when(t == "", "EMPTY").when(F.length(t) > 40, "TOO_LONG").when(F.length(bare) < 3, "TOO_SHORT").when(~t.rlike("[0-9]"), "NO_DIGIT")
        .when(t.rlike(r"\S+(?: +\S+){3}"), "SENTENCE").when(t.rlike(r"^[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4}$"),
        "DATE").when(t.rlike("^(?:19|20)[0-9]{2}$"), "YEAR")
        .when(t.rlike(_MEASURE), "MEASURE").when(t.rlike(r"^[$€£] ?[0-9]"), "MONEY")
    )
