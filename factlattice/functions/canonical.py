"""Canonical JSON, equality of recorded values, derived identifiers, and the scores of extraction and normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(c: Column) -> Column:
    """JSON text with the keys of every object in order and no blanks, numbers in their shortest form; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def same_value(a: Column, b: Column) -> Column:
    """Whether two JSON values are the same: scalars, lists in order, objects whatever the order of their keys. Null equals null only."""
    return canonical_json(a).eqNullSafe(canonical_json(b)) & (a.isNull() == b.isNull())


def derived_uuid(*parts: Column) -> Column:
    """An identifier of the shape of a UUID (version 5) that depends on the parts only: the first 128 bits of their SHA-256, the parts
    joined by U+0000. Null if any part is."""
    h = F.sha2(F.concat_ws("\u0000", *parts), 256)
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.when(whole, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant,
        F.substring(h, 18, 3)), F.substring(h, 21, 12)))


# Weights, penalties and factors of the scores.
REQUIRED_WEIGHT, OPTIONAL_WEIGHT = 0.8, 0.2
PARSE_FAILURE, AMBIGUOUS_FIELD, MISSING_REQUIRED_CEILING = 0.25, 0.15, 0.5
ASSUMED_UNIT_FACTOR, AMBIGUOUS_DATE_FACTOR, UNMAPPED_FACTOR, LOSSY_FACTOR = 0.8, 0.7, 0.6, 0.99


def extraction_confidence(required: Column, required_present: Column, optional: Column, optional_present: Column, failures: Column,
    ambiguous: Column) -> Column:
    """Coverage of required and optional fields, weighted, less penalties for parse failures and ambiguous fields by their share;
    at most one half while a required field is missing; in 0..1, to four digits. Nothing expected counts as covered."""
    share = lambda n, of: F.when(of == 0, 1.0).otherwise(n / of)
    base = (REQUIRED_WEIGHT * share(required_present, required) + OPTIONAL_WEIGHT * share(optional_present, optional)) / (REQUIRED_WEIGHT
        + OPTIONAL_WEIGHT)
    tried = F.greatest(required + optional, F.lit(1))
    score = base - PARSE_FAILURE * failures / tried - AMBIGUOUS_FIELD * ambiguous / tried
    score = F.when(required_present < required, F.least(score, F.lit(MISSING_REQUIRED_CEILING))).otherwise(score)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def normalisation_confidence(unmapped: Column, lossy: Column, assumed_unit: Column, ambiguous_date: Column) -> Column:
    """The product of the factors whose conditions hold, to four digits."""
    score = F.lit(1.0)
    for cond, factor in ((unmapped, UNMAPPED_FACTOR), (lossy, LOSSY_FACTOR), (assumed_unit, ASSUMED_UNIT_FACTOR),
        (ambiguous_date, AMBIGUOUS_DATE_FACTOR)):
        score = score * F.when(F.coalesce(cond, F.lit(False)), factor).otherwise(1.0)
    return F.round(score, 4)


def claim_confidence(authority_rank: Column, extraction: Column) -> Column:
    """How well a claim was read and how much its publisher counts, in equal parts; an unknown reading counts as 1. Four digits."""
    authority = F.greatest(F.lit(0.0), F.least(F.lit(1.0), authority_rank / 100))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), authority * 0.5 + F.coalesce(extraction, F.lit(1.0)) * 0.5)), 4)


def reliability(stated: Column, authority_rank: Column) -> Column:
    """A source's reliability: the stated one, else its rank in hundredths."""
    return F.coalesce(stated, authority_rank / 100)


def backoff_seconds(attempt: Column, base: float = 1.0, factor: float = 2.0, cap: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds to wait before a further attempt: doubling from ``base`` up to ``cap``, less up to half of it by ``jitter`` in 0..1."""
    wait = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0))))
    return wait if jitter is None else wait * (1 - jitter / 2)
