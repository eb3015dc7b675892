"""Identifier spelling: UUID text in one canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX32 = "^[0-9a-f]{32}$"


def bare_hex(col: Column) -> Column:
    """Lower case, without a urn prefix, braces, brackets, hyphens and white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"(?U)^\s*urn:uuid:", ""), r"(?U)[\s{}()\[\]\-]", "")


def canonical_uuid(col: Column) -> Column:
    """UUID text as lower case 8-4-4-4-12; other text trimmed and lower-cased; null for null, empty and blank."""
    h = bare_hex(col)
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    other = F.regexp_replace(F.lower(col), r"(?U)^\s+|\s+$", "")
    return F.when(col.rlike(CANONICAL_UUID), col).when(h.rlike(HEX32), dashed).when(other == "", None).otherwise(other)
