"""Reading the JSON text of recorded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "not known".
NULL_WORDS = (
    "", "-", "--", "---", "—", "–", ".", "?", "n/a", "na", "n.a.", "n.a", "#n/a", "none", "null", "nil", "unknown", "not known", "not available",
    "not applicable", "not specified", "unspecified", "not stated", "not given", "not provided", "tbd", "tba", "to be determined", "undefined",
)


def json_scalar(col: Column) -> Column:
    """The text of a JSON scalar (string without quotes and escapes); the text itself where it isn't a JSON string; null for JSON null."""
    t = F.trim(col)
    return F.when(t == "null", None).when(t.startswith('"'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v"),
        t)).otherwise(t)


def squeezed(col: Column) -> Column:
    """Trimmed, each run of any white space one blank."""
    return F.trim(F.regexp_replace(col, r"(?U)[\s   ﻿]+", " "))


def is_meaningful(col: Column) -> Column:
    """True where a JSON value says something: not null, not empty and not a word for 'not known'. Never null."""
    inner = F.lower(squeezed(json_scalar(col)))
    return F.coalesce(~inner.isin(*NULL_WORDS), F.lit(False))
