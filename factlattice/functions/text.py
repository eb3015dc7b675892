"""Text functions as Column expressions; the few that Catalyst lacks are Arrow functions that skip ASCII input in the JVM."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Punctuation that is folded to ASCII, one to one; the ellipsis becomes three dots.
DASHES = "‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„"
SPACES = "      "
# Invisible characters; the first are debris, the others are written on purpose.
DEBRIS = "­​﻿"
CONTROLS = "‌‍‎‏⁦⁧⁨⁩⁠"
# Spellings of "no value".
NULL_TOKENS = ("", "-", "--", "---", "n/a", "n.a.", "na", "none", "null", "nil", "unknown", "unspecified", "tbd", "not applicable", "not available")
_WS = r"[\s   -     　﻿]"  # white space as in ECMAScript
# Named entities.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "shy": "­", "zwnj": "‌", "zwj": "‍", "lrm": "‎", "rlm": "‏",
    "deg": "°", "frac12": "½", "frac14": "¼", "frac34": "¾", "times": "×", "mdash": "-", "ndash": "-", "hellip": "...", "reg": "®", "trade": "™",
    "copy": "©",
}


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and full-width signs, with their plain counterparts, derived from Unicode."""
    source, target = "", ""
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii():
            source, target = source + chr(code), target + plain
    return source, target


_MARKED, _UNMARKED = _plain_letters()


_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);")


def _decode_one(m: re.Match) -> str:
    body = m.group(1)
    if body[0] == "#":
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(code) if code <= 0x10FFFF else m.group()
    return ENTITIES.get(body, m.group())


@F.pandas_udf(T.StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else _ENTITY.sub(_decode_one, t))


def ascii_only(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def nfkc(c: Column) -> Column:
    """Unicode NFKC; ASCII text never leaves the JVM's filter branch as changed."""
    return F.when(ascii_only(c), c).otherwise(_nfkc(c))


def trim(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space one blank, trimmed."""
    return F.regexp_replace(F.regexp_replace(c, f"{_WS}+", " "), "^ +| +$", "")


def fold_punctuation(c: Column) -> Column:
    source = DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + SPACES + "⁄"
    target = "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + " " * len(SPACES) + "/"
    return F.replace(F.translate(c, source, target), F.lit("…"), F.lit("..."))


def strip_debris(c: Column) -> Column:
    return F.translate(c, DEBRIS, "")


def strip_format(c: Column) -> Column:
    return F.translate(c, DEBRIS + CONTROLS, "")


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal HTML entities; unknown names stay."""
    return F.when(c.contains("&"), _decoded(c)).otherwise(c)


def comparison_key(c: Column) -> Column:
    """The form in which two spellings are compared."""
    return F.lower(collapse(fold_punctuation(strip_format(decode_entities(nfkc(c))))))


def is_null_token(c: Column) -> Column:
    return comparison_key(c).isin(*NULL_TOKENS)


def title_case(c: Column) -> Column:
    """Each word's first letter upper, the rest lower; words end at any white space, which is kept."""
    parts = F.regexp_extract_all(c, F.lit(f"({_WS}+|[^\\s\\u00a0]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def strip_characters(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def replace_pattern(c: Column, pattern: str, replacement: str, every: bool = False) -> Column:
    """The first match replaced by a literal, or every one ($1 in the replacement names a group)."""
    if every:
        return F.regexp_replace(c, pattern, replacement)
    at = F.regexp_instr(c, F.lit(pattern))
    head = F.substring(c, F.lit(1), at - 1)
    tail = F.substring(c, at + F.length(F.regexp_substr(c, F.lit(pattern))), F.length(c))
    return F.when(at > 0, F.concat(head, F.lit(replacement), tail)).otherwise(c)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{_WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def tokens(c: Column) -> Column:
    """Lower-case search tokens: maximal runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


MAX_TOKENS = 12


def contains_all(document: Column, query_tokens: list[str]) -> Column:
    """Whether every token of a query occurs in the document; more than ``MAX_TOKENS`` different ones are refused, not cut."""
    wanted = list(dict.fromkeys(t.lower() for t in query_tokens))
    if len(wanted) > MAX_TOKENS:
        raise ValueError(f"at most {MAX_TOKENS} words, got {len(wanted)}")
    return F.forall(F.array(*[F.lit(t) for t in wanted]), lambda t: F.array_contains(tokens(document), t))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    grams = F.transform(tokens(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w,
        F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, in 0..1; 0 where neither has any."""
    union = F.size(F.array_union(trigrams(a), trigrams(b)))
    return F.when(union > 0, F.size(F.array_intersect(trigrams(a), trigrams(b))) / union).otherwise(0.0)


def contains_folded(c: Column, needle: Column) -> Column:
    """Case-insensitive substring; % and _ in the needle are ordinary characters."""
    return F.contains(F.lower(c), F.lower(needle))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def model_key(c: Column) -> Column:
    """Upper-case letters and digits without accents: the key under which model numbers meet. JVM only, so it may stand in lambdas."""
    return F.regexp_replace(F.upper(F.translate(c, _MARKED, _UNMARKED)), "[^A-Z0-9]", "")


def decode_named(c: Column) -> Column:
    """Named HTML entities only; JVM only, so it may stand in lambdas."""
    for name, sign in [*((k, v) for k, v in ENTITIES.items() if k != "amp"), ("amp", "&")]:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return c


def clean_item(c: Column) -> Column:
    """``clean_notice`` for items of arrays: without numeric entities."""
    return F.coalesce(collapse(decode_named(F.regexp_replace(c, "<[^>]+>", " "))), F.lit(""))


def clean_notice(c: Column) -> Column:
    """Notice text without tags, entities decoded, blanks collapsed; '' for null."""
    return F.coalesce(collapse(decode_entities(F.regexp_replace(c, "<[^>]+>", " "))), F.lit(""))


def unescape_full(text: str) -> str:
    """All HTML entities, for single values on the driver."""
    return html.unescape(text)
