"""Finding the terms of vocabularies in text: one pass of one pattern for all terms of all vocabularies.

A term is one or more words; a star at its end stands for any ending. Words are maximal runs of letters and digits, lower case.
The pattern looks ahead from each blank, with the terms grouped by their first letters and the longest first, so it takes one
term for each place; the terms that are beginnings of it are known beforehand and come with it.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

Vocabulary = dict[str, tuple[str, ...]]


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def padded(text: Column) -> Column:
    """The words of a text, each between two blanks that neighbours share; a single blank for none or null."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def has(words: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether any of a few terms occurs in ``padded`` words of a short text."""
    return reduce(lambda a, b: a | b, [F.contains(words, F.lit(f" {t[:-1]}" if t.endswith("*") else f" {t} ")) for t in terms])


def _pattern(terms: list[str]) -> str:
    """One alternation of all terms, as 'term ' or as the stem of a term with a star."""

    def grouped(items: list[str], depth: int) -> str:
        if depth == 2 or len(items) < 4 or any(len(t) <= depth for t in items):
            return "|".join(re.escape(t[depth:]).replace("\\ ", " ") for t in sorted(items, key=lambda t: (-len(t), t)))
        return "|".join(f"{head}(?:{grouped(list(part), depth + 1)})" for head, part in groupby(sorted(items), key=lambda t: t[depth]))

    return f" (?=({grouped(terms, 0)}))"


def hits(words: Column, vocabularies: dict[str, Vocabulary]) -> Column:
    """'vocabulary/name' of every name of which ``padded`` words hold a term, unordered, maybe repeated."""
    owners: dict[str, set[str]] = {}
    for v, vocabulary in vocabularies.items():
        for name, terms in vocabulary.items():
            for t in terms:
                owners.setdefault(t[:-1] if t.endswith("*") else f"{t} ", set()).add(f"{v}/{name}")
    named = {t: sorted(set().union(*(o for s, o in owners.items() if t.startswith(s)))) for t in owners}
    table = F.from_json(F.lit(json.dumps(named)), "map<string, array<string>>")  # one literal, folded when the plan is made
    found_terms = F.array_distinct(F.regexp_extract_all(words, F.lit(_pattern(list(owners))), F.lit(1)))
    return F.flatten(F.transform(found_terms, lambda t: F.element_at(table, t)))


def pick(hit: Column, v: str, vocabulary: Vocabulary) -> Column:
    """The names of a vocabulary among ``hits``, in the order of the vocabulary."""
    mine = F.array_intersect(F.split(F.lit(" ".join(f"{v}/{n}" for n in vocabulary)), " "), hit)
    return F.transform(mine, lambda n: F.substring(n, len(v) + 2, 1 << 30))


def found(words: Column, vocabulary: Vocabulary) -> Column:
    """The names whose terms occur in ``padded`` words, in the order of the vocabulary."""
    return let(hits(words, {"": vocabulary}), lambda h: pick(h, "", vocabulary))


def classes(text: Column, vocabulary: Vocabulary) -> Column:
    """``found`` of a text; an empty array for null."""
    return found(padded(text), vocabulary)
