"""Searching notices and entities: filters as semi joins on inverted keys, ranked search on an inverted index, honest totals."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions import text as tx
from factlattice.operators import ordering


@dataclass(frozen=True)
class Filters:
    """What a search asks for. ``keys``: for each kind of key the values of which one must be there; ``instead``: for a kind a condition
    on the row that does as well (sold nationwide, for a state); ``equal``: values of columns; ``between``: first and last date, both
    included, either may be None; ``changed_since``: strictly after; ``words``: all in the text; ``like``: part of a column, any case."""

    keys: dict[str, list[str]] = field(default_factory=dict)
    instead: dict[str, Column] = field(default_factory=dict)
    equal: dict[str, list] = field(default_factory=dict)
    between: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    changed_since: tuple[str, str] | None = None
    words: tuple[str, list[str]] | None = None
    like: dict[str, str] = field(default_factory=dict)


def matching(base: DataFrame, keys: DataFrame, wanted: Filters, ident: str = "id") -> DataFrame:
    """The rows of ``base`` that meet all filters, each once. ``keys(kind, value, id)`` is the inverted index.

    All kinds of keys are looked up in one pass: one aggregation with a flag for each kind, then one join, whatever their number."""
    rows = base
    for c, values in wanted.equal.items():
        rows = rows.where(F.col(c).isin(*values))
    for c, (first, last) in wanted.between.items():
        rows = rows.where(F.lit(True) if first is None else F.col(c) >= F.lit(first).cast(dict(base.dtypes)[c])).where(F.lit(True) if last is None else F.col(c) <= F.lit(last).cast(dict(base.dtypes)[c]))
    if wanted.changed_since:
        c, at = wanted.changed_since
        rows = rows.where(F.col(c) > F.lit(at).cast(dict(base.dtypes)[c]))
    for c, part in wanted.like.items():
        rows = rows.where(tx.contains_folded(F.col(c), F.lit(part)))
    if wanted.words:
        rows = rows.where(tx.contains_all(F.col(wanted.words[0]), wanted.words[1]))
    if wanted.keys:
        cond = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("value").isin(*v) for k, v in wanted.keys.items()])
        flags = keys.where(cond).groupBy(F.col(ident).alias("_id")).agg(*[F.bool_or(F.col("kind") == k).alias(f"_k{i}") for i,
            k in enumerate(wanted.keys)])
        rows = rows.join(flags, rows[ident] == flags["_id"], "left" if wanted.instead else "inner")
        for i, k in enumerate(wanted.keys):
            rows = rows.where(F.coalesce(F.col(f"_k{i}"), F.lit(False)) | F.coalesce(wanted.instead.get(k, F.lit(False)), F.lit(False)))
        rows = rows.drop("_id", *[f"_k{i}" for i in range(len(wanted.keys))])
    return rows


def page(rows: DataFrame, at: str, ident: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The next rows, latest first, ties by descending id; ``cursor`` is (time, id) of the last row before."""
    if cursor is not None:
        rows = rows.where(ordering.after([(at, cursor[0], True), (ident, cursor[1], True)]))
    return ordering.page(rows, [F.desc(at), F.desc(ident)], limit)


def inverted_index(docs: DataFrame, ident: str, fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """(token, id, field, boost, n): every word of the fields of every document, with the field's boost and how often it stands there."""
    parts = [docs.select(F.col(ident).alias("id"), F.lit(name).alias("field"), F.lit(float(boost)).alias("boost"),
        F.explode(tx.tokens(c)).alias("token")) for name, (c, boost) in fields.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("token", "id", "field", "boost").agg(F.count(F.lit(1)).alias("n"))


def ranked(index: DataFrame, words: list[str]) -> DataFrame:
    """(id, score): documents that have every word, by the sum over words of the best boosted field weight 1 - 1 / (1 + n).

    Only the words' postings are read; a document's best field counts for each word."""
    words = list(dict.fromkeys(w.lower() for w in words))
    if len(words) > tx.MAX_TOKENS:
        raise ValueError(f"at most {tx.MAX_TOKENS} words")
    hit = index.where(F.col("token").isin(*words)).groupBy("id", "token").agg(F.max(F.col("boost") * (1 - 1 / (1 + F.col("n")))).alias("w"))
    return hit.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.round(F.sum("w"),
        6).alias("score")).where(F.col("words") == len(words)).select("id", "score")


def tiered(exact: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, tier, score): exact matches first (tier 0, score 1), then ranked ones that aren't exact (tier 1)."""
    e = exact.select("id").distinct()
    return e.select("id", F.lit(0).alias("tier"), F.lit(1.0).alias("score")).unionByName(hits.join(e, "id", "left_anti").select("id",
        F.lit(1).alias("tier"), "score"))


def total(found: DataFrame) -> DataFrame:
    """(total): how many different documents were found."""
    return found.agg(F.count_distinct("id").alias("total"))


def parse_filters(query: str) -> dict[str, dict]:
    """``filter.NAME=a,b&filter.NAME.min=1&filter.NAME.max=9&filter.NAME.exists=true`` as {name: {in, min, max, exists}}.

    At most ten names and a hundred values each; anything else that starts with 'filter.', a number that isn't one, or an empty range is
    an error, other parameters are left alone."""
    from urllib.parse import parse_qsl

    out: dict[str, dict] = {}
    for key, value in parse_qsl(query, keep_blank_values=True):
        if not key.startswith("filter."):
            continue
        name, _, kind = key[len("filter.") :].partition(".")
        if not name or kind not in ("", "min", "max", "exists"):
            raise ValueError(f"unknown filter {key}")
        f = out.setdefault(name, {})
        if kind == "":
            f["in"] = [*f.get("in", []), *[v for v in value.split(",") if v]]
        elif kind == "exists":
            if value not in ("true", "false"):
                raise ValueError(f"{key} must be true or false")
            f["exists"] = value == "true"
        else:
            f[kind] = float(value)
    if len(out) > 10 or any(len(f.get("in", [])) > 100 for f in out.values()):
        raise ValueError("too many filters or values")
    if any(f.get("min", float("-inf")) > f.get("max", float("inf")) for f in out.values()):
        raise ValueError("an empty range")
    return out


def facet_conditions(filters: dict[str, dict], value: Column) -> dict[str, Column]:
    """The conditions of parsed filters on a fact's ``value``, for ``relational.facet_filter``; 'exists: false' isn't one of them."""
    out = {}
    for name, f in filters.items():
        cond = F.lit(True)
        if f.get("in"):
            cond = cond & value.isin(*f["in"])
        if "min" in f:
            cond = cond & (value.try_cast("double") >= f["min"])
        if "max" in f:
            cond = cond & (value.try_cast("double") <= f["max"])
        out[name] = cond
    return out


def bounded(items: Column, most: int) -> Column:
    """(items, truncated): the first ``most`` of a list and whether there are more; an empty list for null."""
    whole = F.coalesce(items, F.array())
    return F.struct(F.slice(whole, 1, most).alias("items"), (F.size(whole) > most).alias("truncated"))
