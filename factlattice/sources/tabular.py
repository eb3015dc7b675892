"""CSV and JSON sources with located values, and exact text sinks.

Locators are text of key=value pairs joined by ';', with '%', ';' and '=' percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.functions.text import trim


def locator(**parts: Column) -> Column:
    """A locator of the given parts, null parts left out."""

    def encoded(c: Column) -> Column:
        c = c.cast("string")
        for sign, code in (("%", "%25"), (";", "%3B"), ("=", "%3D")):
            c = F.replace(c, F.lit(sign), F.lit(code))
        return c

    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), encoded(v)) for k, v in parts.items()])


def parse_locator(c: Column) -> Column:
    """The map of a locator."""
    m = F.str_to_map(c, F.lit(";"), F.lit("="))
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("%3D"), F.lit("=")), F.lit("%3B"), F.lit(";")), F.lit("%25"), F.lit("%"))
    return F.transform_values(m, lambda k, v: plain(v))


def read_csv(spark: SparkSession, path: str, preamble: str | None = None, header: bool | list[str] = True, sep: str = ",",
    where: tuple[str, list[str]] | None = None, columns: list[str] | None = None, line_breaks: bool = True) -> DataFrame:
    """A CSV source: all columns as text, blanks trimmed, ``ordinal`` 1, 2, 3 ... in file order whatever the number of splits.

    ``preamble``: a pattern; the leading lines that match it are skipped, later ones aren't. ``where``: keep rows whose column has
    one of the values, without renumbering; an unknown column is an error. ``columns`` projects by name. Cells may hold
    line breaks, which makes each file one task; ``line_breaks`` False says that none does, and large files are split. With a preamble,
    lines are read as text and parsed with the same rules (no line breaks in cells).
    """
    from factlattice.operators.ordering import running

    if preamble is None and header is True:
        df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=line_breaks, ignoreLeadingWhiteSpace=True,
            ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
        df = running(df.withColumn("_line", F.monotonically_increasing_id()), ["_line"]).withColumn("ordinal", F.col("rank") + 1).drop("rank",
            "_line")
    else:
        lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"), F.monotonically_increasing_id().alias("line"))
        if preamble is not None:
            first = lines.where(~F.col("value").rlike(preamble)).agg(F.min("line")).first()[0]
            lines = lines.where(F.col("line") >= (first if first is not None else 0))
        lines = lines.where(F.length("value") > 0)
        names = header if isinstance(header, list) else None
        if names is None:
            head = lines.orderBy("line").first()
            if head is None:
                raise ValueError("no header line")
            names = [c.strip() for c in spark.createDataFrame([(head.value,)], "v string").select(F.split("v", sep)).first()[0]]
            names = [n.strip('"') for n in names]
            lines = lines.where(F.col("line") > head.line)
        schema = ", ".join(f"`{n}` string" for n in names)
        parsed = lines.select("line", F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true",
            "ignoreTrailingWhiteSpace": "true"}).alias("r"))
        df = running(parsed, ["line"]).select("r.*", (F.col("rank") + 1).alias("ordinal"))
    if where is not None:
        if where[0] not in df.columns:
            raise ValueError(f"unknown column {where[0]}")
        df = df.where(F.col(where[0]).isin(*where[1]))
    return df if columns is None else df.select("ordinal", *columns)


def composite_key(parts: list[Column], sep: str, fallback: Column) -> Column:
    """Trimmed parts joined, or ``fallback`` where any part is null or empty: all or nothing."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.coalesce(trim(p) != "", F.lit(False))
    return F.when(whole, F.concat_ws(sep, *[trim(p) for p in parts])).otherwise(fallback)


def read_json_records(spark: SparkSession, path: str, pointer: str, record_schema: str) -> DataFrame:
    """Records of whole JSON files by a JSON pointer: each element of the array it names, or the object; '' is the root."""
    steps = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    text = spark.read.text(path, wholetext=True)
    node = F.get_json_object("value", "$" + "".join(f"['{s}']" if not s.isdigit() else f"[{s}]" for s in steps))
    got = text.select(node.alias("node")).where("node is not null")
    listed = F.when(F.trim("node").startswith("["), F.from_json("node", f"array<{record_schema}>")).otherwise(F.array(F.from_json("node",
        record_schema)))
    return got.select(F.posexplode(listed).alias("ordinal", "record"))


def json_values(c: Column, path: list[str]) -> Column:
    """All values at a path of a JSON text; '*' stands for every element of an array."""
    at = F.array(c)
    for i, step in enumerate(path):
        if step == "*":
            at = F.flatten(F.transform(at, lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))))
        else:
            at = F.filter(F.transform(at, _member(step)), lambda x: x.isNotNull())
    return at


def _member(name: str):
    return lambda x: F.get_json_object(x, f"$['{name}']")


def pick(values: Column, policy: str, sep: str = ", ") -> Column:
    """One of several matches: first, last, join, or single (null if there are several)."""
    if policy == "first":
        return F.get(values, F.lit(0))
    if policy == "last":
        return F.when(F.size(values) > 0, F.element_at(values, -1))
    if policy == "join":
        return F.when(F.size(values) > 0, F.array_join(values, sep))
    if policy == "single":
        return F.when(F.size(values) == 1, F.element_at(values, 1))
    raise ValueError(f"unknown policy {policy}")


def csv_field(c: Column, always: bool = False) -> Column:
    """One CSV cell: quoted where needed, formulas disarmed by a leading apostrophe, null empty and '' as two quotes."""
    t = c.cast("string")
    safe = F.when(t.rlike(r"^[=+\-@\t\r]") & ~t.rlike(r"^[+-]?[0-9.]+$"), F.concat(F.lit("'"), t)).otherwise(t)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    if always:
        return F.coalesce(quoted, F.lit('""'))
    return F.when(t.isNull(), "").when((t == "") | safe.rlike(r'[",\r\n]|^ | $'), quoted).otherwise(safe)


def csv_lines(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(line): the rows as CSV records."""
    src = df if order is None else df.orderBy(*order)
    return src.select(F.array_join(F.array(*[csv_field(F.col(c)) for c in df.columns]), ",").alias("line"))


def jsonl_lines(df: DataFrame) -> DataFrame:
    """(line): the rows as JSON with columns in order, nulls kept; NaN and infinity are refused."""
    bad = F.lit(False)
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = bad | F.coalesce(F.isnan(name) | F.col(name).isin(float("inf"), float("-inf")), F.lit(False))
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.when(bad, F.raise_error(F.lit("a number isn't finite"))).otherwise(text).alias("line"))


def bundle_refs(df: DataFrame, key: str, body: Column, order: list[str]) -> DataFrame:
    """(key, offset, length): where each row's text lies in the file that has one text a line, in the given order."""
    from factlattice.operators.ordering import running

    sized = df.withColumn("_len", F.octet_length(F.coalesce(body, F.lit(""))).cast("bigint")).withColumn("_with_break", F.col("_len") + 1)
    r = running(sized.select(*dict.fromkeys([key, *order]), "_len", "_with_break"), order, "_with_break")
    return r.select(key, "offset", F.col("_len").alias("length"))


def write_export(df: DataFrame, folder: str, order: list[str], per_file: int = 1_000_000) -> dict:
    """A snapshot as JSONL and CSV under ``folder`` in a total order, with counts and an order-independent checksum of the lines.

    The rows are range-partitioned, so files follow each other in order and no single task writes everything."""
    from factlattice.session import parallelism

    sorted_ = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    out = {}
    for name, lines in (("jsonl", jsonl_lines(sorted_)), ("csv", csv_lines(sorted_))):
        lines.write.mode("overwrite").option("maxRecordsPerFile", per_file).text(f"{folder}/{name}")
        r = df.sparkSession.read.text(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("value")).alias("x")).first()
        out[name] = {"records": r.n, "checksum": r.x}
    return out
