"""HTML, text-layer, archive and site-map sources. Parsing is Arrow-batched Python: Catalyst has no parser for these."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element of a parsed page."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.text = tag, attrs, parent, [], []

    def content(self) -> str:
        """The text of the element and its descendants, blanks collapsed."""
        return re.sub(r"\s+", " ", "".join(self._parts())).strip()

    def _parts(self) -> Iterator[str]:
        for t in self.text:
            if isinstance(t, Node):
                if t.tag not in ("script", "style"):
                    yield from t._parts()
            else:
                yield t

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            yield c
            yield from c.walk()

    def path(self) -> str:
        """A selector that names this element by tags and places."""
        parts, n = [], self
        while n.parent is not None:
            same = [c for c in n.parent.children if c.tag == n.tag]
            parts.append(f"{n.tag}:nth-of-type({same.index(n) + 1})")
            n = n.parent
        return " > ".join(reversed(parts))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        self.at.text.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.text.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def select(root: Node, selector: str) -> list[Node]:
    """Elements by a selector of tags, #ids, .classes and [attributes], with descendant and child (>) steps and commas."""
    found: dict[int, Node] = {}
    for alternative in selector.split(","):
        steps = re.findall(r">|[^\s>]+", alternative.strip())
        nodes, child = [root], False
        for s in steps:
            if s == ">":
                child = True
                continue
            pool = [c for n in nodes for c in (n.children if child else n.walk())]
            nodes, child = [n for n in dict.fromkeys(pool) if _fits(n, s)], False
        found |= {id(n): n for n in nodes}
    return [n for n in root.walk() if id(n) in found]


def _fits(n: Node, simple: str) -> bool:
    for sign, name, value in re.findall(r"([.#\[]?)([\w-]+|\*)(?:=[\"']?([^\"'\]]*)[\"']?)?\]?", simple):
        if sign == "" and name not in ("*", n.tag):
            return False
        if sign == "#" and n.attrs.get("id") != name:
            return False
        if sign == "." and name not in (n.attrs.get("class") or "").split():
            return False
        if sign == "[" and (name not in n.attrs or (value and n.attrs[name] != value)):
            return False
    return True


def _label(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().rstrip(":").strip().lower()


def label_fits(actual: str, wanted: str, mode: str = "exact") -> bool:
    a, w = _label(actual), _label(wanted)
    return a == w if mode == "exact" else a.startswith(w) if mode == "prefix" else w in a


def table_value(scope: Node, label: str, mode: str = "exact") -> list[str]:
    """Values in the cell after a label cell of any table row."""
    out = []
    for row in select(scope, "tr"):
        cells = [c for c in row.children if c.tag in ("th", "td")]
        out += [b.content() for a, b in zip(cells, cells[1:], strict=False) if b.tag == "td" and label_fits(a.content(), label, mode)]
    return [x for x in out if x]


def definition_value(scope: Node, term: str, mode: str = "exact") -> list[str]:
    """Values of a definition list's term."""
    out = []
    for dl in select(scope, "dl"):
        kids = [c for c in dl.walk() if c.tag in ("dt", "dd")]
        out += [b.content() for a, b in zip(kids, kids[1:], strict=False) if a.tag == "dt" and b.tag == "dd" and label_fits(a.content(), term, mode)]
    return [x for x in out if x]


def html_records(pages: DataFrame, record: str, fields: dict[str, tuple], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ordinal, path, values MAP<STRING, ARRAY<STRING>>): one row for each element that ``record`` selects.

    A field is ("css", selector, attribute or None), ("table", label, mode) or ("dl", term, mode). Null and empty pages give no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, page in zip(f["k"], f["h"], strict=True):
                if not page:
                    continue
                for i, n in enumerate(select(parse(page), record)):
                    values = {}
                    for name, (kind, what, extra) in fields.items():
                        if kind == "css":
                            got = [(m.attrs.get(extra) or "").strip() if extra else m.content() for m in (select(n, what) if what else [n])]
                            values[name] = [x for x in got if x]
                        else:
                            values[name] = (table_value if kind == "table" else definition_value)(n, what, extra or "exact")
                    out.append((k, i, n.path(), values))
            yield pd.DataFrame(out, columns=["key", "ordinal", "path", "values"])

    kind = pages.schema[key].dataType.simpleString()
    got = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run,
        f"key {kind}, ordinal int, path string, values map<string,array<string>>")
    return got.withColumnRenamed("key", key)


def suggest_records(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 3) -> DataFrame:
    """(key, selector, count, score): groups of sibling elements of one tag and class that may be records, by count and likeness."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, page in zip(f["k"], f["h"], strict=True):
                groups: dict[str, list[Node]] = {}
                for n in parse(page or "").walk():
                    classes = "." + ".".join(sorted((n.attrs.get("class") or "").split())) if n.attrs.get("class") else ""
                    groups.setdefault(f"{n.parent.tag} > {n.tag}{classes}".removeprefix(" > "), []).append(n)
                for sel, nodes in groups.items():
                    if len(nodes) >= least:
                        shapes = [tuple(c.tag for c in n.children) for n in nodes]
                        same = max(shapes.count(s) for s in set(shapes)) / len(nodes)
                        leaves = sorted(sum(1 for _ in n.walk()) for n in nodes)[len(nodes) // 2]
                        out.append((k, sel, len(nodes), round(same * min(len(nodes), 50) * (1 + min(leaves, 10)), 4)))
            yield pd.DataFrame(out, columns=["key", "selector", "count", "score"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run,
        f"key {kind}, selector string, count long, score double").withColumnRenamed("key", key)


def label_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` exploded to lines with ``label`` and ``value`` where a line reads 'label: value' (also with dashes or =)."""
    lines = pages.select(*[c for c in pages.columns if c != text], F.posexplode(F.split(text, r"\r\n?|\n")).alias("line", "content"))
    p = r"^\s*([^:–—=-][^:–—=]*?)\s*(?::|\s[-–—=]\s|=)\s*(.+?)\s*$"
    hit = F.col("content").rlike(p)
    return lines.withColumns({"label": F.when(hit, F.regexp_extract("content", p, 1)), "value": F.when(hit, F.regexp_extract("content", p, 2))})


def line_matches(lines: DataFrame, pattern: str, group: int = 1, content: str = "content") -> DataFrame:
    """``lines`` with one row for each match of a pattern: ``match_index`` and ``matched``."""
    return lines.select("*", F.posexplode(F.regexp_extract_all(content, F.lit(pattern), F.lit(group))).alias("match_index", "matched"))


MAX_MEMBERS, MAX_MEMBER_BYTES, MAX_RATIO = 2000, 256 << 20, 200


def safe_member(name: str) -> bool:
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in re.split(r"[/\\]",
        name) and "\x00" not in name and not re.match(r"^[A-Za-z]:", name)


def zip_members(files: DataFrame, pattern: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, member, bytes, issue): members of zip files that match a glob. A file that isn't a zip, has too many members, an
    unsafe name, a member too large or too tightly packed, or a wrong checksum gives a row with an issue and no bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, data in zip(f["p"], f["c"], strict=True):
                try:
                    if data is None or bytes(data[:4]) != b"PK\x03\x04":
                        raise ValueError("NOT_A_ZIP")
                    z = zipfile.ZipFile(io.BytesIO(data))
                    infos = z.infolist()
                    if len(infos) > MAX_MEMBERS:
                        raise ValueError("TOO_MANY_MEMBERS")
                    for i in infos:
                        if not safe_member(i.filename):
                            raise ValueError("UNSAFE_NAME")
                        if i.file_size > MAX_MEMBER_BYTES or i.file_size > MAX_RATIO * max(1, i.compress_size):
                            raise ValueError("TOO_LARGE")
                    out += [(p, i.filename, z.read(i), None) for i in infos if not i.is_dir() and fnmatch.fnmatchcase(i.filename, pattern)]
                except (ValueError, zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                    out.append((p, None, None, str(e) if str(e).isupper() else "BROKEN_ZIP"))
            yield pd.DataFrame(out, columns=["path", "member", "bytes", "issue"])

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInPandas(run, "path string, member string, bytes binary, issue string")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of a site map."""
    got = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return got.select(F.trim("loc").alias("loc"), F.trim("lastmod").alias("lastmod")).where("loc is not null")


def plan_targets(urls: DataFrame, allowed: list[str], denied: list[str], since: str | None) -> DataFrame:
    """``urls`` with ``reason``: PLANNED, or why not: NOT_ALLOWED, ROBOTS, UNCHANGED. Prefixes are matched; the longest rule wins."""
    fits = lambda rules: F.array_max(F.array(F.lit(0), *[F.when(F.col("loc").startswith(r), len(r)) for r in rules]))
    reason = F.when(fits(allowed) == 0, "NOT_ALLOWED").when(fits(denied) >= fits(allowed), "ROBOTS")
    if since is not None:
        reason = reason.when(F.col("lastmod") <= since, "UNCHANGED")
    return urls.withColumn("reason", reason.otherwise("PLANNED"))


def robots_rules(lines: DataFrame, agent: str) -> DataFrame:
    """(allow BOOLEAN, pattern) of the group of a robots file that names the agent, else of the group for '*'.

    ``lines(line, value)``; one small file, so its order is a window over it."""
    from pyspark.sql import Window

    kv = lines.select("line", F.lower(F.trim(F.regexp_extract("value", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("k"),
        F.trim(F.regexp_replace(F.regexp_extract("value", r"^\s*[A-Za-z-]+\s*:(.*)$", 1), r"#.*$", "")).alias("v")).where("k <> ''")
    w = Window.partitionBy(F.lit(1)).orderBy("line")
    start = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    g = kv.withColumn("_s", start.cast("int")).withColumn("grp", F.sum("_s").over(w))
    agents = g.where("k = 'user-agent'").select("grp", F.lower("v").alias("a"))
    named, star = agents.where(F.col("a") == agent.lower()).select("grp"), agents.where("a = '*'").select("grp")
    pick = named if not named.isEmpty() else star
    return g.join(pick.distinct(), "grp", "left_semi").where("k in ('allow', 'disallow') and v <> ''").select((F.col("k") == "allow").alias("allow"),
        F.col("v").alias("pattern"))


def robots_pattern(pattern: str) -> str:
    """A robots pattern ('*' any run, '$' the end) as a regular expression."""
    body = "".join(".*" if c == "*" else re.escape(c) for c in pattern.rstrip("$"))
    return "^" + body + ("$" if pattern.endswith("$") else "")


def url_key(c: Column) -> Column:
    """A URL without scheme, www, query, fragment and closing slash, lower case: the key under which pages meet."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^https?://(www\.)?|[?#].*$", ""), "/+$", "")
