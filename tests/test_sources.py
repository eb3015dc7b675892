import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from factlattice.sources import documents, tabular
from factlattice.streaming import usage


def test_csv_with_preamble_filter_and_ordinals(spark, tmp_path):
    (tmp_path / "a.csv").write_text('# note\n# more\nRef, Model ,Kind\n1,"24ACC6, x",a\n\n2, 24ACC6 ,b\n# 3,kept,b\n')
    df = tabular.read_csv(spark, str(tmp_path / "a.csv"), preamble="^#", where=("Kind", ["b"]))
    assert [tuple(r) for r in df.select("ordinal", "Ref", "Model").orderBy("ordinal").collect()] == [(2, "2", "24ACC6"), (3, "# 3", "kept")]
    with pytest.raises(ValueError):
        tabular.read_csv(spark, str(tmp_path / "a.csv"), preamble="^#", where=("Nope", ["b"]))


def test_json_pointer_and_paths(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"feed": {"a/b": [{"x": 1, "tags": ["p", "q"]}, {"x": 2}]}}))
    r = tabular.read_json_records(spark, str(tmp_path / "a.json"), "/feed/a~1b", "struct<x:int>").collect()
    assert [(x.ordinal, x.record.x) for x in r] == [(0, 1), (1, 2)]
    doc = spark.createDataFrame([('{"p": [{"n": "a"}, {"n": "b"}, {}]}',)], "v string")
    assert doc.select(tabular.json_values(F.col("v"), ["p", "*", "n"]).alias("r")).first().r == ["a", "b"]
    assert doc.select(tabular.pick(F.array(F.lit("a"), F.lit("b")), "single"),
        tabular.pick(F.array(F.lit("a"), F.lit("b")), "join")).first()[:] == (None, "a, b")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", 2.5), (2, 'a"b,c', None), (3, "", -1.5), (4, None, 0.0)], "k int, t string, x double")
    assert [r.line for r in tabular.csv_lines(df, ["k"]).collect()] == ["1,'=1+1,2.5", '2,"a""b,c",', '3,"",-1.5', "4,,0.0"]
    assert json.loads(tabular.jsonl_lines(df).where("line like '%\"k\":2%'").first().line) == {"k": 2, "t": 'a"b,c', "x": None}
    got = tabular.write_export(df, str(tmp_path / "out"), ["k"])
    again = tabular.write_export(df.repartition(3), str(tmp_path / "out2"), ["k"])
    assert got == again and got["csv"]["records"] == 4
    with pytest.raises(Exception, match="finite"):
        tabular.jsonl_lines(spark.createDataFrame([(float("nan"),)], "x double")).collect()
    loc = spark.range(1).select(tabular.locator(row=F.lit(3), column=F.lit("a=b;c%"), gone=F.lit(None)).alias("l"))
    assert loc.first().l == "row=3;column=a%3Db%3Bc%25" and loc.select(tabular.parse_locator(F.col("l")).alias("m")).first().m == {"row": "3",
        "column": "a=b;c%"}


PAGE = """<html><body><nav><a href="/x">x</a></nav><article class="card" data-item="7"><h2 class="t">One</h2><dl><dt>Brand:</dt><dd>Acme</dd><dt>Item #</dt><dd>24-a</dd></dl></article>
<article class="card" data-item="8"><h2 class="t">Two &amp; more</h2><table><tr><th>Weight</th><td>5 lb</td></tr></table></article><article
class="card"><h2>Three</h2></article></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id bigint, html string")
    fields = {"title": ("css", "h2.t", None), "item": ("css", None, "data-item"), "brand": ("dl", "brand", "exact"),
        "weight": ("table", "weight", "prefix")}
    r = documents.html_records(pages, "article.card", fields).orderBy("ordinal").collect()
    assert [x["values"]["title"] for x in r] == [["One"], ["Two & more"], []]
    assert r[0]["values"]["brand"] == ["Acme"] and r[1]["values"]["weight"] == ["5 lb"] and r[0]["values"]["item"] == ["7"]
    node = documents.select(documents.parse(PAGE), r[1].path)
    assert documents.suggest_records(pages).orderBy(F.desc("score")).first().selector == "body > article.card" and node is not None


def test_lines_zip_robots_and_targets(spark):
    lines = documents.label_lines(spark.createDataFrame([(1, "Model: 24ACC6\nno label\nWeight - 5 lb")], "page int, text string"))
    assert [(r.label, r.value) for r in lines.where("label is not null").orderBy("line").collect()] == [("Model", "24ACC6"), ("Weight", "5 lb")]
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("d/a.csv", "x")
        z.writestr("b.txt", "y")
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../a.csv", "x")
    files = spark.createDataFrame([("ok", b.getvalue()), ("evil", evil.getvalue()), ("text", b"hello"), ("null", None)],
        "path string, content binary")
    got = {(r.path, r.member, r.issue) for r in documents.zip_members(files, "*.csv").collect()}
    assert got == {("ok", "d/a.csv", None), ("evil", None, "UNSAFE_NAME"), ("text", None, "NOT_A_ZIP"), ("null", None, "NOT_A_ZIP")}
    robots = spark.createDataFrame(list(enumerate(["User-agent: *", "Disallow: /", "User-agent: Bot", "User-agent: Other", "Allow: /a # x",
        "Disallow: /b*$"])), "line int, value string")
    assert {tuple(r) for r in documents.robots_rules(robots, "bot").collect()} == {(True, "/a"), (False, "/b*$")}
    assert documents.robots_pattern("/b*$") == "^/b.*$"
    urls = spark.createDataFrame([("https://a/x", "2026-01-02"), ("https://a/x/no", "2026-01-02"), ("https://b", "2026-01-02"),
        ("https://a/y", "2025-01-01")], "loc string, lastmod string")
    plan = documents.plan_targets(urls, ["https://a"], ["https://a/x/no"], "2025-06-01")
    assert [r.reason for r in plan.collect()] == ["PLANNED", "ROBOTS", "NOT_ALLOWED", "UNCHANGED"]


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a/x </loc><lastmod>2026-01-02</lastmod></url><url><loc>https://a/y</loc></url></urlset>")
    assert {tuple(r) for r in documents.read_sitemap(spark, str(tmp_path / "s.xml")).collect()} == {("https://a/x", "2026-01-02"),
        ("https://a/y", None)}


def message(i, **extra):
    e = {"id": f"1b4e28ba-2fa1-11d2-883f-0016d3cca4{i:02x}", "tenant_id": "t", "api_key_id": "k", "vertical_id": "v",
        "occurred_at": "2026-01-02T03:04:05Z", "route_key": "r", "method": "GET", "status": 200, "rows_served": i, "duration_ms": 1}
    return json.dumps(e | extra)


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    first = [message(1), message(1).upper().replace("\"ID\"", '"id"'), message(2), "not json", message(3, surprise=1),
        message(4, schema_version=2, access_tier="a", billing_source="b")]
    (src / "1.txt").write_text("\n".join(first))
    stream = lambda: spark.readStream.schema("body string").text(str(src)).withColumnRenamed("value",
        "body") if False else spark.readStream.text(str(src)).withColumnRenamed("value", "body")
    args = (str(tmp_path / "t"), str(tmp_path / "q"), str(tmp_path / "c"))
    usage.run_once(stream(), *args).awaitTermination()
    (src / "2.txt").write_text("\n".join([message(2), message(5)]))
    usage.run_once(stream(), *args).awaitTermination()
    usage.run_once(stream(), *args).awaitTermination()
    got = spark.read.parquet(args[0])
    assert sorted(r.rows_served for r in got.collect()) == [1, 2, 4, 5]
    assert spark.read.parquet(args[1]).count() == 3
    assert usage.monthly(got).first()[:] == ("t", "2026-01", 4, 12)


def test_rates_and_transitions(spark):
    r = spark.sql("select 's' source, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,x) at, x % 2 = 0 up from values 0, 10, 61, 62 t(x)")
    got = usage.rate_gaps(r).orderBy("at").collect()
    assert [(x.in_window, x.gap_s) for x in got] == [(1, None), (2, 10.0), (2, 51.0), (3, 1.0)]
    assert [x.generation for x in usage.transitions(r, "source", "at", "up").orderBy("at").collect()] == [1, 1, 1, 2]


def test_csv_ordinals_follow_the_file_in_any_number_of_splits(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.csv").write_text("a,b\n" + "".join(f"{n * 50 + i},x{i}\n" for i in range(50)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    try:
        got = [(int(r.a), r.ordinal) for r in tabular.read_csv(spark, str(tmp_path), line_breaks=False).collect()]
        kept = [(int(r.a), r.ordinal) for r in tabular.read_csv(spark, str(tmp_path), line_breaks=False, where=("b", ["x7"])).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(o for _, o in got) == list(range(1, 151))
    by_file = {}
    for a, o in sorted(got, key=lambda x: x[1]):
        by_file.setdefault(a // 50, []).append(a)
    assert all(v == sorted(v) for v in by_file.values()) and set(kept) <= set(got) and len(kept) == 3
