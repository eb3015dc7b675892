import random

import pytest

from pyspark.sql import functions as F

from factlattice.operators import graph, ordering, relational, resolve, selection, versions


def test_running_is_global(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(100)) for i in range(500)]
    rng.shuffle(rows)
    got = {r.k: (r["rank"], r["offset"]) for r in ordering.running(spark.createDataFrame(rows, "k int, n int").repartition(7), ["k"], "n").collect()}
    total, want = 0, {}
    for i, (k, n) in enumerate(sorted(rows)):
        want[k] = (i, total)
        total += n
    assert got == want
    assert ordering.running(spark.createDataFrame([], "k int, n int"), ["k"], "n").count() == 0


def test_pages(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 3)
    order = [F.desc("g"), F.col("id")]
    seen, cond = [], F.lit(True)
    while True:
        page, more = ordering.has_more(df.where(cond), order, 3)
        rows = page.collect()
        seen += [r.id for r in rows]
        if not more.first().has_more:
            break
        cond = ordering.after([("g", rows[-1].g, True), ("id", rows[-1].id, False)])
    assert seen == [r.id for r in df.orderBy(*order).collect()]


def test_cascade_steps(spark):
    from datetime import datetime as d

    t, u = d(2026, 1, 1), d(2026, 1, 2)
    rows = [
        ("a", "p", "c1", "s1", "x", 5, 0.1, t, True), ("b", "p", "c2", "s1", "x", 5, 0.1, t, True), ("b", "p", "c3", "s2", "y", 9, 0.1, t, True),
        ("b", "p", "c4", "s2", "z", 99, 0.1, t, False),
        ("c", "p", "c5", "s1", "x", 5, 0.1, t, True), ("c", "p", "c6", "s2", "x", 5, 0.9, t, True), ("d", "p", "c7", "s1", "x", 5, 0.1, t, True),
        ("d", "p", "c8", "s2", "y", 5, 0.1, u, True),
        ("e", "p", "c9", "s1", "x", 5, 0.1, t, True), ("e", "p", "c10", "s2", "x", 5, 0.1, t, True), ("e", "p", "c11", "s1", "y", 5, 0.1, t, True),
        ("f", "p", "c12", "s1", "bad", 5, None, None, True), ("f", "p", "c13", "s2", "good", 5, None, None, True),
    ]
    df = spark.createDataFrame(rows,
        "entity string, property string, claim string, source string, value string, authority int, reliability double, observed timestamp_ntz, eligible boolean")
    got = {r.entity: (r.claim, r.rule, r.candidates, r.conflicts) for r in selection.cascade(df.repartition(3), F.col("value") != "bad").collect()}
    assert got == {"a": ("c1", "SOLE_ELIGIBLE_CANDIDATE", 1, 0), "b": ("c3", "AUTHORITY", 2, 1), "c": ("c6", "RELIABILITY", 2, 0),
        "d": ("c8", "RECENCY", 2, 1), "e": ("c10", "TIEBREAK", 3, 1), "f": ("c13", "CONSISTENCY", 2, 1)}


def test_chains_with_cycles_and_long_ones(spark):
    rows = [(f"n{i}", f"n{i + 1}") for i in range(100)] + [("x", "y"), ("y", "x"), ("w", "x")]
    got = {r.src: (r.target, r.hops, r.cycle) for r in graph.resolve_chains(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got["n0"] == ("n100", 100, False) and got["n99"] == ("n100", 1, False) and got["w"] == (None, None, True) and got["x"][2]


def test_lineage_bottom_up_and_walk(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "z")], "derived string, input string")
    got = {tuple(r) for r in graph.lineage(d, spark.createDataFrame([("d",)], "root string")).collect()}
    assert got == {("d", "c", 1), ("d", "a", 2), ("d", "b", 3)}
    d2 = spark.createDataFrame([("a", "x"), ("a", "b"), ("b", "y"), ("c", "q")], "derived string, input string")
    assert {r.node for r in graph.bottom_up(d2, spark.createDataFrame([("x",), ("y",)], "node string")).collect()} == {"x", "y", "a", "b"}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("b",)], "node string")
    assert {(r.node, r.hops) for r in graph.bfs(e, s, 2, "out").collect()} == {("b", 0), ("c", 1), ("d", 2)}
    assert {(r.node, r.hops) for r in graph.bfs(e, s, 1, "both").collect()} == {("b", 0), ("c", 1), ("a", 1)}


def test_joins_and_versions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "q")], "id int, code string")
    t = spark.createDataFrame([("x", "x", 1), ("y", "x", 2), ("q", "r", 3)], "name string, display string, n int")
    assert {(r.id, r.n) for r in relational.either(a, t, "code", ["name", "display"]).collect()} == {(1, 1), (1, 2), (2, 3)}
    v = spark.createDataFrame([("k", 1, "open"), ("j", 2, "open")], "k string, valid_to int, status string").withColumn("valid_to",
        F.lit(None).cast("timestamp"))
    r = {x.k: (x.status, x.valid_to is None) for x in versions.retract(v, spark.createDataFrame([("k",)], "k string"), ["k"], "2026-01-01").collect()}
    assert r == {"k": ("RETRACTED", False), "j": ("open", True)}
    items = spark.createDataFrame([("i1", "A"), ("i2", "B"), ("i3", "C"), ("i4", None)], "item string, candidate string")
    keys = spark.createDataFrame([("model", "A", "e1"), ("model", "B", "e1"), ("upc", "B", "e2")], "kind string, value string, entity_id string")
    assert {x.item: x.outcome for x in resolve.screen(items, keys).collect()} == {"i1": "MATCHED", "i2": "AMBIGUOUS", "i3": "NOT_FOUND",
        "i4": "NO_CODE"}
    blocks = spark.createDataFrame([(i, ["big" if i < 9 else "s"]) for i in range(11)], "id int, keys array<string>")
    with pytest.raises(Exception, match="above the limit"):
        relational.blocking_pairs(blocks, F.col("keys"), max_block=5).count()
    assert relational.blocking_pairs(blocks, F.col("keys"), max_block=9).count() == 37 and relational.oversized_blocks(blocks, F.col("keys"),
        5).first()[:] == ("big", 9)
    both = relational.compare(spark.createDataFrame([("e", "p", "1"), ("f", "p", "1"), ("e", "q", "2")],
        "entity_id string, property string, v string"), ["e", "f"], F.col("v"))
    assert {(x.property, x.differs) for x in both.collect()} == {("p", False), ("q", True)}


def test_long_lineage_is_followed_to_its_end(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(70)], "derived int, input int")
    got = {tuple(r) for r in graph.lineage(d, spark.createDataFrame([(0,)], "root int")).collect()}
    assert got == {(0, i, i) for i in range(1, 71)}
    with pytest.raises(ValueError):
        graph.lineage(d, spark.createDataFrame([(0,)], "root int"), max_depth=3)
    assert graph.bottom_up(d, spark.createDataFrame([(70,)], "node int")).count() == 71
    with pytest.raises(ValueError):
        graph.bottom_up(d, spark.createDataFrame([(70,)], "node int"), max_rounds=3)


def test_large_blocks_are_salted(spark, monkeypatch):
    monkeypatch.setattr(relational, "SALT_ABOVE", 7)
    blocks = spark.createDataFrame([(i, ["hot"] if i < 30 else ["hot", "s"] if i < 33 else []) for i in range(35)], "id int, keys array<string>")
    got = relational.blocking_pairs(blocks, F.col("keys")).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for a in range(33) for b in range(a + 1, 33)} and len(got) == 33 * 32 // 2


def test_either_keeps_repeated_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "id int, code string")
    t = spark.createDataFrame([("x", "x", 1), (None, "x", 2)], "name string, display string, n int")
    assert sorted((r.id, r.n) for r in relational.either(a, t, "code", ["name", "display"]).collect()) == [(1, 1), (1, 1), (1, 2), (1, 2)]


def test_a_chain_of_a_hundred_thousand_links(spark):
    links = spark.range(100_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(None, 5),
        (7_000_000, None)], "src bigint, dst bigint"))
    r = graph.resolve_chains(links).where("src in (0, 99999)").collect()
    assert {(x.src, x.target, x.hops) for x in r} == {(0, 100_000, 100_000), (99_999, 100_000, 1)}


def test_facets_without_one_task_for_a_property(spark):
    f = spark.createDataFrame([("p", str(i % 5), f"e{i}") for i in range(17)] + [("q", "x", "e1")], "property string, value string, entity_id string")
    got = {(r.property, r.value): (r.entities, r.low, r.high, r.property_entities) for r in relational.facet_counts(f, F.col("value"), 2).collect()}
    assert got == {("p", "0"): (4, 0.0, 4.0, 17), ("p", "1"): (4, 0.0, 4.0, 17), ("q", "x"): (1, None, None, 1)}
