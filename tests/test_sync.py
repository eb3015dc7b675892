import datetime

import pytest
from pyspark.sql import functions as F

from factlattice.functions import canonical
from factlattice.operators import search, sync


def test_windows_move_and_wrap():
    assert sync.rolling_windows("2026-06-30", None, "2026-01-01") == [("recent", "2026-05-16", "2026-06-30"), ("history", "2026-01-01", "2026-04-30")]
    assert sync.rolling_windows("2026-06-30", "2026-05-01", "2026-01-01")[1] == ("history", "2026-05-01", "2026-05-16")
    assert sync.rolling_windows("2026-06-30", "2026-05-20", "2026-01-01")[1] == ("history", "2026-01-01", "2026-04-30")
    assert sync.year_windows(1980, 1993, [(1980, 1989), (1990, 1991)]) == [("1980-01-01", "1989-12-31"), ("1990-01-01", "1991-12-31"),
        ("1992-01-01", "1992-12-31"), ("1993-01-01", "1993-12-31")]


def test_settled_and_guarded(spark):
    t = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, t + datetime.timedelta(seconds=i)) for i in range(10)] + [(99, None)], "id int, at timestamp_ntz")
    assert sorted(r.id for r in sync.settled(df, "at", "2026-01-01 00:00:02", "2026-01-01 00:00:08", 3).collect()) == [3, 4, 5]
    assert sync.guarded(df, 11).count() == 11
    with pytest.raises(ValueError):
        sync.guarded(df, 12)
    assert {r.window for r in sync.in_windows(df, F.col("at"), [("a", "2026-01-01", "2026-01-01")]).collect()} == {"a"}


def test_affected_levels_and_cycles(spark):
    d = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), (None, "a"), ("q", None)],
        "derived string, input string")
    assert {r.node for r in sync.affected(d, spark.createDataFrame([("b",), (None,)], "node string")).collect()} == {"b", "c", "d"}
    assert {r.node for r in sync.affected(d, spark.createDataFrame([("x",)], "node string")).collect()} == {"x", "y"}
    assert sync.affected(d, spark.createDataFrame([], "node string")).count() == 0
    good = d.where("derived in ('b', 'c', 'd')")
    assert {(r.node, r.level) for r in sync.levels(good).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    with pytest.raises(ValueError, match="cycle"):
        sync.levels(d)
    new = spark.createDataFrame([("a", "d"), ("d", "a"), ("z", "z"), ("z", "a")], "derived string, input string")
    assert {(r.derived, r.input, r.refused) for r in sync.closes_cycle(good, new).collect()} == {("a", "d", True), ("d", "a", False),
        ("z", "z", True), ("z", "a", False)}
    long = spark.createDataFrame([(i + 1, i) for i in range(40)], "derived int, input int")
    assert sync.affected(long, spark.createDataFrame([(0,)], "node int")).count() == 41


def test_merge_and_insert(spark):
    e = spark.createDataFrame([("a", "ACTIVE"), ("b", "ACTIVE"), ("c", None)], "entity_id string, status string")
    r = spark.createDataFrame([("a", "c", True, None)], "from_entity_id string, to_entity_id string, active boolean, created_at timestamp_ntz")
    m = spark.createDataFrame([("a", "b"), ("a", "b"), (None, "b")], "loser string, survivor string")
    ents, reds = sync.merge_entities(e, r, m, "2026-01-01 00:00:00")
    assert {(x.entity_id, x.status) for x in ents.collect()} == {("a", "MERGED"), ("b", "ACTIVE"), ("c", None)}
    assert {(x.from_entity_id, x.to_entity_id, x.active) for x in reds.collect()} == {("a", "c", False), ("a", "b", True)}
    with pytest.raises(ValueError):
        sync.merge_entities(e, r, spark.createDataFrame([("a", "b"), ("b", "c")], "loser string, survivor string"), "2026-01-01 00:00:00")
    rows = spark.createDataFrame([(None, 1), (None, 1), ("k", 2), ("k", 1), ("s", 9)], "k string, v int")
    got = sync.insert_new(spark.createDataFrame([("s",)], "k string"), rows, ["k"]).collect()
    assert sorted((x.k or "", x.v) for x in got) == [("", 1), ("k", 1)]
    assert sync.insert_new(spark.createDataFrame([(None,)], "k string"), rows, ["k"]).count() == 2


def test_canonical_values(spark):
    cases = [('{"b":1,"a":[1,2]}', '{"a":[1,2],"b":1}', True), ("[1,2]", "[2,1]", False), ("1.0", "1", True), ('"a"', '"A"', False),
        (None, None, True), (None, "null", False), ("{}", "[]", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert [r.s for r in df.select(canonical.same_value(F.col("a"), F.col("b")).alias("s")).collect()] == [s for *_, s in cases]
    u = spark.createDataFrame([("x", "y"), ("xy", ""), ("x", None)],
        "a string, b string").select(canonical.derived_uuid(F.col("a"), F.col("b")).alias("u")).collect()
    assert u[2].u is None and u[0].u != u[1].u and u[0].u[14] == "5" and u[0].u[19] in "89ab" and len(u[0].u) == 36


def test_search_filters(spark):
    base = spark.createDataFrame([(1, "2026-01-01", "Acme heater", True), (2, "2026-01-02", "acme lamp", False), (3, None, None, None)],
        "id int, at string, title string, everywhere boolean")
    keys = spark.createDataFrame([("state", "TX", 2), ("state", "TX", 2), ("state", "CA", 1), ("hazard", "fire", 1), ("hazard", "fire", 2),
        ("state", None, 3)], "kind string, value string, id int")
    ids = lambda f: sorted(r.id for r in search.matching(base, keys, f).collect())
    assert ids(search.Filters()) == [1, 2, 3] and ids(search.Filters(keys={"state": ["TX"]})) == [2] and ids(search.Filters(keys={"state": ["TX"]},
        instead={"state": F.col("everywhere")})) == [1, 2]
    assert ids(search.Filters(keys={"state": ["TX", "CA"], "hazard": ["fire"]},
        like={"title": "LAMP"})) == [2] and ids(search.Filters(between={"at": ("2026-01-02",
        None)})) == [2] and ids(search.Filters(keys={"none": ["x"]})) == []
    index = search.inverted_index(base, "id", {"title": (F.coalesce("title", F.lit("")), 1.0)})
    assert {r.id for r in search.ranked(index, ["ACME", "lamp"]).collect()} == {2} and search.ranked(index, ["absent"]).count() == 0
    tiers = search.tiered(spark.createDataFrame([(2,), (2,)], "id int"), search.ranked(index, ["acme"]))
    assert {(r.id, r.tier) for r in tiers.collect()} == {(2, 0), (1, 1)} and search.total(tiers).first().total == 2


def test_url_filters():
    got = search.parse_filters("a=1&filter.x=1,2&filter.x=3&filter.y.min=1.5&filter.y.max=2&filter.z.exists=false")
    assert got == {"x": {"in": ["1", "2", "3"]}, "y": {"min": 1.5, "max": 2.0}, "z": {"exists": False}} and search.parse_filters("") == {}
    for bad in ("filter.x.most=1", "filter.=1", "filter.x.min=a", "filter.x.min=3&filter.x.max=2", "filter.x.exists=yes",
        "&".join(f"filter.f{i}=1" for i in range(11))):
        with pytest.raises(ValueError):
            search.parse_filters(bad)


def test_revisions_and_immutable_columns(spark):
    stored = spark.createDataFrame([("a", "x", 3), ("b", None, 1), ("c", "z", 2)], "k string, d string, revision int")
    incoming = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y"), ("n", None), (None, "q")], "k string, d string")
    assert {tuple(r) for r in sync.reconcile(stored, incoming, "k", "d").collect()} == {("a", 3, "UNCHANGED"), ("b", 2, "REVISED"),
        ("n", 1, "CREATED")}
    patch = spark.createDataFrame([("a", None), ("b", "y"), ("c", "z"), ("q", "w")], "k string, d string")
    assert {tuple(r) for r in sync.immutable_violations(stored, patch, "k", ["d"]).collect()} == {("b", "d")}
    lists = spark.createDataFrame([([1, 2, 3],), ([1],), (None,)], "x array<int>").select(search.bounded(F.col("x"), 2).alias("b")).collect()
    assert [(r.b["items"], r.b.truncated) for r in lists] == [([1, 2], True), ([1], False), ([], False)]


def test_what_typed_codes_may_mean(spark):
    from factlattice.functions import identifiers

    cases = [("0 36000 29145 2", ["00036000291452"]), ("04252614 and 036000291452", ["00036000291452", "00042100005264"]), ("none", []), (None, [])]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string").select(identifiers.gtin_candidates(F.col("c")).alias("g"),
        identifiers.rejection(F.col("c")).alias("r"))
    assert [list(r.g or []) for r in df.collect()] == [g for _, g in cases] and [r.r for r in df.collect()][2:] == ["NO_DIGIT", "EMPTY"]
