import random

from pyspark.sql import functions as F

from factlattice.llm import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def run(spark, edges):
    df = spark.createDataFrame(edges, "u string, v string").withColumn("component", F.lit("clash"))
    return {r.node: r.component for r in components.connected(df).collect()}


def test_chain_star_cycle_self_repeated_and_null(spark):
    edges = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("s0", f"s{i}") for i in range(1, 30)] + [("x", "y"), ("y", "z"), ("z", "x"),
        ("x", "y"), ("l", "l"), (None, "n"), ("n", None)]
    assert run(spark, edges) == brute(edges)


def test_random_graph(spark):
    rng = random.Random(7)
    edges = [(f"{rng.randrange(400):03d}", f"{rng.randrange(400):03d}") for _ in range(330)]
    assert run(spark, edges) == brute(edges)


def test_salted_hubs_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_DEGREE", 20)
    rng = random.Random(9)
    edges = [("hub", f"n{i:03d}") for i in range(200)] + [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(50)]
    assert run(spark, edges) == brute(edges)


def test_empty_and_redirects(spark):
    assert run(spark, []) == {}
    u, w = "1b4e28ba-2fa1-11d2-883f-0016d3cca427", "0b4e28ba-2fa1-11d2-883f-0016d3cca427"
    rows = [(u.upper(), "{" + w + "}", True), (u, None, True), (w, "  ", True), (w, u, False), (None, w, True), (w, u, None)]
    got = components.redirect_edges(spark.createDataFrame(rows, "from_entity_id string, to_entity_id string, active boolean")).collect()
    assert [tuple(r) for r in got] == [(u, w)]
