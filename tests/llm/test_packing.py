import random

import pytest

from factlattice.llm import packing


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if not s:
            out.append(0)
            rooms = rooms or [capacity]
            continue
        if fits:
            least = min(r for r, _ in fits)
            i = next(i for r, i in fits if r == least)
        else:
            rooms.append(capacity)
            i = len(rooms) - 1
        rooms[i] -= s
        out.append(i)
    return len(rooms), out


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_tightest_container(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(0, 101) for _ in range(500)), reverse=True)
    got = packing.best_fit_decreasing(sizes, 100)
    fill = {}
    for s, b in zip(sizes, got, strict=True):
        fill[b] = fill.get(b, 0) + s
    assert max(fill.values()) <= 100 and max(got) + 1 == plain_best_fit(sizes, 100)[0]


def run(spark, items, targets, shard):
    i = spark.createDataFrame([(*x, "clash") for x in items], "item bigint, size bigint, container string")
    return packing.pack(i, spark.createDataFrame(targets, "target string, capacity int"), shard).collect()


@pytest.mark.parametrize("shard", [50, 10_000])
def test_whole_result(spark, shard):
    rng = random.Random(3)
    items = [(i, rng.choice([0, 1, 5, 30, 64, 65, 100, 128, 700, rng.randrange(200)])) for i in range(400)] + [(900, None)]
    got = run(spark, items, [("a", 64), ("b", 256), ("c", None), (None, 5), ("d", 0)], shard)
    for target, capacity in (("a", 64), ("b", 256)):
        mine = [r for r in got if r.target == target]
        fill, per = {}, {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r["size"]
            per.setdefault(int(r.item), []).append(r["size"])
        assert max(fill.values()) <= capacity
        assert {k: sum(v) for k, v in per.items()} == {i: s for i, s in items if s is not None}
        assert all(len(v) == max(1, -(-s // capacity)) for (i, s) in items if s is not None for v in [per[i]])
        need = -(-sum(fill.values()) // capacity)
        assert len(fill) <= need * 1.03 + 3
    assert {r.target for r in got} == {"a", "b"}


def test_empty(spark):
    assert run(spark, [], [("a", 64)], 10) == [] and run(spark, [(1, 5)], [], 10) == []
