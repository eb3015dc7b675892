import random

import pytest

from factlattice.operators import history
from factlattice.operators.ledger import ledger

SCHEMA = "key string, id string, start bigint, recorded bigint"


def brute(rows):
    """Ledger rows by replaying what was known at each recorded time."""
    out = set()
    for key in {r[0] for r in rows}:
        mine = sorted((s, rec, i) for k, i, s, rec in rows if k == key)
        arrival = sorted(mine, key=lambda v: (v[1], v[0], v[2]))
        open_, known = {}, []
        for v in arrival:
            known = sorted([*known, v])
            for a, b in zip(known, [*known[1:], None], strict=True):
                now = (b[0], b[2]) if b else (None, None)
                if a[2] not in open_:
                    open_[a[2]] = (now, v[1])
                elif open_[a[2]][0] != now:
                    was, since = open_[a[2]]
                    out.add((key, a[2], a[0], *was, since, v[1], False))
                    open_[a[2]] = (now, v[1])
        for a in known:
            was, since = open_[a[2]]
            out.add((key, a[2], a[0], *was, since, None, True))
    return out


def result(df):
    return {(r.key, r.id, r.valid_from, r.valid_to, r.next_id, r.known_from, r.known_to, r.current) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 3, 8])
@pytest.mark.parametrize("order", ["random", "in order", "reversed"])
def test_against_replay_also_with_one_hot_key(spark, partitions, order):
    rng = random.Random(partitions)
    rows = []
    for i in range(160):
        key = "hot" if i % 2 else f"k{i % 7}"
        start = rng.randrange(60)
        rec = {"random": rng.randrange(1000), "in order": start * 1000 + i, "reversed": 100000 - start * 1000 - i}[order]
        rows.append((key, f"v{i:03d}", start, rec))
    got = ledger(spark.createDataFrame(rows, SCHEMA), partitions)
    assert result(got) == brute(rows)
    prev = {(r.key, r.id): r.prev_id for r in got.where("current").collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((s, rec, i) for k, i, s, rec in rows if k == key)
        for a, b in zip([None, *mine], mine, strict=False):
            assert prev[(key, b[2])] == (a[2] if a else None)


def test_late_version_splits_and_supersedes(spark):
    rows = [("k", "a", 1, 10), ("k", "c", 9, 20), ("k", "b", 5, 30)]
    got = {(r.id, r.valid_to, r.known_from, r.known_to) for r in ledger(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", None, 10, 20), ("a", 9, 20, 30), ("a", 5, 30, None), ("b", 9, 30, None), ("c", None, 20, None)}


def test_nulls_and_empty(spark):
    got = ledger(spark.createDataFrame([("k", "a", None, None), ("k", "b", 3, None)], SCHEMA)).where("current").collect()
    assert {(r.id, r.valid_to, r.prev_id) for r in got} == {("a", 3, None), ("b", None, "a")}
    assert ledger(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stored_periods(spark):
    schema = "id string, entity_id string, property string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, status string, supersedes_fact_id string, key string"
    from datetime import datetime as d

    a, b, c = d(2026, 1, 1), d(2026, 2, 1), d(2026, 3, 1)
    rows = [
        ("f1", "e", "p", a, b, a, "SUPERSEDED", None, "x"), ("f1", "e", "p", a, b, a, "SUPERSEDED", None, "x"),
        ("f2", "e", "p", b, None, b, "SUPERSEDED", "F1", "x"), ("f3", "e", "p", c, None, c, "ACTIVE", "f1", "x"),
        ("f4", "e", "p", b, None, b, "RETRACTED", None, "x"), ("g1", "e", "q", a, c, a, "ACTIVE", "zz", "x"),
        (None, "e", "q", a, c, a, "ACTIVE", None, "x"),
    ]
    got = {tuple(r) for r in history.period_errors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("f2", "valid_to"), ("f3", "supersedes_fact_id"), ("g1", "supersedes_fact_id")}
    assert history.fact_ledger(spark.createDataFrame(rows, schema)).where("current").count() == 4
