import random
from datetime import date, datetime, timedelta

from factlattice.operators import trailing

SCHEMA = "tenant string, at timestamp_ntz, amount bigint, day string"


def brute(rows, windows):
    days = {}
    for t, at, x in rows:
        if t is not None and at is not None:
            days.setdefault(t, {}).setdefault(at.date(), []).append(x or 0)
    out = {}
    for t, d in days.items():
        first, last = min(d), max(d)
        for i in range((last - first).days + 1):
            day = first + timedelta(i)
            out[(t, day)] = tuple(sum(sum(d.get(day - timedelta(k), [])) for k in range(w) if day - timedelta(k) >= first) for w in windows)
    return out


def run(spark, rows, windows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = trailing.trailing_totals(df, "tenant", "at", "amount", windows).collect()
    return {(r.entity, r.day): tuple(r[f"sum_{w}"] for w in windows) for r in got}, got


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c"]), datetime(2026, 1, 1) + timedelta(days=rng.choice([0, 1, 2, 40, 41, 90, 95]), seconds=rng.randrange(86400)),
        rng.choice([None, 0, 5, 7, -2])) for _ in range(200)]
    rows += [(None, datetime(2026, 1, 1), 3), ("a", None, 9), ("d", datetime(2026, 5, 1), 4)]
    for windows in ((7, 30), (1, 2), (3,), (200,)):
        assert run(spark, rows, windows)[0] == brute(rows, windows)


def test_average_divides_by_the_days_there_are(spark):
    _, got = run(spark, [("a", datetime(2026, 1, 1), 6), ("a", datetime(2026, 1, 3), 3)], (2,))
    assert {r.day: r.avg_2 for r in got} == {date(2026, 1, 1): 6.0, date(2026, 1, 2): 3.0, date(2026, 1, 3): 1.5}


def test_empty(spark):
    assert run(spark, [], (7,))[0] == {}
