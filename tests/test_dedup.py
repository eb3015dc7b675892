import random
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factlattice.operators import dedup

SCHEMA = "delivery_id bigint, message_id string, delivered_at timestamp_ntz, id string, rows_served int, _kind string"
T0 = datetime(2026, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def test_copies_by_spelling_message_and_ties(spark):
    u = "1b4e28ba-2fa1-11d2-883f-0016d3cca427"
    rows = [
        (1, "m1", T0, u), (2, "m2", T0, u.upper()), (3, "m3", T0 - timedelta(1), "{" + u + "}"), (4, "m4", None, u.replace("-", "")),
        (5, "m1", T0, None), (6, "m1", T0, None), (7, None, T0, None), (8, None, T0, None), (9, "m9", T0, "not-hex"), (10, "m10", T0, "NOT-HEX "),
        (11, "", T0, ""),
    ]
    got = {r[0] for r in dedup.repeated_copies(frame(spark, rows)).collect()}
    assert got == {1, 2, 4, 6, 10}


def test_repeated_row_is_one_delivery_and_null_key_is_left_out(spark):
    rows = [(1, "m", T0, None), (1, "m", T0, None), (None, "m", T0, None), (2, "m", T0, None)]
    assert [r[0] for r in dedup.repeated_copies(frame(spark, rows)).collect()] == [2]


def test_any_bigint_and_any_time(spark):
    rows = [(-5, "m", T0, None), (-(2**63), "m", T0, None), (2**63 - 1, "m", T0, None), (7, "m", datetime(1, 1, 2), None),
        (8, "m", datetime(9999, 12, 31), None), (9, "m", None, None)]
    assert {r[0] for r in dedup.repeated_copies(frame(spark, rows)).collect()} == {-5, -(2**63), 2**63 - 1, 8, 9}
    assert {r[0] for r in dedup.repeated_copies(frame(spark, rows[:3])).collect()} == {-5, 2**63 - 1}


def test_empty(spark):
    assert dedup.repeated_copies(frame(spark, [])).count() == 0


def test_permutation_is_a_bijection_and_spreads(spark):
    ids = spark.range(20000).select(F.format_string("%032x", "id").alias("h"))
    left, right = dedup.permuted(F.col("h"))
    p = ids.select(left.alias("l"), right.alias("r"))
    assert p.distinct().count() == 20000
    shares = p.groupBy(F.shiftrightunsigned("l", 60).alias("q")).count().collect()
    assert len(shares) == 16 and max(r["count"] for r in shares) < 1500


def test_against_brute_force_with_a_hot_message(spark):
    rng = random.Random(3)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(300)]
    rows = [(i, f"q-{rng.randrange(40)}", T0 + timedelta(seconds=rng.randrange(50)),
        (ids[0] if i % 3 == 0 else rng.choice(ids)) if i % 11 else None) for i in range(3000)]
    best = {}
    for d, m, at, e in rows:
        k = ("e", e) if e else ("m", m)
        best[k] = min(best.get(k, (at, d)), (at, d))
    want = {d for d, m, at, e in rows} - {d for _, d in best.values()}
    assert {r[0] for r in dedup.repeated_copies(frame(spark, rows)).collect()} == want


def test_table_keeps_identifiers_over_batches_and_replays(spark, tmp_path):
    t = dedup.QuotientTable(str(tmp_path / "ids"), shards=4)
    a = frame(spark, [(1, "m1", T0, None), (2, "m1", T0, None), (3, "m2", T0, None)]).drop("_kind")
    b = frame(spark, [(4, "m2", T0, None), (5, "m3", T0, None), (6, None, T0, None)]).drop("_kind")
    for number, batch, want in ((0, a, {1, 3}), (1, b, {5, 6}), (1, b, {5, 6})):
        rows = t.fresh(batch, number)
        assert {r.delivery_id for r in rows.collect()} == want
        t.record(rows, number)
