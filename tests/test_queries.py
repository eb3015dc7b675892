"""Every registered query of the core against its SQL, on the smallest tables; those without SQL against what must hold."""

import collections

import duckdb
import pytest
from conftest import DATA

import compare
from factlattice.functions import recalls
from factlattice.operators import quantities
from factlattice.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return compare.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, con, name):
    assert compare.differs(catalogue.QUERIES[name](spark, DATA), con, catalogue.SQL[name]) == ""


def test_every_query_is_checked():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"p1_found", "p1_values", "p4_history", "notice_records", "entity_search"}


def test_quantities_lie_where_true_ones_lie(spark):
    v = catalogue.QUERIES["p1_values"](spark, DATA).collect()
    found = {(r.record_table, r.record_id, r.field) for r in catalogue.QUERIES["p1_found"](spark, DATA).collect()}
    common = {q.name: q.common for q in quantities.QUANTITIES.values()}
    assert len(v) > 200 and all(r.common_unit == common[r.quantity] for r in v)
    plain = [r for r in v if r.recorded_unit == r.common_unit and (r.record_table, r.record_id, r.field) not in found]
    foreign = {(r.record_table, r.record_id, r.field) for r in v if r.recorded_unit is not None and r.recorded_unit != r.common_unit}
    assert foreign <= found and plain and all(0 <= r.posterior <= 1 for r in v if r.posterior is not None) and not any(r.uncertain for r in v if not r.by_size)
    ranged = [r for r in v if quantities.QUANTITIES[r.quantity].low is not None and r.by_size and r.common_value is not None]
    assert ranged and all(quantities.QUANTITIES[r.quantity].low * 0.999 <= r.common_value <= quantities.QUANTITIES[r.quantity].high * 1.001 for r in ranged)


def test_history_has_one_current_row_for_each_version(spark, con):
    rows = catalogue.QUERIES["p4_history"](spark, DATA)
    names = rows.columns
    ident = next(n for n in names if n in ("id", "fact_id"))
    current = collections.Counter(r[ident] for r in rows.where("current").collect())
    want = {r[0] for r in con.sql("SELECT DISTINCT id FROM facts WHERE status IN ('ACTIVE', 'SUPERSEDED')").fetchall()}
    assert set(current) == want and set(current.values()) == {1}
    periods = {r[ident]: r.valid_to for r in rows.where("current").collect()}
    sql = "SELECT id, lead(valid_from) OVER (PARTITION BY entity_id, property ORDER BY valid_from, recorded_at, id) FROM (SELECT DISTINCT id, entity_id, property, valid_from, recorded_at FROM facts WHERE status IN ('ACTIVE', 'SUPERSEDED')) x"
    assert periods == dict(con.sql(sql).fetchall())


def test_notice_records_of_every_text(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in catalogue.QUERIES["notice_records"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        words = " " + " ".join("".join(c if c.isalnum() else " " for c in (docs[i] or "").lower()).split()) + " "
        want = [n for n, terms in recalls.HAZARDS.items() if any((f" {t[:-1]}" if t[-1] == "*" else f" {t} ") in words for t in terms)]
        assert r.hazards == want, (i, words)


def test_search_puts_exact_names_first(spark):
    rows = catalogue.QUERIES["entity_search"](spark, DATA).collect()
    assert len({r.entity_id for r in rows}) == len(rows) and all(0 < r.score <= 1 and r.tier in (0, 1, 2) for r in rows)
    assert all("corvanth" in r.canonical_name.lower() for r in rows if r.tier == 1)
