"""Every registered query of the subpackage on the smallest tables: against its SQL, or what must hold of its rows."""

import collections

import duckdb
import pytest
from conftest import DATA

import compare
from factlattice.llm import queries, tokens


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    assert compare.differs(queries.QUERIES[name](spark, DATA), compare.connect(DATA), queries.SQL[name]) == ""


def test_every_query_is_checked():
    assert set(queries.QUERIES) - set(queries.SQL) == {"p6_found", "p6_matches", "p7_truths", "p8_ids", "p9_packed", "p10_found", "p10_repaired"}


def test_each_row_has_at_most_one_live_entity(spark):
    m = rows(spark, "p6_matches")
    live = {r[0] for r in duckdb.sql(f"SELECT entity_id FROM '{DATA}/entities.parquet' WHERE coalesce(status, '') <> 'MERGED'").fetchall()}
    assert m and len({r.catalog_id for r in m}) == len(m) and {r.entity_id for r in m} <= live and all(0.6 <= r.confidence <= 1 for r in m)
    assert {(r.catalog_id, r.entity_id) for r in m} == {(r.catalog_id, r.entity_id) for r in rows(spark, "p6_found")}


def test_at_most_one_value_of_a_field_is_kept(spark):
    t = rows(spark, "p7_truths")
    kept, first = collections.Counter((r.entity_id, r.property) for r in t if r.kept), collections.Counter((r.entity_id,
        r.property) for r in t if r.first)
    assert t and set(kept.values()) == {1} and set(first) == {(r.entity_id,
        r.property) for r in t} and set(first.values()) == {1} and all(0 <= r.posterior <= 1 for r in t)


def test_ids_decode_to_the_text(spark):
    text = {r[0]: r[1] for r in table("documents").select("doc_id, text").fetchall()}
    t = tokens.Tokenizer(tokens.read_vocabulary())
    got = {r.doc_id: list(r.ids) for r in rows(spark, "p8_ids")}
    assert set(got) == set(text) and all(t.decode(ids) == (text[d] or "") for d, ids in got.items())


def test_containers_hold_every_token_and_no_more_than_they_can(spark):
    size = {r.doc_id: len(r.ids) for r in rows(spark, "p8_ids")}
    capacity = dict(table("packing_targets").select("target, capacity_tokens").fetchall())
    filled, whole, pieces = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows(spark, "p9_packed"):
        filled[(r.target, r.container)] += r.n_tokens
        whole[(r.target, r.doc_id)] += r.n_tokens
        pieces[(r.target, r.doc_id)] += 1
    assert all(n <= capacity[t] for (t, _), n in filled.items())
    assert whole == {(t, d): n for t in capacity for d, n in size.items()} and all(n == 1 or size[d] > capacity[t] for (t, d), n in pieces.items())


def test_damaged_texts_and_their_repairs(spark):
    text = {r[0]: r[1] for r in table("documents").select("doc_id, text").fetchall()}
    found, repaired = {r.doc_id for r in rows(spark, "p10_found")}, {r.doc_id: r for r in rows(spark, "p10_repaired")}
    assert found == set(repaired) and all(not text[d].isascii() for d in found) and all((r.text != text[d]) == (r.mapping is not None) for d,
        r in repaired.items())
